"""URLs out of what agents have written down: documents and pages in the order of their first visit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.functions import urls

# Fixed value: a URL in running text.
URL = "(?i)https?://[^\\s\"'<>)\\]]+"


def visited(steps: DataFrame, trace: str, step: str, text: str, domain: str) -> DataFrame:
    """(trace, kind, nth, url): the different document URLs of a trace, and its pages of its own domain, each numbered from 1 by first visit.

    ``steps`` has the texts of a trace by ascending ``step``, and its domain. A page is taken without full stops, commas and semicolons at its end; a
    document as it stands. Repeated steps don't matter; null texts have no URLs. Only different URLs of a trace come together, a row each.
    """
    each = steps.select(F.col(trace).alias("trace"), F.col(step).alias("_step"), F.col(domain).alias("_domain"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(URL), 0)).alias("_at", "_url"))
    bare = F.regexp_replace("_url", "[.,;]+$", "")
    kinds = F.when(urls.downloadish(F.col("_url")), F.struct(F.lit("document").alias("kind"), F.col("_url").alias("url")))
    page = F.when((F.regexp_extract(bare, "(?i)^https?://([^/?#]*)", 1) == F.col("_domain")) & ~urls.downloadish(bare), F.struct(F.lit("page").alias("kind"), bare.alias("url")))
    found = each.select("trace", "_step", "_at", F.explode(F.array_compact(F.array(kinds, page))).alias("_f")).select("trace", "_step", "_at", "_f.*")
    firsts = found.groupBy("trace", "kind", "url").agg(F.min(F.struct("_step", "_at")).alias("_first"))
    return firsts.select("trace", "kind", F.row_number().over(W.partitionBy("trace", "kind").orderBy("_first")).alias("nth"), "url")
