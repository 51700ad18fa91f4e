"""Publication lists, metrics, benchmark grids and stored files of a job platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions import urls

#: Models that a benchmark grid may have; its URLs may be any number.
MODELS = 1000


def _state() -> Column:
    return F.upper(F.trim(F.coalesce("state", F.lit(""))))


def publications(rows: DataFrame, failed_only: bool = False) -> DataFrame:
    """Rows with a URL, trimmed; with ``failed_only`` those whose state is FAILED in any case."""
    named = rows.withColumn("url", F.trim("url")).filter("url <> ''")
    return named.filter(_state() == "FAILED") if failed_only else named


def supported(rows: DataFrame) -> DataFrame:
    """(id, url) of publications whose state isn't UNSUPPORTED."""
    return publications(rows).filter(_state() != "UNSUPPORTED").select("id", "url")


def diverse(rows: DataFrame, count: int) -> DataFrame:
    """The first supported URL of each host by id, of the first ``count`` hosts; a URL without a host is left out."""
    hosted = supported(rows).withColumn("_host", urls.part(F.col("url"), 2)).filter("_host <> ''")
    firsts = hosted.groupBy("_host").agg(F.min(F.struct("id", "url")).alias("_first")).select("_first.*")
    return firsts.orderBy("id").limit(count)


def metrics_snapshot(events: DataFrame, name: str, labels: list[str], units: str, per_second: int) -> DataFrame:
    """(key, count, total_s, avg_s) by name and labels, as ``name{label=value,...}`` with labels by name; seconds with four digits.

    ``units`` are whole parts of a second, so that sums don't hang on their order.
    """
    said = F.array_join(F.array(*[F.concat(F.lit(f"{x}="), F.coalesce(F.col(x).cast("string"), F.lit(""))) for x in sorted(labels)]), ",")
    key = F.concat(F.col(name), F.lit("{"), said, F.lit("}")) if labels else F.col(name)
    summed = events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(units), F.lit(0)).alias("_units"))
    return summed.select("key", "count", F.round(F.col("_units") / per_second, 4).alias("total_s"), F.round(F.col("_units") / per_second / F.col("count"), 4).alias("avg_s"))


def benchmark_grid(models: DataFrame, targets: DataFrame, runs: DataFrame, timeout_units: int) -> DataFrame:
    """(model, url, success, downloaded, iterations, notes): a row for every model and URL.

    The first run by id counts. One that took longer than the limit is a failure without documents, and so is one that isn't there; their notes say so.
    Models are broadcast, which are at most MODELS, else this is an error; URLs aren't.
    """
    named = models.select("model").distinct()
    if named.limit(MODELS + 1).count() > MODELS:
        raise ValueError(f"more than {MODELS} models")
    grid = targets.select("url").distinct().crossJoin(F.broadcast(named))
    first = runs.groupBy("model", "url").agg(F.min(F.struct("id", "runtime_units", "success", "downloaded", "iterations")).alias("_r")).select("model", "url", "_r.*")
    met = grid.join(first, ["model", "url"], "left")
    late, there = F.col("runtime_units") > timeout_units, F.col("id").isNotNull()
    fine = there & ~late
    notes = F.when(~there, "not run").when(late, f"hard timeout >{timeout_units // 100}s").otherwise("")
    return met.select("model", "url", (fine & F.col("success")).alias("success"), *[F.when(fine, F.col(c)).otherwise(0).alias(c) for c in ("downloaded", "iterations")], notes.alias("notes"))


def stored_files(files: DataFrame, items: DataFrame) -> DataFrame:
    """Files (job_id, item_id, name) with the domain of their item; empty for those whose item or job isn't known."""
    known = items.select("job_id", F.col("id").alias("item_id"), "domain")
    return files.join(known, ["job_id", "item_id"], "left").select("job_id", "item_id", "name", F.coalesce("domain", F.lit("")).alias("domain"))


def errors_of(items: DataFrame, category: str, category_of: Column) -> DataFrame:
    """Failed items whose message has this category; all of them for ``all``."""
    found = items.filter("status = 'failed'").withColumn("category", category_of)
    return found if category == "all" else found.filter(F.col("category") == category)
