"""URL lists in files of any separator: dialects found by an aggregate over lines, each file read with its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Separators in the order in which they are preferred, and headers of URL columns: of lists as they come, and of lists in the order of the headers here.
SEPARATORS = [",", ";", "\t", "|"]
ANY_HEADER = ["url", "urls", "link", "links", "tender_url", "site", "address"]
BEST_HEADER = ["url", "urls", "link", "website", "website_url", "tender_url", "tender link", "tender"]


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, line) of text files below ``path``; nth is ascending within a file, without being gapless."""
    read = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"))
    within = F.monotonically_increasing_id() % F.lit(1 << 33)  # of a task, which reads a block from its beginning
    return read.select("file", F.struct("_start", within.alias("_at")).alias("nth"), F.col("value").alias("line"))


def _outside_quotes(separator: str) -> str:
    return f'[{separator}](?=(?:[^"]*"[^"]*")*[^"]*$)'


def cells_of(line: Column, separator: Column) -> Column:
    """The trimmed cells of a line; quotes around a cell go, doubled ones inside become one."""
    split = F.when(separator == SEPARATORS[0], F.split(line, _outside_quotes(SEPARATORS[0]), -1))
    for s in SEPARATORS[1:]:
        split = split.when(separator == s, F.split(line, _outside_quotes(s), -1))
    return F.transform(split, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"((?s).*)"$', "$1"), '""', '"')))


def dialects(lines: DataFrame) -> DataFrame:
    """(file, separator, header): one row a file, whatever its length.

    The separator is the one of which most lines have the same number, more than none; of equal ones the first of SEPARATORS, which also stands for
    files of one column. The header is the first line that isn't blank, without a byte order mark.
    """
    said = lines.filter(F.trim("line") != "")
    counts = said.select("file", F.posexplode(F.array(*[F.size(F.split("line", _outside_quotes(s), -1)) - 1 for s in SEPARATORS])).alias("_s", "_n"))
    alike = counts.filter("_n > 0").groupBy("file", "_s", "_n").agg(F.count(F.lit(1)).alias("_lines"))
    best = alike.groupBy("file").agg(F.max_by("_s", F.struct("_lines", -F.col("_s"))).alias("_s"))
    heads = said.groupBy("file").agg(F.min_by("line", "nth").alias("_head"), F.min("nth").alias("first"))
    separator = F.element_at(F.array(*map(F.lit, SEPARATORS)), F.coalesce("_s", F.lit(0)) + 1)
    named = heads.join(best, "file", "left").withColumn("separator", separator)
    return named.select("file", "separator", "first", cells_of(F.regexp_replace("_head", "^﻿", ""), F.col("separator")).alias("header"))


def url_column(header: Column, names: list[str], by_name: bool) -> Column:
    """The place, from 1, of the URL column: of the first header that is one of ``names``, or ``by_name`` of the first of ``names`` that is a header; null without any."""
    low = F.transform(header, F.lower)
    if by_name:
        places = [F.nullif(F.array_position(low, F.lit(n)), F.lit(0)) for n in names]
        return F.coalesce(*places).cast("int")
    known = F.array(*map(F.lit, names))
    return F.nullif(F.array_position(F.transform(low, lambda c: F.array_contains(known, c)), F.lit(True)), F.lit(0)).cast("int")


def listed_urls(lines: DataFrame, names: list[str] | None = None, by_name: bool = False, column: str | None = None) -> DataFrame:
    """(file, nth, url) of the URL column of lists (file, nth, line), each read with its own separator; only http and https.

    ``column`` names the column, in any case; else it is found by ``names`` (ANY_HEADER), and is the first where none fits. A file whose first line has a URL in it has no
    header and is read by its first column. Blank lines and cells are left out, repeats are not; a null line is a blank one.
    """
    found = dialects(lines)
    wanted = url_column(F.col("header"), [column.lower()] if column else names or ANY_HEADER, by_name)
    headless = F.exists("header", lambda c: F.lower(c).rlike("^https?://"))
    known = found.select("file", "separator", "first", headless.alias("_headless"), F.when(headless, 1).otherwise(F.coalesce(wanted, F.lit(1))).alias("_column"))
    rows = lines.join(known, "file").filter((F.trim("line") != "") & (F.col("_headless") | (F.col("nth") > F.col("first"))))
    url = F.get(cells_of(F.regexp_replace("line", "^﻿", ""), F.col("separator")), F.col("_column") - 1)
    return rows.select("file", "nth", url.alias("url")).filter(F.lower("url").rlike("^https?://"))


def first_of_each(urls: DataFrame, limit: int | None = None) -> DataFrame:
    """Each different URL with its first place (file, nth), or the first ``limit`` of them by place."""
    firsts = urls.groupBy("url").agg(F.min(F.struct("file", "nth")).alias("place"))
    return firsts.orderBy("place").limit(limit) if limit is not None else firsts


def direct_then_listed(direct: DataFrame, listed: DataFrame) -> DataFrame:
    """(url, source): different URLs, those given directly before those of lists; blank ones are left out."""
    both = direct.select(F.trim("url").alias("url"), F.lit(0).alias("_from")).unionByName(listed.select(F.trim("url").alias("url"), F.lit(1).alias("_from"))).filter("url <> ''")
    return both.groupBy("url").agg(F.min("_from").alias("_from")).select("url", F.when(F.col("_from") == 0, "direct").otherwise("list").alias("source"))
