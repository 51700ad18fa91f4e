"""Evaluation sets and URL lists from text lines and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTRY = "url string, expected long, domain string"


def json_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """(url, expected, domain) of JSON lines; blank ones, those that begin with # and those without a URL are left out; nothing expected means 1."""
    text = F.trim(line_col)
    said = lines.filter((text != "") & ~text.startswith("#")).select(F.from_json(text, ENTRY).alias("e")).select("e.*")
    return said.filter("url is not null and url <> ''").withColumn("expected", F.coalesce("expected", F.lit(1).cast("long")))


def completed_first(rows: DataFrame, skipped: DataFrame) -> DataFrame:
    """The first row by id of each domain with state COMPLETED, without domains that are to be skipped; one archive is expected of each."""
    fresh = rows.filter("state = 'COMPLETED'").join(skipped.select("domain").distinct(), "domain", "left_anti")
    nth = F.row_number().over(W.partitionBy("domain").orderBy("id"))
    return fresh.withColumn("n", nth).filter("n = 1").select("domain", "url", F.lit(1).alias("expected"), F.lit("zip").alias("kind"))


def url_pairs(rows: DataFrame, most: int = 2) -> DataFrame:
    """(domain, url, backup): the first two different URLs of a domain, by first place."""
    firsts = rows.groupBy("domain", "url").agg(F.min("id").alias("id"))
    nth = F.row_number().over(W.partitionBy("domain").orderBy("id"))
    kept = firsts.withColumn("n", nth).filter(F.col("n") <= most)
    return kept.groupBy("domain").agg(F.max(F.when(F.col("n") == 1, F.col("url"))).alias("url"), F.max(F.when(F.col("n") == 2, F.col("url"))).alias("backup"))
