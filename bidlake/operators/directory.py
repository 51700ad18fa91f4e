"""The public directory of open tenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.classify import tender_status


def is_open(now: Column) -> Column:
    """A successful item whose deadline isn't over; without a deadline it is open."""
    return (F.col("status") == "success") & (F.col("deadline").isNull() | (F.col("deadline") >= now))


def open_counts(items: DataFrame, now: Column) -> DataFrame:
    named = F.col("domain").isNotNull() & (F.col("domain") != "")
    return items.filter(is_open(now) & named).groupBy("domain").agg(F.count(F.lit(1)).alias("open_count"), F.min("url").alias("sample_url"))


def domains(items: DataFrame, seeds: DataFrame, now: Column) -> DataFrame:
    """Seeded portals, with 0 where nothing is open, and the other domains that have open tenders, with a sample URL."""
    known = seeds.select("domain", F.lit(True).alias("seeded"))
    both = open_counts(items, now).join(known, "domain", "full_outer")
    return both.select("domain", F.coalesce("open_count", F.lit(0)).alias("open_count"), F.coalesce("seeded", F.lit(False)).alias("seeded"), F.when(F.col("seeded").isNull(), F.col("sample_url")).alias("sample_url"))


def tenders(items: DataFrame, domain: str, now: Column, limit: int, offset: int = 0) -> DataFrame:
    """One page of a domain's open tenders: nearest deadline first, those without last, then by id."""
    page = items.filter((F.col("domain") == domain) & is_open(now)).orderBy(F.col("deadline").asc_nulls_last(), "id").offset(offset).limit(limit)
    return page.select("id", "tender_title", "tender_reference", "url", "deadline", tender_status(F.col("deadline"), now).alias("tender_status"))
