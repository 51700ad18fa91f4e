"""Window-shaped operators: firsts, top-n, chunks, collisions, throughput; snapshots and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.operators.running import PART, running_totals


def top_per_group(rows: DataFrame, group: list[str], order: list[Column | str], n: int = 1) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def collision_names(rows: DataFrame, group: list[str], name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """The n-th repeat of a name in its group gets the suffix __n."""
    nth = F.row_number().over(W.partitionBy(*group, name).orderBy(*order)) - 1
    return rows.withColumn(out, F.when(nth > 0, F.concat(F.col(name), F.lit("__"), nth.cast("string"))).otherwise(F.col(name)))


def chunks(items: DataFrame, priority: Column, size: int = 50) -> DataFrame:
    """Each job's items by falling priority, then id, cut into chunks."""
    nth = F.row_number().over(W.partitionBy("job_id").orderBy(priority.desc(), "id"))
    return items.withColumn("chunk", F.floor((nth - 1) / size).cast("int"))


def throughput(events: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """How many rows of the key the trailing window has, the row included.

    Each row is dealt to its stretch of ``seconds``, and once more to the next as one that is only counted: no window looks further back. So
    a key's rows are apart by time, however many there are, and each group holds two stretches.
    """
    length = seconds * 1_000_000
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    dealt = events.withColumn("_moment", moment).withColumn("_later", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_stretch", F.floor(F.col("_moment") / length) + F.col("_later"))
    counted = dealt.withColumn("recent", F.count(F.lit(1)).over(W.partitionBy(key, "_stretch").orderBy("_moment").rangeBetween(-length, 0)))
    return counted.filter("_later = 0").drop("_moment", "_later", "_stretch")


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``nth``, their number from 1 in their group, by ranges of all rows: a group may have most of them. There are to be few groups."""
    placed = running_totals(rows.withColumn("_one", F.lit(1)), [group, *order], "_one", "_before", "_place")
    firsts = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    return placed.join(firsts, group).withColumn("nth", F.col("_place") - F.col("_first") + 1).drop("_one", "_before", "_place", "_first", PART)


def snapshot_delta(old: DataFrame, new: DataFrame, key: str = "filename", value: str = "checksum") -> DataFrame:
    """Names that were added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("_a")), new.select(key, F.col(value).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def content_dedup(rows: DataFrame, checksum: str) -> DataFrame:
    """One row: files, different contents, repeats."""
    return rows.groupBy(checksum).count().agg(F.sum("count").alias("files"), F.count(F.lit(1)).alias("unique_files")).withColumn("duplicates", F.col("files") - F.col("unique_files"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], latest: list[Column]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of several new ones the first by ``latest``."""
    fresh = top_per_group(new, key, latest)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def first_non_null(rows: DataFrame, group: list[str], order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """Merge a group's rows in order: scalars by their first value, lists joined without repeats.

    Lists are taken apart first, and each different element of a group is one row with its first place, so that only those are collected.
    """
    chosen = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in scalars]
    merged = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"), *chosen)
    for c in lists:
        each = rows.select(*group, order, F.posexplode(c).alias("_at", "_element")).groupBy(*group, "_element").agg(F.min(F.struct(order, "_at")).alias("_first"))
        joined = each.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.sort_array(F.collect_list(F.struct("_first", "_element"))).alias("_list"))
        same = [merged[g].eqNullSafe(joined[f"_{g}"]) for g in group]
        in_order = F.coalesce(F.transform("_list", lambda x: x["_element"]), F.array())
        merged = merged.join(joined, same, "left").withColumn(c, in_order).drop("_list", *[f"_{g}" for g in group])
    return merged.drop("_rows")
