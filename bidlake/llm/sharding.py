"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.operators.running import PART, running_totals


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` contiguous ranges of near equal bytes.

    Law ``bytes``: rows stand in the order of (hash of the text, id), so that equal texts are neighbours;
    prefix sums over per-partition totals give each row its byte offset; shard ``i`` holds the rows whose
    middle byte falls into the i-th of ``shards`` equal parts of all bytes. A group of equal texts is moved
    as one, by its own middle, as long as it isn't larger than the largest single row, which a cut
    between rows must tolerate anyhow; a larger group may be cut. So a shard is off its target by no more than
    about the largest row, however the rows are grouped.

    Size is the UTF-8 length plus 1; a null text counts none, so 1. Null ids sort first. Repeated ids are
    placed like any rows. An empty table gives no rows; columns of the input other than id and text aren't
    read. Returns id, size, text_crc32 (of the UTF-8 bytes; null: of none), shard, slot (gapless in its shard from 0).
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"),
        F.xxhash64(text).alias("_key"),
    )
    placed = running_totals(rows, ["_key", "_crc", "_size", "_id"], "_size", "_before", "_at")
    group = ["_key", "_crc", "_size"]
    inside = placed.groupBy(PART, *group).agg(F.min("_before").alias("_start"), F.count(F.lit(1)).alias("_n"))
    # A group that goes over a border between partitions is the last of one and the first of the next.
    last = placed.groupBy(PART).agg(F.min(F.struct(*group)).alias("first"), F.max(F.struct(*group)).alias("last"))
    ends = last.select(F.explode(F.array("first", "last")).alias("g")).distinct().select("g.*")
    ends = ends.join(inside, group).groupBy(*group).agg(F.min("_start").alias("_start_all"), F.sum("_n").alias("_n_all"))
    totals = placed.agg(F.sum("_size").alias("_total"), F.max("_size").alias("_most"))
    inside = (
        inside.join(F.broadcast(ends), group, "left")  # two rows a partition at most
        .withColumn("_start", F.coalesce("_start_all", "_start"))
        .withColumn("_n", F.coalesce("_n_all", "_n"))
        .filter("_n > 1")
        .select(PART, *group, "_start", "_n")
    )
    whole = F.col("_n") * F.col("_size") <= F.col("_most")
    middle = F.when(F.col("_n").isNotNull() & whole, 2 * F.col("_start") + F.col("_n") * F.col("_size")).otherwise(2 * F.col("_before") + F.col("_size"))
    dealt = (
        placed.join(inside, [PART, *group], "left")
        .join(F.broadcast(totals))  # one row
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle.cast("decimal(38,0)") * shards / (2 * F.col("_total")))).cast("int"))
    )
    starts = dealt.groupBy("shard").agg(F.min("_at").alias("_from"))
    return dealt.join(F.broadcast(starts), "shard").select(  # one row a shard
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        "shard",
        (F.col("_at") - F.col("_from")).alias("slot"),
    )
