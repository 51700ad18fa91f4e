"""Global running sums that never gather all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlake.session import cut

PART = "_part"


def running_totals(frame: DataFrame, order: list[str], value: str, total: str = "before", index: str = "position") -> DataFrame:
    """Add, for the global order ``order``, the sum of ``value`` and the number of rows before each row.

    Rows are range-partitioned by ``order``, which must be a total order up to repeated rows, so that a
    hot prefix is split like any other range. The partitions are cut by a checkpoint, so that a lost
    executor can't redraw their borders. Then each partition's total goes through one window over a row
    a partition, and each row adds its partition's offset to a running sum inside its own partition.
    An empty table gives an empty table; a null value counts 0. Also keeps the partition id in ``_part``.
    """
    ranged = cut(frame.repartitionByRange(*[F.col(c) for c in order]).withColumn(PART, F.spark_partition_id()))
    number = F.coalesce(F.col(value), F.lit(0)).cast("long")
    totals = ranged.groupBy(PART).agg(F.sum(number).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        PART,
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    within = W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        ranged.withColumn("_run", F.sum(number).over(within))
        .withColumn("_in_part", F.row_number().over(W.partitionBy(PART).orderBy(*order)))
        .join(F.broadcast(offsets), PART)  # one row a partition
        .withColumn(total, F.col("_run") - number + F.col("_sum_before"))
        .withColumn(index, F.col("_in_part") - 1 + F.col("_rows_before"))
        .drop("_run", "_in_part", "_sum_before", "_rows_before")
    )
