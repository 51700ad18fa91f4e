"""The append-only audit log as a stream of Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def audit_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def event_rates(events: DataFrame, at: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind and window; rows later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "event_type", "n")


#: Fixed value: letters of a message that are kept.
MESSAGE = 4000


def audit_rows(events: DataFrame) -> DataFrame:
    """Events as audit rows: messages cut, and a trace that is job and item, or what there is of them."""
    return events.withColumns({"message": F.substring(F.coalesce("message", F.lit("")), 1, MESSAGE), "trace_id": F.nullif(F.concat_ws(":", "job_id", "item_id"), F.lit(""))})


def append_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a micro-batch is one folder named by its id, so that one that is given again, as after a crash, takes the place of itself."""

    def write(rows: DataFrame, batch: int) -> None:
        audit_rows(rows).write.mode("overwrite").parquet(f"{path}/batch_id={batch}")

    return write


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all batches, with the batch that they came in."""
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*")
