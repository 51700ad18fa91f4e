"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "bidlake") -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; only where it is unset, as in tests, make one, which a cluster's executors wouldn't share."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is to name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="bidlake-checkpoint-"))


def cut(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def let_go(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files, and checkpoints if it is set to, of frames that nothing refers to any more.

    It does so when the driver collects garbage, which in a loop of many small rounds may come only after the last. The queries
    run for it have no exchange: each exchange starts a thread of the driver's, which keeps its memory for a minute.
    """
    gc.collect()
    for _ in range(2):  # Spark itself holds on to the last queries that have ended
        spark.range(1).collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def only_hinted_broadcasts(spark: SparkSession) -> Iterator[None]:
    """What runs inside broadcasts a join's side only where it is told to, however small the side is.

    For queries of many small joins: each broadcast is built in the driver, in pages of a megabyte or more, by a thread that stays for a minute.
    """
    keys = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {key: spark.conf.get(key, None) for key in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(frame: DataFrame) -> tuple[DataFrame, str]:
    """The frame written as compressed Parquet to a new folder of the shared checkpoint folder and read again, and that folder.

    For wide rows of text, which a checkpoint would hold uncompressed. ``remove`` takes the folder away.
    """
    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``written`` has made, in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(columns: list[str], stem: str = "_b") -> str:
    """A prefix that none of the columns begins with, in either case, for columns that only a plan uses."""
    while any(c.lower().startswith(stem) for c in columns):
        stem += "_"
    return stem
