"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tessera", cpus: int | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    n = cpus or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests) a temporary folder of this machine is taken; on
    a cluster its absence is an error, as executors would not see such a folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif context.master == "local" or context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="tessera-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: the rows are computed once and survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """The rows in four partitions for each core at most: what is written on the way to a result then has a file for
    each of these, rather than for each shuffle partition, however many there are. Not for what is made straight from a
    scan of texts, whose tasks would become long."""
    return df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, what: str = "rows", gather: bool = True) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read again, and where they lie. Unlike a checkpoint the result knows
    its true size, so estimates don't grow from round to round, and it can be removed when it is no longer read."""
    spark = df.sparkSession
    folder = new_folder(spark, what)
    (gathered(df) if gather else df).write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing reads any more, wherever they lie."""
    context = spark.sparkContext
    for folder in folders:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """A table to join with: marked for broadcast if it has been counted to have ``most`` rows or fewer, else as it is,
    for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


class Scratch:
    """Tables written on the way to a result, removed together once it is stored."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def keep(self, df: DataFrame, what: str = "rows", gather: bool = True) -> DataFrame:
        out, folder = stored(df, what, gather)
        self.folders.append(folder)
        return out

    def clear(self) -> None:
        remove(self.spark, *self.folders)
        self.folders = []


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
