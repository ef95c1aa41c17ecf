"""Session factory and the checkpoint folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "tradelens", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job relies on: UTC clock, AQE, skew-join handling."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    """Day and hour columns follow the session zone, so every job pins it to UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="tradelens-")


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run of a job."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark removes the shuffle files of a query when it ends. Otherwise they stay until the driver's collector finds the plan, which does not depend on how full the disks are.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, what a finished query shuffled is removed at once."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors. Its shuffle files go when it is written; they are never read again."""
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if named or sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or shared_folder(df.sparkSession))
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own, as another run of the caller's may still need what it shuffled


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a folder of their own and read again; compressed, so for large tables. Order and partitions are not kept.

    A checkpoint keeps Spark's estimate of the size, a product of all that was joined. Where each round of a loop joins what the last one left, the estimate's
    digits multiply until planning fills the driver; that of a file is its size.
    """
    folder = work_folder(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def released(df: DataFrame) -> None:
    """Empties the folder of a ``stored`` table that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        spark.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)
