"""Session, table access and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings that every result here assumes (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: spark.checkpoint.dir where the cluster names one, else (tests) a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), f"strandline-checkpoints-{os.getpid()}")
    os.makedirs(made, exist_ok=True)
    return f"file://{made}"


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Computes df once, writes it with the writer's `options` to the shared folder and reads it back, so its lineage ends there.

    A written table and not Dataset.checkpoint(): that one carries the plan's constraints along, and they
    grow with every turn of an iteration. The files go when the driver's JVM ends, or with release().
    """
    spark = df.sparkSession
    place = f"{shared_dir(spark).rstrip('/')}/strandline-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def release(spark: SparkSession) -> None:
    """Deletes every table cut() has written in this application; results that still read them become unusable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/strandline-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest `order`; nulls of `order` lose, equal rows count once.

    Only for rows without wide columns: the whole row goes through the aggregation.
    """
    columns = df.columns
    rest = [c for c in columns if c not in (key, order)]
    picked = df.groupBy(key).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_row"))
    return picked.select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in columns])
