"""New files as a stream: the batch operators run on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def on_new_rows(spark: SparkSession, folder: str, schema, operator: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Applies an operator to every batch of new Parquet files in a folder and appends its rows to a target; returns the finished query.

    Each batch is written under its number, so a batch that is run again after a failure replaces its own rows.
    """

    def handle(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, by..., n) with rows that come later than `late` left out by the watermark."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")
