"""Budgets: first k, chunks of a capacity, greedy choice, running cut-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """All rows with `state`: 'kept' for the first k of each key, else 'budget'."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("state", F.when(n <= k, "kept").otherwise("budget"))


def _ordered(rows: DataFrame, by: str, order: list[str], item: str, cost: str) -> DataFrame:
    """One key's items in order as an array; the fold that follows is sequential, so a key must fit into a task."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item"), F.col(cost).cast("double").alias("_cost")))).alias("_rows"))


def next_fit(rows: DataFrame, by: str, order: list[str], item: str, cost: str, capacity: float) -> DataFrame:
    """(by, item, chunk): a new chunk begins when the next item would overflow it; an oversized item has a chunk of its own."""
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("chunks"))

    def step(s, r):
        opens = (s["chunk"] < 0) | (s["used"] + r["_cost"] > capacity)
        chunk = F.when(opens, s["chunk"] + 1).otherwise(s["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(opens, r["_cost"]).otherwise(s["used"] + r["_cost"]).alias("used"), F.concat(s["chunks"], F.array(chunk)).alias("chunks"))

    folded = _ordered(rows, by, order, item, cost).withColumn("_chunks", F.aggregate("_rows", start, step)["chunks"])
    return folded.select(by, F.explode(F.arrays_zip(F.col("_rows._item").alias("i"), F.col("_chunks").alias("c"))).alias("z")).select(by, F.col("z.i").alias(item), F.col("z.c").alias("chunk"))


def greedy_skip(rows: DataFrame, by: str, order: list[str], item: str, cost: str, capacity: float) -> DataFrame:
    """(by, item, taken): items in order, each taken if it still fits, so later smaller ones may follow a skipped one."""
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(s, r):
        fits = s["used"] + r["_cost"] <= capacity
        return F.struct(F.when(fits, s["used"] + r["_cost"]).otherwise(s["used"]).alias("used"), F.concat(s["taken"], F.array(fits)).alias("taken"))

    folded = _ordered(rows, by, order, item, cost).withColumn("_taken", F.aggregate("_rows", start, step)["taken"])
    return folded.select(by, F.explode(F.arrays_zip(F.col("_rows._item").alias("i"), F.col("_taken").alias("t"))).alias("z")).select(by, F.col("z.i").alias(item), F.col("z.t").alias("taken"))


def fit_to_budget(rows: DataFrame, by: list[str], order: list, cost: str, budget: float) -> DataFrame:
    """The rows of each key up to the first that overflows; the first is always kept."""
    window = Window.partitionBy(*by).orderBy(*order)
    summed = rows.withColumns({"_n": F.row_number().over(window), "_sum": F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))})
    return summed.where((F.col("_n") == 1) | (F.col("_sum") <= budget)).drop("_n", "_sum")
