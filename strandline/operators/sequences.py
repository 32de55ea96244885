"""Ordered sequences of calls or events per key: equal ones, shared runs, suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequences(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """(key, items): the items of each key in order. One key's items must fit into a task: use it on declarations or sessions."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(item).alias("_item")))).alias("_s")).select(key, F.col("_s._item").alias("items"))


def equal_sequences(sequence: DataFrame, key: str, least: int = 4, body: str | None = None) -> DataFrame:
    """(signature, members, first) of sequences of at least `least` items that several keys have; with `body`, at least two different ones."""
    signed = sequence.where(F.size("items") >= least).withColumn("signature", F.array_join("items", "|"))
    grouped = signed.groupBy("signature").agg(F.count("*").alias("members"), F.min(key).alias("first"), F.count_distinct(body if body else key).alias("bodies"))
    return grouped.where("members > 1 and bodies > 1").select("signature", "members", "first")


def ngrams(sequence: DataFrame, key: str, n: int) -> DataFrame:
    """(key, at, gram): the runs of n items; at is 0-based."""
    starts = F.when(F.size("items") >= n, F.sequence(F.lit(0), F.size("items") - n)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("items", i + 1, F.lit(n)), "|").alias("gram")))
    return sequence.select(key, F.explode(grams).alias("g")).select(key, "g.at", "g.gram")


def shared_runs(sequence: DataFrame, key: str, n: int = 4, most_per_gram: int | None = 50) -> DataFrame:
    """(left_id, right_id, run, left_at, right_at): the longest run that two different sequences share, at least n items.

    Grams that more than `most_per_gram` places have say nothing and are left out: that limit is part of what
    a shared run is; None sets none. Ties take the earliest place.
    """
    grams = ngrams(sequence, key, n)
    if most_per_gram is not None:
        grams = grams.join(grams.groupBy("gram").agg(F.count("*").alias("places")).where(F.col("places") <= most_per_gram), "gram").drop("places")
    a = grams.select("gram", F.col(key).alias("left_id"), F.col("at").alias("la"))
    b = grams.select("gram", F.col(key).alias("right_id"), F.col("at").alias("ra"))
    met = a.join(b, "gram").where("left_id < right_id").select("left_id", "right_id", "la", (F.col("la") - F.col("ra")).alias("offset")).distinct()
    # grams of one offset that follow each other are one run
    order = Window.partitionBy("left_id", "right_id", "offset").orderBy("la")
    islands = met.withColumn("island", F.col("la") - F.row_number().over(order)).groupBy("left_id", "right_id", "offset", "island").agg(F.min("la").alias("left_at"), (F.count("*") + n - 1).alias("run"))
    best = islands.groupBy("left_id", "right_id").agg(F.max(F.struct("run", (-F.col("left_at")).alias("l"), F.col("offset").alias("o"))).alias("m"))
    runs = best.select("left_id", "right_id", "m.run", (-F.col("m.l")).alias("left_at"), (-F.col("m.l") - F.col("m.o")).alias("right_at"))
    sizes = sequence.select(key, F.array_join("items", "|").alias("whole"))
    return runs.join(sizes.select(F.col(key).alias("left_id"), F.col("whole").alias("wl")), "left_id").join(sizes.select(F.col(key).alias("right_id"), F.col("whole").alias("wr")), "right_id").where("wl <> wr").select("left_id", "right_id", "run", "left_at", "right_at")


def suffix_is_whole(sequence: DataFrame, key: str, least: int = 3) -> DataFrame:
    """(key, whole_key, length): sequences whose ending of at least `least` items is all of another; the longest ending, then the smallest other key."""
    starts = F.when(F.size("items") > least, F.sequence(F.lit(2), F.size("items") - least + 1)).otherwise(F.array().cast("array<int>"))
    endings = F.transform(starts, lambda i: F.struct((F.size("items") - i + 1).alias("length"), F.array_join(F.slice("items", i, F.size("items")), "|").alias("signature")))
    ends = sequence.select(key, F.explode(endings).alias("e")).select(key, "e.length", "e.signature")
    wholes = sequence.where(F.size("items") >= least).select(F.array_join("items", "|").alias("signature"), F.col(key).alias("whole_key")).groupBy("signature").agg(F.min("whole_key").alias("whole_key"))
    hit = ends.join(wholes, "signature").where(F.col(key) != F.col("whole_key"))
    return hit.groupBy(key).agg(F.max(F.struct("length", (-F.col("whole_key")).alias("w"))).alias("m")).select(key, (-F.col("m.w")).alias("whole_key"), F.col("m.length").alias("length"))


def beside(rows: DataFrame, key: str, order: list[str], item: str) -> DataFrame:
    """Each row with the item before and after it."""
    window = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({"before": F.lag(item).over(window), "after": F.lead(item).over(window)})


def run_context(runs: DataFrame, sequence: DataFrame, key: str, side: str, at: str, run: str = "run", most: int = 3) -> DataFrame:
    """The runs with the items before and after them in one of their sequences, at most `most` on each side."""
    own = runs.join(sequence.select(F.col(key).alias(side), "items"), side)
    before = F.slice("items", F.greatest(F.col(at) - most, F.lit(0)) + 1, F.least(F.col(at), F.lit(most)))
    return own.withColumns({"before": before, "after": F.slice("items", F.col(at) + F.col(run) + 1, F.lit(most))}).drop("items")
