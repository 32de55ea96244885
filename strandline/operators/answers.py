"""Stored answers: merge, prune, lookup with validation, and the sharded store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = "key string, written_at bigint, kind string, label string, rating double, probability double, probabilities map<string,double>, confidence double"


def merge(ours: DataFrame, theirs: DataFrame, key: str, written: str) -> DataFrame:
    """The union by key: the newer row wins, and at a tie ours does. A side that is not empty but has no key is refused by the caller."""
    columns = ours.columns
    both = ours.withColumn("_side", F.lit(1)).unionByName(theirs.select(columns).withColumn("_side", F.lit(0)))
    order = Window.partitionBy(key).orderBy(F.col(written).desc_nulls_last(), F.col("_side").desc())
    return both.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(order)).where("_n = 1").select(columns)


#: Rows of one piece of time in which sums run.
PIECE = 100_000


def prune(rows: DataFrame, key: str, written: str, size: str, oldest, most: int, piece: int = PIECE) -> DataFrame:
    """Rows not older than `oldest`, and of those the newest (ties by key, greatest first) while their sizes sum to at most `most`.

    The running sum is over all rows. It is taken in pieces of time: rows are counted by second, seconds are put
    together to pieces of about `piece` rows, and the totals of the pieces are summed first. No task holds more than a
    piece or, where more rows than that bear one time, the rows of one second; their keys break the tie.
    """
    kept = rows.where(F.col(written) >= F.lit(oldest)).withColumn("_second", F.unix_timestamp(F.col(written).cast("timestamp")))
    seconds = kept.groupBy("_second").agg(F.count("*").alias("_rows"), F.sum(size).alias("_size"))
    # windows over the seconds alone: by day first, so that neither of them has all rows in one place but the days' totals
    day = seconds.withColumn("_day", F.floor(F.col("_second") / 86400))
    days = day.groupBy("_day").agg(F.sum("_rows").alias("_day_rows"))
    before = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_ahead_rows", F.coalesce(F.sum("_day_rows").over(before), F.lit(0)))
    inside = Window.partitionBy("_day").orderBy(F.col("_second").desc()).rowsBetween(Window.unboundedPreceding, -1)
    numbered = day.withColumn("_seen", F.coalesce(F.sum("_rows").over(inside), F.lit(0))).join(days.select("_day", "_ahead_rows"), "_day")
    placed = numbered.select("_second", "_size", F.floor((F.col("_ahead_rows") + F.col("_seen")) / piece).alias("_piece"))
    totals = placed.groupBy("_piece").agg(F.sum("_size").alias("_total"))
    ahead = totals.withColumn("_ahead", F.coalesce(F.sum("_total").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_piece", "_ahead")
    within = Window.partitionBy("_piece").orderBy(F.col(written).desc(), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = kept.join(placed.join(ahead, "_piece").select("_second", "_piece", "_ahead"), "_second").withColumn("_here", F.sum(size).over(within))
    return summed.where(F.col("_here") + F.col("_ahead") <= most).select(rows.columns)


def lookup(questions: DataFrame, answers: DataFrame, key: str, labels: str | None = None) -> DataFrame:
    """The questions with their answers and `state`: 'answered', 'missing' or 'invalid'.

    An answer is valid if its probability lies in 0..1, its probabilities sum to about 1, and its label is one the question allows.
    """
    joined = questions.join(answers, key, "left")
    total = F.aggregate(F.map_values("probabilities"), F.lit(0.0), lambda a, x: a + x)
    bad = (F.col("probability") < 0) | (F.col("probability") > 1) | F.isnan("probability") | (F.col("probabilities").isNotNull() & (F.abs(total - 1) > 0.01))
    if labels:
        bad = bad | (F.col("label").isNotNull() & ~F.array_contains(labels, F.col("label")))
    state = F.when(F.col("kind").isNull(), "missing").when(F.coalesce(bad, F.lit(False)), "invalid").otherwise("answered")
    return joined.withColumn("state", state)


def write_store(answers: DataFrame, path: str, key: str = "key") -> None:
    """Writes answers as JSON in one folder for each first two digits of the key, rows in order of key; only folders with rows are replaced."""
    sharded = answers.withColumn("shard", F.substring(key, 1, 2))
    sharded.repartition("shard").sortWithinPartitions("shard", key).write.partitionBy("shard").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def read_store(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(answers, unreadable lines) of a store; a line that isn't a row is a miss and never an error."""
    read = spark.read.schema(COLUMNS + ", shard string, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = read.where("_corrupt is null and key is not null").drop("_corrupt", "shard")
    return good, read.where("_corrupt is not null or key is null").select("_corrupt")
