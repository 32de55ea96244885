"""Near-duplicate records with small edits: MinHash LSH forest with exact verification.

Each record is its set of different consecutive token pairs. Equal sets collapse to one class by a
hash of the whole set. Each class gets `trees` label sequences of min-hashes; sorted, one tree's sequences are
its prefix trie. The forest is walked from long prefixes to short ones. First, neighbours in sorted order,
which have the longest prefixes in common, are compared: that joins the dense families at a cost linear in
their size. Then the prefix is shortened, step by step, to the depth that the target recall needs; at each
depth only those buckets are opened that hold members of different groups, and only pairs across groups are
compared. A bucket too large for that is joined on the rarest members of its sets, of which any two sets of the
wanted likeness share one. Only exact likeness makes a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.runtime import cut

#: Labels that two sequences must share at least, and the chance that a pair just at the threshold shares them in some tree.
DEPTH = 6
TARGET_RECALL = 0.9985
#: Set members that are hashed at a time, few enough to stay in a core's cache for all its hash functions.
HASHED = 1 << 16
#: Members of one bucket that form one chain of neighbours; a larger bucket has several.
CHAIN = 50_000
SEED = 20_240_229
#: Labels kept below the base depth in each sequence and their bits, and how many of them the walk keeps at its steps.
BELOW, LABEL_BITS = 7, 9
STEPS = (3, 0)
#: Members of a bucket up to which all pairs across its groups are made.
SMALL_BUCKET = 256


def trees_needed(threshold: float, depth: int, recall: float) -> int:
    """How many trees let a pair of the threshold's likeness share `depth` labels with this recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def pair_hashes(tokens: Column) -> Column:
    """The sorted different hashes of consecutive token pairs; empty for fewer than two tokens or null. A null token counts as empty text."""
    filled = F.transform(tokens, lambda t: F.coalesce(t, F.lit("")))
    n = F.size(filled)
    pairs = F.zip_with(F.slice(filled, 1, n - 1), F.slice(filled, 2, n - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(F.size(tokens) >= 2, F.array_sort(F.array_distinct(pairs))).otherwise(F.array().cast("array<bigint>"))


def _mix(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return key ^ (key >> np.uint64(33))


def signatures(values: np.ndarray, starts: np.ndarray, hashes: int, seed: int = SEED) -> np.ndarray:
    """Min-hashes of the segments of `values` that begin at `starts` (none empty), one row per hash function."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, hashes, dtype=np.uint64)
    out = np.empty((hashes, len(starts)), dtype=np.uint64)
    scratch = np.empty_like(values)
    for j in range(hashes):
        np.multiply(values, a[j], out=scratch)
        np.add(scratch, b[j], out=scratch)
        np.right_shift(scratch, np.uint64(32), out=scratch)
        out[j] = np.minimum.reduceat(scratch, starts)
    return out


def _forest_keys(trees: int, depth: int):
    """Batches of (id, hashes) to rows (id, bucket, below): one row per tree, a hash of the first `depth` labels and the following labels in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHED, side="right")))
                part = batch.slice(at, upto - at)
                at = upto
                lists = part.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
                labels = signatures(values, starts, trees * depth).reshape(trees, depth, -1)
                bucket = np.empty((trees, len(sizes)), dtype=np.uint64)
                head = np.zeros((trees, len(sizes)), dtype=np.uint64)
                for t in range(trees):
                    key = np.full(len(sizes), t + 1, dtype=np.uint64)
                    for d in range(depth):
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + labels[t, d])
                    bucket[t] = key
                    for d in range(BELOW):
                        own = _mix(labels[t, d]) & np.uint64((1 << LABEL_BITS) - 1) if d < depth else np.uint64(0)
                        head[t] = (head[t] << np.uint64(LABEL_BITS)) | own
                # the labels below a tree's prefix are the first of the following tree, so no further hashing is needed
                below = np.roll(head, -1, axis=0)
                ids = np.tile(part.column(0).to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(bucket.ravel().view(np.int64)), pa.array(below.ravel().view(np.int64))], names=["id", "bucket", "below"])

    return run


def _by_rarest(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of members(id, part) of different parts that share one of their rarest set members, of which any two sets that alike share one."""
    own = members.join(sets, "id").select("id", "part", F.size("hashes").alias("n"), F.explode("hashes").alias("gram"))
    own = cut(own)
    rare = own.groupBy("gram").agg(F.count("*").alias("df"))
    ranked = own.join(rare, "gram").groupBy("id", "part", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("g"))
    prefix = cut(ranked.select("id", "part", "n", F.explode(F.slice("g.gram", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).cast("int"))).alias("gram")))
    # what a single part has, however many members it has, makes no pair
    both = prefix.groupBy("gram").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("gram")
    live = cut(prefix.join(both, "gram"))
    x, y = live.select("gram", F.col("id").alias("x"), F.col("part").alias("px"), F.col("n").alias("nx")), live.select("gram", F.col("id").alias("y"), F.col("part").alias("py"), F.col("n").alias("ny"))
    met = x.join(y, "gram").where("px < py").where((F.col("nx") >= F.col("ny") * threshold - 1e-9) & (F.col("ny") >= F.col("nx") * threshold - 1e-9))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _across(placed: DataFrame, sets: DataFrame, threshold: float, small: int) -> DataFrame:
    """(a, b) of the pairs across groups in the buckets of placed(bucket, prefix, id, part)."""
    on = ["bucket", "prefix"]
    live = cut(placed.groupBy(*on).agg(F.count("*").alias("n"), F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select(*on, "n"))
    opened = cut(placed.join(live, on))
    few = opened.where(F.col("n") <= small)
    met = few.select(*on, F.col("id").alias("x"), F.col("part").alias("px")).join(few.select(*on, F.col("id").alias("y"), F.col("part").alias("py")), on).where("px < py")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = opened.where(F.col("n") > small)
    if not many.isEmpty():
        pairs = pairs.unionByName(_by_rarest(many.select("id", "part").distinct(), sets, threshold))
    return pairs.distinct()


def _links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs(a, b) whose sets are at least that alike, counted exactly."""
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    either = F.size("ha") + F.size("hb") - shared
    long_enough = F.least(F.size("ha"), F.size("hb")) >= F.greatest(F.size("ha"), F.size("hb")) * F.lit(threshold) - 1e-9
    return pairs.join(left, "a").join(right, "b").where(long_enough).where(shared >= either * F.lit(threshold) - 1e-9).select("a", "b")


def near_duplicate_groups(records: DataFrame, key: str = "unit_id", tokens: str = "tokens", order: str = "scanned_at", threshold: float = 0.7, recall: float = TARGET_RECALL, depth: int = DEPTH) -> DataFrame:
    """(key, group_id) for each record with at least one other of likeness >= threshold.

    group_id is the smallest key reached by links. Rows of one key count once, the one with the greatest
    `order`. Records with fewer than two tokens (or null ones) have no pairs and so no likeness to anything.
    Rows with a null key are left out; other columns are ignored; an empty input gives an empty result.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(order).alias("seen"), pair_hashes(F.col(tokens)).alias("hashes"))
    return set_groups(rows, threshold, recall, depth).select(F.col("id").alias(key), "group_id")


def set_groups(rows: DataFrame, threshold: float, recall: float = TARGET_RECALL, depth: int = DEPTH, small: int = SMALL_BUCKET, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """(id, group_id) of rows(id, seen, hashes), hashes being sorted and different: the forest over any sets of hashes.

    The last of `steps` must be 0, the base depth; where that is deep already, steps on the way to it save nothing.
    """
    base = cut(rows.withColumns({"row": F.monotonically_increasing_id(), "k1": F.xxhash64("hashes"), "k2": F.xxhash64(F.lit(17), F.col("hashes"))}))
    live = base.groupBy("id").agg(F.max_by(F.struct("row", "k1", "k2", (F.size("hashes") > 0).alias("full")), F.struct("seen", "row")).alias("last")).select("id", "last.*").where("full")
    classes = live.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.count("*").alias("members"), F.min_by("row", "id").alias("row"))
    members = cut(live.select("id", "k1", "k2").join(classes, ["k1", "k2"]).select("id", "class_id", "members", F.when(F.col("id") == F.col("class_id"), F.col("row")).alias("row")))
    # the rows that stand for a class keep their place: only the few others are looked up
    others = base.select("row").join(members.select("row").where("row is not null"), "row", "left_anti")
    sets = base.select("row", "id", "hashes").join(others, "row", "left_anti").select("id", "hashes")

    trees = trees_needed(threshold, depth, recall)
    keys = sets.mapInArrow(_forest_keys(trees, depth), "id long, bucket long, below long").repartition("bucket")
    # all columns are asked for, so that both uses of the keys read one exchange and signatures are made once
    shared = keys.groupBy("bucket").agg(F.count("*").alias("n"), F.max("id").alias("_id"), F.max("below").alias("_below")).where("n > 1 and _id is not null and _below is not null").select("bucket", "n")
    buckets = cut(keys.join(shared, "bucket"))

    chain = Window.partitionBy("bucket", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHAIN))).orderBy("below", "id")
    beside = buckets.select("id", F.lead("id").over(chain).alias("next")).where("next is not null and next <> id")
    compared = cut(beside.select(F.least("id", "next").alias("a"), F.greatest("id", "next").alias("b")).distinct())
    grouped = cut(connected_components(cut(_links(compared, sets, threshold))).select(F.col("vertex").alias("id"), F.col("group_id").alias("part")))

    buckets = buckets.where("n > 2").drop("n")
    for step in steps:
        placed = buckets.join(grouped, "id", "left").select("bucket", F.shiftright("below", LABEL_BITS * (BELOW - step)).alias("prefix"), "id", F.coalesce("part", "id").alias("part"))
        fresh = cut(_across(placed, sets, threshold, small).join(compared, ["a", "b"], "left_anti"))
        late = _links(fresh, sets, threshold)
        bridged = late.join(grouped.select(F.col("id").alias("a"), F.col("part").alias("ga")), "a", "left").join(grouped.select(F.col("id").alias("b"), F.col("part").alias("gb")), "b", "left")
        bridges = cut(bridged.select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")).distinct())
        if bridges.isEmpty():
            compared = compared.unionByName(fresh)
            continue
        joined = connected_components(bridges).select(F.col("vertex").alias("old"), F.col("group_id").alias("whole"))
        alone = bridges.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(grouped.select("id"), "id", "left_anti").withColumn("part", F.col("id"))
        grouped = cut(grouped.unionByName(alone).join(joined, F.col("part") == F.col("old"), "left").select("id", F.coalesce("whole", "part").alias("part")))
        compared = compared.unionByName(fresh)

    found = members.select("id", "class_id", "members").join(grouped.select(F.col("id").alias("class_id"), "part"), "class_id", "left")
    return found.where("members > 1 or part is not null").select("id", F.coalesce("part", "class_id").alias("group_id"))
