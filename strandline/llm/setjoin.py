"""All similar pairs between set-valued records: metric pivot partitioning under Jaccard distance.

Jaccard distance is a metric, so with a pivot p and a reach r = 1 - threshold, a record x whose home
is p (d(x, p) <= home) can only match records within home + r of p. Pivots are records of the dense
places of the data, found by banded min-hashes; their number follows the data and they are never
broadcast. Each record goes home to its nearest pivot and is replicated to every pivot whose ring it
may reach; cells are joined exactly. Records too far from every pivot for the bound to say anything
(in sparse places all Jaccard distances are near 1) are joined among each other by their rarest
members, so that the result is whole whatever the pivots are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut

#: A record is at home with its nearest pivot up to this distance.
HOME = 0.1
#: Min-hash bands that look for dense places, and hashes in each.
BANDS, ROWS = 8, 4
#: Records at home in one cell that are joined in one piece; the homes of larger cells are salted.
CELL = 2_000


def _prefix(ranked: Column, threshold: float) -> Column:
    """The rarest members of which any set of that likeness must share one."""
    n = F.size(ranked)
    return F.slice(ranked, 1, n - F.ceil(n * F.lit(threshold) - 1e-9).cast("int") + 1)


def _least_hash(items: str, seed: int) -> Column:
    return F.array_min(F.transform(items, lambda w: F.xxhash64(w, F.lit(seed))))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(l, r, shared, nl, nr) of candidates that share a rare member and whose sizes allow the threshold, each once."""
    a = left.select("part", F.col("id").alias("l"), F.col("n").alias("nl"), F.explode(_prefix(F.col("ranked"), threshold)).alias("w"))
    b = right.select("part", F.col("id").alias("r"), F.col("n").alias("nr"), F.explode(_prefix(F.col("ranked"), threshold)).alias("w"))
    fits = (F.col("nl") >= F.col("nr") * threshold - 1e-9) & (F.col("nr") >= F.col("nl") * threshold - 1e-9)
    return a.join(b, ["part", "w"]).where(fits).select("l", "r").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(l, r, likeness) of those pairs at or above the threshold, counted exactly."""
    left = sets.select(F.col("id").alias("l"), F.col("ranked").alias("sl"))
    right = sets.select(F.col("id").alias("r"), F.col("ranked").alias("sr"))
    both = pairs.join(left, "l").join(right, "r").withColumn("shared", _shared(F.col("sl"), F.col("sr")))
    both = both.withColumn("either", F.size("sl") + F.size("sr") - F.col("shared"))
    return both.where(F.col("shared") >= F.col("either") * F.lit(threshold) - 1e-9).select("l", "r", (F.col("shared") / F.col("either")).alias("likeness"))


def _class_pairs(records: DataFrame, key: str, part: str, members: str, order: str | None, threshold: float, least: int, side: str | None, home: float) -> tuple[DataFrame, DataFrame]:
    """(owners, pairs): which record has which class of equal sets, and the pairs (part, cl, cr, likeness) of different classes that are alike."""
    least = max(1, least)
    strings = F.array_distinct(F.array_compact(members))
    hashed = F.array_sort(F.transform(strings, lambda m: F.xxhash64(m)))
    rows = records.where(F.col(key).isNotNull()).select(F.col(part).alias("part"), F.col(key).cast("long").alias("id"), (F.col(order) if order else F.lit(0)).alias("seen"), hashed.alias("items"), (F.col(side).cast("string") if side else F.lit("")).alias("side"))
    rows = rows.groupBy("part", "id", "side").agg(F.max_by("items", "seen").alias("items")).where(F.size("items") >= least)
    rows = cut(rows)
    classes = rows.groupBy("part", "items").agg(F.min("id").alias("class_id"))
    owners = rows.join(classes, ["part", "items"]).select("part", "side", F.col("id").alias("member"), "class_id")

    # class ids are unique in a part only; one number stands for both
    named = classes.select("part", F.xxhash64("part", "class_id", "items").alias("id"), "class_id", F.explode("items").alias("w"))
    rarity = named.groupBy("part", "w").agg(F.count("*").alias("df"))
    ranked = named.join(rarity, ["part", "w"]).groupBy("part", "id", "class_id").agg(F.array_sort(F.collect_list(F.struct("df", "w"))).alias("by_df"))
    sets = cut(ranked.select("part", "id", "class_id", F.size("by_df").alias("n"), F.col("by_df.w").alias("ranked")))

    reach = 1.0 - threshold
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.xxhash64(*[_least_hash("ranked", b * ROWS + r) for r in range(ROWS)]).alias("key")) for b in range(BANDS)])
    banded = sets.select("part", "id", F.explode(bands).alias("band"))
    pivots = banded.groupBy("part", "band").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id").distinct()
    pivots = cut(sets.join(pivots, "id", "left_semi"))
    near = cut(_verify(_alike(sets, pivots, 1.0 - home - reach), sets, 1.0 - home - reach).select(F.col("l").alias("id"), F.col("r").alias("cell"), (1.0 - F.col("likeness")).alias("distance")))
    at_home = near.groupBy("id").agg(F.min(F.struct("distance", "cell")).alias("nearest")).select("id", "nearest.*").where(F.col("distance") <= home + 1e-9)
    cells = at_home.groupBy("cell").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / CELL).cast("int").alias("pieces"))
    homes = cut(at_home.join(cells, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int")))
    visitors = near.join(cells, "cell").where(F.col("distance") <= F.col("radius") + F.lit(reach) + 1e-9).select("cell", F.col("id").alias("y"), F.col("distance").alias("dy"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    # two members of a cell whose distances to its pivot differ by more than the reach can't match
    met = homes.select("cell", "piece", F.col("id").alias("x"), F.col("distance").alias("dx")).join(visitors, ["cell", "piece"]).where("x <> y").where(F.abs(F.col("dx") - F.col("dy")) <= reach + 1e-9)
    in_cells = met.select(F.least("x", "y").alias("l"), F.greatest("x", "y").alias("r")).distinct()
    far = sets.join(homes.select("id"), "id", "left_anti")
    between_far = _alike(far, far, threshold).where("l < r")
    found = cut(_verify(in_cells.unionByName(between_far), sets, threshold))

    name = sets.select("id", "part", "class_id")
    pairs = found.join(name.select(F.col("id").alias("l"), "part", F.col("class_id").alias("cl")), "l").join(name.select(F.col("id").alias("r"), F.col("class_id").alias("cr")), "r")
    return owners, pairs.select("part", "cl", "cr", "likeness")


def similar_set_classes(records: DataFrame, key: str, part: str, members: str, order: str | None = None, threshold: float = 0.7, least: int = 1, home: float = HOME) -> DataFrame:
    """(part, key, class_id, members, links): for each record the smallest key with its set, how many records have it, and to how many other sets it is alike.

    The same join as similar_set_pairs, with n copies of a set in n rows instead of n squared.
    """
    owners, pairs = _class_pairs(records, key, part, members, order, threshold, least, None, home)
    ends = pairs.select("part", F.explode(F.array("cl", "cr")).alias("class_id")).groupBy("part", "class_id").agg(F.count("*").alias("links"))
    sizes = owners.groupBy("part", "class_id").agg(F.count("*").alias("members")).join(ends, ["part", "class_id"], "left")
    return owners.join(sizes, ["part", "class_id"]).select(F.col("part").alias(part), F.col("member").alias(key), "class_id", "members", F.coalesce("links", F.lit(0)).alias("links"))


def similar_set_pairs(records: DataFrame, key: str, part: str, members: str, order: str | None = None, threshold: float = 0.7, least: int = 1, side: str | None = None, home: float = HOME) -> DataFrame:
    """(part, left_id, right_id, likeness) of all pairs of one part whose sets are at least that alike; left_id < right_id.

    `members` is an array of strings, of which nulls and repeats don't count; sets with fewer than `least`
    members (at least one) take no part. Rows of one (part, key) count once, the one with the greatest
    `order`. Records with equal sets are joined as one and expanded at the end. With `side` (a column of two
    values) only pairs of different sides are returned, which is the join of two tables. Null keys are left out. The result holds all
    pairs of copies too; similar_set_classes doesn't write them out.
    """
    owners, pairs = _class_pairs(records, key, part, members, order, threshold, least, side, home)
    left = owners.select("part", F.col("class_id").alias("cl"), F.col("member").alias("ml"), F.col("side").alias("sl"))
    right = owners.select("part", F.col("class_id").alias("cr"), F.col("member").alias("mr"), F.col("side").alias("sr"))
    wide = pairs.join(left, ["part", "cl"]).join(right, ["part", "cr"])
    same = left.join(right, (left["part"] == right["part"]) & (left["cl"] == right["cr"])).drop(right["part"]).where("ml < mr or (ml = mr and sl < sr)").withColumn("likeness", F.lit(1.0))
    columns = ["part", "ml", "mr", "sl", "sr", "likeness"]
    everything = wide.select(columns).unionByName(same.select(columns))
    if side:
        everything = everything.where("sl <> sr")
    return everything.select(F.col("part").alias(part), F.least("ml", "mr").alias("left_id"), F.greatest("ml", "mr").alias("right_id"), "likeness")
