"""Consolidating pairwise matches into groups: connected components by low-diameter decomposition.

Every level grows clusters from exponentially shifted start times, contracts each cluster to one
super-vertex, and recurses on the edges between clusters; the assignments of all levels compose to
the component of each vertex. No vertex's neighbours are ever gathered: growth is a join and a
partial minimum, and the edges of very busy vertices are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut

#: Rate of the exponential start times: greater means smaller clusters and more levels.
BETA = 0.2
#: Rounds of growth in one level; a cluster that would reach further is cut there and recursion joins it.
RADIUS = 5
#: Edges of one vertex that stay in one piece; beyond it they are salted into several.
HOT_DEGREE = 50_000
MAX_LEVELS = 60


def _start_time(vertex: Column, level: int, beta: float) -> Column:
    """Minus an Exp(beta) variate that depends only on the vertex and the level."""
    uniform = (F.pmod(F.xxhash64(vertex, F.lit(7919 + level)), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return F.log(uniform) / beta


def _both_ways(edges: DataFrame, hot_degree: int) -> DataFrame:
    """The directed edges with their salt, and a loop of step 0 on each vertex that also has its number of salts."""
    directed = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    vertices = directed.groupBy("src").agg(F.ceil(F.count("*") / hot_degree).cast("int").alias("pieces"))
    loops = vertices.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("step"), F.lit(0).alias("salt"), F.col("pieces").alias("dst_pieces"))
    hot = vertices.where("pieces > 1")
    salted = (
        directed.join(hot, "src", "left")
        .withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("pieces", F.lit(1))).cast("int"))
        .drop("pieces")
        .join(hot.select(F.col("src").alias("dst"), F.col("pieces").alias("dst_pieces")), "dst", "left")
        .select("src", "dst", F.lit(1.0).alias("step"), "salt", F.coalesce("dst_pieces", F.lit(1)).alias("dst_pieces"))
    )
    return salted.unionByName(loops)


def _grow(state: DataFrame, directed: DataFrame) -> DataFrame:
    """One step of growth: each vertex takes the earliest of its own cluster and its neighbours', one step later."""
    offers = state.select(F.col("v").alias("src"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("salt"), "best")
    moved = F.struct((F.col("best.at") + F.col("step")).alias("at"), F.col("best.center").alias("center"))
    arrived = offers.join(directed, ["src", "salt"]).select(F.col("dst").alias("v"), F.col("dst_pieces").alias("pieces"), moved.alias("best"))
    return arrived.groupBy("v").agg(F.max("pieces").alias("pieces"), F.min("best").alias("best"))


def connected_components(edges: DataFrame, beta: float = BETA, radius: int = RADIUS, hot_degree: int = HOT_DEGREE) -> DataFrame:
    """(vertex, group_id) for each vertex of edges(a, b): group_id is the smallest vertex it reaches.

    Rows with a null end and loops link nothing; direction, repeats and order of rows don't matter.
    An empty input gives an empty result; extra columns are ignored. Vertices are bigint.
    """
    ends = edges.select(F.col("a").cast("long").alias("x"), F.col("b").cast("long").alias("y")).where("x is not null and y is not null and x <> y")
    current = cut(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    levels: list[DataFrame] = []
    for level in range(MAX_LEVELS):
        if current.isEmpty():
            break
        directed = cut(_both_ways(current, hot_degree))
        state = directed.where("step = 0").select(F.col("src").alias("v"), F.col("dst_pieces").alias("pieces"), F.struct(_start_time(F.col("src"), level, beta).alias("at"), F.col("src").alias("center")).alias("best"))
        for _ in range(radius):
            state = _grow(state, directed)
        grown = cut(state.select("v", F.col("best.center").alias("center")))
        levels.append(grown)
        left, right = grown.select(F.col("v").alias("a"), F.col("center").alias("ca")), grown.select(F.col("v").alias("b"), F.col("center").alias("cb"))
        between = current.join(left, "a").join(right, "b").where("ca <> cb")
        current = cut(between.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    else:
        raise RuntimeError("the decomposition did not end")
    if not levels:
        return ends.select(F.col("x").alias("vertex"), F.col("y").alias("group_id")).limit(0)
    assigned = levels[0].select(F.col("v").alias("vertex"), F.col("center").alias("component"))
    for grown in levels[1:]:
        step = grown.select(F.col("v").alias("component"), "center")
        assigned = assigned.join(step, "component", "left").select("vertex", F.coalesce("center", "component").alias("component"))
    smallest = assigned.groupBy("component").agg(F.min("vertex").alias("group_id"))
    return assigned.join(smallest, "component").select("vertex", "group_id")
