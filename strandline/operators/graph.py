"""Graphs: components, cliques, cycles, closures, what a change reaches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node that each node of an undirected graph reaches.

    Large-star and small-star steps, which need a number of rounds that grows with the logarithm of the
    longest chain; every round is two joins-by-key whose groups are reduced to their minimum first.
    """
    pairs = edges.where(f"`{left}` is not null and `{right}` is not null and `{left}` <> `{right}`").select(F.col(left).alias("a"), F.col(right).alias("b"))
    current = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        following = cut(small)
        if following.count() == current.count() and following.exceptAll(current).isEmpty():
            break
        current = following
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _greedy_clique(pdf: pd.DataFrame) -> pd.DataFrame:
    near: dict = {}
    for a, b in zip(pdf["left_id"], pdf["right_id"]):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    chosen: list = []
    for node in sorted(near, key=lambda n: (-len(near[n]), n)):
        if all(node in near[c] for c in chosen):
            chosen.append(node)
    inside = set(chosen)
    component = pdf["component"].iloc[0]
    return pd.DataFrame({"component": component, "node": sorted(near), "role": ["clique" if n in inside else "chained" for n in sorted(near)]})


def greedy_cliques(pairs: DataFrame, largest: int = 1000) -> DataFrame:
    """(component, node, role) of pairs(left_id, right_id): one clique for each component, most-linked nodes first, the rest 'chained'.

    Components of more than `largest` nodes are not searched: all their nodes have the role 'oversize'.
    """
    placed = components(pairs, "left_id", "right_id")
    sizes = placed.groupBy("component").agg(F.count("*").alias("nodes"))
    small = sizes.where(F.col("nodes") <= largest).select("component")
    inside = pairs.where("left_id <> right_id").select("left_id", "right_id").distinct().join(placed.withColumnRenamed("node", "left_id"), "left_id").join(small, "component")
    searched = inside.groupBy("component").applyInPandas(_greedy_clique, "component long, node long, role string")
    rest = placed.join(small, "component", "left_anti").select("component", "node", F.lit("oversize").alias("role"))
    return searched.unionByName(rest)


def split_oversize(cliques: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(cliques of at most `most` nodes, drops): the nodes of larger ones and those only chained to one are dropped with the reason."""
    sizes = cliques.where("role = 'clique'").groupBy("component").agg(F.count("*").alias("_n"))
    both = cliques.join(sizes, "component", "left")
    reason = F.when(F.col("role") != "clique", F.col("role")).when(F.col("_n") > most, "oversize")
    return both.where(reason.isNull()).select("component", "node"), both.where(reason.isNotNull()).select("component", "node", reason.alias("reason"))


def reachable(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(from, to) of all nodes joined by a path of one step or more, cycles included.

    Every round doubles the length of the paths known, so rounds grow with the logarithm of the longest shortest path.
    """
    known = fresh = cut(edges.where(f"`{source}` is not null and `{target}` is not null").select(F.col(source).alias("from"), F.col(target).alias("to")).distinct())
    while not fresh.isEmpty():
        # a shortest path of up to twice the length begins with one of those found last
        further = fresh.join(known.select(F.col("from").alias("to"), F.col("to").alias("next")), "to").select("from", F.col("next").alias("to")).distinct()
        fresh = cut(further.join(known, ["from", "to"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def strong_components(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, cycle): nodes of directed cycles, the cycle named by its smallest node.

    Nodes without an edge in or out are trimmed first, again and again; what remains is closed under reachability.
    The closure is quadratic in a cyclic core, which in dependency graphs is small.
    """
    core = cut(edges.where(f"`{source}` is not null and `{target}` is not null").select(F.col(source).alias("s"), F.col(target).alias("t")).distinct())
    while True:
        kept = cut(core.join(core.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(core.select(F.col("s").alias("t")).distinct(), "t", "left_semi"))
        if kept.count() == core.count():
            break
        core = kept
    reach = reachable(core, "s", "t")
    mutual = reach.join(reach.select(F.col("from").alias("to"), F.col("to").alias("from")), ["from", "to"])
    return mutual.groupBy(F.col("from").alias("node")).agg(F.min("to").alias("cycle"))


def cycle_kinds(edges: DataFrame, source: str, target: str, weak: str) -> DataFrame:
    """(cycle, nodes, kind): 'runtime' if strong edges alone close it, 'type only' if all its edges are weak, else 'mixed'. Parallel edges are weak only if all are."""
    merged = edges.groupBy(F.col(source).alias("s"), F.col(target).alias("t")).agg(F.min(F.col(weak)).alias("weak"))
    nodes = cut(strong_components(merged, "s", "t"))
    strong = cut(strong_components(merged.where(~F.col("weak")), "s", "t").select(F.col("node").alias("n2")))
    inside = merged.join(nodes.select(F.col("node").alias("s"), "cycle"), "s").join(nodes.select(F.col("node").alias("t"), F.col("cycle").alias("c2")), "t").where("cycle = c2")
    edges_of = inside.groupBy("cycle").agg(F.min(F.col("weak")).alias("all_weak"))
    size = nodes.join(strong, F.col("node") == F.col("n2"), "left").groupBy("cycle").agg(F.count("*").alias("nodes"), F.count("n2").alias("closed"))
    return size.join(edges_of, "cycle").select("cycle", "nodes", F.when(F.col("closed") > 0, "runtime").when(F.col("all_weak"), "type only").otherwise("mixed").alias("kind"))


def dependents(changed: DataFrame, edges: DataFrame, node: str, source: str, target: str) -> DataFrame:
    """One step back from what changed: (source) of edges into it, without the changed nodes themselves."""
    hit = edges.join(changed.select(F.col(node).alias(target)).distinct(), target, "left_semi").select(F.col(source).alias(node)).distinct()
    return hit.join(changed.select(node), node, "left_anti")


def cascade(sites: list[tuple[str, DataFrame]], place: str) -> DataFrame:
    """(place, reasons): the union of several kinds of sites, each place once with its reasons in order."""
    union = None
    for reason, frame in sites:
        part = frame.select(place, F.lit(reason).alias("reason"))
        union = part if union is None else union.unionByName(part)
    return union.distinct().groupBy(place).agg(F.array_join(F.array_sort(F.collect_list("reason")), "|").alias("reasons"))
