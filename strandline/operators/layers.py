"""Layers: which one a path lies in, and edges that go the wrong way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import glob_regex


def layer_expression(path: str, layers: list[tuple[str, list[str], int]]):
    """The first layer (name, include globs, rank), in order of rank, whose pattern a path matches, as a struct; null without one.

    Layers are a short configured list, so this is an expression and not a join.
    """
    chain = None
    for name, globs, rank in sorted(layers, key=lambda x: (x[2], x[0])):
        hit = F.lit(False)
        for glob in globs:
            hit = hit | F.col(path).rlike(glob_regex(glob))
        value = F.struct(F.lit(name).alias("name"), F.lit(rank).alias("rank"))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def upward_edges(edges: DataFrame, source: str, target: str, layers: list[tuple[str, list[str], int]]) -> DataFrame:
    """Edges whose target lies in a layer of greater rank than their source; edges without a layer, or within one, are left out."""
    placed = edges.where(f"`{target}` is not null and `{source}` <> `{target}`").withColumns({"from_layer": layer_expression(source, layers), "to_layer": layer_expression(target, layers)})
    return placed.where("to_layer.rank > from_layer.rank").select(source, target, F.col("from_layer.name").alias("from_layer"), F.col("to_layer.name").alias("to_layer"))


def forbidden_edges(edges: DataFrame, source: str, specifier: str, forbidden: list[tuple[str, str]], layers: list[tuple[str, list[str], int]]) -> DataFrame:
    """(source, specifier, pattern) of edges from a layer to what (layer, pattern) forbids it; a pattern without * matches whole names only."""
    placed = edges.withColumn("layer", layer_expression(source, layers)["name"])
    rules = F.array(*[F.struct(F.lit(layer).alias("layer"), F.lit(pattern).alias("pattern"), F.lit(glob_regex(pattern)).alias("regex")) for layer, pattern in forbidden])
    each = placed.withColumn("rule", F.explode(F.filter(rules, lambda r: r["layer"] == F.col("layer"))))
    return each.where("rlike(`" + specifier + "`, rule.regex)").select(source, specifier, F.col("rule.pattern").alias("pattern")).distinct()


def shared_lower_layer(pairs: DataFrame, left_rank: str, right_rank: str, ranks: list[int]) -> DataFrame:
    """The greatest configured rank below both ranks of a pair, null if there is none."""
    options = F.array(*[F.lit(r) for r in sorted(ranks)])
    below = F.filter(options, lambda r: (r < F.col(left_rank)) & (r < F.col(right_rank)))
    return pairs.withColumn("shared_rank", F.array_max(below))
