"""Exact duplicates and other groups of records that share a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_groups(records: DataFrame, by: list[str], place: str, least_places: int = 2, test: Column | None = None) -> DataFrame:
    """(by..., members, places, group_key) of keys that stand in several places; groups of nothing but tests are left out.

    Null keys form no group. Sizes only: members join back by key, so a key of a third of all rows is no burden.
    """
    known = records.where(" and ".join(f"`{c}` is not null" for c in by))
    grouped = known.groupBy(*by).agg(F.count("*").alias("members"), F.count_distinct(place).alias("places"), F.min(test if test is not None else F.lit(False)).alias("all_test"))
    kept = grouped.where((F.col("places") >= least_places) & ~F.coalesce("all_test", F.lit(False)))
    return kept.select(*by, "members", "places", F.substring(F.sha1(F.concat_ws("\0", *[F.col(c).cast("string") for c in by])), 1, 16).alias("group_key"))


def representative(records: DataFrame, by: list[str], first_by: list[str], keep: list[str]) -> DataFrame:
    """One record for each key: the first by `first_by`."""
    picked = records.groupBy(*by).agg(F.min(F.struct(*first_by, *[F.col(c).alias(f"_{c}") for c in keep])).alias("_first"), F.count("*").alias("members"))
    return picked.select(*by, *[F.col(f"_first._{c}").alias(c) for c in keep], "members")


def reach(edges: DataFrame, target: str, source: str, least: int) -> DataFrame:
    """(target, sources) of targets that at least so many different sources refer to."""
    return edges.groupBy(target).agg(F.count_distinct(source).alias("sources")).where(F.col("sources") >= least)


def paired_gap(rows: DataFrame, key: str, what: str, one: str, other: str) -> DataFrame:
    """Keys that have `one` among their values and not `other`, with how often."""
    return rows.groupBy(key).agg(F.count(F.when(F.col(what) == one, 1)).alias("with_one"), F.count(F.when(F.col(what) == other, 1)).alias("with_other")).where("with_one > 0 and with_other = 0").select(key, "with_one")


def structure(units: DataFrame, name: str, kind: str) -> DataFrame:
    """One row: different names, declarations, declarations in repeated names, names with several kinds."""
    per = units.groupBy(name).agg(F.count("*").alias("n"), F.count_distinct(kind).alias("kinds"))
    return per.agg(F.count("*").alias("concepts"), F.sum("n").alias("declarations"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated"), F.count(F.when(F.col("kinds") > 1, 1)).alias("overloaded"))
