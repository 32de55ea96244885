"""Resolved types as facts: lookup at a site, filters on type texts, guards that types could carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def type_at(sites: DataFrame, facts: DataFrame, file: str, line: str, name: str, display: str) -> DataFrame:
    """The sites with `type`: the fact at their file and line, else the one of their file and name, else null.

    Both need columns for file, line and name. Files are compared without letter case; of several facts the one with
    the longest display wins, then the smallest; facts without a name are found by line only. Sites keep all their columns.
    """
    file_key = F.lower(F.col(file))
    known = facts.where(F.col(display).isNotNull()).select(file_key.alias("_f"), F.col(line).alias("_l"), F.col(name).alias("_n"), F.struct((-F.length(display)).alias("short"), F.col(display).alias("text")).alias("_d"))
    by_line = known.where("_l is not null").groupBy("_f", "_l").agg(F.min("_d").alias("_at_line"))
    by_name = known.where("_n <> ''").groupBy("_f", "_n").agg(F.min("_d").alias("_at_name"))
    keyed = sites.withColumns({"_f": file_key, "_l": F.col(line), "_n": F.col(name)})
    both = keyed.join(by_line, ["_f", "_l"], "left").join(by_name, ["_f", "_n"], "left")
    return both.withColumn("type", F.coalesce("_at_line", "_at_name")["text"]).drop("_f", "_l", "_n", "_at_line", "_at_name")


def string_capable(types: Column) -> Column:
    """Whether a value of one of these type texts can be a string; unknown types (null, or none recorded) may be."""
    def one(t: Column) -> Column:
        return F.trim(t).isin("string", "Promise<string>") | F.exists(F.split(t, r"\|"), lambda m: F.trim(m) == "string")

    return (F.coalesce(F.size(types), F.lit(0)) <= 0) | F.exists(types, lambda t: F.coalesce(one(t), F.lit(True)))


def may_yield(types: Column, excluded: list[str]) -> Column:
    """Whether anything but the excluded types can come out; what is unknown may."""
    return (F.coalesce(F.size(types), F.lit(0)) <= 0) | F.exists(types, lambda t: F.coalesce(~t.isin(excluded), F.lit(True)))


def carries_invariant(flags: Column, members: Column) -> Column:
    """Whether a type could carry what a guard tests: it isn't a plain object, or it admits a missing value."""
    return ~F.coalesce(F.array_contains(flags, "Object"), F.lit(False)) | F.coalesce(F.exists(members, lambda m: m.isin("null", "undefined")), F.lit(False))


def guards_for_types(guards: DataFrame, spans: DataFrame, facts: DataFrame, on: list[str], guard: str, at: str, end: str, exits: str, refs: str, span: str, start: str, stop: str, fact_name: str) -> DataFrame:
    """(on..., guard, span, ref) of guards that leave the function and test a value whose type carries an invariant: one row for each guard.

    guards(on..., guard, at, end, exits, refs array), spans(on..., span, start, stop), facts(on..., fact_name, flags, members).
    The span is the shortest that holds the guard; the ref is the first in the guard's order that has such a type.
    """
    leaving = guards.where(F.col(exits)).select(*on, F.col(guard), F.col(at), F.col(end), F.col(refs))
    held = leaving.join(spans.select(*on, F.col(span), F.col(start), F.col(stop)), on).where((F.col(at) >= F.col(start)) & (F.col(end) <= F.col(stop)))
    inside = held.groupBy(*on, guard).agg(F.min_by(span, F.struct(F.col(stop) - F.col(start), F.col(start))).alias(span), F.any_value(refs).alias(refs))
    each = inside.select(*on, guard, span, F.posexplode(refs).alias("_n", fact_name))
    telling = facts.where(carries_invariant(F.col("flags"), F.col("members"))).select(*on, fact_name).distinct()
    return each.join(telling, [*on, fact_name], "left_semi").groupBy(*on, guard, span).agg(F.min_by(fact_name, "_n").alias("ref"))
