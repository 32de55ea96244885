"""Candidates from sites in texts: literals, helpers, calls, flags and skips, joined to the declarations around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.types import may_yield, string_capable

#: fixed values: return types that carry no items
NO_DATA = ["void", "undefined", "null", "boolean", "bigint", "symbol", "never"]


def paired_calls(calls: DataFrame, names: str, one: str, other: str) -> DataFrame:
    """Rows whose calls hold `one` and not `other`."""
    return calls.where(F.array_contains(names, one) & ~F.array_contains(names, other))


def pressed_pages(pages: DataFrame, states: str, elements: str, least_states: int = 3, least_elements: int = 15) -> DataFrame:
    """Pages with at least so many state calls and inline elements; call sites count, not different names."""
    return pages.where((F.col(states) >= least_states) & (F.col(elements) >= least_elements))


def shallow_files(files: DataFrame, lines: str, exports: str, least_exports: int = 5, depth: float = 2.0) -> DataFrame:
    """Files that export at least so many things over fewer than `depth` lines of code for each."""
    return files.where((F.col(exports) >= least_exports) & (F.col(lines) / F.col(exports) < depth))


def only_such_users(uses: DataFrame, by: list[str], such: Column) -> DataFrame:
    """(by..., users) of what is used, and by nothing but users for which `such` holds; an unknown answer counts as no."""
    return uses.groupBy(*by).agg(F.count("*").alias("users"), F.min(F.coalesce(such, F.lit(False))).alias("_all")).where("_all").drop("_all")


def shared_literals(literals: DataFrame, literal: str, place: str, first: str, least: int = 2) -> DataFrame:
    """(literal, places, first) of literals that stand in at least so many places."""
    return literals.groupBy(literal).agg(F.count_distinct(place).alias("places"), F.min(first).alias(first)).where(F.col("places") >= least)


def preferred_partner(rows: DataFrame, partners: DataFrame, on: str, file: str, name: str) -> DataFrame:
    """rows(on, file, ...) with partner_file and partner_name: a partner of the same `on`, best from another file, then the smallest (file, name).

    Only the two smallest partners of different files are kept of each key, so a key that very many have costs no more than its rows.
    """
    each = F.struct(F.col(file).alias("f"), F.col(name).alias("n"))
    first = partners.where(F.col(on).isNotNull()).groupBy(on).agg(F.min(each).alias("_one"))
    rest = partners.join(first, on).where(F.col(file) != F.col("_one.f")).groupBy(on).agg(F.min(each).alias("_two"))
    both = rows.join(first, on).join(rest, on, "left")
    chosen = F.when(F.col("_one.f") != F.col(file), F.col("_one")).otherwise(F.coalesce("_two", "_one"))
    return both.withColumns({"partner_file": chosen["f"], "partner_name": chosen["n"]}).drop("_one", "_two")


def caller_literals(units: DataFrame, uses: DataFrame, unit: str, file: str, name: str, literals: str, least_callers: int = 2, most: int = 3) -> DataFrame:
    """(unit, literal, callers) of the first literals of units that files other than their own use by name.

    uses(name, file) are calls and renderings. A literal counts if it is a word: four characters or more, one of them a
    lower-case letter; the first `most` of a unit are what is asked about.
    """
    distinct = uses.select(F.col(name), F.col(file).alias("_user")).where(F.col(name).isNotNull() & F.col("_user").isNotNull()).distinct()
    counted = distinct.groupBy(name).agg(F.count("*").alias("_all"))
    own = units.join(distinct.withColumnRenamed("_user", file).withColumn("_own", F.lit(1)), [name, file], "left")
    used = own.join(counted, name).withColumn("callers", F.col("_all") - F.coalesce("_own", F.lit(0))).where(F.col("callers") >= least_callers)
    words = F.slice(F.filter(literals, lambda x: (F.length(x) >= 4) & x.rlike("[a-z]")), 1, most)
    return used.select(unit, F.explode(words).alias("literal"), "callers")


def strings_beside_helpers(units: DataFrame, calls: DataFrame, unit: str, file: str, name: str, builds: str, returns: str, least_callers: int = 2) -> DataFrame:
    """(unit, helpers) of units that build a string although their file calls helpers that several files call and that may return one.

    units(unit, file, name, builds boolean, returns array of type texts), calls(file, name). The helper itself is where the
    string belongs, so units named as one of the helpers are left out.
    """
    distinct = calls.select(file, name).where(F.col(name).isNotNull()).distinct()
    shared = distinct.groupBy(name).agg(F.count("*").alias("_files")).where(F.col("_files") >= least_callers)
    made = units.where(string_capable(F.col(returns))).select(name).where(F.col(name).isNotNull()).distinct()
    helpers = shared.join(made, name, "left_semi").select(name)
    used = distinct.join(helpers, name, "left_semi")
    per_file = used.groupBy(file).agg(F.count("*").alias("helpers"))
    builders = units.where(F.col(builds)).join(helpers, name, "left_anti")
    return builders.join(per_file, file).select(unit, "helpers")


def unbounded_reads(calls: DataFrame, functions: DataFrame, data_files: DataFrame, unit: str, name: str, file: str) -> DataFrame:
    """(unit, name, callee_file) of calls to functions all of whose parameters are optional and that lie in a file that reads data.

    calls(unit, name), functions(name, file, all_optional), data_files(file). Sites are those of the unit itself.
    """
    reading = functions.where("all_optional").join(data_files.select(file).distinct(), file, "left_semi")
    return calls.select(unit, name).distinct().join(reading.select(name, F.col(file).alias("callee_file")).distinct(), name).select(unit, name, "callee_file")


def inferred_flags(units: DataFrame, fields: DataFrame, unit: str, text: str, refs: str, returns_comparison: str, type_name: str, field: str) -> DataFrame:
    """(unit, type, flag) of units that return a comparison and name a type with a boolean field they don't read: the first such type in the unit's order, and its first field by name."""
    deriving = units.where(F.col(returns_comparison)).select(unit, text, F.posexplode(F.array_distinct(refs)).alias("_n", "type"))
    flags = fields.groupBy(F.col(type_name).alias("type")).agg(F.array_sort(F.collect_set(field)).alias("_flags"))
    unread = F.filter("_flags", lambda f: ~F.contains(F.col(text), f))
    met = deriving.join(flags, "type").withColumn("_unread", unread).where(F.size("_unread") > 0)
    return met.groupBy(unit).agg(F.min(F.struct("_n", "type", F.element_at("_unread", 1).alias("flag"))).alias("m")).select(unit, "m.type", "m.flag")


def unaccounted_skips(units: DataFrame, exported: str, test: str, skips: str, returns: str, no_data: list[str] = NO_DATA) -> DataFrame:
    """Exported functions outside tests that skip items and hand data back; unknown return types may."""
    return units.where(F.col(exported) & ~F.coalesce(F.col(test), F.lit(False)) & (F.col(skips) > 0) & may_yield(F.col(returns), no_data))


def outage_shapes(handlers: DataFrame, text: str, guard: str, catches: str, status: str, by: list[str]) -> DataFrame:
    """(by..., shape) of handlers that answer with a server error: in a guard against a missing value ('guard'), else in what they catch ('catch'), once each.

    guard, catches and status are patterns; the status must follow the guard or catch within its block.
    """
    block = r"[^{}]*\{[^{}]*"
    shape = F.when(F.col(text).rlike(guard + block + status), "guard").when(F.col(text).rlike(catches + block + status), "catch")
    return handlers.select(*by, shape.alias("shape")).where("shape is not null").distinct()
