"""Field sets of types: containment, coverage, groups that recur, drift of types and nullability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.graph import reachable
from strandline.runtime import cut


def largest_contained(sets: DataFrame, key: str, fields: str, least: int = 3) -> DataFrame:
    """(whole, part, shared, added) for each set that holds another with at most as many fields added as it has; the largest part, then the smallest key.

    Parts have at least `least` fields and differ from the whole. The join is on the part's rarest field, which its whole must have.
    """
    each = sets.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(fields)).alias("f")).where(F.size("f") >= least)
    exploded = each.select("id", "f", F.explode("f").alias("field"))
    rarity = exploded.groupBy("field").agg(F.count("*").alias("df"))
    rarest = exploded.join(rarity, "field").groupBy("id").agg(F.min(F.struct("df", "field")).alias("r"), F.any_value("f").alias("pf")).select(F.col("id").alias("part"), "pf", F.col("r.field").alias("field"))
    wholes = exploded.select(F.col("id").alias("whole"), F.col("f").alias("wf"), "field")
    held = wholes.join(rarest, "field").where((F.size("wf") > F.size("pf")) & (F.size("wf") - F.size("pf") <= F.size("pf"))).where(F.size(F.array_except("pf", "wf")) == 0)
    best = held.groupBy("whole").agg(F.min(F.struct((-F.size("pf")).alias("n"), "part", "pf", "wf")).alias("b"))
    return best.select("whole", F.col("b.part").alias("part"), F.size("b.pf").alias("shared"), F.array_join(F.array_except("b.wf", "b.pf"), ",").alias("added"))


def uncovered_sets(sets: DataFrame, key: str, fields: str, declared: DataFrame, declared_fields: str) -> DataFrame:
    """Sets that no declared set covers. Only declared sets that hold a set's rarest field are looked at."""
    each = sets.select(F.col(key).alias("id"), F.array_distinct(fields).alias("f")).where(F.size("f") > 0)
    known = declared.select(F.array_distinct(declared_fields).alias("d")).where(F.size("d") > 0).distinct()
    known_each = known.select("d", F.explode("d").alias("field"))
    rarity = known_each.groupBy("field").agg(F.count("*").alias("df"))
    rare = each.select("id", "f", F.explode("f").alias("field")).join(rarity, "field", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "field")).alias("r"), F.any_value("f").alias("f")).select("id", "f", F.col("r.field").alias("field"))
    covered = rare.join(known_each, "field").where(F.size(F.array_except("f", "d")) == 0).select("id").distinct()
    return each.join(covered, "id", "left_anti").select(F.col("id").alias(key), F.array_join(F.array_sort("f"), ",").alias("fields"))


def uncovered_by_others(sets: DataFrame, key: str, fields: str) -> DataFrame:
    """Sets that no other key's set covers; one row for each key. A set that two keys have is covered by itself, so only the rest is joined, on its rarest field."""
    each = sets.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(fields)).alias("f")).where(F.size("f") > 0)
    known = cut(each.groupBy("f").agg(F.count("*").alias("n"), F.min("id").alias("id")))
    exploded = known.select("id", "f", "n", F.explode("f").alias("field"))
    rarity = exploded.groupBy("field").agg(F.count("*").alias("df"))
    rare = exploded.where("n = 1").join(rarity, "field").groupBy("id").agg(F.min(F.struct("df", "field")).alias("r"), F.any_value("f").alias("f")).select("id", "f", F.col("r.field").alias("field"))
    covered = rare.join(exploded.select("field", F.col("f").alias("d")), "field").where((F.size("d") > F.size("f")) & (F.size(F.array_except("f", "d")) == 0)).select("id").distinct()
    return known.where("n = 1").join(covered, "id", "left_anti").select(F.col("id").alias(key), F.array_join("f", ",").alias("fields"))


def field_pairs(sets: DataFrame, fields: str, least: int) -> DataFrame:
    """(field_a, field_b, support) of fields that stand together in at least so many sets; rarer fields are left out beforehand."""
    each = sets.select(F.monotonically_increasing_id().alias("row"), F.array_sort(F.array_distinct(fields)).alias("f"))
    each = cut(each.select("row", F.explode("f").alias("field")))
    often = each.groupBy("field").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("field")
    kept = each.join(often, "field").groupBy("row").agg(F.array_sort(F.collect_list("field")).alias("f")).where(F.size("f") > 1)
    pairs = kept.select("f", F.posexplode("f").alias("at", "field_a")).select("field_a", F.explode(F.slice("f", F.col("at") + 2, F.size("f"))).alias("field_b"))
    return pairs.groupBy("field_a", "field_b").agg(F.count("*").alias("support")).where(F.col("support") >= least)


def field_groups(sets: DataFrame, key: str, fields: str, least: int = 6, least_fields: int = 3) -> DataFrame:
    """(fields, n_fields, support) of groups of fields that recur: what all carriers of a frequent pair share, without groups that a larger kept one holds.

    Groups that are exactly the fields of one declared set are left out, since they have a name already.
    Subsets are dropped against all larger groups, which equals the greedy pass in order of size.
    """
    each = cut(sets.select(F.col(key).alias("id"), F.array_sort(F.array_distinct(fields)).alias("f")).where(F.size("f") >= least_fields))
    pairs = field_pairs(each, "f", least)
    by_field = each.select("id", "f", F.explode("f").alias("field_a"))
    carriers = by_field.join(pairs, "field_a").where(F.array_contains("f", F.col("field_b")))
    # what all carriers share, counted: a field is in the group if it is in as many carriers as the pair has
    counted = carriers.select("field_a", "field_b", "support", F.explode("f").alias("field")).groupBy("field_a", "field_b", "support", "field").agg(F.count("*").alias("n"))
    shared = counted.where("n = support").groupBy("field_a", "field_b", "support").agg(F.array_sort(F.collect_list("field")).alias("group"))
    groups = shared.where(F.size("group") >= least_fields).groupBy("group").agg(F.max("support").alias("support"))
    groups = cut(groups.join(each.select(F.col("f").alias("group")).distinct(), "group", "left_anti"))
    first = groups.select(F.col("group").alias("small"), F.element_at("group", 1).alias("field"))
    larger = groups.select(F.col("group").alias("large"), F.explode("group").alias("field"))
    held = first.join(larger, "field").where((F.size("large") > F.size("small")) & (F.size(F.array_except("small", "large")) == 0)).select(F.col("small").alias("group")).distinct()
    return groups.join(held, "group", "left_anti").select(F.array_join("group", ",").alias("fields"), F.size("group").alias("n_fields"), "support")


def type_drift(fields: DataFrame, field: str, type_text: str, place: str, related: list[str], least_words: int = 2, words: str | None = None) -> DataFrame:
    """(field, group..., types, places) of fields that have several type texts among places related by the columns `related`."""
    rows = fields if words is None else fields.where(F.size(words) >= least_words)
    return rows.groupBy(field, *related).agg(F.array_join(F.array_sort(F.collect_set(type_text)), " | ").alias("types"), F.count_distinct(type_text).alias("n_types"), F.count_distinct(place).alias("places")).where("n_types > 1")


def last_declared(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The value of the last row of each key."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def nullability_drift(columns: DataFrame, mapped: DataFrame, by: list[str]) -> DataFrame:
    """Columns whose declared nullability differs from that of the field mapped to them; both need a column `nullable`."""
    return columns.withColumnRenamed("nullable", "column_nullable").join(mapped.withColumnRenamed("nullable", "field_nullable"), by).where("column_nullable <> field_nullable")


def inherited_fields(types: DataFrame, name: str, own: str, parents: str) -> DataFrame:
    """(name, fields) with the fields of all ancestors; cycles end by themselves."""
    up = types.select(F.col(name).alias("n"), F.explode(parents).alias("parent"))
    above = reachable(up, "n", "parent").select(F.col("from").alias("n"), F.col("to").alias("a"))
    pairs = types.select(F.col(name).alias("n"), F.col(name).alias("a")).unionByName(above).distinct()
    held = pairs.join(types.select(F.col(name).alias("a"), F.explode(own).alias("field")), "a")
    return held.groupBy(F.col("n").alias(name)).agg(F.array_sort(F.collect_set("field")).alias("fields"))


def with_preference(candidates: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key in this order."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


