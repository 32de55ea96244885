"""The rules over the test tables: candidates by rule, and findings with answers that are made of the questions alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import rule_set, rules
from strandline.plans.code_queries import _files, _imports, _units, imports_package
from strandline.plans.judging_queries import _module_graph, _roles
from strandline.plans.registry import ORACLE, query
from strandline.plans.site_queries import RETURN_TYPE, _calls
from strandline.runtime import table


def rule_tables(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "file_path", "kind", "name", "exported", "is_test", "shape_hash", "type_refs", "field_types", "start_pos", "text", F.size("tokens").alias("n_tokens"), F.array_sort(F.map_keys("field_types")).alias("fields"))
    units = units.withColumn("returns", F.filter(F.array(F.regexp_extract("text", RETURN_TYPE, 1)), lambda x: x != ""))
    pairs = table(spark, sf_dir, "scored_pairs").where("score between 0.7 and 1 and left_id <> right_id")
    nulls = units.select("repo", "is_test", F.explode("field_types").alias("field", "t")).groupBy("repo", "field", "is_test").agg(F.bool_or(F.startswith("t", F.lit("?"))).alias("nullable"))
    used = _imports(spark, sf_dir).withColumn("package", imports_package())
    declared = _files(spark, sf_dir, "repo", "path").select("repo", F.explode(F.split("path", "/")).alias("word")).select("repo", F.concat(F.lit("@app/"), "word").alias("package"))
    internal = spark.createDataFrame([("@app/amber",), ("@app/vault",)], "package string")
    return {
        "units": units, "calls": _calls(spark, sf_dir), "sequences": units.where("kind = 'function'").select("unit_id", F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\("), F.lit(1)).alias("items")),
        "links": pairs.select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), F.coalesce(F.col("rule_id") == "close-names", F.lit(False)).alias("weak")),
        "columns": nulls.where("not is_test").drop("is_test"), "mapped": nulls.where("is_test").drop("is_test"), "uses": used.where("specifier like '@%'").join(internal, "package", "left_anti"), "declared": declared,
        "imports": used.select("specifier", "repo", "path").distinct(), "files": _files(spark, sf_dir, "repo", "path", "text"),
        "module_edges": _module_graph(spark, sf_dir), "module_roles": _roles(spark, sf_dir).drop("repo").distinct(),
    }


#: rules whose candidates are the rows of a query that has SQL of its own
SAME_AS = {
    "same-shape": "duplicate_shapes", "nested-fields": "field_set_containment", "recurring-fields": "field_group_mining", "unnamed-fields": "key_set_groups", "drifting-type": "field_type_drift", "drifting-null": "nullability_drift",
    "same-calls": "call_pattern_groups", "undeclared-package": "undeclared_dependency", "upward-role": "upward_roles", "shallow-file": "shallow_files", "tests-only": "used_by_tests_only", "carries-caller": "caller_literals",
    "own-string": "strings_beside_helpers", "uncounted-skip": "unaccounted_skips", "outage": "outage_shapes",
}


@query(" union all ".join(f"select '{rule}' as rule, count(*)::bigint as candidates from ({ORACLE[name]})" for rule, name in SAME_AS.items()))
def rule_candidates(spark, sf_dir):
    known = rule_set.registry(rule_tables(spark, sf_dir))
    tables = rule_tables(spark, sf_dir)
    planned = rules.plans([known.rules[r] for r in SAME_AS], tables)
    counted = planned.groupBy("rule").agg(F.count("*").alias("candidates"))
    every = spark.createDataFrame([(r,) for r in SAME_AS], "rule string")
    return every.join(counted, "rule", "left").select("rule", F.coalesce("candidates", F.lit(0)).alias("candidates"))


@query(None)
def rule_findings(spark, sf_dir):
    """All rules whose tables are there, with stub answers: findings and drops by rule and band."""
    tables = rule_tables(spark, sf_dir)
    known = rule_set.registry(tables)
    chosen = list(known.rules.values())
    planned = rules.plans(chosen, tables)
    found, dropped = rules.judged(planned, rules.stub_answers(planned, {r.id: r.violations for r in chosen}), chosen)
    both = found.select("rule", "band").unionByName(dropped.select("rule", F.col("stage").alias("band")))
    return both.groupBy("rule", "band").agg(F.count("*").alias("candidates"))

