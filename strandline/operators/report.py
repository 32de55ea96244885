"""Findings: ranking, order, rendering, census, exit code, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def severity_rank(name: Column) -> Column:
    return F.when(name == "error", 0).when(name == "warning", 1).when(name == "info", 2).otherwise(3)


def ranked(findings: DataFrame) -> DataFrame:
    """By score, greatest first (a missing one last), then path and line."""
    return findings.orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "path", "line")


def sorted_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "col", severity_rank(F.col("severity")), "rule")


def rendered(findings: DataFrame, form: str = "unix") -> DataFrame:
    """(line_text) of findings(path, line, col, severity, rule, message) as 'text', 'unix', 'stylish', 'github' or 'json'."""
    where = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    text = {
        "text": F.concat(where, F.lit(" "), F.col("severity"), F.lit(" "), F.col("message"), F.lit(" ("), F.col("rule"), F.lit(")")),
        "unix": F.concat(where, F.lit(": "), F.col("message"), F.lit(" ["), F.col("severity"), F.lit("/"), F.col("rule"), F.lit("]")),
        "stylish": F.concat(F.lit("  "), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit("  "), F.col("severity"), F.lit("  "), F.col("message"), F.lit("  "), F.col("rule")),
        "github": F.concat(F.lit("::"), F.when(F.col("severity") == "error", "error").when(F.col("severity") == "warning", "warning").otherwise("notice"), F.lit(" file="), F.col("path"), F.lit(",line="), F.col("line").cast("string"), F.lit(",col="), F.col("col").cast("string"), F.lit("::"), F.col("message")),
        "json": F.to_json(F.struct("path", "line", "col", "severity", "rule", "message")),
    }[form]
    return findings.select(text.alias("line_text"))


def exit_code(findings: DataFrame, most_warnings: int = -1) -> int:
    """1 if any finding is an error, or if there are more warnings than allowed (negative allows all); else 0."""
    row = findings.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings")).first()
    return int(row["errors"] > 0 or (0 <= most_warnings < row["warnings"]))


def census(findings: DataFrame, by: list[str]) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("total"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.count(F.when(F.col("severity") == "info", 1)).alias("notices"))


def funnel(drops: DataFrame, by: list[str], example: str) -> DataFrame:
    """How many were dropped at each stage, with the smallest example."""
    return drops.groupBy(*by).agg(F.count("*").alias("dropped"), F.min(example).alias("example"))


def listed(names: Column, most: int = 4) -> Column:
    """The first names of an array and how many more there are."""
    n = F.size(names)
    return F.when(n <= most, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" and "), (n - most).cast("string"), F.lit(" more")))


def keyword_search(rows: DataFrame, query: str, texts: list[str], key: str, most: int = 200) -> DataFrame:
    """(key, hits): rows that contain most of the query's words of three or more letters; the top `most`, ties by key. The limit is the feature."""
    words = sorted({w for w in query.lower().split() if len(w) > 2})
    whole = F.lower(F.concat_ws(" ", *texts))
    hits = sum((F.contains(whole, F.lit(w)).cast("int") for w in words), F.lit(0))
    return rows.select(key, hits.alias("hits")).where("hits > 0").orderBy(F.col("hits").desc(), F.col(key)).limit(most)


def fill(template: str, **data: Column) -> Column:
    """{{name}} places filled from columns; a name without a column is an error when the plan is made."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{(\w+)\}\}", template):
        if m.group(1) not in data:
            raise KeyError(m.group(1))
        parts += [F.lit(template[at : m.start()]), data[m.group(1)].cast("string")]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def finding_identity(rule: Column, symbol: Column, files: Column) -> Column:
    return F.concat_ws("\0", rule, symbol, F.array_join(F.array_sort(F.array_distinct(files)), "\0"))
