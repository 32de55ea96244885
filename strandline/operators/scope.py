"""What changed, and results held to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, state) of two snapshots: 'changed', 'deleted', 'added', or 'moved' for a new path with a vanished path's content; unchanged paths are left out."""
    old, new = before.select(path, F.col(digest).alias("_old")), after.select(path, F.col(digest).alias("_new"))
    both = old.join(new, path, "full_outer")
    gone = both.where("_new is null").select(F.col("_old").alias("_new")).distinct().withColumn("_moved", F.lit(True))
    state = F.when(F.col("_old").isNull(), F.when(F.col("_moved"), "moved").otherwise("added")).when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed")
    return both.join(gone, "_new", "left").select(path, state.alias("state")).where("state is not null")


def in_scope(rows: DataFrame, place: str, changed: DataFrame | None, moved: DataFrame | None = None) -> DataFrame:
    """Rows whose place changed (or moved). Without a scope (None) all rows are in it; an empty one holds none."""
    if changed is None:
        return rows
    places = changed.select(place)
    if moved is not None:
        places = places.unionByName(moved.select(place))
    return rows.join(places.distinct(), place, "left_semi")


def without_accepted(findings: DataFrame, identity: str, accepted: DataFrame) -> DataFrame:
    """Findings whose identity isn't accepted; those without an identity are kept."""
    return findings.join(accepted.select(identity).where(F.col(identity).isNotNull()).distinct(), identity, "left_anti")


def in_globs(rows: DataFrame, path: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Rows by path patterns: excluded ones go, then, if any is given, only included ones stay."""
    from strandline.functions.paths import glob_regex

    for glob in exclude:
        rows = rows.where(~F.col(path).rlike(glob_regex(glob)))
    if include:
        hit = F.lit(False)
        for glob in include:
            hit = hit | F.col(path).rlike(glob_regex(glob))
        rows = rows.where(hit)
    return rows


def ignored(rows: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """The rows with `ignored` by ignore rules of which the last that matches decides, and `rule` (its number, from 0; null without one)."""
    from strandline.functions.paths import ignore_regex

    verdict, number = F.lit(False), F.lit(None).cast("int")
    for n, rule in enumerate(rules):
        regex, negated = ignore_regex(rule)
        hit = F.col(path).rlike(regex)
        verdict = F.when(hit, F.lit(not negated)).otherwise(verdict)
        number = F.when(hit, F.lit(n)).otherwise(number)
    return rows.withColumns({"ignored": verdict, "rule": number})


def ignored_in_tree(rows: DataFrame, path: str, rules: DataFrame) -> DataFrame:
    """The rows with `ignored` by ignore files anywhere above them: rules(dir, ord, rule), dir '' being the root.

    A rule counts for paths below its directory and is matched against what follows it; of all that match, one of a
    deeper file wins over one further up, and a later line over an earlier one. Rules with equal text are compiled once
    on the driver: their number is that of the different lines, not of the files.
    """
    from strandline.functions.paths import ancestors, ignore_regex

    spark = rows.sparkSession
    lines = [r[0] for r in rules.select("rule").where("trim(rule) <> '' and not rule like '#%'").distinct().limit(MOST_RULES + 1).collect()]
    if len(lines) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} different ignore rules")
    compiled = spark.createDataFrame([(line, *ignore_regex(line.strip())) for line in lines], "rule string, regex string, negated boolean")
    known = rules.join(F.broadcast(compiled), "rule").groupBy(F.col("dir").alias("_dir")).agg(F.collect_list(F.struct("ord", "regex", "negated")).alias("_rules"))
    each = rows.select(path).distinct().select(path, F.posexplode(ancestors(F.col(path))).alias("_depth", "_dir")).join(known, "_dir")
    rest = F.when(F.col("_dir") == "", F.col(path)).otherwise(F.substring(F.col(path), F.length("_dir") + 2, F.length(path)))
    hit = each.withColumn("_rest", rest).select(path, "_depth", "_rest", F.explode("_rules").alias("_r")).where("rlike(_rest, _r.regex)")
    last = hit.groupBy(path).agg(F.max_by(~F.col("_r.negated"), F.struct("_depth", "_r.ord")).alias("_ignored"))
    return rows.join(last, path, "left").withColumn("ignored", F.coalesce("_ignored", F.lit(False))).drop("_ignored")


#: Different ignore rules that are compiled at once.
MOST_RULES = 100_000


def configured(findings: DataFrame, path: str, ignore: list[str] = (), only: dict[str, list[str]] | None = None, severities: dict[str, str] | None = None) -> DataFrame:
    """Findings (rule, severity, path, ...) as the configuration wants them: ignored paths and rules that are off go, a rule with path patterns keeps those, severities are replaced."""
    from strandline.functions.paths import glob_regex

    for glob in ignore:
        findings = findings.where(F.col(path).isNull() | ~F.col(path).rlike(glob_regex(glob)))
    for rule, globs in (only or {}).items():
        hit = F.lit(False)
        for glob in globs:
            hit = hit | F.coalesce(F.col(path).rlike(glob_regex(glob)), F.lit(False))
        findings = findings.where((F.col("rule") != rule) | hit)
    wanted = severities or {}
    if wanted:
        named = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
        findings = findings.withColumn("severity", F.coalesce(F.try_element_at(named, F.col("rule")), "severity"))
    return findings.where("severity <> 'off'")
