"""File scans: folders of texts, manifests, ignore rules, and a parse cache keyed by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.paths import glob_regex
from strandline.operators.scope import ignored

#: fixed values: folders that are never source
SKIPPED = ["node_modules", ".git", "dist", "build", "coverage", ".next", "out"]


def text_files(spark: SparkSession, places: list[str], endings: list[str], rules: list[str] = (), include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, text) of the files under places (folders or files) with one of these endings.

    Spark lists and reads the files in parallel; `rules` are ignore rules of which the last match decides.
    Declaration files (.d.ts) are left out. Without `include` every file is in scope; exclude wins.
    """
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(list(places)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.where(F.col("path").rlike(r"\.(?:" + "|".join(endings) + r")$") & ~F.col("path").rlike(r"\.d\.[cm]?ts$"))
    rows = rows.where(~F.col("path").rlike(r"/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"))
    if rules:
        rows = ignored(rows, "path", list(rules)).where("not ignored").drop("ignored", "rule")
    for glob in exclude:
        rows = rows.where(~F.col("path").rlike(glob_regex(glob)))
    if include:
        rows = rows.where(_any(F.col("path"), include))
    return rows


def _any(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for glob in globs:
        hit = hit | path.rlike(glob_regex(glob))
    return hit


def listed(files: DataFrame, path: str, manifest: DataFrame, manifest_path: str) -> DataFrame:
    """Files that a manifest lists."""
    return files.join(manifest.select(F.col(manifest_path).alias(path)).distinct(), path, "left_semi")


def package_manifests(spark: SparkSession, places: list[str]) -> DataFrame:
    """(dir, name, summary, declares) of the package.json files under places; one that isn't JSON gives a row without a name."""
    read = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "package.json").text(list(places))
    schema = "name string, description string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>"
    parsed = read.select(F.regexp_replace(F.col("_metadata.file_path"), "/package.json$", "").alias("dir"), F.from_json("value", schema).alias("p"))
    empty = F.array().cast("array<string>")
    declares = F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.map_keys(F.col(f"p.{c}")), empty) for c in ("dependencies", "devDependencies", "peerDependencies")])))
    return parsed.select("dir", F.col("p.name").alias("name"), F.col("p.description").alias("summary"), declares.alias("declares"))


def cached_parse(files: DataFrame, path: str, text: str, cache: DataFrame | None, tool: str) -> tuple[DataFrame, DataFrame | None]:
    """(to parse, still good): files whose (path, content) the cache doesn't have, and the cache's rows that hold. Another tool version discards the cache whole."""
    keyed = files.withColumn("digest", F.substring(F.sha1(text), 1, 16))
    if cache is None:
        return keyed, None
    good = cache.where(F.col("tool") == tool).join(keyed.select(path, "digest"), [path, "digest"], "left_semi")
    return keyed.join(good.select(path, "digest").distinct(), [path, "digest"], "left_anti"), good


def type_facts(documents: DataFrame, doc: str, type_id: str, display: str, arguments: str, most: int = 8) -> DataFrame:
    """(doc, type_id, display, argument_displays): types of several documents whose ids are local, with their arguments resolved; the longest display wins."""
    best = documents.groupBy(doc, type_id).agg(F.max_by(display, F.length(display)).alias(display), F.max_by(arguments, F.length(display)).alias(arguments))
    each = best.select(doc, type_id, F.posexplode_outer(F.slice(arguments, 1, most)).alias("at", "argument"))
    names = best.select(doc, F.col(type_id).alias("argument"), F.col(display).alias("_d"))
    resolved = each.join(names, [doc, "argument"], "left").groupBy(doc, type_id).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("at", "_d")))), lambda x: x["_d"]).alias("argument_displays"))
    return best.select(doc, type_id, display).join(resolved, [doc, type_id])
