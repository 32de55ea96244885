"""Import edges: statements from texts, resolution to paths, packages nobody declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.paths import directory

#: fixed values: what a specifier may stand for, tried in this order
SUFFIXES = ["", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js"]
#: fixed values: marks of a path from the project's root, and the directories above an importer that may be that root
ROOT_MARK, MOST_ANCESTORS = r"^[~@]/", 8
STATEMENT = r"(?m)^import[ \t]+([^;'\"]*)from[ \t]+['\"]([^'\"\n]+)['\"]"


def import_statements(files: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., specifier, clause, type_only): the import statements of each file; type_only if the clause says so for all."""
    whole = F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0))
    each = files.select(*keep, F.explode(whole).alias("statement"))
    clause = F.trim(F.regexp_extract("statement", STATEMENT, 1))
    return each.select(*keep, F.regexp_extract("statement", STATEMENT, 2).alias("specifier"), clause.alias("clause"), clause.rlike(r"^type[ \t]").alias("type_only"))


def normal_path(path):
    """A path without . and .. segments."""
    def step(done, part):
        return F.when((part == ".") | (part == ""), done).when(part == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve(edges: DataFrame, within: str, importer: str, specifier: str, files: DataFrame, path: str) -> DataFrame:
    """The edges with `resolved`: the first of the specifier's possible paths that is a file of the same `within`; null if none is.

    A relative specifier starts at the importer's directory. Any other may start at the importer's directory or one
    above it, the nearest first, at most MOST_ANCESTORS of them; a package resolves to nothing that way, as it
    should. A specifier with a leading slash isn't resolved.
    """
    keyed = edges.withColumn("_edge", F.xxhash64(within, importer, specifier))
    each = keyed.select("_edge", within, importer, specifier).distinct()
    place = directory(F.col(importer))
    parts = F.filter(F.split(place, "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(MOST_ANCESTORS - 1))), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/"))
    named = F.regexp_replace(F.col(specifier), ROOT_MARK, "")
    relative = F.col(specifier).rlike(r"^\.")
    bases = F.when(relative, F.array(F.concat_ws("/", place, F.col(specifier)))).otherwise(F.transform(above, lambda d: F.concat_ws("/", d, named)))
    spread = each.where(F.col(specifier).isNotNull() & ~F.col(specifier).rlike("^/")).select("_edge", within, F.posexplode(bases).alias("_far", "_base"))
    options = F.array(*[F.struct(F.lit(n).alias("suffix"), F.lit(x).alias("text")) for n, x in enumerate(SUFFIXES)])
    tried = spread.withColumn("_base", normal_path(F.col("_base"))).select("_edge", within, "_far", "_base", F.explode(options).alias("o"))
    tried = tried.select("_edge", within, F.struct("_far", "o.suffix").alias("prio"), F.concat("_base", "o.text").alias(path))
    found = tried.join(files.select(within, path).distinct(), [within, path]).groupBy("_edge").agg(F.min_by(path, "prio").alias("resolved"))
    return keyed.join(found, "_edge", "left").drop("_edge")


def importers_of_name(edges: DataFrame, target: str, names: str, importer: str) -> DataFrame:
    """(target, name, importers): how many files import each name from each file; edges without a resolved target don't count."""
    each = edges.where(F.col(target).isNotNull()).select(target, importer, F.explode(names).alias("name")).where("name <> ''")
    return each.groupBy(target, "name").agg(F.count_distinct(importer).alias("importers"))


def imported_names(clause: Column) -> Column:
    """The names that an import clause takes from the other file: those in braces before an `as`, 'default' for a default import, '*' for a namespace."""
    bare = F.regexp_replace(clause, r"^type[ \t]+", "")
    inner = F.regexp_extract(bare, r"\{([^}]*)\}", 1)
    listed = F.transform(F.split(inner, ","), lambda x: F.regexp_extract(F.trim(F.regexp_replace(x, r"^\s*type\s+", "")), r"^([\w$]+)", 1))
    star = F.when(bare.rlike(r"\*\s*as\b"), F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    default = F.when(bare.rlike(r"^[\w$]+"), F.array(F.lit("default"))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(default, star, listed), lambda x: x != "")


def undeclared(uses: DataFrame, package: str, within: str, declared: DataFrame, internal: list[str]) -> DataFrame:
    """(within, package, uses) of packages used without being declared in the same place, built in or internal."""
    rows = uses.where(F.col(package).isNotNull() & ~F.col(package).isin(internal))
    rows = rows.join(declared.select(within, package).distinct(), [within, package], "left_anti")
    return rows.groupBy(within, package).agg(F.count("*").alias("uses"))
