"""Runs: what one was made of, replaying it, the baseline it is held against, and where its input changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from strandline.functions.hashing import canonical, sha16


def manifest(files: DataFrame, path: str, digest: str, config: dict) -> DataFrame:
    """One row (manifest): a digest of all (path, digest) pairs, whatever their order, and of the configuration.

    Pairs are put into 256 parts by a digest of the path; each part's pairs are sorted and digested, then the parts.
    """
    pair = F.concat_ws("\0", path, digest)
    parts = files.groupBy(F.substring(F.sha1(F.col(path)), 1, 2).alias("part")).agg(F.sha1(F.array_join(F.array_sort(F.collect_set(pair)), "\n")).alias("d"))
    whole = parts.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "part", "d"))), "\n").alias("all"))
    return whole.select(sha16(F.concat(F.coalesce("all", F.lit("")), F.lit("\n" + canonical(config)))).alias("manifest"))


def store_run(findings: DataFrame, mark: str, place: str) -> None:
    """Keeps a whole run's findings with its manifest; a scoped run says nothing about the rest and isn't to be stored."""
    findings.write.mode("overwrite").parquet(f"{place}/findings")
    findings.sparkSession.createDataFrame([(mark,)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{place}/manifest")


def replay(spark: SparkSession, mark: str, place: str) -> DataFrame | None:
    """The stored findings if they were made of the same manifest, else None; a store that can't be read is none."""
    try:
        stored = spark.read.parquet(f"{place}/manifest").first()
        return spark.read.parquet(f"{place}/findings") if stored and stored["manifest"] == mark else None
    except AnalysisException:
        return None


def baseline_fragments(findings: DataFrame, identity: str) -> DataFrame:
    """(fragment, identity): one for each accepted identity, named by its digest; findings without an identity can't be accepted."""
    return findings.where(F.col(identity).isNotNull()).select(F.col(identity).alias("identity")).distinct().select(sha16(F.col("identity")).alias("fragment"), "identity")


def write_baseline(findings: DataFrame, identity: str, place: str) -> None:
    """Replaces the baseline: fragments in folders of their first two digits, so that stale ones go and equal ones stay where they are."""
    rows = baseline_fragments(findings, identity).withColumn("shard", F.substring("fragment", 1, 2))
    rows.repartition("shard").sortWithinPartitions("shard", "fragment").write.mode("overwrite").partitionBy("shard").json(place)


def read_baseline(spark: SparkSession, place: str) -> DataFrame:
    """(identity) of a baseline; a fragment whose name isn't the digest of its identity counts for nothing."""
    read = spark.read.schema("fragment string, identity string").json(place)
    return read.where(sha16(F.col("identity")) == F.col("fragment")).select("identity")


def change_source(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """(path, status, old_path) between two snapshots: 'A' added, 'M' changed, 'D' deleted, 'R100' for a new path that has a vanished one's whole content.

    Of several vanished paths with one content the smallest stands for all; each new path with it counts as renamed from it.
    """
    both = before.select(path, F.col(digest).alias("_old")).join(after.select(path, F.col(digest).alias("_new")), path, "full_outer")
    gone = both.where("_new is null").groupBy(F.col("_old").alias("_new")).agg(F.min(path).alias("old_path"))
    status = F.when(F.col("_old").isNull(), F.when(F.col("old_path").isNotNull(), "R100").otherwise("A")).when(F.col("_new").isNull(), "D").when(F.col("_old") != F.col("_new"), "M")
    named = both.join(gone, "_new", "left").withColumn("status", status).where("status is not null")
    return named.select(path, "status", F.when(F.col("status") == "R100", F.col("old_path")).alias("old_path"))


def affected(changed: DataFrame, edges: DataFrame, before: DataFrame, after: DataFrame, path: str, source: str, target: str, exports: str) -> DataFrame:
    """(path) of the changed files and of those that import one whose set of exported names differs between the snapshots."""
    def named(rows: DataFrame, alias: str) -> DataFrame:
        return rows.select(path, F.array_join(F.array_sort(F.col(exports)), ",").alias(alias))

    sets = changed.select(path).distinct().join(named(before, "_was"), path, "left").join(named(after, "_now"), path, "left")
    moved = sets.where(F.coalesce("_was", F.lit("")) != F.coalesce("_now", F.lit("")))
    importers = edges.join(moved.select(F.col(path).alias(target)), target, "left_semi").select(F.col(source).alias(path))
    return changed.select(path).unionByName(importers).distinct()


def outside_root(files: DataFrame, path: str, cache_named: bool) -> DataFrame:
    """Files that lie outside the root, whose judgements would reach a store that doesn't own them; none where the store was named on purpose."""
    escaping = files.where(F.startswith(path, F.lit("..")))
    return escaping.limit(0) if cache_named else escaping
