"""Generated, minified or vendored source files: clusters of identifier-masked token shingles.

Each file becomes the set of its masked five-token shingles. MinHash prefixes (neardup's forest) propose
pairs, exact likeness of 0.9 or more verifies them, and the links form clusters. What a cluster is follows from its
own shape. Code written by hand after one pattern forms clusters too, but short ones: what their members share
is no more than chance gives. So a cluster counts if it is of nothing but literals (blobs), if its members say the
same few things over and over, as emitted code does, or if the shingles they share are so rare in the whole
collection that they can't have met by chance. Within one repository that is a family, as generators make; across
repositories it is what copying or a common tool makes. Members of other clusters are compared as written: near-identical
ones of several repositories, or beside one with a sign of its origin, are copies.

A file that has no like in the collection can't be found by any cluster. For these the signs a file bears by
itself (its path, its banner, the shape of its tokens) decide; found_by tells which of the two found a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.file_evidence import code_tokens, masked_kinds, signs
from strandline.llm.neardup import set_groups
from strandline.runtime import cut

SHINGLE = 5
LIKENESS = 0.9
DEPTH = 16
#: Files of a cluster of which the shape can say something, the bits of information in what its members share, and how often
#: on average a member repeats each of its shingles.
LEAST_FILES, LEAST_BITS, LEAST_REPEATS = 3, 300.0, 10.0
#: Files that a smaller collection counts as when tokens as written are weighed: what is rare in a few files may be common elsewhere.
PRIOR_FILES = 1_000
#: Signs that lie in where a file stands or whence it came.
ORIGIN_SIGNS = ("vendored_path", "vendored_text", "wrapper")


def shingle_hashes(kinds: str) -> np.ndarray:
    """The sorted different hashes of five consecutive kinds; a shorter text is one shingle, an empty one none."""
    codes = np.frombuffer(kinds.replace("\n", "").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if not len(codes):
        return np.empty(0, dtype=np.int64)
    n = max(1, len(codes) - SHINGLE + 1)
    key = np.zeros(n, dtype=np.uint64)
    for d in range(min(SHINGLE, len(codes))):
        key = (key + codes[d : d + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return np.unique(key.view(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, literal, hashes, lengths = [], [], [], []
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
            kinds = masked_kinds(text or "")
            s, only = signs(path, text, kinds)
            found.append(s)
            literal.append(only)
            hashes.append(shingle_hashes(kinds))
            lengths.append(len(kinds) - kinds.count("\n"))
        kept = batch.select(["id", "repo", "seen"])
        offsets = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(hashes) if hashes else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.list_(pa.string())), pa.array(literal, pa.bool_()), pa.array(lengths, pa.int32()), lists], names=["id", "repo", "seen", "signs", "literal", "length", "hashes"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of five consecutive tokens as written, comments left out."""
    for batch in batches:
        hashes = []
        for text in batch.column("text").to_pylist():
            tokens = code_tokens(text or "")
            runs = {"\0".join(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()
            hashes.append(sorted(int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for x in runs))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("seen"), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "seen", "hashes"])


def _evidence(read: DataFrame, members: DataFrame, total: DataFrame) -> DataFrame:
    """(id, bits) of members(id): the information in a file's shingles, each -log2 of the share of the `total` rows that have it in read(id, seen, hashes)."""
    spread = read.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    mine = read.join(members, "id", "left_semi").select("id", "seen", F.explode("hashes").alias("h")).join(spread, "h")
    bits = mine.crossJoin(F.broadcast(total)).groupBy("id", "seen").agg(F.sum(F.log2(F.col("total") / F.col("df"))).alias("bits"))
    return bits.groupBy("id").agg(F.max("bits").alias("bits"))


def file_origins(files: DataFrame, key: str = "file_id", order: str = "ingested_at", use_signs: bool = True) -> DataFrame:
    """(key, repo, signs, cluster_id, cluster_files, cluster_repos, cluster_kind, found_by, handwritten) for every file; needs repo, path, text.

    cluster_kind is 'family', 'copies' or 'blobs' by the cluster's own shape, else null; a file in no cluster is its
    own. found_by is 'cluster', 'signs' (borne by the file itself), 'both', or null for files written by hand.
    Without `use_signs` only clusters decide. Rows of one key count once, the one with the greatest `order`; null
    and empty texts are hand-written unless their path says otherwise.
    """
    rows = files.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), "repo", F.col(order).cast("timestamp").alias("seen"), "path", "text")
    read = cut(rows.mapInArrow(_read, "id long, repo string, seen timestamp, signs array<string>, literal boolean, length int, hashes array<bigint>"))
    # one row of one number
    total = read.agg(F.count("*").alias("total"))
    repeats = F.col("length") / F.greatest(F.size("hashes"), F.lit(1))
    facts = read.groupBy("id").agg(F.max_by(F.struct("repo", "signs", "literal", repeats.alias("repeats")), F.struct(F.col("seen").isNotNull().alias("known"), "seen")).alias("f")).select("id", "f.*")
    if not use_signs:
        facts = facts.withColumn("signs", F.array().cast("array<string>"))
    groups = set_groups(read.select("id", "seen", "hashes"), LIKENESS, depth=DEPTH, steps=(0,))
    origin = F.exists("signs", lambda s: s.isin(*ORIGIN_SIGNS))
    placed = cut(facts.join(groups, "id", "left").select("id", "repo", "signs", "literal", "repeats", F.coalesce("group_id", "id").alias("cluster_id"), origin.alias("origin")))
    sizes = placed.groupBy("cluster_id").agg(F.count("*").alias("cluster_files"), F.count_distinct("repo").alias("cluster_repos"), F.min("repeats").alias("repeats"), F.min(F.col("literal").cast("int")).alias("all_literal"))
    several = cut(sizes.where("cluster_files > 1"))
    inside = placed.join(several.where(F.col("cluster_files") >= LEAST_FILES).select("cluster_id"), "cluster_id", "left_semi").select("id", "cluster_id")
    bits = inside.join(_evidence(read, inside.select("id"), total), "id").groupBy("cluster_id").agg(F.min("bits").alias("bits"))
    telling = (F.col("cluster_files") >= LEAST_FILES) & ((F.col("bits") >= LEAST_BITS) | (F.col("repeats") >= LEAST_REPEATS))
    kind = F.when(F.col("all_literal") == 1, "blobs").when(telling, F.when(F.col("cluster_repos") <= 1, "family").otherwise("copies"))
    shaped = several.join(bits, "cluster_id", "left").select("cluster_id", "cluster_files", "cluster_repos", kind.alias("cluster_kind"))
    judged = cut(placed.drop("literal", "repeats").join(shaped, "cluster_id", "left").withColumns({"cluster_files": F.coalesce("cluster_files", F.lit(1)), "cluster_repos": F.coalesce("cluster_repos", F.col("repo").isNotNull().cast("long"))}))
    copied = _copied(rows, judged.where("cluster_kind is null and cluster_files >= 2").select("id", "repo", "origin"), total)
    judged = judged.join(copied, "id", "left").withColumn("cluster_kind", F.coalesce("cluster_kind", "copied"))
    signed, clustered = F.size("signs") > 0, F.col("cluster_kind").isNotNull()
    found_by = F.when(signed & clustered, "both").when(clustered, "cluster").when(signed, "signs")
    return judged.select(F.col("id").alias(key), "repo", "signs", "cluster_id", "cluster_files", "cluster_repos", "cluster_kind", found_by.alias("found_by"), found_by.isNull().alias("handwritten"))


def _copied(rows: DataFrame, members: DataFrame, total: DataFrame) -> DataFrame:
    """(id, copied): 'copies' for those of members(id, repo, origin) whose tokens as written are nearly another's: one of another repository, or one taken over by its own signs.

    As for masked shingles, what they share must be more than chance gives: a one-line file is no copy of another.
    """
    members = cut(members)
    texts = rows.join(members.select("id"), "id", "left_semi").select("id", "seen", "text")
    total = total.select(F.greatest("total", F.lit(PRIOR_FILES)).alias("total"))
    written = cut(texts.mapInArrow(_written, "id long, seen timestamp, hashes array<bigint>"))
    if written.isEmpty():
        return members.select("id", F.lit("copies").alias("copied")).limit(0)
    groups = cut(set_groups(written, LIKENESS, depth=DEPTH, steps=(0,)))
    groups = groups.join(members, "id").join(_evidence(written, groups.select("id"), total), "id")
    alike = groups.groupBy("group_id").agg(F.count("*").alias("n"), F.count_distinct("repo").alias("repos"), F.max("origin").alias("origin"), F.min("bits").alias("bits")).where("n >= 2 and (repos >= 2 or origin)").where(F.col("bits") >= LEAST_BITS)
    return groups.join(alike.select("group_id"), "group_id", "left_semi").select("id", F.lit("copies").alias("copied"))
