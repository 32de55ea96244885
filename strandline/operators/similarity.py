"""Set-similarity joins: prefix filtering with sketches, and the complete size-window sweep it must equal."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.text import TOKEN
from strandline.runtime import cut

#: Frequent grams whose order is kept: the others count as rare. Any order gives the same pairs, a better one with less work.
KNOWN_GRAMS = 65_536
#: Words of 64 bits in the sketch of a set, and the members up to which a set fills one of them; from there on twice as many for twice the members.
SKETCH_WORDS, MEMBERS_A_WORD = 8, 96
#: Members that are sketched at a time, and records with candidates up to which their keys go to every task.
SKETCHED, FEW_KEYS = 1 << 18, 100_000
WORDS = [f"w{i}" for i in range(SKETCH_WORDS)]
#: Members of all sets for one bucket of prefix grams, pairs that are looked at at a time in it, and texts that are split at a time.
BUCKET_MEMBERS, PAIRS, TEXTS = 3_000_000, 1 << 19, 1 << 10


def gram_frequency(sets: DataFrame, key: str, members: str) -> DataFrame:
    """(gram, records) over all sets."""
    return sets.select(key, F.explode(F.array_distinct(members)).alias("gram")).groupBy("gram").agg(F.count("*").alias("records"))


class _TokenHashes(dict):
    """Hashes of token texts; those seen first are worked out and kept."""

    LIMIT = 1_000_000

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[token] = int.from_bytes(blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def _shingled(least_tokens: int):
    """Batches of (key, text) to rows (key, the sorted different hashes of adjacent tokens) of those with so many tokens."""
    hashes, split = _TokenHashes(), re.compile(TOKEN).findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            found = [split(t) for t in batch.column(1).to_pylist()]
            kept = [i for i, t in enumerate(found) if len(t) >= least_tokens]
            counts = np.array([len(found[i]) for i in kept], dtype=np.int64)
            ends = np.cumsum(counts)
            token = np.fromiter(map(hashes.__getitem__, chain.from_iterable(found[i] for i in kept)), np.uint64, int(counts.sum()))
            pair = _mix(_mix(token[:-1]) * np.uint64(0x9E3779B97F4A7C15) + token[1:]).view(np.int64)
            sets = [np.unique(pair[e - n : max(e - n, e - 1)]) for e, n in zip(ends.tolist(), counts.tolist())]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), lists], names=["id", "h"])

    return run


def shingle_sets(texts: DataFrame, key: str, text: str, least_tokens: int = 0) -> DataFrame:
    """(key, shingles) of the texts with so many tokens: functions.text.shingles of functions.text.tokens as hashes of 64 bits. Null texts have no row."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_shingled(least_tokens), f"id {rows.schema['id'].dataType.simpleString()}, h array<bigint>").select(F.col("id").alias(key), F.col("h").alias("shingles"))


def _sets(sets: DataFrame, key: str, members: str, least: int) -> DataFrame:
    """(id, h, k1, k2): each record with its set as sorted hashes, for which two hashes of the whole set stand, so that long sets aren't keys. Members that are bigint are their own hashes."""
    if sets.schema[members].dataType.simpleString() == "array<bigint>":
        own = F.array_except(members, F.array(F.lit(None).cast("bigint")))
    else:
        own = F.array_distinct(F.transform(F.array_compact(members), lambda g: F.xxhash64(g)))
    hashed = sets.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.sort_array(own).alias("h"))
    # sizes are looked at where the sets are read, or each set would be made twice; members come again in many sets, so a dictionary has most of them
    return cut(hashed.withColumns({"k1": F.xxhash64("h"), "k2": F.xxhash64(F.lit(17), "h")}), compression="zstd", **{"parquet.dictionary.page.size": str(8 << 20)}).where(F.size("h") >= max(1, least))


def _classes(clean: DataFrame) -> DataFrame:
    """(id, k1, k2, class_id): each record of _sets and the smallest id that has the same set. The sets themselves stay where they are."""
    named = clean.select("id", "k1", "k2")
    return cut(named.join(named.groupBy("k1", "k2").agg(F.min("id").alias("class_id")), ["k1", "k2"]).select("id", "k1", "k2", "class_id"))


def _mix(key: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return key ^ (key >> np.uint64(33))


def _length(sizes: np.ndarray) -> np.ndarray:
    """The words of the sketches of sets of these sizes."""
    length, half = np.full(len(sizes), SKETCH_WORDS, dtype=np.int64), SKETCH_WORDS // 2
    while half:
        length[sizes <= MEMBERS_A_WORD * half] = half
        half //= 2
    return length


def _sketches(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The words of each segment's sketch: a bit is set if an odd number of members fall on it, so two sketches differ in no more bits than their sets in members.

    A sketch of half the length is the first half combined with the second; small sets have only that.
    """
    place = _mix(values.view(np.uint64)) & np.uint64(64 * SKETCH_WORDS - 1)
    bit, word = np.uint64(1) << (place & np.uint64(63)), place >> np.uint64(6)
    words = [np.bitwise_xor.reduceat(np.where(word == np.uint64(i), bit, np.uint64(0)), starts) for i in range(SKETCH_WORDS)]
    half, length = SKETCH_WORDS // 2, _length(sizes)
    while half:
        short = length <= half
        for i in range(half):
            words[i] = np.where(short, words[i] ^ words[half + i], words[i])
            words[half + i] = np.where(short, np.uint64(0), words[half + i])
        half //= 2
    return words


def _prefixes(known: np.ndarray, rank: np.ndarray, threshold: float):
    """Batches of (id, k1, k2, h) to rows (id, k1, k2, n, prefix, the sketch's words): prefix has the rarest grams of each set in order, of which a set of that likeness must share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.diff(batch.column(3).offsets.to_numpy()).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SKETCHED, side="right")))
                part = batch.slice(at, upto - at)
                at = upto
                sizes = np.diff(part.column(3).offsets.to_numpy()).astype(np.int64)
                values = part.column(3).flatten().to_numpy(zero_copy_only=False)
                starts = np.cumsum(sizes) - sizes
                order = np.full(len(values), -1, dtype=np.int64)
                if len(known):
                    found = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    order = np.where(known[found] == values, rank[found], order)
                ordered = values[np.lexsort((values, order, np.repeat(np.arange(len(sizes)), sizes)))]
                kept = sizes - np.ceil(sizes * threshold - 1e-9).astype(np.int64) + 1
                prefix = ordered[np.arange(len(values)) - np.repeat(starts, sizes) < np.repeat(kept, sizes)]
                offsets = np.concatenate(([0], np.cumsum(np.minimum(kept, sizes)))).astype(np.int32)
                words = [pa.array(w.view(np.int64)) for w in _sketches(values, starts, sizes)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix)), *words], names=["id", "k1", "k2", "n", "prefix", *WORDS])

    return run


def _packed(buckets: int):
    """Batches of (id, n, prefix, the sketch's words) to rows (bucket, ids, n, sketch, grams, gram, place): the records that have prefix grams of one bucket, how many of them, and these with their places.

    A record stands once beside all its grams of a bucket, and not beside each. Grams are cut to 31 bits; what
    only these make equal is dropped with the pairs that aren't alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            gram = _mix(batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if not len(gram):
                continue
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            bucket, record = (gram >> np.uint64(32)) % np.uint64(buckets), np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(bucket, kind="stable")
            bucket, record_in, place = bucket[order], record[order], (np.arange(len(gram)) - np.repeat(np.cumsum(counts) - counts, counts))[order]
            begins = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            first = begins | np.concatenate(([True], record_in[1:] != record_in[:-1]))
            at = np.append(np.flatnonzero(begins), len(gram))
            holders, seen = record_in[first], np.cumsum(first)
            heads = np.append(seen[at[:-1]] - 1, len(holders))  # of each row, where its holders begin
            length = _length(sizes[holders])
            words = np.stack([batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(SKETCH_WORDS)], axis=1)[holders]
            sketch = words[np.arange(SKETCH_WORDS) < length[:, None]]
            grams, records, sketches = (pa.array(x.astype(np.int32)) for x in (at, heads, np.concatenate(([0], np.cumsum(length)))[heads]))
            lists = [pa.ListArray.from_arrays(records, batch.column(0).take(pa.array(holders))), pa.ListArray.from_arrays(records, pa.array(sizes[holders])), pa.ListArray.from_arrays(sketches, pa.array(sketch))]
            lists += [pa.ListArray.from_arrays(records, pa.array(np.diff(np.append(np.flatnonzero(first), len(gram))).astype(np.int32)))]
            lists += [pa.ListArray.from_arrays(grams, pa.array(x.astype(np.int32))) for x in ((gram & np.uint64(0x7FFFFFFF))[order], place)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[begins].astype(np.int32)), *lists], names=["bucket", "ids", "n", "sketch", "grams", "gram", "place"])

    return run


def _met(threshold: float):
    """The rows of _packed of one bucket to pairs (left_id, right_id), in any order, of records that share a gram of it and may be that alike."""

    def run(rows: pa.Table) -> pa.Table:
        flat = lambda name: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows.column(name).chunks])
        ids = pa.concat_arrays([c.flatten() for c in rows.column("ids").chunks])
        n, gram, place = flat("n").astype(np.int64), flat("gram").astype(np.int64), flat("place").astype(np.int64)
        owner = np.repeat(np.arange(len(n)), flat("grams"))
        length, sketch = _length(n), flat("sketch").view(np.uint64)
        starts = np.cumsum(length) - length
        words = np.zeros((SKETCH_WORDS, len(n)), dtype=np.uint64)
        for i in range(SKETCH_WORDS):
            words[i, length > i] = sketch[starts[length > i] + i]
        folded = {SKETCH_WORDS: words}  # by length; right for the records whose sketches are at least that long
        while (half := min(folded) // 2) > 0:
            folded[half] = folded[2 * half][:half] ^ folded[2 * half][half:]
        order = np.lexsort((n[owner], gram))
        owner, gram, place = owner[order], gram[order], place[order]
        size = n[owner]
        # a set meets those of at most its size; of these the first gram both have stands nearer to the beginning
        near = place < size - np.ceil(size * (2 * threshold / (1 + threshold)) - 1e-9) + 1
        key, other, other_place = (gram << 32 | size)[near], owner[near], place[near]
        low = np.searchsorted(key, gram << 32 | np.maximum(1, np.ceil(size * threshold - 1e-9)).astype(np.int64))
        count = np.searchsorted(key, gram << 32 | size, side="right") - low
        ends = np.cumsum(count)
        found, at = [np.empty(0, dtype=np.int64)], 0
        while at < len(count):
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            x = np.repeat(np.arange(at, upto), count[at:upto])
            y = np.arange(len(x)) - (ends[x] - count[x] - done) + low[x]
            at = upto
            a, b = owner[x], other[y]
            na, nb = n[a], n[b]
            # both sets are in the same order: from the first gram they share on (places count from 0), enough must be left
            keep = (np.minimum(na - place[x], nb - other_place[y]) >= (na + nb) * (threshold / (1 + threshold)) - 1e-9) & (a != b)
            a, b = a[keep], b[keep]
            for size_in_words, parts in folded.items():
                of = length[b] == size_in_words
                left, right = a[of], b[of]
                apart = np.zeros(len(left), dtype=np.int64)
                for part in parts:
                    apart += np.bitwise_count(part[left] ^ part[right])
                alike = apart <= (n[left] + n[right]) * ((1 - threshold) / (1 + threshold)) + 1e-6
                left, right = left[alike], right[alike]
                found.append(np.minimum(left, right) * len(n) + np.maximum(left, right))
            if len(found) > 64:
                found = [np.unique(np.concatenate(found))]
        pairs = np.unique(np.concatenate(found))
        return pa.table({"left_id": ids.take(pa.array(pairs // len(n))), "right_id": ids.take(pa.array(pairs % len(n)))})

    return run


def _candidates(prefixes: DataFrame, buckets: int, threshold: float) -> DataFrame:
    """(left_id, right_id) of different records of _prefixes that may be that alike, every pair that is among them."""
    kind = prefixes.schema["id"].dataType.simpleString()
    rows = prefixes.select("id", "n", "prefix", *WORDS).mapInArrow(_packed(buckets), f"bucket int, ids array<{kind}>, n array<int>, sketch array<bigint>, grams array<int>, gram array<int>, place array<int>")
    met = rows.groupBy("bucket").applyInArrow(_met(threshold), f"left_id {kind}, right_id {kind}")
    return met.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).where("left_id < right_id").distinct()


def _few(keys: DataFrame) -> DataFrame:
    """These keys, to go to every task where they are few."""
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys


def _similar(clean: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, likeness) between the representatives of _classes.

    Sets are long and stay in the table of _sets: what is moved are their prefixes with a sketch, then the sets of those
    records that are candidates.
    """
    grams = clean.select(F.explode("h").alias("gram")).groupBy("gram").agg(F.count("*").alias("records"))
    often = grams.where("records > 1").orderBy(F.desc("records"), "gram").limit(KNOWN_GRAMS).select("gram").toArrow()["gram"].to_numpy()
    by_value = np.argsort(often)
    schema = T.StructType([*clean.select("id", "k1", "k2").schema, T.StructField("n", T.IntegerType()), T.StructField("prefix", T.ArrayType(T.LongType())), *[T.StructField(w, T.LongType()) for w in WORDS]])
    every = clean.select("id", "k1", "k2", "h").mapInArrow(_prefixes(often[by_value], len(often) - by_value, threshold), schema)
    copies = classes.where("id <> class_id").select("id", "k1", "k2").distinct()
    buckets = 1 + (clean.agg(F.sum(F.size("h"))).first()[0] or 0) // BUCKET_MEMBERS
    pairs = cut(_candidates(every.join(_few(copies), ["id", "k1", "k2"], "left_anti"), buckets, threshold))
    first = classes.where("id = class_id").select("id", "k1", "k2").distinct()
    keys = cut(pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().join(first, "id"))
    opened = clean.join(_few(keys), ["id", "k1", "k2"], "left_semi").dropDuplicates(["id", "k1", "k2"])
    left, right = opened.select(F.col("id").alias("left_id"), F.col("h").alias("ha")), opened.select(F.col("id").alias("right_id"), F.col("h").alias("hb"))
    shared = F.size(F.array_intersect("ha", "hb"))
    both = pairs.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", shared.alias("shared"), (F.size("ha") + F.size("hb") - shared).alias("either"))
    return both.where(F.col("shared") >= F.col("either") * F.lit(threshold) - 1e-9).select("left_id", "right_id", F.round(F.col("shared") / F.col("either"), 6).alias("likeness"))


def similar_class_pairs(sets: DataFrame, key: str, members: str, threshold: float, least: int = 1) -> DataFrame:
    """(left_id, right_id, likeness) of all pairs of different sets with at least `least` members and that Jaccard likeness; left_id < right_id.

    Records with equal sets are one class, for which its smallest key stands: similar_classes says who belongs to
    which, so that n copies are n rows and not n squared. Members are hashed to 64 bits. Null sets and null members
    take no part.
    """
    clean = _sets(sets, key, members, least)
    return _similar(clean, _classes(clean), threshold)


def similar_pairs(sets: DataFrame, key: str, members: str, threshold: float, least: int = 1) -> DataFrame:
    """(left_id, right_id, likeness) of all pairs of records: those of similar_class_pairs with every class written out, copies of one set among them.

    The result grows with the square of the copies; where there may be many, take the classes.
    """
    clean = _sets(sets, key, members, least)
    classes = _classes(clean)
    own = classes.select("id", "class_id")
    left, right = own.select(F.col("id").alias("x"), F.col("class_id").alias("left_id")), own.select(F.col("id").alias("y"), F.col("class_id").alias("right_id"))
    between = _similar(clean, classes, threshold).join(left, "left_id").join(right, "right_id")
    within = left.join(right, F.col("left_id") == F.col("right_id")).where("x < y").withColumn("likeness", F.lit(1.0))
    both = between.select("x", "y", "likeness").unionByName(within.select("x", "y", "likeness"))
    return both.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "likeness")


def similar_classes(sets: DataFrame, key: str, members: str, threshold: float, least: int = 1) -> DataFrame:
    """(key, class_id, members, links): for each record the smallest key of its set, how many records have that set, and to how many other sets it is alike."""
    clean = _sets(sets, key, members, least)
    classes = _classes(clean)
    pairs = _similar(clean, classes, threshold)
    ends = pairs.select(F.explode(F.array("left_id", "right_id")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("members"))
    counted = sizes.join(ends, "class_id", "left")
    return classes.select("id", "class_id").join(counted, "class_id").select(F.col("id").alias(key), "class_id", "members", F.coalesce("links", F.lit(0)).alias("links"))


def window_pairs(sets: DataFrame, key: str, members: str, threshold: float) -> DataFrame:
    """The same pairs by comparing every two sets whose sizes allow it: complete and slow, the measure for similar_pairs on small inputs."""
    clean = sets.select(F.col(key).alias("id"), F.array_distinct(members).alias("m")).where(F.size("m") > 0)
    a = clean.select(F.col("id").alias("left_id"), F.col("m").alias("ma"), F.size("m").alias("na"))
    b = clean.select(F.col("id").alias("right_id"), F.col("m").alias("mb"), F.size("m").alias("nb"))
    pairs = a.join(b, (F.col("left_id") < F.col("right_id")) & (F.col("nb") <= F.col("na") / threshold + 1e-9) & (F.col("na") <= F.col("nb") / threshold + 1e-9))
    shared = F.size(F.array_intersect("ma", "mb"))
    scored = pairs.select("left_id", "right_id", shared.alias("shared"), (F.col("na") + F.col("nb") - shared).alias("either"))
    return scored.where(F.col("shared") >= F.col("either") * F.lit(threshold) - 1e-9).select("left_id", "right_id", F.round(F.col("shared") / F.col("either"), 6).alias("likeness"))


def blocked_name_pairs(names: DataFrame, key: str, words: str, block: list[str], least_shared: int = 2, least_likeness: float = 0.5) -> DataFrame:
    """(left_id, right_id, shared, likeness, left_members, right_members) of names of one block that are nested with one word more.

    The first word is part of the block, so only names about the same thing meet. Records with the same words are
    one name, for which the smallest key stands; its members are counted. A name finds the longer ones through the
    keys these make by leaving out one word at a time, so nothing is compared that isn't in the result.
    """
    rows = names.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), *block, F.array_distinct(words).alias("w")).where(F.size("w") >= least_shared)
    sets = rows.select("id", *block, F.element_at("w", 1).alias("head"), F.array_sort("w").alias("w"))
    on = [*block, "head", "w"]
    classes = cut(sets.groupBy(*on).agg(F.min("id").alias("id"), F.count("*").alias("members")))
    shorter = classes.select(*on, F.col("id").alias("short_id"), F.col("members").alias("short_members"))
    # the head stays, or the name would be about something else
    less = F.transform(F.filter(F.array_except("w", F.array("head")), lambda x: x.isNotNull()), lambda x: F.array_except("w", F.array(x)))
    longer = classes.where(F.size("w") > least_shared).select(*block, "head", F.size("w").alias("n"), F.explode(less).alias("w"), F.col("id").alias("long_id"), F.col("members").alias("long_members"))
    met = longer.join(shorter, on)
    first = F.col("short_id") < F.col("long_id")
    pairs = met.select(F.least("short_id", "long_id").alias("left_id"), F.greatest("short_id", "long_id").alias("right_id"), (F.col("n") - 1).cast("long").alias("shared"), F.round((F.col("n") - 1) / F.col("n"), 6).alias("likeness"), F.when(first, F.col("short_members")).otherwise(F.col("long_members")).alias("left_members"), F.when(first, F.col("long_members")).otherwise(F.col("short_members")).alias("right_members"))
    return pairs.where(F.col("likeness") >= least_likeness)
