"""Subject area of each document: averaged word and subword embeddings with independent logistic outputs.

A document is the weighted mean of the embeddings of its words, word pairs and character n-grams, hashed
into a fixed number of rows; a feature weighs as much as the labelled documents that have it differ in
their subjects from all labelled ones, so what documents of every subject say weighs nothing. One logistic output for each subject makes several or none
possible. The labelled documents are read into features once and written in shards of one size. In every round
each shard takes its mini-batch steps from the shared model, in a fixed order; the changes are merged by blocks of
the embedding table, in parallel, and only the merged change, which has the model's size, reaches the driver. Every
document is then scored where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut

#: Rows of the embedding table and their length: the model's size is fixed by these (8 MB).
BUCKETS, DIM = 1 << 17, 16
#: Labelled documents used at most: the bounded sample the classifier is fitted on.
MOST_LABELLED = 200_000
#: Labelled documents of one shard on average, rounds of synchronisation, and passes of a shard in one round.
SHARD_DOCS, ROUNDS, STEPS = 400, 10, 3
#: Rows of the embedding table whose changes are merged together.
BLOCK = 1 << 12
#: Labelled documents that the prior stands for when a feature's subjects are counted, and the least divergence that weighs.
PRIOR, LEAST_DIVERGENCE = 8.0, 0.08
#: A text with less weight than this in all is drawn towards having no subject.
LEAST_WEIGHT = 3.0
RATE, BATCH, SEED = 0.5, 32, 5
#: Subjects at most: their names and outputs are held by the driver and every task.
MOST_SUBJECTS = 10_000
THRESHOLD = 0.33

_WORD = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?:;\n\r]+")
_CODE = re.compile(r"```[\s\S]*?(?:```|$)|https?://\S+|\x1b\[[0-9;]*m")


def _hash(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % BUCKETS


_word_features: dict[str, np.ndarray] = {}


def _of_word(word: str) -> np.ndarray:
    """A word's own row and those of its character n-grams."""
    got = _word_features.get(word)
    if got is None:
        marked = f"<{word}>"
        grams = {marked} | {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
        got = np.array(sorted({_hash(g) for g in grams}), dtype=np.int32)
        if len(_word_features) > 200_000:
            _word_features.clear()
        _word_features[word] = got
    return got


def features(text: str | None) -> np.ndarray:
    """The feature rows of a text with repeats; none for null, empty or wordless texts."""
    if not text:
        return np.empty(0, dtype=np.int32)
    parts: list[np.ndarray] = []
    for sentence in _SENTENCE.split(_CODE.sub(" ", text)):
        words = [w.lower() for token in _WORD.findall(sentence) for w in _CAMEL.split(token)]
        if words:
            parts += map(_of_word, words)
            parts.append(np.array([_hash(f"{a} {b}") for a, b in zip(words, words[1:])], dtype=np.int32))
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)


_READ = "id {kind}, classes array<int>, shard int, rows array<int>, times array<int>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, classes, shard, text) to (id, classes, shard, rows, times): the different feature rows of each text and how often each stands in it."""
    for batch in batches:
        rows, times = [], []
        for text in batch.column(3).to_pylist():
            r, t = np.unique(features(text), return_counts=True)
            rows.append(r.astype(np.int32))
            times.append(t.astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.select([0, 1, 2]).columns, pa.array(rows, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["id", "classes", "shard", "rows", "times"])


def feature_weights(read: DataFrame) -> np.ndarray:
    """The weight of each feature row of read(classes, rows): the divergence of its subjects from all, smoothed by the prior; at most BUCKETS numbers reach the driver."""
    each = read.select("rows", F.explode("classes").alias("class"))
    alone = cut(each.groupBy("class").agg(F.count("*").cast("double").alias("of_class")))
    counted = cut(each.select("class", F.explode("rows").alias("row")).groupBy("row", "class").agg(F.count("*").cast("double").alias("n")))
    whole = alone.agg(F.sum("of_class").alias("whole"))
    prior = alone.crossJoin(F.broadcast(whole)).select("class", (F.col("of_class") / F.col("whole")).alias("prior"))
    total = counted.groupBy("row").agg(F.sum("n").alias("of_row"))
    share = (F.col("n") + PRIOR * F.col("prior")) / (F.col("of_row") + PRIOR)
    # sums of doubles in the order of the classes, so that two runs agree to the last digit
    terms = counted.join(prior, "class").join(total, "row").groupBy("row", "of_row").agg(F.array_sort(F.collect_list(F.struct("class", (share * F.log(share / F.col("prior"))).alias("x"), "prior"))).alias("t"))
    add = lambda field: F.aggregate("t", F.lit(0.0), lambda a, x: a + x[field])
    # subjects that a feature never stands with all fall by the same factor
    rest = PRIOR / (F.col("of_row") + PRIOR)
    divergence = add("x") + F.greatest(1 - add("prior"), F.lit(0.0)) * rest * F.log(rest)
    got = terms.select("row", divergence.alias("w")).where(F.col("w") >= LEAST_DIVERGENCE).toPandas()
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[got["row"].to_numpy()] = got["w"].to_numpy()
    return weights


def _weighed(rows: np.ndarray, times: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different feature rows with a weight; the weights add up to 1, or less for a text that says little."""
    w = weights[rows] * np.sqrt(times)
    kept = w > 0
    rows, w = rows[kept], w[kept]
    return rows, (w / (w.sum() + LEAST_WEIGHT)).astype(np.float32)


def _sparse(text: str | None, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _weighed(*np.unique(features(text), return_counts=True), weights)


class Model:
    """Embeddings, outputs and biases."""

    def __init__(self, classes: int, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.embed = np.zeros((BUCKETS, DIM), dtype=np.float32)
        self.out = rng.normal(0, 1 / np.sqrt(DIM), (DIM, classes)).astype(np.float32)
        self.bias = np.full(classes, -2.0, dtype=np.float32)

    def logits(self, rows: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (w @ self.embed[rows]) @ self.out * SCALE + self.bias

    def steps(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], order: np.ndarray, rate: float) -> None:
        """Mini-batch gradient steps over the documents (rows, weights, targets) in this order, in place."""
        for at in range(0, len(order), BATCH):
            batch = [docs[i] for i in order[at : at + BATCH]]
            hidden = np.stack([w @ self.embed[r] if len(r) else np.zeros(DIM, np.float32) for r, w, _ in batch])
            target = np.stack([y for _, _, y in batch])
            error = 1 / (1 + np.exp(-(hidden @ self.out * SCALE + self.bias))) - target
            back = error @ self.out.T * SCALE
            self.out -= rate / len(batch) * SCALE * (hidden.T @ error)
            self.bias -= rate / len(batch) * error.sum(0)
            for (r, w, _), g in zip(batch, back):
                self.embed[r] -= rate * np.outer(w, g).astype(np.float32)


#: The mean of many small vectors is short: outputs see it this many times as long.
SCALE = 8.0


_CHANGE = "shard int, block int, n long, sums binary, rows binary"
_MERGED = "block int, n long, sums binary, counts binary"


_PACKED = "shard int, n int, ends binary, rows binary, weights binary, targets binary"


def _pack(weights, classes: int):
    """One shard's documents (id, classes, rows, times), in the order of their ids, as one row of arrays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        kept = [_weighed(rows, times, weights.value) for rows, times in zip(pdf["rows"], pdf["times"])]
        targets = np.zeros((len(pdf), classes), dtype=np.uint8)
        for n, own in enumerate(pdf["classes"]):
            targets[n, np.asarray(own, dtype=int)] = 1
        ends = np.cumsum([len(r) for r, _ in kept], dtype=np.int64)
        rows = np.concatenate([r for r, _ in kept]).astype(np.int32)
        shares = np.concatenate([w for _, w in kept]).astype(np.float32)
        return pd.DataFrame([(int(pdf["shard"].iloc[0]), len(pdf), ends.tobytes(), rows.tobytes(), shares.tobytes(), targets.tobytes())], columns=["shard", "n", "ends", "rows", "weights", "targets"])

    return run


def _shard_steps(shared, r: int, rate: float):
    """Packed shards to the changes the steps of each make to the shared model, by blocks of the embedding table; block -1 is the outputs and biases."""

    def one(shard: int, n: int, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[tuple]:
        mine = Model.__new__(Model)
        mine.embed, mine.out, mine.bias = (x.copy() for x in shared.value)
        rng = np.random.default_rng([SEED, r])
        for _ in range(STEPS):
            mine.steps(docs, rng.permutation(n), rate)
        before = shared.value
        touched = np.zeros(BUCKETS, dtype=np.float32)
        for rows, _, _ in docs:
            touched[rows] = 1
        ends = np.concatenate([(mine.out - before[1]).ravel(), mine.bias - before[2]]).astype(np.float32) * np.float32(n)
        out = [(shard, -1, n, ends.tobytes(), b"")]
        rows = np.flatnonzero(touched).astype(np.int32)
        for b, own in ((b, rows[rows // BLOCK == b]) for b in np.unique(rows // BLOCK)):
            out.append((shard, int(b), n, (mine.embed[own] - before[0][own]).tobytes(), own.tobytes()))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for p in pdf.itertuples():
                cuts = np.frombuffer(p.ends, dtype=np.int64)[:-1]
                rows, w = np.split(np.frombuffer(p.rows, dtype=np.int32), cuts), np.split(np.frombuffer(p.weights, dtype=np.float32), cuts)
                targets = np.frombuffer(p.targets, dtype=np.uint8).reshape(p.n, -1).astype(np.float32)
                yield pd.DataFrame(one(p.shard, p.n, list(zip(rows, w, targets))), columns=["shard", "block", "n", "sums", "rows"])

    return run


def _merge_changes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The changes of all shards to one block, added in the order of the shards."""
    pdf = pdf.sort_values("shard")
    block = int(pdf["block"].iloc[0])
    if block < 0:
        sums, counts = sum(np.frombuffer(x, dtype=np.float32) for x in pdf["sums"]), np.empty(0, dtype=np.float32)
    else:
        sums, counts = np.zeros((BLOCK, DIM), dtype=np.float32), np.zeros(BLOCK, dtype=np.float32)
        for change, rows in zip(pdf["sums"], pdf["rows"]):
            own = np.frombuffer(rows, dtype=np.int32) - block * BLOCK
            sums[own] += np.frombuffer(change, dtype=np.float32).reshape(-1, DIM)
            counts[own] += 1
    return pd.DataFrame([(block, int(pdf["n"].sum()), sums.tobytes(), counts.tobytes())], columns=["block", "n", "sums", "counts"])


def train(read: DataFrame, classes: int, weights: np.ndarray, rounds: int = ROUNDS) -> Model:
    """A model fitted to read(id, classes, shard, rows, times) by rounds of steps on each shard and averaging of their changes."""
    spark = read.sparkSession
    model = Model(classes)
    # each round reads the shards where they lie, so nothing but changes is shuffled
    packed = cut(read.groupBy("shard").applyInPandas(_pack(spark.sparkContext.broadcast(weights), classes), _PACKED))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((model.embed, model.out, model.bias))
        rate = RATE * (1 - 0.7 * r / rounds)
        changes = packed.mapInPandas(_shard_steps(shared, r, rate), _CHANGE)
        merged = changes.groupBy("block").applyInPandas(_merge_changes, _MERGED).toPandas()
        for c in merged.itertuples():
            sums = np.frombuffer(c.sums, dtype=np.float32)
            if c.block < 0:
                model.out += sums[: model.out.size].reshape(model.out.shape) / c.n
                model.bias += sums[model.out.size :] / c.n
            else:
                # a feature's row moves by the mean change of the shards that have it
                counts = np.frombuffer(c.counts, dtype=np.float32)
                model.embed[c.block * BLOCK : (c.block + 1) * BLOCK] += sums.reshape(-1, DIM) / np.maximum(counts, 1)[:, None]
        shared.unpersist()
    return model


def subject_scores(documents: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(key, subject, score) of each document and subject whose score reaches the threshold.

    The classifier is fitted on the labelled documents, or where there are more than `most_labelled` on that many
    in expectation (those whose key's hash falls below a bound); scores cover all documents. Subjects and labels
    are compared without letter case and outer blanks: subjects that differ in these alone are one, which
    comes out under the smallest spelling. Labels of unknown subjects or documents don't count, repeats count once.
    A document with a null, empty or neutral text has no subject; so have all where there are no labels. Ties
    don't arise: each subject is judged by itself.
    """
    spark = documents.sparkSession
    folded = subjects.select(F.lower(F.trim("subject")).alias("known"), "subject").where("known <> ''").groupBy("known").agg(F.min("subject").alias("subject"))
    spelt = sorted((r.known, r.subject) for r in folded.limit(MOST_SUBJECTS + 1).collect())
    if len(spelt) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    names = [subject for _, subject in spelt]
    numbers = spark.createDataFrame([(known, i) for i, (known, _) in enumerate(spelt)], "known string, number int")
    kind = documents.schema[key].dataType.simpleString()
    empty = spark.createDataFrame([], f"`{key}` {kind}, subject string, score double")
    if not names:
        return empty
    known = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.lower(F.trim("subject")).alias("known")).join(F.broadcast(numbers), "known")
    known = known.groupBy("id").agg(F.array_sort(F.collect_set("number")).alias("classes"))
    rows = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    labelled = rows.where("text is not null").join(known, "id")
    labelled = cut(labelled.withColumn("h", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30))))
    there = labelled.count()
    if not there:
        return empty
    kept = labelled.where(F.col("h") < int((1 << 30) * min(1.0, most_labelled / there)))
    shards = max(1, round(min(there, most_labelled) / SHARD_DOCS))
    placed = kept.select("id", "classes", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), "text")
    read = cut(placed.repartition("shard").mapInArrow(_read, _READ.format(kind=kind)))
    if read.isEmpty():
        return empty
    weights = feature_weights(read)
    model = train(read, len(names), weights)
    shared = spark.sparkContext.broadcast((model.embed, model.out, model.bias, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Model.__new__(Model)
        mine.embed, mine.out, mine.bias, w = shared.value
        for batch in batches:
            ids, picked, scores = [], [], []
            for n, t in enumerate(batch.column(1).to_pylist()):
                r, share = _sparse(t, w)
                if not len(r):
                    continue
                p = 1 / (1 + np.exp(-mine.logits(r, share)))
                for c in np.flatnonzero(p >= threshold):
                    ids.append(n)
                    picked.append(names[c])
                    scores.append(float(p[c]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(picked, pa.string()), pa.array(scores, pa.float64())], names=[key, "subject", "score"])

    return rows.mapInArrow(score, f"`{key}` {kind}, subject string, score double")
