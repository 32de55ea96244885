"""Encoding with a public byte-level BPE tokenizer by forced-boundary splitting.

A pair of bytes that never occurs inside any token of the vocabulary can't be merged across, so the text
may be cut there and the fragments encoded by themselves. Where the cut would change how the pattern
splits the text (after white space, before an apostrophe, inside a character) it isn't made. Most
fragments are words that come again and again; each is encoded once per worker and then looked up.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that splits text before the merges, a fixed value of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where the vocabulary files are; the folder is a parameter of every operator here.
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Fragments a worker remembers.
REMEMBERED = 300_000


class ForcedBoundaryEncoder:
    """Encodes texts with a rank file: bytes to ids, null and empty texts to an empty list."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.inside = np.zeros(1 << 16, dtype=bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                self.inside[a << 8 | b] = True
        before = np.zeros(256, dtype=bool)
        before[0x21:0x7F] = True  # printable ASCII: no white space and no part of a longer character
        after = np.ones(256, dtype=bool)
        after[0x80:0xC0] = False  # the middle of a character
        after[ord("'")] = False  # may begin a contraction
        self.cut = ~self.inside & (before[:, None] & after[None, :]).ravel()
        self.known: dict[bytes, list[int]] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint16)
        cuts = np.flatnonzero(self.cut[codes[:-1] << 8 | codes[1:]]) + 1
        bounds = [0, *cuts.tolist(), len(data)]
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.known
        for fragment in self.fragments(text.encode("utf-8", "replace")):
            got = known.get(fragment)
            if got is None:
                got = self.encoding.encode_ordinary(fragment.decode("utf-8"))
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(fragment) <= 64:
                    known[fragment] = got
            ids += got
        return ids


_encoders: dict[str, ForcedBoundaryEncoder] = {}


def encoder(vocabulary: str, folder: str) -> ForcedBoundaryEncoder:
    """The encoder of a vocabulary file, made once per process."""
    path = os.path.join(folder, f"{vocabulary}.tiktoken")
    if path not in _encoders:
        _encoders[path] = ForcedBoundaryEncoder(path)
    return _encoders[path]


def encode_texts(documents: DataFrame, text: str = "text", into: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, keep: tuple[str, ...] = ("doc_id",), count_only: bool = False) -> DataFrame:
    """The columns `keep` with the ids of each text (or only their number), one row for every row of documents.

    Special tokens' names are ordinary text; a null text and an empty one give an empty list (or 0). The
    vocabulary is read from the folder on every executor. Rows stay where they are: there is no shuffle.
    """
    rows = documents.select(*keep, F.col(text).alias("_text"))
    kept = list(keep)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + (f", `{into}` bigint" if count_only else f", `{into}` array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                made = pa.array([len(x) for x in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*kept, into])

    return rows.mapInArrow(run, schema)
