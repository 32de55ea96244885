"""Content addresses: short digests, canonical JSON, keys of facts and answers."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sha16(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of a text."""
    return F.substring(F.sha1(text), 1, 16)


def canonical(value) -> str:
    """JSON with sorted keys at every depth and no blanks; arrays keep their order."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON texts in canonical form; null for null and for what isn't JSON."""

    def one(text):
        try:
            return None if text is None else canonical(json.loads(text))
        except (TypeError, ValueError, RecursionError):
            return None

    return texts.map(one)


def fact_id(canonical_text: Column) -> Column:
    """The address of a fact given as canonical JSON."""
    return F.concat(F.lit("a"), sha16(canonical_text))


def answer_key(model: str, version: str, decision: dict, material: list) -> str:
    """The key under which an answer to a question about some material is kept."""
    return hashlib.sha1(canonical({"model": model, "version": version, "decision": decision, "material": material}).encode()).hexdigest()[:16]
