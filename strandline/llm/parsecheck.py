"""Source files that do not parse: each file against the supported grammars, ranked by its tokens.

The grammar of the path's ending decides whether a file is valid. Every file, valid or not, is tried in all
grammars, the likeliest first by the tokens it has. A file that fails in its own grammar and parses in another
has a wrong extension; one that parses in none is corrupt (cut off, left in conflict, damaged). The text is split
into tokens once for all JavaScript and TypeScript grammars, and each other grammar reads it once, so the
time for a file grows with its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import plain_grammars
from strandline.sources.ecma import GRAMMARS, Source

#: The grammars a file is tried in besides those of JavaScript and TypeScript.
PLAIN: dict[str, Callable[[str], bool]] = {
    "python": plain_grammars.parses_python,
    "json": plain_grammars.parses_json,
    "css": plain_grammars.parses_css,
    "yaml": plain_grammars.parses_yaml,
    "toml": plain_grammars.parses_toml,
    "xml": plain_grammars.parses_xml,
}
ECMA = ("ts", "tsx", "js", "mjs")
CHECKS = (*ECMA, *PLAIN)
# endings that have the grammar of another
_SAME = {"mts": "ts", "cts": "ts", "jsx": "js", "cjs": "mjs"}

# Tokens that speak for a language, with their weight; a token counts as often as it stands in the text.
_HINTS: dict[str, dict[str, float]] = {
    "ts": {"interface": 3, "readonly": 2, "enum": 3, "namespace": 3, "declare": 2, "keyof": 3, "string": 1, "number": 1, "boolean": 1, "unknown": 1, "type": 0.5, "const": 0.5, "let": 0.5, "export": 0.5, "import": 0.2, "=>": 0.5, "===": 0.5},
    "tsx": {"interface": 2, "string": 0.6, "number": 0.6, "boolean": 0.6, "JSX": 3, "React": 2, "className": 3, "</": 1, "/>": 2, "const": 0.5, "export": 0.5, "=>": 0.5, "===": 0.4},
    "js": {"const": 0.6, "let": 0.6, "var": 1, "require": 2, "function": 0.6, "export": 0.5, "=>": 0.5, "===": 0.5, "className": 1},
    "mjs": {"const": 0.6, "let": 0.6, "export": 0.6, "function": 0.5, "=>": 0.5, "===": 0.5},
    "python": {"def": 4, "elif": 4, "None": 3, "True": 2, "False": 2, "self": 2, "lambda": 2, "pass": 2, "not": 1, "and": 1, "except": 3, "with": 0.5, "import": 0.3},
    "json": {"true": 0.4, "false": 0.4, "null": 0.4, "{": 0.2, "[": 0.2, ":": 0.2},
    "css": {"px": 2, "color": 2, "margin": 2, "padding": 2, "display": 2, "@media": 3, "solid": 1, "font": 1, "border": 1, "#": 0.3, ":": 0.2, ";": 0.1},
    "yaml": {"-": 0.5, ":": 0.3, "---": 3, "name": 0.2},
    "toml": {"[": 0.3, "=": 0.3, "[[": 1},
    "xml": {"<": 0.3, "</": 1, "/>": 1, ">": 0.2, "xmlns": 4, "version": 1},
}


_TELLING = frozenset(token for hints in _HINTS.values() for token in hints)


def rank_grammars(text: str, tokens: list[str] | None = None) -> list[str]:
    """The grammars of CHECKS by how many of the text's tokens speak for each, with their weights; ties keep the order of CHECKS."""
    seen = Counter(filter(_TELLING.__contains__, Source(text).tokens if tokens is None else tokens))
    score = {name: sum(weight * seen[token] for token, weight in _HINTS[name].items() if token in seen) for name in CHECKS}
    return sorted(CHECKS, key=lambda name: -score[name])


def accepting(text: str, source: Source) -> list[str]:
    """All grammars that accept a text, the likeliest by its tokens first."""
    return [name for name in rank_grammars(text, source.tokens) if (source.error(name) is None if name in ECMA else PLAIN[name](text))]


def judge(path: str | None, text: str | None) -> tuple[bool, str | None, str | None, list[str]]:
    """(valid, reason, the likeliest grammar that accepts it instead, all that accept it).

    A path without a supported ending has no grammar of its own and is valid, as are null and empty texts.
    """
    ending = (path or "").rsplit(".", 1)[-1].lower()
    if not text:
        return True, None, None, []
    source = Source(text)
    accepts = accepting(text, source)
    if ending not in GRAMMARS or _SAME.get(ending, ending) in accepts:
        return True, None, None, accepts
    return False, source.error(ending), accepts[0] if accepts else None, accepts


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdicts = [judge(p, t) for p, t in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist())]
        kept = batch.select(["id", "repo", "path", "seen"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array([v[0] for v in verdicts], pa.bool_()), pa.array([v[1] for v in verdicts], pa.string()), pa.array([v[2] for v in verdicts], pa.string()), pa.array([v[3] for v in verdicts], pa.list_(pa.string()))],
            names=["id", "repo", "path", "seen", "valid", "reason", "parses_as", "accepted_by"],
        )


def parse_verdicts(files: DataFrame, key: str = "file_id", order: str = "ingested_at") -> DataFrame:
    """(key, repo, path, language, valid, reason, parses_as, accepted_by, cause) for every file; needs columns repo, path and text.

    cause is null for valid files, else 'wrong extension' or 'corrupt'. accepted_by lists all grammars that
    accept the text. language is the path's ending in lower case. Rows of one key count once, the one with the
    greatest `order`; repeats are parsed where they lie, so that texts never cross the network. Null and empty
    texts are valid and accepted by none.
    """
    rows = files.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), "repo", "path", F.col(order).cast("timestamp").alias("seen"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    parsed = rows.mapInArrow(_run, f"id {kind}, repo string, path string, seen timestamp, valid boolean, reason string, parses_as string, accepted_by array<string>")
    last = parsed.groupBy("id").agg(F.max_by(F.struct("repo", "path", "valid", "reason", "parses_as", "accepted_by"), "seen").alias("last"), F.any_value(F.struct("repo", "path", "valid", "reason", "parses_as", "accepted_by")).alias("any"))
    one = last.select("id", F.coalesce("last", "any").alias("v")).select(F.col("id").alias(key), "v.*")
    cause = F.when(~F.col("valid"), F.when(F.col("parses_as").isNotNull(), "wrong extension").otherwise("corrupt"))
    return one.select(key, "repo", "path", F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.(\w+)$", 1)).alias("language"), "valid", "reason", "parses_as", "accepted_by", cause.alias("cause"))


def parse_rates(verdicts: DataFrame) -> DataFrame:
    """(repo, language, files, unparsed, wrong_extension, corrupt, rate) of parse_verdicts' rows."""
    bad = (~F.col("valid")).cast("bigint")
    return verdicts.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.sum(bad).alias("unparsed"),
        F.count(F.when(F.col("cause") == "wrong extension", 1)).alias("wrong_extension"),
        F.count(F.when(F.col("cause") == "corrupt", 1)).alias("corrupt"),
        F.round(F.avg(bad.cast("double")), 6).alias("rate"),
    )
