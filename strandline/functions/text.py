"""Text and name functions, all as column expressions that stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: fixed value: a token is a run of word characters or any other single visible character
TOKEN = r"[A-Za-z0-9_$]+|[^ \t\n\r\f\x0BA-Za-z0-9_$]"

#: abbreviations that are written out when names are compared, unless others are given
ABBREVIATIONS = {
    "cfg": "config", "ctx": "context", "db": "database", "desc": "description", "dir": "directory", "err": "error", "fn": "function",
    "id": "identifier", "idx": "index", "img": "image", "info": "information", "msg": "message", "num": "number", "obj": "object",
    "params": "parameters", "prev": "previous", "ref": "reference", "req": "request", "res": "response", "src": "source", "str": "string",
    "temp": "temporary", "val": "value", "var": "variable",
}


def tokens(text: Column) -> Column:
    """The tokens of a text in order; null for null, empty for an empty text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def shingles(token_array: Column) -> Column:
    """The different pairs of adjacent tokens joined by NUL; empty for fewer than two tokens."""
    n = F.size(token_array)
    pairs = F.zip_with(F.slice(token_array, 1, n - 1), F.slice(token_array, 2, n - 1), lambda a, b: F.concat(a, F.lit("\0"), b))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets: 1 if both are empty, 0 if one is; null if either is null."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) == 0, F.lit(1.0)).otherwise(shared / either)


def name_words(name: Column, expand: bool = True, abbreviations: dict[str, str] | None = None) -> Column:
    """The lower-case words of a camel, snake or kebab name, abbreviations written out if `expand`."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(spaced, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    if not expand:
        return words
    known = F.create_map(*[F.lit(x) for pair in (ABBREVIATIONS if abbreviations is None else abbreviations).items() for x in pair]) if abbreviations != {} else None
    if known is None:
        return words
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w))


def nested_by_one(a: Column, b: Column) -> Column:
    """Whether two word sets are equal, or one holds the other and one word more."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    shared = F.size(F.array_intersect(a, b))
    return ((F.size(a) == shared) & (F.size(b) - shared <= 1)) | ((F.size(b) == shared) & (F.size(a) - shared <= 1))


def single_word(name: Column) -> Column:
    """Whether a name is one lower-case word."""
    return name.rlike("^[a-z]+$")


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a 0-based character offset."""
    return F.size(F.split(F.substring(text, F.lit(1), offset), "\n"))


def column_of(text: Column, offset: Column) -> Column:
    """The 1-based column of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(F.element_at(F.split(before, "\n"), -1)) + 1


def occurrences(rows: DataFrame, key: list[str], text: str, needle: str) -> DataFrame:
    """(key..., at, line, col) of every place where a literal stands in a text: 0-based offset, 1-based line and column; places don't overlap.

    Texts are taken apart line by line, so a long text with many places costs no more than its length.
    """
    n = len(needle)
    lines = rows.select(*key, F.posexplode(F.split(text, "\n")).alias("_line", "_text"))
    before = Window.partitionBy(*key).orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("_start", F.coalesce(F.sum(F.length("_text") + 1).over(before), F.lit(0))).where(F.contains("_text", F.lit(needle)))
    pieces = lines.select(*key, "_line", "_start", F.posexplode(F.split("_text", re.escape(needle))).alias("_n", "_piece"))
    upto = Window.partitionBy(*key, "_line").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("_col", F.sum(F.length("_piece") + n).over(upto) - n).where("_n > 0")
    return placed.select(*key, (F.col("_start") + F.col("_col")).alias("at"), (F.col("_line") + 1).cast("long").alias("line"), (F.col("_col") + 1).alias("col"))


def code_lines(text: Column) -> Column:
    """How many lines are neither blank nor comment nor import."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^[ \t\r]*$") & ~x.rlike(r"^[ \t]*(?://|/\*|\*)") & ~x.rlike(r"^[ \t]*import\b")))


def untagged_prose(text: Column) -> Column:
    """A documentation text without its tag lines."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^[ \t*/]*@")), "\n")


def blank_outside(text: Column, region: str) -> Column:
    """The text with every character outside matches of `region` turned into a blank, newlines kept, so offsets stay true.

    Regions are marked, what lies between is blanked, and the marks go; texts must not hold the two private marks.
    """
    begin, end = "\ue000", "\ue001"
    pieces = F.split(F.regexp_replace(text, f"({region})", f"{begin}$1{end}"), begin)

    def blank(part: Column) -> Column:
        return F.regexp_replace(part, r"[^\n]", " ")

    first = blank(F.element_at(pieces, 1))
    rest = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.concat(F.substring_index(p, end, 1), blank(F.substring_index(p, end, -1))))
    return F.concat(first, F.array_join(rest, ""))


def common_prefix_dir(paths: Column) -> Column:
    """The deepest directory that all paths of an array lie in, '' at the root; null for an empty array."""
    low, high = F.array_min(paths), F.array_max(paths)
    a, b = F.split(low, "/"), F.split(high, "/")
    depth = F.least(F.size(a), F.size(b)) - 1
    # the part shared by the least and the greatest path is shared by all
    same = F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), lambda i: F.element_at(a, i) == F.element_at(b, i))
    length = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")), lambda s, x: F.struct(F.when(s["open"] & x, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["open"] & x).alias("open")))["n"]
    return F.array_join(F.slice(a, F.lit(1), length), "/")


def preceding_comment(text: Column, offset: Column) -> Column:
    """The comment that ends directly before a 0-based offset, with nothing but white space between; '' without one."""
    return F.regexp_extract(F.substring(text, F.lit(1), offset), r"(//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)\s*$", 1)


def call_chains(text: Column, least: int = 2) -> Column:
    """The chains of at least so many method calls on a name, as written: name.first(...).second(...)."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*\([^()]*\)){%d,}" % least), F.lit(0))


def string_literals(text: Column) -> Column:
    """The contents of the strings in single quotes, escapes kept as written."""
    return F.regexp_extract_all(text, F.lit(r"'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'"), F.lit(1))


_DECLARED = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)|\b(?:const|let|var)\s*([\[{][^=]*?[\]}])\s*=|\(([^()]*)\)\s*(?::[^=(){}]+)?\s*(?:=>|\{)|([A-Za-z_$][\w$]*)\s*=>")
_PIECE = re.compile(r"(//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)|([A-Za-z_$][\w$]*)|([()\[\]{}])")


def _bound(pattern: str) -> set[str]:
    """The names a list of parameters or a destructuring binds: in braces what stands after a colon, elsewhere what stands before one."""
    found, depth = set(), 0
    for m in re.finditer(r"([{}])|([A-Za-z_$][\w$]*)(\s*:)?|[,\[\](]|=[^,{}\])]*|:\s*[^,={}\])]+", pattern):
        if m.group(1):
            depth += 1 if m.group(1) == "{" else -1
        elif m.group(2) and not (m.group(3) and depth > 0):
            found.add(m.group(2))
    return found


def normalised(text: str) -> str:
    """A declaration with comments dropped, the names it binds itself as _, and white space as single blanks.

    Property names, types and names from outside stay, so that two declarations which differ in the names of their
    parameters and variables alone become equal.
    """
    bare = _PIECE.sub(lambda m: " " if m.group(1) else m.group(), text)
    bound: set[str] = set()
    for m in _DECLARED.finditer(bare):
        for whole in (m.group(1), m.group(4)):
            if whole:
                bound.add(whole)
        for pattern in (m.group(2), m.group(3)):
            if pattern:
                # types of parameters name nothing that is bound here
                bound |= _bound(pattern if m.group(2) else re.sub(r":\s*[^,={}()]+(?=[,=)]|$)", "", _outside_braces(pattern)) + " " + " ".join(re.findall(r"\{[^{}]*\}", pattern)))
    out, at, stack = [], 0, []
    for m in _PIECE.finditer(bare):
        out.append(bare[at : m.start()])
        at = m.end()
        name, bracket = m.group(3), m.group(4)
        if bracket:
            if bracket in "([{":
                stack.append(bracket)
            elif stack:
                stack.pop()
        if name in bound if name else False:
            before, after = _neighbour(bare, m.start() - 1, -1), _neighbour(bare, at, 1)
            key = after == ":" and before in ("{", ",") and stack and stack[-1] == "{"
            if (before != "." or bare.endswith("...", 0, m.start())) and not key:
                out.append("_")
                continue
        out.append(m.group())
    return " ".join("".join([*out, bare[at:]]).split())


def _neighbour(text: str, at: int, step: int) -> str:
    """The nearest character from a place on that isn't white space, '' without one."""
    while 0 <= at < len(text) and text[at].isspace():
        at += step
    return text[at] if 0 <= at < len(text) else ""


def _outside_braces(pattern: str) -> str:
    return re.sub(r"\{[^{}]*\}", "", pattern)


@F.pandas_udf(T.StringType())
def normalise(texts: pd.Series) -> pd.Series:
    """normalised() of each text; null for null. Binding names needs a look at the whole declaration, which expressions can't take."""
    return texts.map(lambda t: None if t is None else normalised(t))
