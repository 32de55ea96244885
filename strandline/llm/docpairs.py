"""Functions paired with their documentation: comments matched to functions by bipartite assignment.

Comments that say nothing (directives, notices, separators, bare tags, placeholders, ticket numbers,
disabled code, the name in other words) are no candidates. The others are offered to the functions of the file
that follow them, weighted by the parameters they tag, the words of the name and the code that lies
between. A link that nothing speaks for, or of which the tags name parameters the function doesn't have, is
implausible and isn't made. Each comment and each function gets at most one partner so that the total weight is
greatest.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.ecma import syntax_error

_COMMENT = re.compile(r"//[^\r\n]*(?:\r?\n[ \t]*//[^\r\n]*)*|/\*[\s\S]*?\*/")
_SPACE = re.compile(r"\s*")
_MARKS = re.compile(r"^\s*(?:/{2,}!?|/\*+!?|\*+/?|<!--)\s?|\s*(?:\*+/|-->)\s*$")
#: Functions after a comment that it is offered to, and the least weight of a plausible link.
FOLLOWING, LEAST_WEIGHT = 3, 1.5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")

# What tools read, what lawyers write, what stands in place of documentation.
_DIRECTIVE = re.compile(
    r"^\s*(?:@?(?:ts-(?:ignore|nocheck|check|expect-error)|eslint|tslint|prettier|biome|istanbul|c8|v8|jshint|jslint|jscs|flow|nolint|noinspection|codecov|sonar|deno|oxlint|stylelint|webpack|vite|rollup|cspell|spell-?checker|type-coverage|standard)\b[\w-]*"
    r"|globals?\s+\w|exported\s+\w|#?(?:end)?region\b|[@#]__(?:PURE|NO_SIDE_EFFECTS|INLINE)__|<reference\b|@jsx\w*\s|-\*-|vim?:|@(?:format|flow|noflow|preserve|generated)\b)",
    re.I,
)
_NOTICE = re.compile(r"\bcopyright\b|\(c\)\s*\d{4}|©|\bspdx-|\blicen[sc]ed?\b|\ball rights reserved\b|\breleased under\b|\burheberrecht\b|\bderechos reservados\b|\bpermission is hereby\b|^\W*(?:written|created|authored|coded|maintained|ported|contributed|added) (?:by|on)\b[^.]*\W*$|\bwithout warrant", re.I)
_PLACEHOLDER = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx|hack|tbd|tba|wip|n/?a)\b.*|(?:(?:insert|add|write|put|enter|your)\s+)?(?:a |the )?(?:short |brief |function |method )?(?:description|documentation|docs?|comment|summary|text)(?:\s+(?:goes\s+)?(?:here|missing|needed|pending|to follow|follows|later))*"
    r"|(?:missing|no)\s+(?:docs?|documentation|description|comment)s?(?:\s+(?:here|yet))?|see (?:above|below|there|code|name|source|docs?)|as (?:above|below|discussed|the name says)|self[- ]explanatory|ditto|same(?: as above)?|lorem ipsum.*|nothing (?:here|to see)(?: yet)?|undocumented|placeholder|siehe oben|ver arriba)\W*$",
    re.I,
)
_TICKET = re.compile(r"^\W*(?:(?:see|fixes|closes|refs?|issue|ticket|bug|cf\.?)\s+)*(?:[A-Z][A-Z0-9]{0,9}-\d+|(?:GH-?|#)\d+|https?://\S+)(?:[\s,;]+(?:[A-Z][A-Z0-9]{0,9}-\d+|#\d+))*\W*$", re.I)
_SEPARATOR = re.compile(r"^\W*$|^\s*(?:[-=*#~_+.<>/]\s*){3,}[^.!?]{0,40}?(?:\s*[-=*#~_+.<>/]){0,}\s*$|^[^.!?]{0,40}(?:[-=*#~_+]\s*){3,}$")
#: tags whose text speaks about the function itself
_SPEAKING = frozenset(("remarks", "remark", "description", "desc", "summary", "returns", "return", "throws", "throw", "exception", "deprecated", "note", "notes", "details", "brief", "warning", "todo-none"))
#: words that carry no meaning of their own in a description
_EMPTY = frozenset(
    """a an the this that these those it its is are was be been being do does did of to for from by with in on at as and or not but
    function functions method methods helper helpers utility util routine procedure callback handler implementation wrapper main
    runs run performs perform executes execute calls call returns return gets get sets set given value values result results outcome
    params param parameter parameters argument arguments options input output data object used use uses using which will can just simply only here
    der die das den dem des ein eine und oder für von zu zum zur im in mit ist wird funktion methode hilfsfunktion
    el la los las un una de del y o para por con en es se que función funcion método metodo""".split()
)


def words_of(name: str) -> list[str]:
    """The lower-case words of an identifier."""
    return [w.lower() for part in re.split(r"[_\W]+", name) for w in _CAMEL.split(part) if w]


def _stem(word: str) -> str:
    for ending in ("ations", "ation", "ings", "ing", "ies", "ied", "ers", "er", "es", "ed", "s", "e", "y"):
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            return word[: -len(ending)]
    return word


def leading_comments(text: str) -> tuple[list[tuple[int, int]], int]:
    """Spans of the comments above the code, and where the code begins."""
    spans, at = [], _SPACE.match(text).end()
    while m := _COMMENT.match(text, at):
        spans.append(m.span())
        at = _SPACE.match(text, m.end()).end()
    return spans, at


def prose(comment: str) -> tuple[str, list[str]]:
    """What a comment says in words about the thing below it, and the parameters it tags."""
    lines = [_MARKS.sub("", _MARKS.sub("", x)).strip() for x in re.split(r"\r\n?|\n", comment)]
    said: list[str] = []
    tagged: list[str] = []
    keep = True
    for line in lines:
        if not line:
            keep = True
            continue
        if _DIRECTIVE.match(line):
            keep = True
            continue
        tag = re.match(r"@(\w+)\s*(?:\{[^}]*\})?\s*(.*)$", line)
        if tag:
            name, rest = tag.group(1).lower(), tag.group(2)
            if name in ("param", "arg", "argument", "prop", "property"):
                parameter = re.match(r"\[?([\w$]+)", rest)
                if parameter:
                    tagged.append(parameter.group(1))
            keep = name in _SPEAKING
            if keep and rest:
                said.append(rest)
            continue
        if keep:
            said.append(line)
    said = [x for x in said if not (_NOTICE.search(x) or _SEPARATOR.match(x) or _PLACEHOLDER.match(x) or _TICKET.match(x))]
    return "\n".join(said), tagged


def _is_code(text: str) -> bool:
    return bool(re.search(r"[=(;{]", text)) and syntax_error("async function f() {\n" + text + "\n}", "ts") is None


def informative(text: str, name: str | None) -> bool:
    """Whether a description has at least two words that neither the name nor any function has."""
    if not text or _is_code(text):
        return False
    known = words_of(name or "")
    stems = {_stem(w) for w in known}
    fresh = set()
    for token in _WORD.findall(text):
        for word in _CAMEL.split(token):
            word = word.lower()
            if len(word) < 2 or word in _EMPTY:
                continue
            stem = _stem(word)
            if word in known or stem in stems or any(len(s) >= 4 and len(stem) >= 4 and (s.startswith(stem) or stem.startswith(s)) for s in stems):
                continue
            fresh.add(stem)
    return len(fresh) >= 2


def weight(description: str, tagged: list[str], name: str | None, signature: str, between: int) -> float | None:
    """How well a comment fits a function: tagged parameters it has, words of its name, and how much code lies between; None for an implausible link."""
    names = set(re.findall(r"[\w$]+", signature))
    fit = (sum(t in names for t in tagged) - sum(t not in names for t in tagged)) / len(tagged) if tagged else 0.0
    said = {_stem(w.lower()) for w in _WORD.findall(description)}
    own = {_stem(w) for w in words_of(name or "")}
    shared = len(said & own) / len(own) if own else 0.0
    if between and fit <= 0 and not shared:
        return None
    total = 2.0 / (1.0 + between / 200.0) + fit + shared
    return total if total >= LEAST_WEIGHT else None


def assign(weights: dict[tuple[int, int], float]) -> dict[int, int]:
    """Right to left of the matching with the greatest total weight, by augmenting along the longest paths."""
    lefts = sorted({a for a, _ in weights})
    of_right: dict[int, int] = {}
    if len(lefts) == len(weights) == len({b for _, b in weights}):
        return {b: a for a, b in weights}
    options: dict[int, list[tuple[int, float]]] = {}
    for (a, b), w in weights.items():
        options.setdefault(a, []).append((b, w))
    for start in lefts:
        # Bellman-Ford over alternating paths from one more left node: gain of ending in each right node
        gain: dict[int, tuple[float, list[tuple[int, int]]]] = {}
        frontier = [(start, 0.0, [])]
        while frontier:
            following = []
            for a, so_far, path in frontier:
                for b, w in options[a]:
                    if any(b == seen for _, seen in path):
                        continue
                    total = so_far + w
                    if b not in gain or total > gain[b][0] + 1e-12:
                        gain[b] = (total, [*path, (a, b)])
                        if b in of_right:
                            holder = of_right[b]
                            following.append((holder, total - weights[holder, b], [*path, (a, b)]))
            frontier = following
        free = [(g, path) for b, (g, path) in gain.items() if b not in of_right]
        swaps = [(g - weights[of_right[b], b], path) for b, (g, path) in gain.items() if b in of_right]
        best = max(free + swaps, default=(0.0, []), key=lambda x: x[0])
        if best[0] > 0:
            for a, b in best[1]:
                of_right[b] = a
    return of_right


def _signature(code: str) -> str:
    """A function's text up to its body: what stands before the first brace that isn't in its parameter list."""
    depth = 0
    for m in re.finditer(r"[(){]", code):
        if m.group() == "{" and not depth:
            return code[: m.start()]
        depth += (m.group() == "(") - (m.group() == ")")
    return code


def _components(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The pairs of a bipartite graph by connected component."""
    near: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for pair in pairs:
        near.setdefault(("f", pair[0]), []).append(pair)
        near.setdefault(("c", pair[1]), []).append(pair)
    out, seen = [], set()
    for start in near:
        if start in seen:
            continue
        seen.add(start)
        todo, inside = [start], set()
        while todo:
            for pair in near[todo.pop()]:
                inside.add(pair)
                for node in (("f", pair[0]), ("c", pair[1])):
                    if node not in seen:
                        seen.add(node)
                        todo.append(node)
        out.append(sorted(inside))
    return out


def match_file(units: list[dict]) -> list[dict]:
    """One file's functions (unit_id, name, start_pos, text) to those with documentation: unit_id, name, description, code, weight, adjacent."""
    functions: list[tuple[int, int, str, str]] = []  # where the code begins and ends, the code and its signature
    comments: dict[tuple[int, int], tuple[str, list[str]]] = {}
    own: list[set[tuple[int, int]]] = []
    for unit in units:
        text, start = unit["text"] or "", unit["start_pos"] or 0
        spans, begin = leading_comments(text)
        functions.append((start + begin, start + len(text), text[begin:], _signature(text[begin:])))
        places = {(start + a, start + b) for a, b in spans}
        for a, b in spans:
            if (start + a, start + b) not in comments:
                comments[start + a, start + b] = prose(text[a:b])
        own.append(places)
    order = sorted(range(len(units)), key=lambda f: functions[f][0])
    begins = [functions[f][0] for f in order]
    weights: dict[tuple[int, int], float] = {}
    listed = sorted(comments)
    for c, place in enumerate(listed):
        said, tagged = comments[place]
        first = bisect.bisect_left(begins, place[1])
        near = order[first : first + FOLLOWING]
        for f in {*near, *(f for f in near_owners(own, order, begins, place) if f not in near)}:
            begin, _, _, signature = functions[f]
            # the code between: all of the functions that lie there
            between = 0 if place in own[f] else max(1, sum(functions[g][1] - functions[g][0] for g in near if functions[g][0] < begin))
            if informative(said, units[f]["name"]):
                w = weight(said, tagged, units[f]["name"], signature, between)
                if w is not None:
                    weights[f, c] = w
    out = []
    for pairs in _components(list(weights)):
        for c, f in assign({pair: weights[pair] for pair in pairs}).items():
            out.append({"unit_id": units[f]["unit_id"], "name": units[f]["name"], "description": comments[listed[c]][0], "code": functions[f][2], "weight": weights[f, c], "adjacent": listed[c] in own[f]})
    return out


def near_owners(own: list[set[tuple[int, int]]], order: list[int], begins: list[int], place: tuple[int, int]) -> list[int]:
    """The functions in whose own text a comment stands; usually one, several where rows of one place have different ids."""
    first = bisect.bisect_left(begins, place[1])
    found = []
    while first < len(order) and place in own[order[first]]:
        found.append(order[first])
        first += 1
    return found


_OUT = pa.schema([("unit_id", pa.int64()), ("name", pa.string()), ("description", pa.string()), ("code", pa.string()), ("weight", pa.float64()), ("adjacent", pa.bool_())])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by file, unit and time to documented functions, one file after the other."""
    place, units, out = None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["repo"], row["file_path"], row["alone"])
            if here != place:
                out += match_file(units)
                place, units = here, []
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=_OUT)
                    out = []
            if units and units[-1]["unit_id"] == row["unit_id"]:
                units[-1] = row
            else:
                units.append(row)
    out += match_file(units)
    yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def documented_functions(units: DataFrame, order: str = "scanned_at") -> DataFrame:
    """(unit_id, name, description, code, weight, adjacent) of the functions of units(unit_id, repo, file_path, kind, name, start_pos, text) that have one.

    adjacent says whether the description stands directly above the function's code or, as its tags and words
    show, was parted from it by other functions. Rows of one unit_id count once, the one with the greatest `order`.
    Null or empty texts have no comment; a null name makes no word known; a row without a file stands alone.
    Functions without an informative comment are left out. One file's functions are in memory together.
    """
    rows = units.where((F.col("kind") == "function") & F.col("unit_id").isNotNull()).select(F.col("unit_id").cast("long").alias("unit_id"), "repo", "file_path", "name", F.col("start_pos").cast("int").alias("start_pos"), "text", F.col(order).alias("seen"))
    rows = rows.withColumn("alone", F.when(F.col("repo").isNull() | F.col("file_path").isNull(), F.col("unit_id")))
    file = ["repo", "file_path", "alone"]
    placed = rows.repartition(*file).sortWithinPartitions(*file, "unit_id", "seen").drop("seen")
    return placed.mapInArrow(_run, "unit_id long, name string, description string, code string, weight double, adjacent boolean")
