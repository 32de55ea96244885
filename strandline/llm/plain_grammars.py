"""Checks of texts in languages other than JavaScript and TypeScript: each reads its text once, in linear time."""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from xml.parsers import expat


def parses_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def parses_python(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def parses_toml(text: str) -> bool:
    try:
        return bool(tomllib.loads(text))
    except (ValueError, RecursionError):
        return False


def parses_xml(text: str) -> bool:
    if not text.lstrip().startswith("<"):
        return False
    parser = expat.ParserCreate()
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except (expat.ExpatError, ValueError):
        return False
    return True


_CSS_TOKEN = re.compile(
    r"(?P<blank>\s+|/\*[\s\S]*?\*/|<!--|-->)|(?P<open>/\*)"
    r"|(?P<string>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
    r"|(?P<url>url\(\s*[^\s\"'()\\]*\s*\))"
    r"|(?P<word>[#.@]?-{0,2}(?:[A-Za-z_\u0080-\U0010ffff]|\\[^\n])(?:[\w\u0080-\U0010ffff-]|\\[^\n])*\(?|#[\w-]+)"
    r"|(?P<number>[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+)?)"
    r"|(?P<mark>[{}();:,\[\]>+~*=|^$!/&.%<-])"
)
_CSS_SELECTOR_MARKS = frozenset(":,[]>+~*=|^$()&.-")
_CSS_VALUE_MARKS = frozenset(",()/+*-!%[]=.:<>")


def parses_css(text: str) -> bool:
    """Whether a text is a style sheet: at-rules and rules of selectors and declarations, nested to any depth."""
    at, end = 0, len(text)
    rules = depth = 0
    item: list[tuple[str, str]] = []  # the tokens of the statement that is being read
    round_open = 0
    while at < end:
        m = _CSS_TOKEN.match(text, at)
        if not m:
            return False
        at, kind, token = m.end(), m.lastgroup, m.group()
        if kind == "blank":
            continue
        if kind == "open":
            return False
        if kind == "word" and token[-1] == "(" or kind == "mark" and token in "([":
            round_open += 1
        elif kind == "mark" and token in ")]":
            round_open -= 1
            if round_open < 0:
                return False
        if kind == "mark" and token in "{}" and len(item) > 1 and item[0][1].startswith("--") and item[1][1] == ":":
            # a custom property may hold a block
            if token == "{" or round_open:
                round_open += 1 if token == "{" else -1
                item.append((kind, token))
                continue
        if kind == "mark" and not round_open and token in "{};":
            if token == "{":
                if not item or item[0][1][0] != "@" and not _selects(item):
                    return False
                depth += 1
                rules += 1
            elif token == ";":
                if not item and not depth or item and not (_declares(item) if depth and item[0][1][0] != "@" else item[0][1][0] == "@" and len(item) > 1):
                    return False
            else:
                if not depth or item and not _declares(item):
                    return False
                depth -= 1
            item = []
            continue
        item.append((kind, token))
    return rules > 0 and depth == 0 and not item and round_open == 0


def _selects(item: list[tuple[str, str]]) -> bool:
    """Whether the tokens before a block are selectors, or the percentages of a key frame; brackets belong to a pseudo-class."""
    inside = 0
    for n, (kind, token) in enumerate(item):
        if kind == "word" and token[-1] == "(":
            if not n or item[n - 1][1] != ":":
                return False
            inside += 1
        elif token == "(" and not inside:
            return False
        elif token in "()":
            inside += 1 if token == "(" else -1
        elif kind == "number" and not inside and token[-1] != "%" or kind == "url" or kind == "mark" and token not in _CSS_SELECTOR_MARKS:
            return False
    return item[-1][1] not in (",", ".", ":")


def _declares(item: list[tuple[str, str]]) -> bool:
    """Whether the tokens of a statement in a block are a property, a colon and a value."""
    if len(item) < 3 or item[0][0] != "word" or item[0][1][0] in "#.@" or item[0][1][-1] == "(" or item[1][1] != ":":
        return False
    if item[0][1].startswith("--"):
        return True
    return all(kind in ("word", "number", "string", "url") or token in _CSS_VALUE_MARKS for kind, token in item[2:])


_YAML_KEY = re.compile(r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s#\-?:,\[\]{}&*!|>'\"%@`][^:#\n]*+|[-?:][^\s:#][^:#\n]*+|<<)[ \t]*+:(?=[ \t]|$)")
_YAML_BLOCK = re.compile(r"(?:![\w!/.:-]*[ \t]+|&[\w-]+[ \t]+)*[|>][+-]?\d?[+-]?[ \t]*(?:#.*)?$")
_YAML_FLOW = re.compile(r"\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^']|'')*+'|[\[\]{},]|#[^\n]*|[^\[\]{},\"'#\n]+|\n")
_YAML_QUOTED = re.compile(r"(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^']|'')*+')[ \t]*(?:#.*)?$")


def parses_yaml(text: str) -> bool:
    """Whether a text is YAML whose documents are block mappings or sequences; scalars and flow collections may be their values.

    A plain text is a YAML scalar too, which says nothing about a file, so a scalar alone doesn't count.
    """
    lines = text.lstrip("\ufeff").split("\n")
    levels: list[tuple[int, str]] = []  # (column, 'map' or 'seq') of the open collections
    open_value: int | None = -1  # the column beyond which a value may begin, None where none is awaited
    scalar: int | None = None  # a plain scalar may go on in lines beyond this column
    found, n = False, 0
    while n < len(lines):
        line = lines[n].rstrip()
        n += 1
        body = line.lstrip(" ")
        if not body or body[0] == "#":
            continue
        if body[0] == "\t":
            return False
        column = len(line) - len(body)
        if column == 0 and (body in ("---", "...") or body.startswith("--- ") or body[0] == "%"):
            levels, open_value, scalar = [], -1, None
            continue
        if scalar is not None and column > scalar and not _YAML_KEY.match(body) and not body.startswith("- "):
            continue
        scalar = None
        while True:  # a line may open several collections: - - a: b
            dash = body == "-" or body.startswith("- ")
            key = None if dash else _YAML_KEY.match(body)
            if not dash and not key:
                break
            kind = "seq" if dash else "map"
            while levels and (levels[-1][0] > column or levels[-1][0] == column and levels[-1][1] == "seq" and kind == "map"):
                levels.pop()
                open_value = None
            if not levels or levels[-1] != (column, kind):
                if open_value is None or column <= open_value and not (kind == "seq" and column == open_value and levels and levels[-1][1] == "map"):
                    return False
                levels.append((column, kind))
            found = True
            rest = body[1:] if dash else body[key.end() :]
            inner = rest.lstrip(" \t")
            open_value = column
            column += len(body) - len(inner)
            body = inner
            if not body or body[0] == "#":
                body = ""
                break
            if not dash:
                break
        if not body:
            continue
        if not found or open_value is None:
            return False
        base = open_value
        open_value = None
        if _YAML_BLOCK.match(body):
            while n < len(lines) and (not lines[n].strip() or len(lines[n]) - len(lines[n].lstrip(" ")) > base):
                n += 1
        elif body[0] in "[{":
            depth, rest = 0, body
            while True:
                at = 0
                while at < len(rest):
                    m = _YAML_FLOW.match(rest, at)
                    if not m:
                        return False
                    at = m.end()
                    depth += (m.group() in ("[", "{")) - (m.group() in ("]", "}"))
                if depth == 0:
                    break
                if depth < 0 or n == len(lines):
                    return False
                rest = lines[n]
                n += 1
        elif body[0] in "\"'":
            if not _YAML_QUOTED.match(body):
                return False
        elif body[0] in "@`%" or _YAML_KEY.match(body) or body[0] in "{}[],":
            return False
        else:
            scalar = base
    return found
