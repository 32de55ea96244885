"""Parse scans: texts to declarations, structural facts and failures.

A tree isn't built. Comments and literals are blanked in place, so offsets stay true, and declarations are
found by their heads and the bracket that ends them. Whether a text parses is decided by ecma.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources.ecma import GRAMMARS, syntax_error

_LITERAL = re.compile(
    r"//[^\r\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\r\n]|\\[\s\S])*\"|'(?:[^'\\\r\n]|\\[\s\S])*'|`"
    r"|(?<=[=(,:\[!&|?{};])(\s*)/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[a-z]*"
)
_HEAD = re.compile(
    r"(?<![\w$.])(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?(?:"
    r"(?P<function>(?:async\s+)?function\b\s*\*?\s*(?P<fname>[\w$]+))"
    r"|(?P<interface>interface\s+(?P<iname>[\w$]+))"
    r"|(?P<type>type\s+(?P<tname>[\w$]+)\s*(?:<[^=]*>)?\s*=)"
    r"|(?P<class>(?:abstract\s+)?class\s+(?P<cname>[\w$]+)[^{]*\{)"
    r"|(?P<const>(?:const|let|var)\s+(?P<vname>[\w$]+)\s*(?::[^=]*?)?=\s*(?:async\s*)?(?=\(|[\w$]+\s*=>|function\b|<)))"
)
_METHOD = re.compile(r"(?:(?:public|private|protected|static|override|async|abstract|readonly|get|set)\s+)*\*?\s*(?P<name>[\w$#]+)\s*(?:<[^>(]*>)?\s*\(")
_PAIR = {"(": ")", "[": "]", "{": "}"}


def _template_end(text: str, at: int) -> int:
    """One past the backtick that ends the template literal that begins at `at`; templates may stand in its substitutions."""
    at += 1
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 2
        elif c == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                c = text[at]
                if c == "`":
                    at = _template_end(text, at)
                    continue
                if c in "'\"":
                    m = _LITERAL.match(text, at)
                    at = m.end() if m else at + 1
                    continue
                depth += (c == "{") - (c == "}")
                at += 1
        else:
            at += 1
    return len(text)


def blanked(text: str) -> str:
    """The text with comments and literals as blanks of the same length, line ends kept."""
    out, at = [], 0
    while m := _LITERAL.search(text, at):
        begin = m.start() + len(m.group(1) or "")
        end = _template_end(text, begin) if text[begin] == "`" else m.end()
        out += [text[at:begin], re.sub(r"[^\r\n]", " ", text[begin:end])]
        at = end
    return "".join([*out, text[at:]])


def _close(code: str, at: int) -> int:
    """Where the bracket that opens at `at` is closed, one past it; the end of the text if it isn't."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(code, at):
        depth += 1 if m.group() in _PAIR else -1
        if depth == 0:
            return m.end()
    return len(code)


def _statement_end(code: str, at: int) -> int:
    """One past the semicolon that ends a statement, or its last bracket where none follows."""
    while at < len(code):
        c = code[at]
        if c in _PAIR:
            at = _close(code, at)
        elif c == ";":
            return at + 1
        else:
            at += 1
    return len(code)


def _body_end(code: str, at: int) -> int:
    """The end of a function from its parameter list on: its body, or the semicolon of a signature without one."""
    at = _close(code, at)
    while at < len(code) and code[at] not in "{;":
        if code[at] == ":" and (m := re.compile(r":\s*").match(code, at)) and code[m.end() : m.end() + 1] in ("{", "("):
            at = _close(code, m.end())
            continue
        at += 1
    return _close(code, at) if code[at : at + 1] == "{" else at + 1


def declarations(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(kind, name, start, end, exported) of the functions, methods, interfaces and types of a text, in order; start is that of the code."""
    return [d[:5] for d in declarations_and_members(text)]


def declarations_and_members(text: str) -> list[tuple[str, str, int, int, bool, bool]]:
    """declarations() with a last value that says whether one is a method of a class; a method is exported if its class is."""
    code = blanked(text)
    found: list[tuple[str, str, int, int, bool, bool]] = []
    at = 0
    while m := _HEAD.search(code, at):
        exported = bool(m.group("export"))
        if m.group("function"):
            bracket = code.find("(", m.end())
            end = _body_end(code, bracket) if bracket >= 0 else len(code)
            found.append(("function", m.group("fname"), m.start(), end, exported, False))
            at = end
        elif m.group("interface"):
            bracket = code.find("{", m.end())
            end = _close(code, bracket) if bracket >= 0 else len(code)
            found.append(("interface", m.group("iname"), m.start(), end, exported, False))
            at = end
        elif m.group("type"):
            end = _statement_end(code, m.end())
            found.append(("type", m.group("tname"), m.start(), end, exported, False))
            at = end
        elif m.group("const"):
            end = _statement_end(code, m.end())
            value = code[m.end() : end]
            if "=>" in value or value.lstrip().startswith("function"):
                found.append(("function", m.group("vname"), m.start(), end, exported, False))
            at = end
        else:
            last = _close(code, m.end() - 1)
            inside = m.end()
            while inside < last - 1:
                if code[inside].isspace() or code[inside] == ";":
                    inside += 1
                elif head := _METHOD.match(code, inside):
                    end = _body_end(code, head.end() - 1)
                    if code[end - 1] == "}":
                        found.append(("function", head.group("name"), inside, end, exported, True))
                    inside = end
                else:
                    inside = min(_statement_end(code, inside), last)
            at = last
    return found


_DECLARED = "id long, repo string, path string, kind string, name string, start int, end int, exported boolean, member boolean"


def declaration_scan(files: DataFrame, key: str, repo: str, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(declarations, failures) of files: one row for each declaration, and one (key, path, reason) for each file that doesn't parse.

    A .js file is read with JSX allowed. Files with other endings, null and empty texts have no declarations.
    """
    rows = files.select(F.col(key).cast("long").alias("id"), F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("repo", pa.string()), ("path", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("exported", pa.bool_()), ("member", pa.bool_())])
        for batch in batches:
            out = []
            for i, r, p, t in zip(*(c.to_pylist() for c in batch.columns)):
                ending = (p or "").rsplit(".", 1)[-1]
                if not t or ending not in GRAMMARS:
                    continue
                error = syntax_error(t, ending)
                if error is not None:
                    out.append((i, r, p, None, error, None, None, None, None))
                    continue
                out += [(i, r, p, *found) for found in declarations_and_members(t)]
            yield pa.RecordBatch.from_arrays([pa.array([o[n] for o in out], f.type) for n, f in enumerate(schema)], schema=schema)

    both = rows.mapInArrow(run, _DECLARED)
    return both.where("kind is not null"), both.where("kind is null").select("id", "repo", "path", F.col("name").alias("reason"))


#: fixed values: what each list of facts is found by, and the group that is its value
FACTS: dict[str, tuple[str, int]] = {
    "call": (r"([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\(", 1),
    "string": (r"'([^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'", 1),
    "literal": (r"\"([^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+)\"", 1),
    "comparison": (r"return[ \t]+([\w$.]+[ \t]*(?:===|!==|<|>)[ \t]*[\w$.]+)", 1),
    "guard": (r"if[ \t]*\(([^()\n]*(?:===|!==)[ \t]*null)\)", 1),
    "return": (r"return[ \t]+([^;\n]+);", 1),
    "skip": (r"\b(continue|break)[ \t]*;", 1),
    "object": (r"\{ ((?:\.\.\.)?[\w$]+(?:: [^{},\n]+)?(?:, (?:\.\.\.)?[\w$]+(?:: [^{},\n]+)?)*) \}", 1),
    "element": (r"<([A-Z][\w$]*(?:\.[A-Z][\w$]*)*)", 1),
    "column": (r"([\w$]+)\.(?:notNullable|nullable|primary)\(", 1),
    "optional": (r"function[ \t]+([\w$]+)\((?:[\w$]+(?:\?:| =)[^,()]*(?:, )?)+\)", 1),
}


def structural_facts(files: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep..., fact, value) by expressions only: the facts of FACTS in each text, in order within each list; comments and strings aren't told from code."""
    def found(name: str, pattern: str, group: int):
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.struct(F.lit(name).alias("fact"), v.alias("value")))

    facts = F.concat(*[found(name, *where) for name, where in FACTS.items()])
    return files.select(*keep, F.explode(facts).alias("f")).select(*keep, "f.fact", "f.value")
