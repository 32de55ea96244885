"""Grammars: linear time on cut files, style sheets and YAML, and that every file is tried in all of them."""

import random
import re
import time

import pytest

from strandline.llm import plain_grammars as plain
from strandline.llm.parsecheck import CHECKS, judge, parse_verdicts
from strandline.sources import ecma, ecma_lex


def cut_file(functions):
    return "\n\n".join(f"export function f{i}(a: number) {{\n  return a + {i};\n}}" for i in range(functions)) + "\n\nexport function last("


def test_cut_files_take_linear_time():
    seconds = {}
    for n in (10, 100, 1000, 10_000):
        began = time.perf_counter()
        assert judge("a.ts", cut_file(n))[:3:2] == (False, None)
        seconds[n] = time.perf_counter() - began
    assert seconds[10_000] < 30 * max(seconds[1000], 0.02)


@pytest.mark.parametrize("text", ["word " * 50_000, "a" * 300_000, "\n" * 200_000 + "x", "/* " * 50_000, "{" * 20_000, "a:\n" * 20_000, "- " * 20_000, "'" * 30_000, '"\\' * 30_000, "<a" * 20_000, ".a{" * 20_000, "`${" * 5_000])
def test_odd_texts_end_soon(text):
    began = time.perf_counter()
    judge("a.ts", text)
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    "text,valid",
    [
        (".a { color: red; }", True),
        ("@import url(x.css);\n/* c */ a:hover, .b > #c[d='e']::after { color: red; margin: 0 auto !important }", True),
        ("@media (max-width: 3px) { .x { --y: {z} ; } }\n@keyframes k { 0% { top: 0 } to { top: calc(1px + 2%) } }", True),
        (".a { .b & { color: #fff } }", True),
        (".a { color red; }", False),
        (".a { color: red;", False),
        ("a b", False),
        ("", False),
        ("/* only a comment */", False),
        ("export {};", False),
        ("function f() { return 1; }", False),
        ("}", False),
    ],
)
def test_style_sheets(text, valid):
    assert plain.parses_css(text) is valid


@pytest.mark.parametrize(
    "text,valid",
    [
        ("a: 1\nb:\n  - c\n  - d: e\n    f: |\n      text: [\n  - [1, {x: y}]\ng: 'h'\n# c\nk:\n- z\n- y\nm: plain text\n  goes on\n", True),
        ("- a\n- b:\n    c\n---\nd: e\n", True),
        ("key: [1,\n  2]\n", True),
        ("hello world\n", False),
        ("a: 1\n   b: 2\n", False),
        ("a: [1, 2\n", False),
        ("a:\n\tb: 1\n", False),
        ("import x from 'y';\n", False),
        ("", False),
    ],
)
def test_yaml(text, valid):
    assert plain.parses_yaml(text) is valid


def test_other_grammars():
    assert plain.parses_toml("[a]\nb = 1\n") and not plain.parses_toml("") and not plain.parses_toml("a b")
    assert plain.parses_xml("<a><b c='d'/></a>") and not plain.parses_xml("<a>") and not plain.parses_xml("x")
    assert not plain.parses_json("[" * 100_000) and not plain.parses_python("(" * 100_000)


def test_valid_files_are_tried_in_all_grammars():
    assert judge("a.ts", "const a = 1;")[3] and set(judge("a.ts", "const a = 1;")[3]) == {"ts", "tsx", "js", "mjs"}
    assert set(judge("a.mts", "export function f(a: number): number[] { return [a]; }")[3]) == {"ts", "tsx"} and judge("a.jsx", "a(<b/>);")[0]
    assert judge("a.ts", "{'a': 1}")[3] and set(judge("x.md", "{}")[3]) <= set(CHECKS)
    assert judge("A.TS", "let x = 1;")[0] and judge("a.ts", "")[3] == []


def test_verdicts_list_the_grammars(spark):
    rows = [(1, "r", "a.ts", "let a = 1;", None, "x"), (2, "r", "b.ts", "a:\n  - b\n  - c: d\n", None, "x"), (3, None, None, None, None, "x")]
    frame = spark.createDataFrame(rows, "file_id long, repo string, path string, text string, ingested_at timestamp, valid string")
    got = {r.file_id: (r.valid, r.cause, r.parses_as, sorted(r.accepted_by)) for r in parse_verdicts(frame).collect()}
    assert got == {1: (True, None, None, ["js", "mjs", "ts", "tsx"]), 2: (False, "wrong extension", "yaml", ["yaml"]), 3: (True, None, None, [])}


def test_a_text_is_parsed_again_only_where_the_grammar_can_matter(monkeypatch):
    made = []
    parser = ecma._Parser
    monkeypatch.setattr(ecma, "_Parser", lambda *a: made.append(a[1:]) or parser(*a))

    def parsed(text):
        made.clear()
        source = ecma.Source(text)
        errors = {name: source.error(name) is None for name in ("ts", "tsx", "js", "mjs")}
        return len(made), errors

    assert parsed("const a = b < c;\n") == (2, dict.fromkeys(("ts", "tsx", "js", "mjs"), True))
    assert parsed("let m: Map<string, Set<number>>;\n") == (2, {"ts": True, "tsx": True, "js": False, "mjs": False})
    # here JSX decides
    assert parsed("const a = <T>b;\n")[1] == {"ts": True, "tsx": False, "js": False, "mjs": False}
    assert parsed("let x\n<T>y;\n")[1] == {"ts": True, "tsx": False, "js": False, "mjs": False}
    assert parsed("const f = async <T>(x: T) => x;\n")[1]["ts"]


def test_plain_words_and_marks_are_the_tokens_of_before():
    marks = r"[=(,:\[!&|?{};~]"
    slow = re.compile(rf"[\r\n]\s*|{ecma_lex._OPEN}|{marks}\s*{ecma_lex._REGEX}|{ecma_lex._NUMBER}|(?:[\w$]|\\u[0-9a-fA-F]{{4}}|\\u\{{[0-9a-fA-F]+\}})+|{ecma_lex._TEMPLATE}|#{ecma_lex._WORD}|{ecma_lex._OPERATOR}|\S")
    rng = random.Random(8)
    parts = ["a", "b1", "é", "٣", "1.5", ".5", "0x1", "\\u0041", "\\u{61}", "\\", "#p", "...", "?.", "=>", "=", "==", ".", "/", "/x/g", "//c\n", "/*c*/", "/*", "'s'", "'", "`t${x}`", "`", "(", ")", "[", "]", "{", "}", ";", ",", ":", "~", "@", "<", ">>", " ", "\t", "\n  ", "\r\n", "\x0b", " "]
    for _ in range(5000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert ecma_lex.fast_tokens(text) == slow.findall(text)
