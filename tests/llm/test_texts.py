"""Parsing verdicts, file origins, documented functions, encoding, subjects: decided cases and awkward rows."""

import random

import pytest

from strandline.llm.docpairs import assign, documented_functions, informative, prose
from strandline.llm.encoding import VOCABULARIES, encode_texts, encoder
from strandline.llm.handwritten import file_origins, shingle_hashes
from strandline.llm.parsecheck import judge, parse_rates, parse_verdicts, rank_grammars
from strandline.llm.subjects import features, subject_scores

FILES = "file_id long, repo string, path string, text string, ingested_at timestamp"


def test_wrong_extensions_and_corruption():
    assert judge("a.ts", "def f(x):\n    return x\n")[2] == "python"
    assert judge("a.ts", ".a {\n  color: red;\n}\n")[2] == "css"
    assert judge("a.js", "export const f = (a: number): string => 'x';")[2] in ("ts", "tsx")
    assert judge("a.ts", '{"a": [1, 2]}')[2] == "json"
    assert judge("a.ts", "function f( {")[2] is None and judge("a.ts", "function f( {")[0] is False
    assert judge("a.ts", None)[0] and judge("a.ts", "")[0] and judge(None, "((")[0] and judge("a.txt", "((")[0]
    assert rank_grammars("def f(x):\n    return x\n")[0] == "python"


def test_verdicts_take_the_latest_row_and_rates_count_files(spark):
    rows = [(1, "r", "a.ts", "let a = ;", None), (2, "r", "b.ts", "let a = 1;", None), (3, "q", "c.js", None, None), (3, "q", "c.js", None, None), (None, "q", "d.js", "((", None)]
    frame = spark.createDataFrame(rows, FILES)
    verdicts = parse_verdicts(frame)
    assert {r.file_id: r.valid for r in verdicts.collect()} == {1: False, 2: True, 3: True}
    assert sorted((r.repo, r.language, r.files, r.unparsed, r.rate) for r in parse_rates(verdicts).collect()) == [("q", "js", 1, 0, 0.0), ("r", "ts", 2, 1, 0.5)]
    assert parse_verdicts(frame.limit(0)).collect() == []


def test_file_origins(spark):
    hand = "import { a } from './a';\n\n/** Adds one. */\nexport function f(x: number): number {\n  const y = x + 1;\n  if (y > 3) throw new Error('big');\n  return y;\n}\n" * 3
    blob = "export const d = [" + ", ".join(str(i) for i in range(300)) + "];\n"
    rows = [
        (1, "r", "src/a.ts", hand, None),
        (2, "r", "src/b.ts", "// Code generated by tool. DO NOT EDIT.\n" + hand, None),
        (3, "r", "node_modules/x-y/c.js", "var a = 1;", None),
        (4, "r", "src/vendor/own.ts", "/* do not edit the order by hand: generated ids depend on it */\n" + hand, None),
        (5, "r", "src/d.js", blob, None),
        (6, "r", "src/e.min.js", "var a=1;", None),
        (7, "r", "src/f.ts", None, None),
        (8, None, None, "", None),
        (9, "r", "src/g.js", "/*\n * Copyright (c) 2025 own project\n * Licensed under the MIT license\n */\n" + hand.replace(": number", ""), None),
    ]
    frame = spark.createDataFrame(rows, FILES)
    got = {r.file_id: r.handwritten for r in file_origins(frame).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: True, 8: True, 9: True}
    assert file_origins(frame.limit(0)).collect() == []
    assert len(shingle_hashes("")) == 0 and len(shingle_hashes("ab")) == 1


@pytest.mark.parametrize(
    "comment,name,says",
    [
        ("/** Rounds half up, because the screen shows whole units. */", "roundOff", True),
        ("// Not safe to call twice.", "run", True),
        ("/** The function parseInput. */", "parseInput", False),
        ("// Helper to parse the inputs", "parseInput", False),
        ("// eslint-disable-next-line no-console", "f", False),
        ("/* Copyright (c) 2025 the authors. */", "f", False),
        ("// SPDX-License-Identifier: MIT", "f", False),
        ("// ------------ helpers ------------", "f", False),
        ("// TODO: document", "f", False),
        ("/** Description. */", "f", False),
        ("// T-1234", "f", False),
        ("// const old = f(0);\n// return old;", "f", False),
        ("/**\n * @param a\n * @returns {*}\n */", "f", False),
        ("/**\n * @param a\n * @remarks Expects metres, not feet\n */", "f", True),
        ("/** Hält beide Werte auf demselben Stand. */", "f", True),
        ("//", "f", False),
        ("/** ??? */", None, False),
    ],
)
def test_comments_that_say_something(comment, name, says):
    assert informative(prose(comment)[0], name) is says


def test_documented_functions(spark):
    schema = "unit_id long, repo string, file_path string, kind string, name string, start_pos int, text string, scanned_at int, description string"
    good = "/** Keeps both sides in step. */\n\n// prettier-ignore\nfunction f() { /* tells a lot about nothing */ }"
    rows = [(1, "r", "a", "function", "f", 0, good, 1, "c"), (1, "r", "a", "function", "f", 0, good, 2, "c"), (2, "r", "a", "function", "g", 200, "function g() {\n  // says much about the inner loop\n}", 1, "c"), (3, "r", "b", "interface", "I", 0, "/** Says a whole lot here. */ interface I {}", 1, "c"), (4, "r", "b", "function", None, 50, None, 1, "c"), (5, None, None, "function", None, None, "// Waits for the next turn of the loop\nfunction h() {}", 1, "c")]
    got = {r.unit_id: r for r in documented_functions(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 5} and got[1].description == "Keeps both sides in step." and got[1].code.startswith("function f()")
    assert documented_functions(spark.createDataFrame([], schema)).collect() == []


def test_assignment_is_best_over_all_matchings():
    import itertools

    rng = random.Random(0)
    for _ in range(60):
        weights = {(a, b): rng.random() for a in range(4) for b in range(4) if rng.random() < 0.6}
        best = 0.0
        for n in range(1, 5):
            for edges in itertools.combinations(weights, n):
                if len({a for a, _ in edges}) == n == len({b for _, b in edges}):
                    best = max(best, sum(weights[e] for e in edges))
        got = assign(weights)
        assert abs(sum(weights[a, b] for b, a in got.items()) - best) < 1e-9


def test_encoding_equals_the_library_on_odd_texts(spark):
    e = encoder("byte_bpe_50k", VOCABULARIES)
    rng = random.Random(9)
    alphabet = ["a", "é", "ß", "'", "'s", "'LL", " ", "  ", "\n", "\t", "\r\n", "1", "²", "!", "—", "日本", " ", "👍", "<|endoftext|>", "\x00", "\x1c", "ـ", "Z" * 90]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 30))) for _ in range(3000)] + ["x" * 50_000, " " * 5_000]
    assert all(e.encode(t) == e.encoding.encode_ordinary(t) for t in texts)
    frame = spark.createDataFrame([(1, None, "i"), (2, "", "i"), (3, "<|endoftext|>", "i")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in encode_texts(frame).collect()}
    assert got[1] == got[2] == [] and 50256 not in got[3] and encode_texts(frame.limit(0)).collect() == []


def test_subjects_on_held_out_documents(spark):
    words = {"law": "court judge verdict appeal clause witness".split(), "sport": "goal referee match team league coach".split(), "food": "oven dough broth recipe roast spice".split()}
    neutral = "this was agreed in the last review".split()
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(360):
        mine = rng.sample(sorted(words), 2 if i % 6 == 0 else 1)
        docs.append((i, ". ".join(" ".join(rng.sample(words[s], 4)) for s in mine for _ in range(3)) + ". " + " ".join(neutral)))
        labels += [(i, s.upper() if i % 5 == 0 else s) for s in mine]
    docs += [(900, None), (901, ""), (902, " ".join(neutral)), (903, "​")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([x for x in labels if x[0] % 4] + [(1, "unknown"), (None, "law"), (2, None)], "doc_id long, subject string")
    subjects = spark.createDataFrame([(s,) for s in words], "subject string")
    got = {(r.doc_id, r.subject) for r in subject_scores(frame, known, subjects).collect()}
    test = {(i, s.lower()) for i, s in labels if i % 4 == 0}
    found = {x for x in got if x[0] % 4 == 0 and x[0] < 900}
    assert len(found & test) / len(test) > 0.9 and len(found & test) / max(1, len(found)) > 0.9
    assert not {x for x in got if x[0] >= 900}
    assert subject_scores(frame, known.limit(0), subjects).collect() == [] and len(features(None)) == 0


def test_subjects_fold_by_case_and_two_fits_agree(spark):
    docs = [(i, ("court judge verdict " if i % 2 else "goal referee match ") * 3 + f"word{i}") for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "Law" if i % 2 else " sport ") for i in range(60)], "doc_id long, subject string")
    subjects = spark.createDataFrame([("law",), ("LAW",), ("Sport",), (None,), (" ",)], "subject string")
    first = sorted(tuple(r) for r in subject_scores(frame, labels, subjects).collect())
    assert {(i, s) for i, s, _ in first} == {(i, "LAW" if i % 2 else "Sport") for i in range(80)}
    assert first == sorted(tuple(r) for r in subject_scores(frame.repartition(3), labels.repartition(5), subjects).collect())
    sampled = subject_scores(frame, labels, subjects, most_labelled=40).collect()
    assert {(r.doc_id, r.subject) for r in sampled} == {(i, s) for i, s, _ in first}
