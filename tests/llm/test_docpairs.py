"""Links between comments and functions: implausible ones are rejected, the whole file is looked at."""

import pytest

from strandline.llm.docpairs import documented_functions, informative, match_file, prose, weight


def units_of(*texts):
    """Functions of one file, one after the other."""
    out, at = [], 0
    for n, (name, text) in enumerate(texts):
        out.append({"unit_id": n, "name": name, "start_pos": at, "text": text})
        at += len(text) + 2
    return out


def test_tags_of_other_parameters_make_a_link_implausible():
    wrong = "/**\n * Keeps both sides in step.\n * @param left\n * @param right\n */\nfunction f(a, b) { return a; }"
    right = wrong.replace("f(a, b)", "f(left, right)")
    assert match_file(units_of(("f", wrong))) == [] and [x["unit_id"] for x in match_file(units_of(("f", right)))] == [0]
    assert weight("anything", ["x"], "f", "f(a)", 0) is None and weight("anything", ["a"], "f", "f(a)", 0) == 3.0 and weight("anything", [], "f", "f()", 0) == 2.0


def test_a_comment_finds_its_function_further_down():
    stray = "/**\n * Waits until the queue drains.\n * @param queue\n */\nfunction first(a) { return a; }"
    got = match_file(units_of(("first", stray), ("drainQueue", "function drainQueue(queue) { return queue; }"), ("other", "function other() {}")))
    assert [(x["unit_id"], x["adjacent"]) for x in got] == [(1, False)]
    plain = "// Waits until all is done again.\nfunction first(a) { return a; }"
    assert [(x["unit_id"], x["adjacent"]) for x in match_file(units_of(("first", plain), ("second", "function second() {}")))] == [(0, True)]


def test_the_whole_signature_counts():
    long = "// Says how it goes on.\n// @param last\nfunction f(" + ", ".join(f"p{i} = {{}}" for i in range(600)) + ", last) { return last; }"
    assert [x["unit_id"] for x in match_file(units_of(("f", long)))] == [0]


@pytest.mark.parametrize("text", ["Written by Maria Lopez in Vienna", "Created on 2024-01-01 by somebody else", "Ported by the platform team"])
def test_authors_describe_nothing(text):
    assert not informative(prose("// " + text)[0], "f")


def test_rows_without_a_file_stand_alone(spark):
    rows = [(i, None, None, "function", "f", 0, "// Waits for the next turn of the loop\nfunction f() {}", 1) for i in range(3)]
    rows += [(9, "r", "a", "function", "g", None, "function g() {}", 1), (9, "r", "a", "function", "g", 0, "// Waits for the turn of others\nfunction g() {}", 2)]
    frame = spark.createDataFrame(rows, "unit_id long, repo string, file_path string, kind string, name string, start_pos int, text string, scanned_at int")
    assert sorted(r.unit_id for r in documented_functions(frame).collect()) == [0, 1, 2, 9]
