"""Types, roles, runs, judging and site operators on small inputs: positive and negative rows, nulls, ties, empty inputs."""

import pytest
from pyspark.sql import functions as F

from strandline.functions import paths, text
from strandline.operators import gates, imports, judging, roles, runs, sites, types


def ids(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_types_are_found_by_line_then_by_name(spark):
    facts = spark.createDataFrame([("A.ts", 3, "x", "string"), ("a.ts", 3, "x", "string | null"), ("a.ts", 9, "y", "Row"), ("a.ts", None, "z", "Z"), ("a.ts", 7, "", "B"), ("a.ts", 5, "n", None)], "file string, line int, name string, display string")
    at = spark.createDataFrame([(1, "a.TS", 3, "q"), (2, "a.ts", 4, "y"), (3, "a.ts", 4, "none"), (4, "b.ts", 3, "x"), (5, "a.ts", None, "z"), (6, None, 3, None)], "id int, file string, line int, name string")
    got = {r.id: r.type for r in types.type_at(at, facts, "file", "line", "name", "display").collect()}
    assert got == {1: "string | null", 2: "Row", 3: None, 4: None, 5: "Z", 6: None}


def test_type_filters_keep_what_is_unknown(spark):
    rows = [(1, ["string"]), (2, ["Set<string>"]), (3, ["number | string"]), (4, []), (5, None), (6, [None, "number"]), (7, ["void", "never"]), (8, ["Promise<string>"])]
    frame = spark.createDataFrame(rows, "id int, t array<string>").select("id", types.string_capable(F.col("t")), types.may_yield(F.col("t"), sites.NO_DATA))
    assert [(a, b) for _, a, b in ids(frame)] == [(True, True), (False, True), (True, True), (True, True), (True, True), (True, True), (False, False), (True, True)]


def test_guards_take_their_first_telling_ref(spark):
    guards = spark.createDataFrame([("f", 1, 10, 12, True, ["a", "b"]), ("f", 2, 11, 12, False, ["a"]), ("f", 3, 50, 51, True, ["a"]), ("f", 4, 13, 14, True, ["c"])], "file string, g int, at int, stop_at int, exits boolean, refs array<string>")
    spans = spark.createDataFrame([("f", "outer", 0, 40), ("f", "inner", 5, 20)], "file string, span string, start int, stop int")
    facts = spark.createDataFrame([("f", "a", ["Object"], []), ("f", "b", ["Object"], ["null"]), ("f", "c", [], None)], "file string, ref string, flags array<string>, members array<string>")
    got = ids(types.guards_for_types(guards, spans, facts, ["file"], "g", "at", "stop_at", "exits", "refs", "span", "start", "stop", "ref"))
    assert got == [("f", 1, "inner", "b"), ("f", 4, "inner", "c")]


def test_upward_roles_and_the_edge(spark):
    graph = roles.module_graph(spark.createDataFrame([("a/x", "b/y"), ("a/x", "b/y"), ("b/y", "a/x"), ("a/x", "a/x"), ("a/x", None), ("a", "a/x")], "f string, t string"), F.col("f"), F.col("t"), [])
    assert ids(graph) == [("a", "a/x", 1), ("a/x", "b/y", 2), ("b/y", "a/x", 1)]
    ranked = spark.createDataFrame([("a", "low", 1), ("a/x", "low2", 2), ("b/y", "high", 3), ("c", "none", None)], "module string, role string, rank int")
    assert ids(roles.upward_roles(graph, ranked, [])) == [("low2", "high", "a/x", "b/y")]
    assert ids(roles.edge_roles(ranked, "role", "rank", [])) == [("high",)] and ids(roles.edge_roles(ranked.limit(0), "role", "rank", [])) == []


def test_missing_and_orphans(spark):
    rows = [("Card", ["Display", "Provider", "useCard", "Gone"], ["CardDisplay", "Lost"]), ("E", [], [])]
    got = roles.missing_and_orphans(spark.createDataFrame(rows, "p string, k array<string>, n array<string>"), "k", "n", "p")
    assert sorted((r.p, r.missing, r.orphans) for r in got.collect()) == [("Card", ["Gone"], ["Lost"]), ("E", [], [])]


def test_manifest_replay_and_baseline(spark, tmp_path):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, digest string")
    def mark(rows, config):
        return runs.manifest(rows, "path", "digest", config).first().manifest
    first = mark(files, {"a": 1, "b": 2})
    assert first == mark(files.repartition(3).orderBy(F.desc("path")), {"b": 2, "a": 1}) != mark(files, {"a": 2, "b": 2})
    assert first != mark(files.where("path <> 'a'"), {"a": 1, "b": 2}) and len(mark(files.limit(0), {})) == 16
    place = str(tmp_path / "run")
    assert runs.replay(spark, first, place) is None
    runs.store_run(files, first, place)
    assert runs.replay(spark, first, place).count() == 3 and runs.replay(spark, "other", place) is None
    found = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "identity string")
    runs.write_baseline(found, "identity", str(tmp_path / "base"))
    runs.write_baseline(found.where("identity <> 'y'"), "identity", str(tmp_path / "base"))
    assert ids(runs.read_baseline(spark, str(tmp_path / "base"))) == [("x",)]


def test_changes_and_what_they_reach(spark):
    old = spark.createDataFrame([("same", "1"), ("mod", "2"), ("gone", "3"), ("also", "3"), ("left", "4")], "p string, d string")
    new = spark.createDataFrame([("same", "1"), ("mod", "9"), ("moved", "3"), ("fresh", "8")], "p string, d string")
    assert ids(runs.change_source(old, new, "p", "d")) == [("also", "D", None), ("fresh", "A", None), ("gone", "D", None), ("left", "D", None), ("mod", "M", None), ("moved", "R100", "also")]
    edges = spark.createDataFrame([("u", "a"), ("v", "b"), ("w", "c")], "s string, t string")
    before, after = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"])], "p string, e array<string>"), spark.createDataFrame([("a", ["x", "new"]), ("b", ["z", "y"])], "p string, e array<string>")
    assert ids(runs.affected(spark.createDataFrame([("a",), ("b",), ("c",)], "p string"), edges, before, after, "p", "s", "t", "e")) == [("a",), ("b",), ("c",), ("u",)]
    assert runs.outside_root(old.withColumn("p", F.lit("../x")), "p", True).count() == 0 and runs.outside_root(old, "p", False).count() == 0


def test_requests_are_halved_and_retried():
    seen = []

    def ask(chunk):
        seen.append(list(chunk))
        if 3 in chunk and len(chunk) > 1 or chunk == [5] and seen.count([5]) < 2 or 9 in chunk:
            raise ValueError("bad distribution")
        return [x * 10 for x in chunk]

    assert judging.answer_in_halves(ask, [1, 2, 3, 4]) == [10, 20, 30, 40]
    assert judging.answer_in_halves(ask, [5]) == [50] and judging.answer_in_halves(ask, [9]) == [None] and judging.answer_in_halves(ask, []) == []

    def silent(_):
        raise judging.Unreachable

    with pytest.raises(judging.Unreachable):
        judging.answer_in_halves(silent, [1, 2])
    assert judging.ask_fewer(lambda c: sum(c) if len(c) <= 2 else 1 / 0, [1, 2, 3, 4, 5]) == (3, 2)
    with pytest.raises(ZeroDivisionError):
        judging.ask_fewer(lambda c: 1 / 0, [1])


def test_policies_for_a_silent_judge(spark):
    planned = spark.createDataFrame([("r", "a"), ("r", "b"), ("q", "c")], "rule string, subject string")
    assert judging.unavailable_policy("count", "report", "propagate") == "count" and judging.unavailable_policy(None, None, "propagate") == "propagate"
    with pytest.raises(ValueError):
        judging.unavailable_policy("guess", None, "report")
    assert [tuple(f.count() for f in judging.unreached(planned, p, "down")) for p in ("report", "propagate", "count")] == [(0, 0), (0, 2), (3, 2)]


def test_scope_holds_before_and_after(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "f string, n int")
    changed = rows.where("f = 'a'").select("f")
    assert ids(judging.scoped_plans(rows, "f", changed)) == ids(judging.scoped_findings(rows, "f", changed)) == [("a", 1)]
    assert judging.scoped_plans(rows, "f", None).count() == 2 and judging.scoped_plans(rows, "f", changed.limit(0)).count() == 0
    drops = spark.createDataFrame([("a", "unreadable"), ("b", "unreadable"), ("c", "unreadable"), ("a", "gate"), ("d", None)], "s string, stage string")
    got = judging.settled_drops(drops, "s", "stage", spark.createDataFrame([("a",)], "s string"), spark.createDataFrame([("b",), ("b",)], "s string"))
    assert ids(got) == [("a", "gate"), ("b", "budget"), ("c", "unreadable"), ("d", None)]


def test_prescriptions_members_and_totals(spark):
    rows = [("wire_contract", "same_module"), ("wire_contract", "apart"), ("domain_concept", None), ("framework_glue", "apart"), (None, "apart")]
    got = spark.createDataFrame(rows, "r string, l string").select(judging.prescription(F.col("r"), F.col("l")).alias("p"))
    assert [r.p for r in got.collect()] == ["keep one", "expected", "share", "leave", "hoist"]
    members = spark.createDataFrame([("c", f"m{i:02}", i == 19) for i in range(20)] + [("d", "x", None)], "c string, n string, ch boolean")
    named = {r.c: r.names for r in judging.described_members(members, "c", ["n"], "n", "ch").collect()}
    assert named == {"c": ["m19"] + [f"m{i:02}" for i in range(11)], "d": ["x"]}
    totals = judging.run_totals(spark.createDataFrame([("r", True, 5), ("r", None, 7), ("r", False, None)], "k string, re boolean, t int"), "re", "t", ["k"])
    assert ids(totals) == [("r", 3, 1, 2, 7)]
    drift = judging.anchored_drift(spark.createDataFrame([("f", "string", "b", 2), ("f", "number", "a", 9), ("g", "x", "a", 1), ("f", None, "a", 1)], "f string, t string, file string, line int"), "f", "t", "file", "line")
    assert ids(drift) == [("f", 2, 3, "a", 1)]
    best = judging.relevance(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2, 0.9), (9, 1.0)], "k int, p double"), "k", "p", 0.5, 2)
    assert [tuple(r) for r in best.collect()] == [(2, 0.9, 0.5), (1, 0.0, 0.5)]


def test_settling_follows_the_proposal(spark):
    rows = [(None, "merge", 1.0, 1.0), ("merge", None, 0.1, None), ("merge", None, 0.9, 0.1), ("merge", None, None, None), ("merge", "merge", 0.0, 0.0), ("merge", "move", 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "p string, d string, g double, c double")
    got = [r.s for r in frame.select(gates.settle(F.col("p"), F.col("d"), F.col("g"), F.col("c")).alias("s")).collect()]
    assert got == ["drop", "review", "review", "act", "act", "review"]
    derived = spark.createDataFrame([("overloaded", 0.0, None), ("misplaced", 0.0, None), ("duplicated", 0.4, "value"), ("duplicated", 0.5, "value"), ("duplicated", 0.9, "meaning"), ("duplicated", 0.9, "unclear")], "c string, p double, d string")
    assert [r.s for r in derived.select(gates.derived_operation(F.col("c"), F.col("p"), F.col("d")).alias("s")).collect()] == ["split", "move", None, "merge", "move", None]
    assert [r.a for r in spark.createDataFrame([(0.75,), (None,)], "a double").select(gates.agreement_margin(F.col("a")).alias("a")).collect()] == [0.5, 1.0]
    normal = spark.createDataFrame([(3, 5, 0.1), (None, 5, 0.1), (3, 1, 0.2)], "r int, n int, f double").select(gates.normal_rating(F.col("r"), F.col("n"), F.col("f")).alias("x"))
    assert [r.x for r in normal.collect()] == [0.75, 0.1, 0.2]
    assert sorted(r.turn for r in gates.expand_repeats(spark.createDataFrame([(1,)], "q int")).collect()) == [0, 1, 2]


def test_specifiers_resolve_by_ancestors(spark):
    files = spark.createDataFrame([("r", "src/utils/a.ts"), ("r", "src/deep/utils/a.cts"), ("r", "lib/index.tsx"), ("q", "x.ts")], "repo string, t string")
    edges = [("r", "src/deep/er/i.ts", "~/utils/a"), ("r", "src/deep/er/i.ts", "@/lib"), ("r", "src/other/i.ts", "utils/a"), ("r", "src/i.ts", "react"), ("r", "src/i.ts", "/abs"), ("r", "src/deep/i.ts", "../../lib"), ("r", "i.ts", "./lib"), ("r", "src/i.ts", None)]
    frame = spark.createDataFrame(edges, "repo string, path string, s string")
    got = {(r.path, r.s): r.resolved for r in imports.resolve(frame, "repo", "path", "s", files, "t").collect()}
    assert got == {("src/deep/er/i.ts", "~/utils/a"): "src/deep/utils/a.cts", ("src/deep/er/i.ts", "@/lib"): "lib/index.tsx", ("src/other/i.ts", "utils/a"): "src/utils/a.ts", ("src/i.ts", "react"): None, ("src/i.ts", "/abs"): None, ("src/deep/i.ts", "../../lib"): "lib/index.tsx", ("i.ts", "./lib"): "lib/index.tsx", ("src/i.ts", None): None}
    clauses = spark.createDataFrame([("type { A as B, type C }",), ("D, { e }",), ("* as ns",), ("F",), ("{}",)], "c string").select(imports.imported_names(F.col("c")).alias("n"))
    assert [r.n for r in clauses.collect()] == [["A", "C"], ["default", "D"][:1] + ["e"], ["*"], ["default"], []]


def test_site_operators(spark):
    units = spark.createDataFrame([(1, "a", "shared", ["ab", "Copy", "XX12", "word", "more", "last"]), (2, "a", "own", ["long word"])], "unit int, file string, name string, ls array<string>")
    uses = spark.createDataFrame([("shared", "b"), ("shared", "c"), ("shared", "a"), ("own", "a"), ("own", "b"), (None, "z")], "name string, file string")
    assert ids(sites.caller_literals(units, uses, "unit", "file", "name", "ls")) == [(1, "Copy", 2), (1, "more", 2), (1, "word", 2)]
    builders = spark.createDataFrame([(1, "a", "fmt", True, ["string"]), (2, "a", "show", True, ["number"]), (3, "b", "other", False, []), (4, "c", "late", True, [])], "unit int, file string, name string, builds boolean, returns array<string>")
    calls = spark.createDataFrame([("a", "fmt"), ("b", "fmt"), ("c", "late"), ("a", "show"), ("b", "show")], "file string, name string")
    assert ids(sites.strings_beside_helpers(builders, calls, "unit", "file", "name", "builds", "returns")) == [(2, 1)]
    reads = sites.unbounded_reads(spark.createDataFrame([(7, "all"), (7, "all"), (8, "some")], "unit int, name string"), spark.createDataFrame([("all", "d", True), ("all", "e", True), ("some", "d", False)], "name string, file string, all_optional boolean"), spark.createDataFrame([("d",)], "file string"), "unit", "name", "file")
    assert ids(reads) == [(7, "all", "d")]
    deriving = spark.createDataFrame([(1, "x === y", ["B", "A"], True), (2, "x.done", ["A"], True), (3, "x", ["A"], False), (4, "x", None, True)], "unit int, text string, refs array<string>, c boolean")
    flags = spark.createDataFrame([("A", "done"), ("B", "open"), ("B", "late")], "owner string, field string")
    assert ids(sites.inferred_flags(deriving, flags, "unit", "text", "refs", "c", "owner", "field")) == [(1, "B", "late")]
    partners = sites.preferred_partner(spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a"), ("h", "a")], "field string, file string"), spark.createDataFrame([("f", "a", "n1"), ("f", "a", "n0"), ("f", "b", "n2"), ("g", "a", "n3")], "field string, file string, name string"), "field", "file", "name")
    assert ids(partners) == [("f", "a", "b", "n2"), ("f", "b", "a", "n0"), ("g", "a", "a", "n3")]
    skipping = spark.createDataFrame([(1, True, False, 1, []), (2, True, True, 1, []), (3, True, None, 1, ["boolean"]), (4, True, None, 2, ["Row[]"]), (5, False, False, 3, [])], "unit int, e boolean, t boolean, n int, r array<string>")
    assert [r.unit for r in sites.unaccounted_skips(skipping, "e", "t", "n", "r").orderBy("unit").collect()] == [1, 4]
    handlers = spark.createDataFrame([(1, "if (!row) { return res.status(500); }"), (2, "try { a(); } catch (e) { return res.status(503); }"), (3, "if (!row) { return res.status(404); }"), (4, None)], "id int, text string")
    assert ids(sites.outage_shapes(handlers, "text", r"if \(!\w+\)", r"catch \(\w+\)", r"status\(5\d\d\)", ["id"])) == [(1, "guard"), (2, "catch")]
    assert sites.only_such_users(spark.createDataFrame([("a", True), ("b", True), ("b", None)], "k string, x boolean"), ["k"], F.col("x")).collect()[0].k == "a"


def test_names_paths_and_comments(spark):
    row = spark.range(1).select(
        paths.display_name(F.lit("a/b.ts#this.lock")).alias("d"), paths.display_name(F.lit("plain")).alias("p"), paths.method_tail(F.lit("a/b.ts#this.lock")).alias("m"), paths.component_name(F.lit("x/my-card.view.tsx")).alias("c"),
        paths.is_test_path(F.lit("src/tests/a.ts")).alias("t"), paths.is_test_path(F.lit("src/latest/a.ts")).alias("n"), paths.is_compiler_helper(F.lit("__awaiter")).alias("h"), paths.is_compiler_helper(F.lit("__own")).alias("o"),
        text.preceding_comment(F.lit("/* a */ // b\n\nf()"), F.lit(14)).alias("k"), text.preceding_comment(F.lit("// b\nx f()"), F.lit(7)).alias("none"), text.untagged_prose(F.lit("Says it.\n@param x")).alias("u"),
    ).first()
    assert row[:] == ("b.ts:this.lock", "plain", "lock", "MyCardView", True, False, True, False, "// b", "", "Says it.")


def test_normalised_declarations(spark):
    a = "function f(a: Row, { p, c: d }: Opts, ...rest) { /* x */ const z = a.b + d; let [u] = b; return { z: z, q: rest.map((k) => k.a), p }; // end\n}"
    assert text.normalised(a) == "function f(_: Row, { _, c: _ }: Opts, ..._) { const _ = _.b + _; let [_] = b; return { z: _, q: _.map((_) => _.a), _ }; }"
    assert text.normalised("const g = async (x) => use('x', x);") == "const _ = async (_) => use('x', _);" and text.normalised("") == ""
    frame = spark.createDataFrame([("(a) => a.b",), ("(b) => b.b  // same",), (None,)], "t string").select(text.normalise(F.col("t")).alias("n"))
    assert [r.n for r in frame.collect()] == ["(_) => _.b", "(_) => _.b", None]


def test_places_of_a_word(spark):
    rows = spark.createDataFrame([(1, "the a\nbthe the\n\nthe"), (2, ""), (3, None), (4, "thethe")], "id int, t string")
    assert ids(text.occurrences(rows, ["id"], "t", "the")) == [(1, 0, 1, 1), (1, 11, 2, 6), (1, 16, 4, 1), (1, 7, 2, 2), (4, 0, 1, 1), (4, 3, 1, 4)]
