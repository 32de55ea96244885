"""Operators on small hand-made inputs: positive and negative rows, nulls, ties, empty inputs."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import hashing, paths, text
from strandline.operators import answers, fields, gates, graph, imports, intervals, layers, packing, report, scope, sequences, similarity


def ids(frame):
    return sorted(tuple(r) for r in frame.collect())


def random_sets(seed, n=120, vocabulary=90):
    rng = random.Random(seed)
    sets = [(i, sorted({f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(5, 25))})) for i in range(n)]
    for i in range(n, n + 25):
        base = list(sets[rng.randrange(n)][1])
        if len(base) > 5:
            base.pop(rng.randrange(len(base)))
        sets.append((i, base + [f"x{i}"] * rng.randrange(2)))
    return sets


@pytest.mark.parametrize("seed,threshold", [(7, 0.7), (99, 0.3)])
def test_prefix_join_equals_window_sweep(spark, seed, threshold):
    sets = spark.createDataFrame(random_sets(seed), "id long, s array<string>")
    fast, slow = similarity.similar_pairs(sets, "id", "s", threshold), similarity.window_pairs(sets, "id", "s", threshold)
    assert ids(fast) == ids(slow) and ids(fast)


def test_similar_pairs_with_nulls_and_empty_sets(spark):
    rows = [(1, ["a", "b"]), (2, ["b", "a", None]), (3, []), (4, None), (None, ["a", "b"])]
    sets = spark.createDataFrame(rows, "id long, s array<string>")
    assert ids(similarity.similar_pairs(sets, "id", "s", 1.0)) == [(1, 2, 1.0)]
    assert ids(similarity.similar_pairs(sets.limit(0), "id", "s", 0.7)) == []


def shuffled(spark):
    """Bytes of shuffle written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    jvm = spark._jvm
    stages = context.statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def phrased_sets(n=1000):
    """Sets of five of sixty phrases: many share one and hardly any two are alike, but every hundredth has a copy with one member more."""
    rng = random.Random(5)
    sets = [(i, [f"p{p}-{j}" for p in rng.sample(range(60), 5) for j in range(20)]) for i in range(n)]
    return sets + [(n + i, sets[i][1] + [f"x{i}"]) for i in range(0, n, 100)]


@pytest.mark.parametrize("classes", [True, False])
def test_sets_that_only_share_a_phrase_are_not_moved(spark, classes):
    rows = phrased_sets()
    sets = spark.createDataFrame(rows, "id long, s array<string>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sets were many
    try:
        before = shuffled(spark)
        got = ids(similarity.similar_classes(sets, "id", "s", 0.8).where("links > 0").select("id") if classes else similarity.similar_class_pairs(sets, "id", "s", 0.8))
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved < 4 * sum(8 * len(s) for _, s in rows)
    want = [(i, j) for i, a in rows for j, b in rows if i < j and len({*a} & {*b}) >= 0.8 * len({*a} | {*b})]
    assert len(want) >= 10 and (sorted({(i,) for p in want for i in p}) if classes else want) == [g if classes else g[:2] for g in got]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95, 1.0])
def test_sets_of_all_sizes_equal_window_sweep(spark, threshold):
    rng = random.Random(11)
    rows = []
    for n in (1, 2, 5, 30, 95, 96, 97, 110, 191, 193, 380, 390, 800, 1500):
        for _ in range(4):
            base = [f"g{rng.randrange(4000)}" for _ in range(n)]
            # edits about as many as the threshold allows, some less and some more
            for share in (0, 0.02, 0.05, 0.1, 0.2, 0.3):
                rows.append((len(rows), rng.sample(base, n - int(n * share * rng.random())) + [f"y{rng.randrange(10**6)}" for _ in range(int(n * share * rng.random()))]))
    sets = spark.createDataFrame(rows, "id long, s array<string>")
    found = ids(similarity.similar_pairs(sets, "id", "s", threshold))
    assert found and found == ids(similarity.window_pairs(sets, "id", "s", threshold))


def test_shingle_sets_are_the_shingles_of_the_tokens(spark):
    rows = [(1, "a b a b c"), (2, "x-y  Zü😀 q"), (3, None), (4, ""), (5, "one"), (6, "b a c"), (7, "a b\x0bc d")]
    docs = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r.shingles for r in similarity.shingle_sets(docs, "id", "t").collect()}
    want = {r.id: r.s for r in docs.where("t is not null").select("id", text.shingles(text.tokens(F.col("t"))).alias("s")).collect()}
    assert {i: len(s) for i, s in got.items()} == {i: len(s) for i, s in want.items()}
    assert all(s == sorted({*s}) for s in got.values())
    same = lambda sets: sorted((i, j, len({*sets[i]} & {*sets[j]})) for i in sets for j in sets)
    assert same(got) == same(want)
    assert sorted(r.id for r in similarity.shingle_sets(docs, "id", "t", 4).collect()) == [1, 2, 7]


@pytest.mark.parametrize("members", [300, 3_000_000])
def test_numbers_as_members_and_many_buckets(spark, monkeypatch, members):
    monkeypatch.setattr(similarity, "BUCKET_MEMBERS", members)
    number = {}
    rows = [(i, [number.setdefault(w, len(number)) for w in s] + [None] * (i % 2)) for i, s in random_sets(23)]
    sets = spark.createDataFrame(rows, "id long, s array<long>")
    found = ids(similarity.similar_pairs(sets, "id", "s", 0.6))
    plain = sets.select("id", F.array_compact("s").alias("s"))
    assert found and found == ids(similarity.window_pairs(plain, "id", "s", 0.6))
    assert similarity.similar_pairs(sets, "id", "s", 0.6, least=99).collect() == []


def test_prefixes_move_without_their_sketch_at_each_gram(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(i, rng.sample(vocabulary, 100)) for i in range(4000)]
    sets = spark.createDataFrame(rows, "id long, s array<string>")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the sets were many
    try:
        before = shuffled(spark)
        similarity.similar_class_pairs(sets, "id", "s", 0.8).collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert moved < 400 * len(rows)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (None, 3), (3, None)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(31)}}


def test_cliques_mark_what_is_only_chained(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "left_id long, right_id long")
    assert ids(graph.greedy_cliques(pairs)) == [(1, 1, "clique"), (1, 2, "clique"), (1, 3, "clique"), (1, 4, "chained")]
    assert {r[2] for r in ids(graph.greedy_cliques(pairs, largest=3))} == {"oversize"}


def test_cycles_once_and_by_kind(spark):
    edges = [("a", "b", False), ("b", "a", False), ("c", "d", True), ("d", "c", True), ("e", "f", True), ("f", "e", False), ("p", "q", False), ("p", "r", False), ("q", "s", False), ("r", "s", False)]
    kinds = ids(graph.cycle_kinds(spark.createDataFrame(edges, "s string, t string, w boolean"), "s", "t", "w"))
    assert kinds == [("a", 2, "runtime"), ("c", 2, "type only"), ("e", 2, "mixed")]


def test_dependents_leave_out_the_changed(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "src string, dst string")
    assert ids(graph.dependents(spark.createDataFrame([("b",)], "n string"), edges, "n", "src", "dst")) == [("a",), ("c",)]


def test_layers_first_match_and_exact_patterns(spark):
    named = [("domain", ["src/domain/**"], 1), ("web", ["src/**"], 2)]
    edges = spark.createDataFrame([("src/domain/a.ts", "src/web/b.ts"), ("src/web/b.ts", "src/domain/a.ts"), ("x", "src/web/b.ts")], "s string, t string")
    assert ids(layers.upward_edges(edges, "s", "t", named)) == [("src/domain/a.ts", "src/web/b.ts", "domain", "web")]
    uses = spark.createDataFrame([("src/domain/a.ts", "lib"), ("src/domain/a.ts", "library")], "s string, p string")
    assert ids(layers.forbidden_edges(uses, "s", "p", [("domain", "lib")], named)) == [("src/domain/a.ts", "lib", "lib")]


def test_field_operators(spark):
    types = [(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, ["x", "y"]), (4, None)]
    sets = spark.createDataFrame(types, "id long, f array<string>")
    assert ids(fields.largest_contained(sets, "id", "f", 3)) == [(2, 1, 3, "d")]
    declared = spark.createDataFrame([(["a", "b", "c"],)], "d array<string>")
    assert ids(fields.uncovered_sets(sets, "id", "f", declared, "d")) == [(2, "a,b,c,d"), (3, "x,y")]
    trio = spark.createDataFrame([(i, ["k", "l", "m", f"o{i}"]) for i in range(6)], "id long, f array<string>")
    assert ids(fields.field_groups(trio, "id", "f", 6, 3)) == [("k,l,m", 3, 6)]
    assert ids(fields.field_groups(trio.limit(5), "id", "f", 6, 3)) == []
    kin = spark.createDataFrame([("a", ["x"], ["b"]), ("b", ["y"], ["a", "c"]), ("c", ["z"], [])], "n string, o array<string>, p array<string>")
    assert ids(fields.inherited_fields(kin, "n", "o", "p").select("n", F.array_join("fields", ""))) == [("a", "xyz"), ("b", "xyz"), ("c", "z")]


def test_sequences(spark):
    rows = [(1, list("abcde")), (2, list("zabcdey")), (3, list("cde")), (4, list("abcde")), (5, [])]
    seqs = spark.createDataFrame(rows, "k long, items array<string>")
    assert ids(sequences.equal_sequences(seqs, "k", 4)) == [("a|b|c|d|e", 2, 1)]
    assert (1, 2, 5, 0, 1) in ids(sequences.shared_runs(seqs, "k", 4))
    assert (1, 4) not in {r[:2] for r in ids(sequences.shared_runs(seqs, "k", 4))}
    assert ids(sequences.suffix_is_whole(seqs, "k", 3)) == [(1, 3, 3), (4, 3, 3)]


def test_snapshots_tell_moves_from_changes(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "p string, h string")
    new = spark.createDataFrame([("a", "9"), ("d", "2"), ("c", "3"), ("e", "5")], "p string, h string")
    assert ids(scope.snapshot_diff(old, new, "p", "h")) == [("a", "changed"), ("b", "deleted"), ("d", "moved"), ("e", "added")]


def test_no_scope_is_everything_and_an_empty_scope_nothing(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "p string")
    assert scope.in_scope(rows, "p", None).count() == 2
    assert scope.in_scope(rows, "p", rows.limit(0)).count() == 0


def test_baseline_keeps_findings_without_identity(spark):
    found = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "i string, n int")
    accepted = spark.createDataFrame([("x",), (None,)], "i string")
    assert sorted(r.n for r in scope.without_accepted(found, "i", accepted).collect()) == [2, 3]


def test_last_ignore_rule_wins(spark):
    rows = spark.createDataFrame([("a/b.log",), ("keep/b.log",), ("dist/x.js",), ("a/dist/x.js",), ("b.txt",)], "p string")
    got = {r.p: r.ignored for r in scope.ignored(rows, "p", ["*.log", "!keep/*", "dist/"]).collect()}
    assert got == {"a/b.log": True, "keep/b.log": False, "dist/x.js": True, "a/dist/x.js": True, "b.txt": False}


def test_globs():
    import re

    assert re.match(paths.glob_regex("src/**/*.ts"), "src/a/b/c.ts") and re.match(paths.glob_regex("src/**/*.ts"), "src/c.ts")
    assert not re.match(paths.glob_regex("src/*.ts"), "src/a/c.ts")
    assert re.match(paths.glob_regex("a?.ts"), "ab.ts") and not re.match(paths.glob_regex("a?.ts", literal_question=True), "ab.ts")


def test_answers(spark, tmp_path):
    schema = "key string, at long"
    ours, theirs = spark.createDataFrame([("a", 5), ("b", 1), ("c", 7)], schema), spark.createDataFrame([("a", 5), ("b", 9)], schema)
    merged = answers.merge(ours.withColumn("v", F.lit("o")), theirs.withColumn("v", F.lit("t")), "key", "at")
    assert ids(merged) == [("a", 5, "o"), ("b", 9, "t"), ("c", 7, "o")]
    store = spark.createDataFrame([("aa1", 1, "rate", None, 2.0, None, None, 0.5), ("ab2", 2, "classify", "x", None, None, {"x": 1.0}, 0.9)], answers.COLUMNS)
    answers.write_store(store, str(tmp_path / "s"))
    with open(tmp_path / "s" / "shard=aa" / "bad.json", "w") as file:
        file.write("not json\n")
    good, bad = answers.read_store(spark, str(tmp_path / "s"))
    assert good.count() == 2 and bad.count() == 1
    questions = spark.createDataFrame([("aa1",), ("zz",)], "key string")
    assert {r.key: r.state for r in answers.lookup(questions, good, "key").collect()} == {"aa1": "answered", "zz": "missing"}


def test_gates(spark):
    rows = spark.createDataFrame([(0.9, 0.5, 0.9), (0.9, 0.1, 0.9), (0.9, 0.5, 0.1), (0.4, 0.9, 0.9), (0.9, None, None)], "s double, m double, c double")
    got = [r[0] for r in rows.select(gates.quality(F.col("s"), F.col("m"), F.col("c"))).collect()]
    assert got == ["act", "review", "review", "drop", "act"]
    shares = spark.createDataFrame([({"a": 0.7, "b": 0.2, "c": 0.1},), ({"a": 1.0},), (None,)], "p map<string,double>")
    assert [r[0] if r[0] is None else round(r[0], 6) for r in shares.select(gates.margin(F.col("p"))).collect()] == [0.5, 1.0, None]


def test_packing_and_budgets(spark):
    rows = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 3, 20), ("k", 4, 1), ("k", 5, 9)], "k string, n int, c int")
    assert [r[2] for r in ids(packing.next_fit(rows, "k", ["n"], "n", "c", 10))] == [0, 1, 2, 3, 3]
    assert [r[2] for r in ids(packing.greedy_skip(rows, "k", ["n"], "n", "c", 12))] == [True, True, False, True, False]
    assert [r[1] for r in ids(packing.fit_to_budget(rows, ["k"], ["n"], "c", 3))] == [1]


def test_positions(spark):
    row = spark.createDataFrame([("ab\ncd\nef",)], "t string")
    assert tuple(row.select(text.line_of(F.col("t"), F.lit(4)), text.column_of(F.col("t"), F.lit(4))).first()) == (2, 2)
    kept = row.select(text.blank_outside(F.col("t"), "cd")).first()[0]
    assert kept == "  \ncd\n  "
    found = spark.createDataFrame([(["src/a/x.ts", "src/a/y/z.ts"],), (["a.ts", "b/c.ts"],)], "p array<string>")
    assert [r[0] for r in found.select(text.common_prefix_dir(F.col("p"))).collect()] == ["src/a", ""]


def test_as_of_and_ancestors(spark):
    points = spark.createDataFrame([("k", 1, 10), ("k", 2, 3), ("q", 3, 5)], "k string, p int, at int")
    marks = spark.createDataFrame([("k", "a", 5), ("k", "b", 9), ("k", "c", 11)], "k string, m string, mt int")
    got = {r.p: r.m for r in intervals.nearest_before(points, marks, ["k"], "p", "at", "m", "mt").collect()}
    assert got == {1: "b", 2: None, 3: None}
    files = spark.createDataFrame([("r", "a/b/c.ts"), ("r", "x.ts")], "r string, p string")
    places = spark.createDataFrame([("r", "a"), ("r", "a/b")], "r string, d string")
    assert ids(intervals.nearest_ancestor(files, "r", "p", places, "d")) == [("r", "a/b/c.ts", "a/b"), ("r", "x.ts", None)]


def test_import_resolution_prefers_the_first_candidate(spark):
    edges = spark.createDataFrame([("r", "src/a/x.ts", "../b/y"), ("r", "src/a/x.ts", "./none"), ("r", "src/a/x.ts", "react")], "r string, i string, s string")
    files = spark.createDataFrame([("r", "src/b/y.ts"), ("r", "src/b/y/index.ts")], "r string, t string")
    assert {r.s: r.resolved for r in imports.resolve(edges, "r", "i", "s", files, "t").collect()} == {"../b/y": "src/b/y.ts", "./none": None, "react": None}


def test_report(spark):
    rows = spark.createDataFrame([("a.ts", 1, 2, "error", "r", "m", 0.5), ("a.ts", 1, 1, "warning", "r", "m", None)], "path string, line int, col int, severity string, rule string, message string, score double")
    assert report.rendered(report.sorted_findings(rows), "github").first()[0] == "::warning file=a.ts,line=1,col=1::m"
    assert report.exit_code(rows) == 1 and report.exit_code(rows.where("severity = 'warning'")) == 0 and report.exit_code(rows.where("severity = 'warning'"), 0) == 1
    assert report.ranked(rows).first()["score"] == 0.5
    with pytest.raises(KeyError):
        report.fill("{{missing}}")


def test_canonical_json_sorts_keys_and_keeps_arrays(spark):
    rows = spark.createDataFrame([('{"b": [2, 1], "a": {"d": 1, "c": null}}',), ("no json",), (None,)], "j string")
    assert [r[0] for r in rows.select(hashing.canonical_json(F.col("j"))).collect()] == ['{"a":{"c":null,"d":1},"b":[2,1]}', None, None]
    assert hashing.answer_key("m", "1", {"x": 1, "y": 2}, []) == hashing.answer_key("m", "1", {"y": 2, "x": 1}, [])


def test_oversize_cliques_are_dropped(spark):
    cliques = spark.createDataFrame([(1, n, "clique") for n in range(4)] + [(9, 9, "clique"), (9, 10, "clique"), (9, 11, "chained"), (20, 20, "oversize")], "component long, node long, role string")
    kept, dropped = graph.split_oversize(cliques, 3)
    assert ids(kept) == [(9, 9), (9, 10)] and ids(dropped) == [(1, 0, "oversize"), (1, 1, "oversize"), (1, 2, "oversize"), (1, 3, "oversize"), (9, 11, "chained"), (20, 20, "oversize")]


def test_context_of_a_run(spark):
    from strandline.operators import sequences

    sequence = spark.createDataFrame([(1, list("abcdefgh")), (2, list("cde"))], "id long, items array<string>")
    runs = spark.createDataFrame([(1, 2, 3, 2, 0)], "left_id long, right_id long, run int, left_at int, right_at int")
    got = sequences.run_context(runs, sequence, "id", "left_id", "left_at").first()
    assert got.before == ["a", "b"] and got.after == ["f", "g", "h"]
    assert sequences.run_context(runs, sequence, "id", "right_id", "right_at").first()[-2:] == ([], [])


def test_deeper_ignore_files_win(spark):
    rows = spark.createDataFrame([("a.log",), ("keep/a.log",), ("keep/deep/a.log",), ("keep/b.ts",), ("b.ts",)], "path string")
    rules = spark.createDataFrame([("", 0, "*.log"), ("keep", 0, "!*.log"), ("keep/deep", 0, "*.log"), ("", 1, "# none"), ("", 2, "")], "dir string, ord int, rule string")
    assert ids(scope.ignored_in_tree(rows, "path", rules)) == [("a.log", True), ("b.ts", False), ("keep/a.log", False), ("keep/b.ts", False), ("keep/deep/a.log", True)]
    assert ids(scope.ignored_in_tree(rows, "path", rules.limit(0)))[0] == ("a.log", False)


def test_configurations_merge_from_general_to_own():
    from strandline.operators.rules import merged_config

    assert merged_config({"rules": {"a": "off", "b": "info"}, "ignore": ["x"], "n": 1}, {"rules": {"a": "error"}, "ignore": ["x", "y"], "n": 2}) == {"rules": {"a": "error", "b": "info"}, "ignore": ["x", "y"], "n": 2}


def test_preference_and_identity(spark):
    rows = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("m", None, "c")], "key string, rank int, name string")
    assert ids(fields.with_preference(rows, ["key"], [F.col("rank"), F.col("name")])) == [("k", 1, "a"), ("m", None, "c")]
    same = spark.createDataFrame([("r", "s", ["b", "a", "b"]), ("r", "s", ["a", "b"])], "rule string, symbol string, files array<string>")
    assert len({r.i for r in same.select(report.finding_identity(F.col("rule"), F.col("symbol"), F.col("files")).alias("i")).collect()}) == 1
