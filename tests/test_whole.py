"""Whole jobs: long sequences, long chains and all rows, against brute force where the registered SQL states less."""

import datetime
import random

from strandline.operators import fields, graph
from strandline.plans import registry


def ids(frame):
    return sorted(tuple(r) for r in frame.collect())


def events(spark, folder, histories):
    began = datetime.datetime(2024, 1, 1)
    rows = [(user * 1000 + at, user, item, began + datetime.timedelta(hours=at)) for user, items in histories.items() for at, item in enumerate(items)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def longest_shared(a, b, least):
    """(run, left_at, right_at) by looking at all pairs of places; the earliest on the left, then on the right."""
    best = None
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least and (best is None or n > best[0]):
                best = (n, i, j)
    return best


def test_runs_are_shared_over_whole_histories(spark, tmp_path):
    run = [f"r{i}" for i in range(20)]
    histories = {1: [f"a{i}" for i in range(50)] + run, 2: [f"b{i}" for i in range(35)] + run + ["z"], 3: ["c"] + run[:9] + ["d"] * 5}
    # one gram in more than 50 places
    histories |= {user: [f"u{user}"] + [f"g{i}" for i in range(7)] for user in range(10, 70)}
    wanted = [(a, b, *found) for a in histories for b in histories if a < b and (found := longest_shared(histories[a], histories[b], 7))]
    assert ids(registry.QUERIES["shared_event_runs"](spark, events(spark, tmp_path, histories))) == sorted(wanted)
    assert len(wanted) == 3 + 60 * 59 // 2


def test_equal_sequences_are_equal_to_the_last_event(spark, tmp_path):
    same, opening = ["a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d"]
    histories = {1: same, 2: opening + ["x"], 3: same, 4: opening + ["y"], 5: opening, 6: ["a", "b", "c"], 7: ["a", "b", "c"]}
    assert ids(registry.QUERIES["equal_event_sequences"](spark, events(spark, tmp_path, histories))) == [("a|b|c|d|e|f", 2, 1)]


def test_spans_of_all_files_and_none_but_those_of_units(spark, data):
    spans = {tuple(r) for r in registry.QUERIES["declaration_spans"](spark, data).collect()}
    units = {tuple(r) for r in spark.read.parquet(f"{data}/units.parquet").select("repo", "file_path", "kind", "end_pos").distinct().collect()}
    files = {u[:2] for u in units}
    texts = {(r.repo, r.path): r.text for r in spark.read.parquet(f"{data}/source_files.parquet").select("repo", "path", "text").collect()}
    # units lacks the short minified functions that stand in some of its files
    more = {s for s in spans if s[:2] in files} - units
    assert units <= spans and all("const tiny=(a,b)=>" in texts[s[:2]] and texts[s[:2]][: s[3]].endswith("return c?c.v:!1};") for s in more)


def test_spans_of_files_without_units(spark, tmp_path):
    text = "export function f() {\n  return 1;\n}\n"
    spark.createDataFrame([(1, "2025-01-01", "r", "src/a.ts", text)], "file_id long, ingested_at string, repo string, path string, text string").write.parquet(f"{tmp_path}/source_files.parquet")
    spark.createDataFrame([], "repo string, file_path string, kind string, end_pos int").write.parquet(f"{tmp_path}/units.parquet")
    assert ids(registry.QUERIES["declaration_spans"](spark, str(tmp_path))) == [("r", "src/a.ts", "function", text.index("}") + 1)]


def test_long_chains_and_rings(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "s long, t long")
    assert ids(graph.reachable(chain, "s", "t")) == [(i, j) for i in range(71) for j in range(i + 1, 71)]
    rings = [(i, (i + 1) % 60, False) for i in range(60)] + [(1000 + i, 1000 + (i + 1) % 120, True) for i in range(120)]
    assert ids(graph.cycle_kinds(spark.createDataFrame(rings, "s long, t long, w boolean"), "s", "t", "w")) == [(0, 60, "runtime"), (1000, 120, "type only")]


def test_fields_of_remote_ancestors(spark):
    types = spark.createDataFrame([(f"t{i:02}", [f"f{i:02}"], [f"t{i + 1:02}"]) for i in range(45)] + [("x", ["fx"], ["y"]), ("y", ["fy"], ["x"])], "name string, f array<string>, p array<string>")
    wanted = [(f"t{i:02}", [f"f{j:02}" for j in range(i, 45)]) for i in range(45)] + [("x", ["fx", "fy"]), ("y", ["fx", "fy"])]
    assert ids(fields.inherited_fields(types, "name", "f", "p")) == wanted


def reached(edges):
    """Of each node all that it reaches."""
    out = {}
    for first in {a for a, _ in edges}:
        seen, todo = set(), [first]
        while todo:
            at = todo.pop()
            todo += [b for a, b in edges if a == at and b not in seen]
            seen |= {b for a, b in edges if a == at}
        out[first] = seen
    return out


def test_cycles_of_the_links_themselves(spark, tmp_path):
    rng = random.Random(5)
    # 40 and 70 are the same modulo 30, as are 5 and 35; 100 and 220 are far apart modulo 30
    rows = [(40, 70, "same-shape", 0.9), (70, 40, "same-shape", 0.9), (100, 220, "close-names", 0.8), (220, 100, "close-names", 0.8), (1, 5, "same-shape", 0.9), (35, 31, "same-shape", 0.9), (6, 6, "same-shape", 0.9), (8, 9, "same-shape", 0.9), (9, 8, "same-shape", 0.5)]
    rows += [(a, b, rng.choice(["same-shape", "close-names", None]), 0.7 + rng.random() * 0.3) for a, b in ((rng.randrange(300, 380), rng.randrange(300, 380)) for _ in range(110))]
    spark.createDataFrame(rows, "left_id long, right_id long, rule_id string, score double").write.parquet(f"{tmp_path}/scored_pairs.parquet")
    weak = {}
    for a, b, rule, score in rows:
        if score >= 0.7 and a != b:
            weak[a, b] = weak.get((a, b), True) and rule == "close-names"
    every, strong = reached(set(weak)), reached({e for e, w in weak.items() if not w})
    cycles = {}
    for a in every:
        if a in every[a]:
            cycles.setdefault(min(b for b in every[a] if a in every.get(b, ())), set()).add(a)
    wanted = []
    for first, nodes in cycles.items():
        runtime = any(n in strong.get(n, ()) for n in nodes)
        only = all(w for (a, b), w in weak.items() if a in nodes and b in nodes)
        wanted.append((first, len(nodes), "runtime" if runtime else "type only" if only else "mixed"))
    assert {(40, 2, "runtime"), (100, 2, "type only")} < set(wanted)
    assert ids(registry.QUERIES["link_cycles"](spark, str(tmp_path))) == sorted(wanted)


def test_every_set_is_asked_against_all_others(spark, tmp_path):
    rng = random.Random(3)
    sets = {1: "ab", 2: "abc", 4: "xy", 7: "xyz", 3: "pq", 6: "pqr", 9: "same", 12: "same", 5: "", 8: "u", 10: "v", 11: "vw"}
    sets |= {100 + i: "".join(sorted(rng.sample("ABCDEFG", rng.randrange(1, 6)))) for i in range(25)}
    rows = [(u, 0, "interface", {c: "string" for c in f}) for u, f in sets.items()] + [(500, 0, "function", {"zz": "string"}), (501, 0, "type", None)]
    spark.createDataFrame(rows, "unit_id long, scanned_at int, kind string, field_types map<string,string>").write.parquet(f"{tmp_path}/units.parquet")
    wanted = [(u, ",".join(sorted(set(f)))) for u, f in sets.items() if f and not any(set(f) <= set(g) for v, g in sets.items() if v != u)]
    assert {2, 6, 7, 8, 11} <= {u for u, _ in wanted} and not {1, 3, 4, 9, 10, 12} & {u for u, _ in wanted}
    assert ids(registry.QUERIES["key_set_groups"](spark, str(tmp_path))) == sorted(wanted)
