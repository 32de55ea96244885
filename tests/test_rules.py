"""The rule layer: asked once, replayed, gated, every candidate a finding or a drop."""

import pytest

from strandline.operators import rules
from strandline.operators.answers import COLUMNS


def pair_rule(tables):
    return tables["pairs"].selectExpr("id as subject", "path", "facts")


def test_candidates_are_findings_or_drops(spark):
    pairs = spark.createDataFrame([(1, "a", '{"x": 1, "y": 2}'), (2, "b", '{"y": 2, "x": 1}'), (3, "c", '{"x": 3}'), (4, "d", '{"x": 4}')], "id long, path string, facts string")
    rule = rules.Rule("same", pair_rule, ("same",))
    planned = rules.plans([rule], {"pairs": pairs})
    assert rules.questions(planned).count() == 3
    keys = {r.subject: r.question for r in planned.collect()}
    assert keys["1"] == keys["2"]
    answers = spark.createDataFrame([(keys["1"], 1, "classify", "same", None, None, {"same": 0.9, "other": 0.1}, 0.9), (keys["3"], 1, "classify", "other", None, None, {"same": 0.1, "other": 0.9}, 0.9)], COLUMNS)
    assert [r.question for r in rules.missing(planned, answers).collect()] == [keys["4"]]
    found, dropped = rules.judged(planned, answers, [rule])
    assert sorted((r.subject, r.band, r.severity) for r in found.collect()) == [("1", "act", "warning"), ("2", "act", "warning")]
    assert sorted((r.subject, r.stage) for r in dropped.collect()) == [("3", "gate"), ("4", "unanswered")]


def test_registry():
    registry = rules.Registry()
    registry.add(rules.Rule("a", pair_rule, ("x",)))
    with pytest.raises(ValueError):
        registry.add(rules.Rule("a", pair_rule, ("x",)))
    with pytest.raises(ValueError):
        registry.add(rules.Rule("b", pair_rule, ()))
    registry.load("no_such_module")
    assert registry.notes and registry.notes[0][0] == "no_such_module"
    assert registry.configured({"a": "off"}) == [] and registry.configured({"a": "error"})[0].severity == "error"


def test_the_catalogue_keeps_what_is_expected_of_authors():
    from strandline.authoring import CATALOGUE, Rule, faults, registry

    names = [name for name, *_ in CATALOGUE]
    assert len(names) == len(set(names)) and all(violations for _, _, violations, _ in CATALOGUE)
    everything = {table: None for *_, needs in CATALOGUE for table in needs}
    assert faults(list(registry(everything).rules.values())) == [] and registry(everything).notes == []
    bare = registry({"units": None})
    assert "same-shape" in bare.rules and ("shared-run", "no table sequences") in bare.notes
    bad = Rule("x", None, (), "loud", "")
    assert [f for _, f in faults([bad])] == ["no-violations", "no-version", "unknown-severity"] and faults([bad], {"x": ("no-violations", "no-version", "unknown-severity")}) == []


def test_rules_on_small_tables(spark):
    from strandline.authoring import registry
    from strandline.operators import rules

    units = [(1, "r", "a.ts", "function", "readRow", True, False, 30, "h", [], None, None, "// Reads it.\nfunction readRow(deep: boolean) { if (deep) { continue; } }", 0, []), (2, "r", "b.ts", "function", "readRow", True, False, 30, "h", [], None, None, "function readRow() {}", 0, []), (3, "r", "c.ts", "type", "readRow", True, False, 5, "k", [], ["a", "b"], {"a": "x"}, "type readRow = {}", 0, [])]
    frame = spark.createDataFrame(units, "unit_id long, repo string, file_path string, kind string, name string, exported boolean, is_test boolean, n_tokens int, shape_hash string, type_refs array<string>, fields array<string>, field_types map<string,string>, text string, start_pos int, returns array<string>")
    tables = {"units": frame, "edges": spark.createDataFrame([("p/lib/a", "p/src/b"), ("p/src/b", "p/lib/a"), ("p/lib/a", "p/server/c")], "src string, dst string"), "links": spark.createDataFrame([(1, 2, False), (2, 1, True)], "src long, dst long, weak boolean"), "sequences": spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["x", "a", "b", "c", "d"]), (3, ["a", "b", "c", "d"])], "unit_id long, items array<string>")}
    known = registry(tables)
    planned = rules.plans(list(known.rules.values()), tables)
    found = {}
    for r in planned.collect():
        found.setdefault(r.rule, []).append(r.subject)
    assert len(found["same-shape"]) == 1 and found["many-meanings"] == ["readRow"] and found["described"] == ["1"] and found["switched-by-flag"] == ["1"] and found["uncounted-skip"] == ["1"]
    assert sorted(found["upward-layer"]) == ["p/lib/a>p/server/c", "p/lib/a>p/src/b"] and found["forbidden-layer"] == ["p/lib/a>p/server/c"] and found["link-cycle"] == ["1"]
    assert len(found["same-calls"]) == 1 and sorted(found["shared-run"]) == ["1~2", "2~3"] and found["ends-as-another"] == ["2"] and found["unnamed-fields"] == ["3"]
    answers = rules.stub_answers(planned, {r.id: r.violations for r in known.rules.values()})
    kept, dropped = rules.judged(planned, answers, list(known.rules.values()))
    assert kept.count() + dropped.count() == planned.count() and rules.missing(planned, answers).count() == 0
    own = rules.Rule("own", None, ("yes",), run=lambda t: t["units"].selectExpr("name as subject", "file_path as path", "1.0 as score").limit(1))
    assert [tuple(r) for r in rules.self_judged([own], tables).select("rule", "band", "severity").collect()] == [("own", "act", "warning")] and rules.self_judged([], tables) is None


def test_rules_on_pages_words_and_bundles(spark):
    from strandline.operators import rule_set

    page = "const [a, b] = useState(1);\n" * 3 + "<Row />\n" * 15
    files = spark.createDataFrame([("r", "a.tsx", page), ("r", "b.tsx", page[30:]), ("r", "c.tsx", None)], "repo string, path string, text string")
    assert [r.subject for r in rule_set.pressed_page({"files": files}).collect()] == ["r/a.tsx"]
    docs = spark.createDataFrame([(1, "The Ledger is a Ledger of the Ledger. Market day"), (2, "at the Market and the Market or a Market"), (3, None)], "doc_id long, text string")
    words = spark.createDataFrame([("Market",), (None,)], "word string")
    assert [r.subject for r in rule_set.drifting_word({"documents": docs, "vocabulary": words}).collect()] == ["ledger"]
    bundles = spark.createDataFrame([("x", "Card", ["Display", "Gone"], ["CardDisplay"]), ("y", "E", ["A"], ["A"])], "dir string, prefix string, promised array<string>, declared array<string>")
    assert [r.subject for r in rule_set.uneven_bundle({"bundles": bundles}).collect()] == ["x"]
