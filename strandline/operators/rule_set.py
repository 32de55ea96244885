"""The rules that come with the library: what each takes as a candidate, from named tables, and which answers are violations.

Tables, all optional (a rule whose tables aren't there is skipped with a note):
units(unit_id, repo, file_path, kind, name, exported, is_test, n_tokens, shape_hash, type_refs, fields, field_types, text, start_pos),
calls(unit_id, file, name), sequences(unit_id, items), links(src, dst, weak), edges(src, dst), layers as a list in LAYERS,
uses(repo, package, file), declared(repo, package), sets(unit_id, shingles), imports(specifier, path), files(repo, path, text),
module_edges(from_module, to_module), module_roles(module, role, rank), columns and mapped(repo, field, nullable),
documents(doc_id, text), vocabulary(word), bundles(dir, prefix, promised, declared).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import paths, text
from strandline.operators import duplicates, fields, graph, imports, layers, roles, sequences, similarity, sites
from strandline.operators.rules import Registry, Rule

Tables = dict[str, DataFrame]

#: layers (name, globs, rank) and what each must not reach: an example that callers replace
LAYERS: list[tuple[str, list[str], int]] = [("low", ["**/lib/**"], 1), ("middle", ["**/src/**"], 2), ("high", ["**"], 3)]
FORBIDDEN: list[tuple[str, str]] = [("low", "**/server/**")]


def _rows(frame: DataFrame, subject: Column, path: Column | None = None, **facts: Column) -> DataFrame:
    """A candidate's subject, its place, and the facts a judgement may look at as JSON."""
    place = path if path is not None else F.lit(None)
    return frame.select(subject.cast("string").alias("subject"), place.cast("string").alias("path"), F.to_json(F.struct(*[v.alias(k) for k, v in facts.items()])).alias("facts"))


def _place(repo: str = "repo", path: str = "file_path") -> Column:
    return F.concat_ws("/", repo, path)


def same_shape(t: Tables) -> DataFrame:
    groups = duplicates.exact_groups(t["units"].withColumn("place", _place()), ["kind", "shape_hash"], "place", 2, F.col("is_test"))
    return _rows(groups, F.col("group_key"), kind=F.col("kind"), members=F.col("members"), places=F.col("places"))


def alike(t: Tables) -> DataFrame:
    return _rows(similarity.similar_class_pairs(t["sets"], "unit_id", "shingles", 0.7, 12), F.concat_ws("~", "left_id", "right_id"), likeness=F.col("likeness"))


def nested_fields(t: Tables) -> DataFrame:
    found = fields.largest_contained(t["units"].where("kind <> 'function' and fields is not null"), "unit_id", "fields", 3)
    return _rows(found, F.col("whole"), part=F.col("part"), shared=F.col("shared"), added=F.col("added"))


def recurring_fields(t: Tables) -> DataFrame:
    found = fields.field_groups(t["units"].where("kind <> 'function' and fields is not null"), "unit_id", "fields", 6, 3)
    return _rows(found, F.col("fields"), support=F.col("support"))


def unnamed_fields(t: Tables) -> DataFrame:
    found = fields.uncovered_by_others(t["units"].where("kind <> 'function' and fields is not null"), "unit_id", "fields")
    return _rows(found, F.col("unit_id"), fields=F.col("fields"))


def drifting_type(t: Tables) -> DataFrame:
    each = t["units"].select("unit_id", "repo", F.explode("field_types").alias("field", "t")).withColumn("t", F.regexp_replace("t", r"^\??: ", ""))
    found = fields.type_drift(each.withColumn("w", text.name_words(F.col("field"), expand=False)), "field", "t", "unit_id", ["repo"], 2, "w")
    return _rows(found, F.concat_ws("#", "repo", "field"), types=F.col("types"), places=F.col("places"))


def drifting_null(t: Tables) -> DataFrame:
    found = fields.nullability_drift(t["columns"], t["mapped"], ["repo", "field"])
    return _rows(found, F.concat_ws("#", "repo", "field"), column=F.col("column_nullable"), mapped=F.col("field_nullable"))


def same_calls(t: Tables) -> DataFrame:
    return _rows(sequences.equal_sequences(t["sequences"], "unit_id", 3), F.sha1("signature"), members=F.col("members"), first=F.col("first"), calls=F.col("signature"))


def shared_run(t: Tables) -> DataFrame:
    return _rows(sequences.shared_runs(t["sequences"], "unit_id", 4, 50), F.concat_ws("~", "left_id", "right_id"), run=F.col("run"), left_at=F.col("left_at"), right_at=F.col("right_at"))


def ends_as_another(t: Tables) -> DataFrame:
    return _rows(sequences.suffix_is_whole(t["sequences"], "unit_id", 3), F.col("unit_id"), whole=F.col("whole_key"), length=F.col("length"))


def close_names(t: Tables) -> DataFrame:
    named = t["units"].where("name is not null").select("unit_id", "kind", text.name_words(F.col("name")).alias("w"))
    found = similarity.blocked_name_pairs(named, "unit_id", "w", ["kind"])
    return _rows(found, F.concat_ws("~", "left_id", "right_id"), likeness=F.col("likeness"), left_members=F.col("left_members"), right_members=F.col("right_members"))


def wide_word(t: Tables) -> DataFrame:
    found = duplicates.reach(t["calls"].where(text.single_word(F.col("name"))), "name", "file", 12)
    return _rows(found, F.col("name"), files=F.col("sources"))


def many_meanings(t: Tables) -> DataFrame:
    per = t["units"].where("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).where("kinds > 1")
    return _rows(per, F.col("name"), declarations=F.col("n"), kinds=F.col("kinds"))


def upward_layer(t: Tables) -> DataFrame:
    found = layers.upward_edges(t["edges"], "src", "dst", LAYERS)
    return _rows(found, F.concat_ws(">", "src", "dst"), F.col("src"), from_layer=F.col("from_layer"), to_layer=F.col("to_layer"))


def forbidden_layer(t: Tables) -> DataFrame:
    found = layers.forbidden_edges(t["edges"], "src", "dst", FORBIDDEN, LAYERS)
    return _rows(found, F.concat_ws(">", "src", "dst"), F.col("src"), pattern=F.col("pattern"))


def link_cycle(t: Tables) -> DataFrame:
    return _rows(graph.cycle_kinds(t["links"], "src", "dst", "weak"), F.col("cycle"), nodes=F.col("nodes"), kind=F.col("kind"))


def upward_role(t: Tables) -> DataFrame:
    found = roles.upward_roles(t["module_edges"], t["module_roles"], [])
    return _rows(found, F.concat_ws(">", "from_role", "to_role"), F.col("from_module"), to_module=F.col("to_module"))


def undeclared_package(t: Tables) -> DataFrame:
    return _rows(imports.undeclared(t["uses"], "package", "repo", t["declared"], []), F.concat_ws("#", "repo", "package"), uses=F.col("uses"))


def shallow_file(t: Tables) -> DataFrame:
    exports = t["units"].groupBy("repo", F.col("file_path").alias("path")).agg(F.count(F.when(F.col("exported"), 1)).alias("exports"))
    counted = t["files"].select("repo", "path", text.code_lines(F.col("text")).alias("lines")).join(exports, ["repo", "path"])
    found = sites.shallow_files(counted, "lines", "exports", 2, 12.0)
    return _rows(found, _place("repo", "path"), _place("repo", "path"), exports=F.col("exports"), lines=F.col("lines"))


def tests_only(t: Tables) -> DataFrame:
    found = sites.only_such_users(t["imports"], ["specifier"], paths.is_test_path(F.col("path")))
    return _rows(found, F.col("specifier"), users=F.col("users"))


def unpaired_call(t: Tables, one: str = "get", other: str = "put") -> DataFrame:
    per = t["calls"].groupBy("unit_id").agg(F.collect_set("name").alias("names"))
    return _rows(sites.paired_calls(per, "names", one, other), F.col("unit_id"), calls=F.size("names"))


def carries_caller(t: Tables) -> DataFrame:
    units = t["units"].where("kind = 'function' and exported and name is not null and length(text) <= 1500")
    found = sites.caller_literals(units.select("unit_id", _place().alias("file"), "name", text.string_literals(F.col("text")).alias("ls")), t["calls"], "unit_id", "file", "name", "ls")
    return _rows(found, F.concat_ws("#", "unit_id", "literal"), literal=F.col("literal"), callers=F.col("callers"))


def own_string(t: Tables) -> DataFrame:
    units = t["units"].where("kind = 'function'").select("unit_id", _place().alias("file"), "name", F.contains("text", F.lit("${")).alias("builds"), F.col("returns"))
    return _rows(sites.strings_beside_helpers(units, t["calls"], "unit_id", "file", "name", "builds", "returns"), F.col("unit_id"), helpers=F.col("helpers"))


def uncounted_skip(t: Tables) -> DataFrame:
    skips = F.size(F.regexp_extract_all("text", F.lit(r"\bcontinue\b|\.filter\("), F.lit(0)))
    found = sites.unaccounted_skips(t["units"].where("kind = 'function'").withColumn("skips", skips), "exported", "is_test", "skips", "returns")
    return _rows(found, F.col("unit_id"), _place(), skips=F.col("skips"))


def outage(t: Tables) -> DataFrame:
    found = sites.outage_shapes(t["units"].where("kind = 'function'"), "text", r"if \([^()\n]* === null\)", r"catch \(\w+\)", r"\b(?:throw|return)\b", ["unit_id"])
    return _rows(found, F.col("unit_id"), shape=F.col("shape"))


def described(t: Tables) -> DataFrame:
    """Functions of some length with a comment above their code: does it say what the code does?"""
    head = F.regexp_extract("text", r"^(?:\s|//[^\n]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+", 0)
    units = t["units"].where("kind = 'function' and n_tokens >= 20").withColumn("comment", text.untagged_prose(text.preceding_comment(F.col("text"), F.length(head))))
    return _rows(units.where(F.col("comment").rlike(r"\w")), F.col("unit_id"), _place(), comment=F.col("comment"))


def switched_by_flag(t: Tables) -> DataFrame:
    """Functions of which one parameter is a flag that a branch tests by itself: do both branches mean one thing?"""
    flag = F.regexp_extract("text", r"([A-Za-z_$][\w$]*)\??: boolean[,)=]", 1)
    units = t["units"].where("kind = 'function'").withColumn("flag", flag).where("flag <> ''")
    tested = units.where(F.col("text").rlike(r"if \(!?[A-Za-z_$]") & (F.contains("text", F.concat(F.lit("if ("), F.col("flag"), F.lit(")"))) | F.contains("text", F.concat(F.lit("if (!"), F.col("flag"), F.lit(")")))))
    return _rows(tested, F.col("unit_id"), _place(), flag=F.col("flag"))


def pressed_page(t: Tables, states: str = r"\buseState\b(?:<[^()\n]*>)?\(", elements: str = r"<[A-Z][\w$.]*") -> DataFrame:
    """Files that hold much state and many elements of their own: should they be put together from parts?"""
    counted = t["files"].select("repo", "path", F.size(F.regexp_extract_all("text", F.lit(states), F.lit(0))).alias("states"), F.size(F.regexp_extract_all("text", F.lit(elements), F.lit(0))).alias("elements"))
    return _rows(sites.pressed_pages(counted, "states", "elements"), _place("repo", "path"), _place("repo", "path"), states=F.col("states"), elements=F.col("elements"))


def drifting_word(t: Tables, least: int = 3) -> DataFrame:
    """Capitalised words of prose that don't begin a sentence, are said often, and are no words of the vocabulary."""
    words = t["documents"].where("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    inside = sequences.beside(words, "doc_id", ["at"], "word").where(F.col("word").rlike("^[A-Z][a-z]{3,}") & F.col("before").isNotNull() & (F.col("before") != "") & ~F.col("before").rlike(r"[.!?:\n]\z"))
    terms = inside.select(F.explode(text.name_words(F.regexp_extract("word", "^[A-Z][A-Za-z]{3,}", 0), expand=False)).alias("word"))
    counted = terms.groupBy("word").agg(F.count("*").alias("mentions")).where(F.col("mentions") >= least)
    return _rows(counted.join(t["vocabulary"].select(F.lower("word").alias("word")).distinct(), "word", "left_anti"), F.col("word"), mentions=F.col("mentions"))


def uneven_bundle(t: Tables) -> DataFrame:
    found = roles.missing_and_orphans(t["bundles"], "promised", "declared", "prefix").where((F.size("missing") > 0) | (F.size("orphans") > 0))
    return _rows(found, F.col("dir"), F.col("dir"), missing=F.col("missing"), orphans=F.col("orphans"))


#: id, plan, violating answers, the tables it needs
CATALOGUE: list[tuple[str, Callable[[Tables], DataFrame], tuple[str, ...], tuple[str, ...]]] = [
    ("same-shape", same_shape, ("redundant",), ("units",)),
    ("alike", alike, ("redundant",), ("sets",)),
    ("nested-fields", nested_fields, ("composes", "same_name"), ("units",)),
    ("recurring-fields", recurring_fields, ("one_thing",), ("units",)),
    ("unnamed-fields", unnamed_fields, ("one_concept",), ("units",)),
    ("drifting-type", drifting_type, ("drift", "two_concepts"), ("units",)),
    ("drifting-null", drifting_null, ("drift",), ("columns", "mapped")),
    ("same-calls", same_calls, ("same_orchestration",), ("sequences",)),
    ("shared-run", shared_run, ("shared_helper",), ("sequences",)),
    ("ends-as-another", ends_as_another, ("same_operation",), ("sequences",)),
    ("close-names", close_names, ("one_concept",), ("units",)),
    ("wide-word", wide_word, ("yes",), ("calls",)),
    ("many-meanings", many_meanings, ("one_concept", "two_concepts"), ("units",)),
    ("upward-layer", upward_layer, ("upward",), ("edges",)),
    ("forbidden-layer", forbidden_layer, ("forbidden",), ("edges",)),
    ("link-cycle", link_cycle, ("cycle",), ("links",)),
    ("upward-role", upward_role, ("upward",), ("module_edges", "module_roles")),
    ("undeclared-package", undeclared_package, ("violates",), ("uses", "declared")),
    ("shallow-file", shallow_file, ("yes",), ("units", "files")),
    ("tests-only", tests_only, ("domain_logic",), ("imports",)),
    ("unpaired-call", unpaired_call, ("needs_release",), ("calls",)),
    ("carries-caller", carries_caller, ("names_caller",), ("units", "calls")),
    ("own-string", own_string, ("reimplements",), ("units", "calls")),
    ("uncounted-skip", uncounted_skip, ("unaccounted",), ("units",)),
    ("outage", outage, ("about_a_row",), ("units",)),
    ("described", described, ("contradicts", "outdated", "says_nothing"), ("units",)),
    ("switched-by-flag", switched_by_flag, ("switched",), ("units",)),
    ("pressed-page", pressed_page, ("worth_fixing",), ("files",)),
    ("drifting-word", drifting_word, ("the_word",), ("documents", "vocabulary")),
    ("uneven-bundle", uneven_bundle, ("violation",), ("bundles",)),
]


def registry(tables: Tables) -> Registry:
    """All rules whose tables are there; the others leave a note."""
    made = Registry()
    for name, plan, violations, needs in CATALOGUE:
        lacking = [n for n in needs if n not in tables]
        if lacking:
            made.notes.append((name, f"no table {', '.join(lacking)}"))
        else:
            made.add(Rule(name, plan, violations))
    return made
