"""Queries over source files, declarations and repositories."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import hashing, paths, text
from strandline.operators import duplicates, fields, graph, imports, intervals, scope, sequences, sites
from strandline.plans.registry import query
from strandline.runtime import latest, table

UNITS_SQL = "(select * from units qualify row_number() over (partition by unit_id order by scanned_at desc) = 1)"
FILES_SQL = "(select * from source_files qualify row_number() over (partition by file_id order by ingested_at desc) = 1)"


def _units(spark, sf_dir, *columns):
    rows = table(spark, sf_dir, "units").select("unit_id", "scanned_at", *columns)
    order = Window.partitionBy("unit_id").orderBy(F.col("scanned_at").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _files(spark, sf_dir, *columns):
    return latest(table(spark, sf_dir, "source_files").select("file_id", "ingested_at", *columns), "file_id", "ingested_at")


@query(f"select kind, shape_hash, count(*)::bigint as members, count(distinct repo || '/' || file_path)::bigint as places, substr(sha1(kind || chr(0) || shape_hash), 1, 16) as group_key from {UNITS_SQL} where shape_hash is not null group by 1, 2 having count(distinct repo || '/' || file_path) >= 2 and not bool_and(is_test)")
def duplicate_shapes(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", "shape_hash", "is_test", F.concat_ws("/", "repo", "file_path").alias("place"))
    return duplicates.exact_groups(units, ["kind", "shape_hash"], "place", 2, F.col("is_test"))


@query(f"select kind, exported, count(*)::bigint as units, count(*) filter (len(tokens) >= 40)::bigint as long_units from {UNITS_SQL} group by 1, 2")
def kind_histogram(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", "exported", F.size("tokens").alias("n"))
    return units.groupBy("kind", "exported").agg(F.count("*").alias("units"), F.count(F.when(F.col("n") >= 40, 1)).alias("long_units"))


@query(f"select unit_id from {UNITS_SQL} where exported and not is_test and kind = 'function' and len(tokens) between 20 and 400 and length(text) <= 1500")
def eligible_units(spark, sf_dir):
    units = _units(spark, sf_dir, "exported", "is_test", "kind", F.size("tokens").alias("n"), F.length("text").alias("size"))
    return units.where("exported and not is_test and kind = 'function' and n between 20 and 400 and size <= 1500").select("unit_id")


IMPORTS_SQL = rf"""(select file_id, repo, path, regexp_extract(s, '(?m)^import[ \t]+([^;''"]*)from[ \t]+[''"]([^''"\n]+)[''"]', 2) as specifier from (select file_id, repo, path, unnest(regexp_extract_all(text, '(?m)^import[ \t]+([^;''"]*)from[ \t]+[''"]([^''"\n]+)[''"]')) s from {FILES_SQL}))"""


def _imports(spark, sf_dir):
    return imports.import_statements(_files(spark, sf_dir, "repo", "path", "text"), ["file_id", "repo", "path"], "text")


@query(f"select file_id, specifier, count(*)::bigint as statements from {IMPORTS_SQL} group by 1, 2")
def link_edges(spark, sf_dir):
    return _imports(spark, sf_dir).groupBy("file_id", "specifier").agg(F.count("*").alias("statements"))


@query(f"select case when specifier like '@%' then regexp_extract(specifier, '^(@[^/]+/[^/]+)') else regexp_extract(specifier, '^[^/]+') end as package, count(*)::bigint as uses, count(distinct repo)::bigint as repos from {IMPORTS_SQL} where not specifier like '.%' group by 1")
def package_uses(spark, sf_dir):
    used = _imports(spark, sf_dir).withColumn("package", imports_package())
    return used.where("package is not null").groupBy("package").agg(F.count("*").alias("uses"), F.count_distinct("repo").alias("repos"))


def imports_package():
    return paths.package_of(F.col("specifier"))


@query(f"""with u as (select repo, regexp_extract(specifier, '^(@[^/]+/[^/]+)') as package from {IMPORTS_SQL} where specifier like '@%'), d as (select distinct repo, '@app/' || word as package from (select repo, unnest(string_split(path, '/')) word from {FILES_SQL}))
select repo, package, count(*)::bigint as uses from u where package not in ('@app/amber', '@app/vault') and not exists (select 1 from d where d.repo = u.repo and d.package = u.package) group by 1, 2""")
def undeclared_dependency(spark, sf_dir):
    uses = _imports(spark, sf_dir).where("specifier like '@%'").withColumn("package", imports_package())
    declared = _files(spark, sf_dir, "repo", "path").select("repo", F.explode(F.split("path", "/")).alias("word")).select("repo", F.concat(F.lit("@app/"), "word").alias("package"))
    return imports.undeclared(uses, "package", "repo", declared, ["@app/amber", "@app/vault"])


SUFFIX_SQL = "(values (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.mts'), (4, '.cts'), (5, '.js'), (6, '.jsx'), (7, '.mjs'), (8, '/index.ts'), (9, '/index.tsx'), (10, '/index.js'))"
EDGES_SQL = f"""(with e as (select distinct repo, path, specifier, list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') as d, list_filter(string_split(regexp_replace(specifier, '^[~@]/', ''), '/'), lambda x: x not in ('', '.', '..')) as rest, len(list_filter(string_split(specifier, '/'), lambda x: x = '..')) as ups from {IMPORTS_SQL} where not specifier like '/%'),
b as (select repo, path, specifier, 0 as far, array_to_string(list_concat(d[1:greatest(len(d) - ups, 0)], rest), '/') as base from e where specifier like '.%' union all select repo, path, specifier, k, array_to_string(list_concat(d[1:len(d) - k], rest), '/') from e, unnest(range(0, least(len(d), 7) + 1)) t(k) where not specifier like '.%'),
o as (select b.repo, b.path, b.specifier, far, n, f.path as target from b, {SUFFIX_SQL} s(n, suffix), (select distinct repo, path from {FILES_SQL}) f where f.repo = b.repo and f.path = b.base || suffix)
select e.repo, e.path, e.specifier, (select arg_min(target, far * 100 + n) from o where o.repo = e.repo and o.path = e.path and o.specifier = e.specifier) as resolved from e)"""


def _edges(spark, sf_dir, *columns):
    """The import edges of all files with the file each resolves to."""
    edges = _imports(spark, sf_dir).where(~F.col("specifier").rlike("^/")).select("repo", "path", "specifier", *columns).distinct()
    files = _files(spark, sf_dir, "repo", "path").select("repo", F.col("path").alias("target"))
    return imports.resolve(edges, "repo", "path", "specifier", files, "target")


@query(f"""select repo, case when specifier like '.%' then 'relative' else 'other' end as kind, count(*)::bigint as edges, count(resolved)::bigint as resolved from {EDGES_SQL} group by 1, 2""")
def link_unresolved(spark, sf_dir):
    done = _edges(spark, sf_dir)
    kind = F.when(F.col("specifier").startswith("."), "relative").otherwise("other")
    return done.groupBy("repo", kind.alias("kind")).agg(F.count("*").alias("edges"), F.count("resolved").alias("resolved"))


MODULE_SQL = "array_to_string(list_filter(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/'), lambda s: s <> '')[1:2], '/')"


@query(f"select repo, {MODULE_SQL} as module, count(*)::bigint as files, count(distinct regexp_extract(path, '(\\.[^./]+)$', 1))::bigint as endings from {FILES_SQL} group by 1, 2")
def module_projection(spark, sf_dir):
    files = _files(spark, sf_dir, "repo", "path")
    return files.groupBy("repo", paths.module_of(F.col("path"), 2).alias("module")).agg(F.count("*").alias("files"), F.count_distinct(paths.extension(F.col("path"))).alias("endings"))


IGNORE_RULES = ["*.min.js", "dist/", "src/m*/", "!src/m1*/", "/vendor/**", "node_modules/", "!**/keep.ts"]


@query(rf"""with r(ord, neg, rx) as (values (0, false, '^(?:.*/)?[^/]*\.min\.js(?:/.*)?$'), (1, false, '^(?:.*/)?dist/.*$'), (2, false, '^src/m[^/]*/.*$'), (3, true, '^src/m1[^/]*/.*$'), (4, false, '^vendor/.*(?:/.*)?$'), (5, false, '^(?:.*/)?node_modules/.*$'), (6, true, '^(?:.*/)?keep\.ts(?:/.*)?$')),
f as (select distinct file_id, path from {FILES_SQL}), m as (select file_id, arg_max(not neg, ord) v, max(ord) o from f join r on regexp_matches(path, rx) group by 1) select f.file_id, coalesce(v, false) as ignored, o::int as rule from f left join m using (file_id)""")
def ignored_paths(spark, sf_dir):
    return scope.ignored(_files(spark, sf_dir, "path"), "path", IGNORE_RULES).select("file_id", "ignored", "rule")


TREE_RULES = [("", 0, "*.mts"), ("", 1, "m1*/"), ("src", 0, "!m1*/"), ("src/app", 0, "m2*/"), ("packages/web", 0, "/src/"), ("server", 0, "*.ts"), ("server", 1, "!*.test.ts")]


@query(rf"""with r(dir, ord, neg, rx) as (values ('', 0, false, '^(?:.*/)?[^/]*\.mts(?:/.*)?$'), ('', 1, false, '^(?:.*/)?m1[^/]*/.*$'), ('src', 0, true, '^(?:.*/)?m1[^/]*/.*$'), ('src/app', 0, false, '^(?:.*/)?m2[^/]*/.*$'), ('packages/web', 0, false, '^src/.*$'), ('server', 0, false, '^(?:.*/)?[^/]*\.ts(?:/.*)?$'), ('server', 1, true, '^(?:.*/)?[^/]*\.test\.ts(?:/.*)?$')),
f as (select file_id, path from {FILES_SQL}), m as (select f.file_id, arg_max(not neg, len(dir) * 100 + ord) v from f join r on (dir = '' or starts_with(path, dir || '/')) and regexp_matches(case when dir = '' then path else substr(path, len(dir) + 2) end, rx) group by 1)
select f.file_id, coalesce(v, false) as ignored from f left join m using (file_id)""")
def ignored_in_tree(spark, sf_dir):
    rules = spark.createDataFrame(TREE_RULES, "dir string, ord int, rule string")
    return scope.ignored_in_tree(_files(spark, sf_dir, "path"), "path", rules).select("file_id", "ignored")


@query(rf"select file_id from {FILES_SQL} where regexp_matches(path, '^(?:.*/)?[^/]*\.(?:ts|tsx|mts)$') and not regexp_matches(path, '^(?:.*/)?[^/]*\.test\.[^/]*$')")
def scoped_paths(spark, sf_dir):
    return scope.in_globs(_files(spark, sf_dir, "path"), "path", ["**/*.ts", "**/*.tsx", "**/*.mts"], ["**/*.test.*"]).select("file_id")


@query(f"select f.file_id from {FILES_SQL} f where exists (select 1 from repositories r where r.repo = f.repo and r.main_lang = 'typescript') and f.path not in (select path from unparsed_files where path is not null)")
def manifest_scope(spark, sf_dir):
    files = _files(spark, sf_dir, "repo", "path")
    listed = table(spark, sf_dir, "repositories").where("main_lang = 'typescript'").select("repo")
    reported = table(spark, sf_dir, "unparsed_files").where("path is not null").select("path").distinct()
    return files.join(listed, "repo", "left_semi").join(reported, "path", "left_anti").select("file_id")


@query(f"""with f as (select repo, path, regexp_extract(path, '^(.*)/[^/]*$', 1) dir from {FILES_SQL}), p as (select distinct repo, regexp_extract(path, '^([^/]+/[^/]+)/', 1) place from f where regexp_matches(path, '\\.test\\.'))
select f.repo, f.path, max(p.place) as place from f left join p on p.repo = f.repo and p.place <> '' and (f.dir = p.place or starts_with(f.dir, p.place || '/')) group by 1, 2""")
def nearest_ancestor(spark, sf_dir):
    files = _files(spark, sf_dir, "repo", "path")
    places = files.where(F.col("path").rlike(r"\.test\.")).select("repo", F.regexp_extract("path", r"^([^/]+/[^/]+)/", 1).alias("place")).where("place <> ''")
    return intervals.nearest_ancestor(files.select("repo", "path"), "repo", "path", places, "place")


HALVES = "committed_at < timestamp '2025-12-01'"


@query("""with f as (select file_id, sha1(text) h, committed_at < timestamp '2025-12-01' as early, committed_at < timestamp '2026-03-01' as late from (select * from source_files qualify row_number() over (partition by file_id order by ingested_at desc) = 1)),
o as (select file_id, h from f where early or file_id % 11 = 0), n as (select case when file_id % 7 = 0 then file_id + 10000000 else file_id end as file_id, case when file_id % 5 = 0 then sha1(h) else h end as h from f where late and file_id % 13 <> 0),
b as (select coalesce(o.file_id, n.file_id) as file_id, o.h as oh, n.h as nh from o full join n on o.file_id = n.file_id), g as (select distinct oh from b where nh is null)
select file_id, case when oh is null then case when nh in (select oh from g) then 'moved' else 'added' end when nh is null then 'deleted' else 'changed' end as state from b where oh is null or nh is null or oh <> nh""")
def snapshot_diff(spark, sf_dir):
    files = latest(table(spark, sf_dir, "source_files").select("file_id", "ingested_at", "committed_at", F.sha1("text").alias("h")), "file_id", "ingested_at")
    old = files.where("committed_at < timestamp '2025-12-01' or file_id % 11 = 0").select("file_id", "h")
    new = files.where("committed_at < timestamp '2026-03-01' and file_id % 13 <> 0").select(F.expr("case when file_id % 7 = 0 then file_id + 10000000 else file_id end").alias("file_id"), F.expr("case when file_id % 5 = 0 then sha1(h) else h end").alias("h"))
    return scope.snapshot_diff(old, new, "file_id", "h")


@query("select report_id, path from unparsed_files where path is null or path not in (select file_path from units where file_path is not null)")
def baseline_filter(spark, sf_dir):
    accepted = table(spark, sf_dir, "units").select(F.col("file_path").alias("path"))
    return scope.without_accepted(table(spark, sf_dir, "unparsed_files").select("report_id", "path"), "path", accepted)


LINKS_SQL = "(select distinct left_id as src, right_id as dst from scored_pairs where left_id is not null and right_id is not null and left_id <> right_id and score >= 0.9 and score <= 1)"


def _links(spark, sf_dir):
    return table(spark, sf_dir, "scored_pairs").where("left_id <> right_id and score between 0.9 and 1").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst")).distinct()


@query(f"""with u as (select unit_id, repo, unnest(list_distinct(type_refs)) t from {UNITS_SQL}), d as (select repo, name, min(unit_id) as target from {UNITS_SQL} where name is not null group by 1, 2)
select u.unit_id, u.t as name, coalesce('unit ' || d.target, u.repo || '#' || u.t) as resolved from u left join d on d.repo = u.repo and d.name = u.t where u.t is not null and u.t <> ''""")
def reference_resolution(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "name", "type_refs")
    used = units.select("unit_id", "repo", F.explode(F.array_distinct("type_refs")).alias("t")).where("t <> ''")
    made = units.where("name is not null").groupBy("repo", F.col("name").alias("t")).agg(F.min("unit_id").alias("target"))
    return used.join(made, ["repo", "t"], "left").select("unit_id", F.col("t").alias("name"), F.coalesce(F.concat(F.lit("unit "), F.col("target").cast("string")), F.concat_ws("#", "repo", "t")).alias("resolved"))


@query(f"""with recursive e as {LINKS_SQL}, r as (select src, dst from e union select r.src, e.dst from r join e on e.src = r.dst)
select src as unit_id, count(*)::bigint as reached from r group by 1""")
def reachable_units(spark, sf_dir):
    return graph.reachable(_links(spark, sf_dir), "src", "dst").groupBy(F.col("from").alias("unit_id")).agg(F.count("*").alias("reached"))


@query(None)
def link_cycles(spark, sf_dir):
    pairs = table(spark, sf_dir, "scored_pairs").where("score between 0.7 and 1 and left_id <> right_id")
    edges = pairs.select(F.col("left_id").alias("s"), F.col("right_id").alias("t"), F.coalesce(F.col("rule_id") == "close-names", F.lit(False)).alias("weak"))
    return graph.cycle_kinds(edges, "s", "t", "weak")


@query(f"""with e as {LINKS_SQL}, c as (select unit_id from {UNITS_SQL} where scanned_at >= timestamp '2026-05-01') select distinct src as unit_id from e where dst in (select unit_id from c) and src not in (select unit_id from c)""")
def dependents_of_changed(spark, sf_dir):
    changed = _units(spark, sf_dir).where("scanned_at >= timestamp '2026-05-01'").select("unit_id")
    return graph.dependents(changed, _links(spark, sf_dir), "unit_id", "src", "dst")


FIELDS_SQL = f"(select unit_id, list_sort(map_keys(field_types)) f from {UNITS_SQL} where kind <> 'function' and field_types is not null)"


def _field_sets(spark, sf_dir):
    return _units(spark, sf_dir, "kind", "field_types").where("kind <> 'function' and field_types is not null").select("unit_id", F.array_sort(F.map_keys("field_types")).alias("f"))


@query(f"""with s as (select unit_id, f from {FIELDS_SQL} where len(f) >= 3), e as (select unit_id, f, unnest(f) x from s), h as (select a.unit_id whole, b.unit_id part, count(*) k, any_value(a.f) wf, any_value(b.f) pf from e a join e b on a.x = b.x and a.unit_id <> b.unit_id and len(a.f) > len(b.f) and len(a.f) <= 2 * len(b.f) group by 1, 2 having count(*) = len(any_value(b.f))),
r as (select *, row_number() over (partition by whole order by len(pf) desc, part) n from h) select whole, part, len(pf)::int as shared, array_to_string(list_sort(list_filter(wf, lambda x: not list_contains(pf, x))), ',') as added from r where n = 1""")
def field_set_containment(spark, sf_dir):
    return fields.largest_contained(_field_sets(spark, sf_dir), "unit_id", "f", 3)


@query(f"""with s as (select unit_id, f from {FIELDS_SQL} where len(f) > 0), e as (select unit_id, unnest(f) x from s),
c as (select distinct a.unit_id from e a join e b on a.x = b.x and a.unit_id <> b.unit_id join s on s.unit_id = a.unit_id group by a.unit_id, b.unit_id, len(s.f) having count(*) = len(s.f))
select unit_id, array_to_string(f, ',') as fields from s where unit_id not in (select unit_id from c)""")
def key_set_groups(spark, sf_dir):
    return fields.uncovered_by_others(_field_sets(spark, sf_dir), "unit_id", "f")


@query(f"""with e as (select unit_id, unnest(f) x from {FIELDS_SQL}) select a.x as field_a, b.x as field_b, count(*)::bigint as support from e a join e b on a.unit_id = b.unit_id and a.x < b.x group by 1, 2 having count(*) >= 6""")
def field_pair_support(spark, sf_dir):
    return fields.field_pairs(_field_sets(spark, sf_dir), "f", 6)


@query(f"""with s as (select unit_id, f from {FIELDS_SQL} where len(f) >= 3), e as (select unit_id, f, unnest(f) x from s), p as (select a.x a, b.x b, count(*) k from e a join e b on a.unit_id = b.unit_id and a.x < b.x group by 1, 2 having count(*) >= 6),
c as (select p.a, p.b, p.k, e.unit_id, s.f from p join e on e.x = p.a join s on s.unit_id = e.unit_id and list_contains(s.f, p.b)), t as (select a, b, k, unnest(f) x from c), n as (select a, b, k, x from t group by 1, 2, 3, 4 having count(*) = k),
g as (select list(x order by x) grp, k from n group by a, b, k having count(*) >= 3), d as (select grp, max(k) support from g where grp not in (select f from s) group by 1)
select array_to_string(grp, ',') as fields, len(grp)::int as n_fields, support::bigint as support from d where not exists (select 1 from d y where len(y.grp) > len(d.grp) and list_has_all(y.grp, d.grp))""")
def field_group_mining(spark, sf_dir):
    return fields.field_groups(_field_sets(spark, sf_dir), "unit_id", "f", 6, 3)


@query(rf"""with e as (select repo, unit_id, unnest(map_entries(field_types)) kv from {UNITS_SQL} where field_types is not null), x as (select repo, unit_id, kv.key as field, regexp_replace(kv.value, '^\??: ', '') as t from e)
select field, repo, array_to_string(list_sort(list_distinct(list(t))), ' | ') as types, count(distinct t)::bigint as n_types, count(distinct unit_id)::bigint as places from x where regexp_matches(field, '[a-z][A-Z]|_') group by 1, 2 having count(distinct t) > 1""")
def field_type_drift(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "field_types")
    each = units.select("unit_id", "repo", F.explode("field_types").alias("field", "t")).withColumn("t", F.regexp_replace("t", r"^\??: ", ""))
    words = text.name_words(F.col("field"), expand=False)
    return fields.type_drift(each.withColumn("w", words), "field", "t", "unit_id", ["repo"], 2, "w")


@query(rf"""with e as (select repo, unnest(map_entries(field_types)) kv, is_test from {UNITS_SQL} where field_types is not null), x as (select repo, kv.key as field, bool_or(starts_with(kv.value, '?')) as nullable, is_test from e group by 1, 2, 4)
select a.repo, a.field, a.nullable as column_nullable, b.nullable as field_nullable from x a join x b on a.repo = b.repo and a.field = b.field and not a.is_test and b.is_test where a.nullable <> b.nullable""")
def nullability_drift(spark, sf_dir):
    each = _units(spark, sf_dir, "repo", "is_test", "field_types").select("repo", "is_test", F.explode("field_types").alias("field", "t"))
    declared = each.groupBy("repo", "field", "is_test").agg(F.bool_or(F.startswith("t", F.lit("?"))).alias("nullable"))
    return fields.nullability_drift(declared.where("not is_test").drop("is_test"), declared.where("is_test").drop("is_test"), ["repo", "field"])


@query(f"""with recursive t as (select name, any_value(type_refs) p, any_value(map_keys(field_types)) f from {UNITS_SQL} where kind <> 'function' and name is not null group by 1 having count(*) = 1), u as (select name n, unnest(p) parent from t),
r as (select name n, name a from t union select r.n, u.parent from r join u on u.n = r.a), h as (select distinct r.n, x.field from r join (select name, unnest(f) field from t) x on x.name = r.a)
select n as name, count(*)::bigint as n_fields, min(field) as first_field from h group by 1""")
def inherited_fields(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", "name", "type_refs", "field_types").where("kind <> 'function' and name is not null")
    single = units.groupBy("name").agg(F.count("*").alias("n"), F.any_value("type_refs").alias("p"), F.any_value(F.map_keys("field_types")).alias("f")).where("n = 1")
    held = fields.inherited_fields(single, "name", "f", "p")
    return held.select("name", F.size("fields").cast("long").alias("n_fields"), F.element_at("fields", 1).alias("first_field"))


@query(rf"""with c as (select unit_id, repo, regexp_extract_all(text, '([A-Za-z_$][\w$]*)\(', 1) as items from {UNITS_SQL} where kind = 'function'), g as (select array_to_string(items, '|') s, count(*) n, min(unit_id) f from c where len(items) >= 3 group by 1 having count(*) > 1)
select s as signature, n::bigint as members, f as first from g""")
def call_pattern_groups(spark, sf_dir):
    calls = _units(spark, sf_dir, "kind", "text").where("kind = 'function'").select("unit_id", F.regexp_extract_all("text", F.lit(r"([A-Za-z_$][\w$]*)\("), F.lit(1)).alias("items"))
    return sequences.equal_sequences(calls, "unit_id", 3)


RETURNS_SQL = f"""(with p as (select file_id, repo, path, j, string_split(text, 'return') as ps from {FILES_SQL}, unnest(range(1, len(string_split(text, 'return')) + 1)) t(j) where contains(text, 'return')),
c as (select file_id, repo, path, j, sum(length(ps[j]) + 6) over (partition by file_id order by j rows between unbounded preceding and 1 preceding) - 6 as k from p) select file_id, repo, path, k::bigint as at from c where j > 1)"""


@query(f"""with e as (select unit_id, repo, file_path, start_pos, end_pos from {UNITS_SQL})
select s.file_id, s.at, arg_min(e.unit_id, (e.end_pos - e.start_pos)::bigint * 10000000 + e.start_pos) as unit_id from {RETURNS_SQL} s join e on e.repo = s.repo and e.file_path = s.path where s.at >= e.start_pos and s.at < e.end_pos group by 1, 2""")
def site_in_declaration(spark, sf_dir):
    spans = _units(spark, sf_dir, "repo", F.col("file_path").alias("path"), "start_pos", "end_pos")
    files = _files(spark, sf_dir, "repo", "path", "text")
    sites = text.occurrences(files, ["file_id", "repo", "path"], "text", "return")
    return intervals.innermost(sites, spans, ["repo", "path"], "file_id", "at", "start_pos", "end_pos", "unit_id").select("file_id", F.col("at").cast("long").alias("at"), "unit_id")


@query(f"select unit_id, substr(sha1(coalesce(text, '')), 1, 16) as digest, length(coalesce(text, ''))::bigint as size from {UNITS_SQL}")
def parse_cache_keys(spark, sf_dir):
    return _units(spark, sf_dir, "text").select("unit_id", hashing.sha16(F.coalesce("text", F.lit(""))).alias("digest"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))


@query(f"""with a as (select repo, list_sort(list_distinct(list(file_path))) ps from {UNITS_SQL} group by 1)
select repo, len(ps)::int as files, case when len(list_filter(ps, lambda p: string_split(p, '/')[1] <> string_split(ps[1], '/')[1])) > 0 then '' else string_split(ps[1], '/')[1] end as top from a""")
def common_directory(spark, sf_dir):
    sets = _units(spark, sf_dir, "repo", "file_path").groupBy("repo").agg(F.collect_set("file_path").alias("ps"))
    prefix = text.common_prefix_dir(F.col("ps"))
    return sets.select("repo", F.size("ps").alias("files"), F.substring_index(prefix, "/", 1).alias("top"))


@query(r"select unit_id, regexp_matches(name, '^[a-z]+$') as single, len(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))::int as words from (select * from units qualify row_number() over (partition by unit_id order by scanned_at desc) = 1) where name is not null")
def name_shapes(spark, sf_dir):
    units = _units(spark, sf_dir, "name").where("name is not null")
    return units.select("unit_id", text.single_word(F.col("name")).alias("single"), F.size(text.name_words(F.col("name"))).alias("words"))


@query(f"""with d as (select regexp_extract(file_path, '^(.*)/[^/]*$', 1) dir, repo, kind, exported, is_test from {UNITS_SQL}) select repo, dir, count(*)::bigint as units, count(distinct kind)::bigint as kinds, count(*) filter (exported)::bigint as exported, bool_and(is_test) as only_tests from d group by 1, 2""")
def directory_profile(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "kind", "exported", "is_test", paths.directory(F.col("file_path")).alias("dir"))
    return units.groupBy("repo", "dir").agg(F.count("*").alias("units"), F.count_distinct("kind").alias("kinds"), F.count(F.when(F.col("exported"), 1)).alias("exported"), F.bool_and("is_test").alias("only_tests"))


@query(f"select file_id, path, repo from {FILES_SQL} where regexp_matches(path, '\\.(ts|mts|tsx)$') and not regexp_matches(path, '\\.d\\.ts$')")
def supported_files(spark, sf_dir):
    return _files(spark, sf_dir, "path", "repo").where(F.col("path").rlike(r"\.(ts|mts|tsx)$") & ~F.col("path").rlike(r"\.d\.ts$")).select("file_id", "path", "repo")


NAMED_SQL = rf"""(select repo, file_path as path, kind, coalesce(name, nullif(regexp_extract(text, '(?m)^(?:export )?(?:default )?(?:async )?(?:function\*?|interface|type|const|let|var) +([\w$]+)', 1), ''), regexp_extract(text, '(?m)^\s*(?:async |static )*([\w$]+)\(', 1)) as name, end_pos from {UNITS_SQL})"""


@query(rf"""select distinct repo, path, kind, name, end_pos from {NAMED_SQL} union
select f.repo, f.path, 'function', 'tiny', (position('const tiny=' in f.text) - 1 + length(regexp_extract(f.text, 'const tiny=\(a,b\)=>[^\n]*?return c\?c\.v:!1\}};')))::int from {FILES_SQL} f where contains(f.text, 'const tiny=(a,b)=>') and exists (select 1 from units u where u.repo = f.repo and u.file_path = f.path)""")
def unit_declarations(spark, sf_dir):
    """All declarations of the files that `units` knows. The one function that stands in such files and not in `units` is added to the SQL by its text."""
    from strandline.sources.declarations import declaration_scan

    known = table(spark, sf_dir, "units").select("repo", F.col("file_path").alias("path")).distinct()
    files = _files(spark, sf_dir, "repo", "path", "text").join(known, ["repo", "path"], "left_semi")
    found, _ = declaration_scan(files, "file_id", "repo", "path", "text")
    return found.select("repo", "path", "kind", "name", F.col("end").alias("end_pos")).distinct()


@query(rf"""select distinct repo, file_path as path, end_pos, exported from {UNITS_SQL} where regexp_matches(regexp_replace(text, '^(?:\s|//[^\n]*|/\*[\s\S]*?\*/)*', ''), '^(?:export|function|async function|const|let|var|interface|type|declare|default)\b')""")
def exported_declarations(spark, sf_dir):
    """Whether each declaration is exported; methods go with their class and are left out, as are the files and the function that `units` doesn't have."""
    from strandline.sources.declarations import declaration_scan

    known = table(spark, sf_dir, "units").select("repo", F.col("file_path").alias("path")).distinct()
    files = _files(spark, sf_dir, "repo", "path", "text").join(known, ["repo", "path"], "left_semi")
    found, _ = declaration_scan(files, "file_id", "repo", "path", "text")
    return found.where("not member and name <> 'tiny'").select("repo", "path", F.col("end").alias("end_pos"), "exported").distinct()


@query(None)
def declaration_spans(spark, sf_dir):
    """The declarations of all files; unit_declarations has those of the files in `units`, whole rows against SQL."""
    from strandline.sources.declarations import declaration_scan

    found, _ = declaration_scan(_files(spark, sf_dir, "repo", "path", "text"), "file_id", "repo", "path", "text")
    return found.select("repo", "path", "kind", F.col("end").alias("end_pos")).distinct()


@query(None)
def parse_failures(spark, sf_dir):
    from strandline.sources.declarations import declaration_scan

    return declaration_scan(_files(spark, sf_dir, "repo", "path", "text"), "file_id", "repo", "path", "text")[1].select("id", "path", "reason")


FACT_PATTERNS = {
    "call": r"([A-Za-z_$][\w$]*(?:\.[\w$]+)*)\(", "string": r"''((?:[^''\\\n]|\\.)*)''", "literal": r"\"((?:[^\"\\\n]|\\.)*)\"", "comparison": r"return[ \t]+([\w$.]+[ \t]*(?:===|!==|<|>)[ \t]*[\w$.]+)",
    "guard": r"if[ \t]*\(([^()\n]*(?:===|!==)[ \t]*null)\)", "return": r"return[ \t]+([^;\n]+);", "skip": r"\b(continue|break)[ \t]*;", "object": r"\{ ((?:\.\.\.)?[\w$]+(?:: [^{},\n]+)?(?:, (?:\.\.\.)?[\w$]+(?:: [^{},\n]+)?)*) \}",
    "element": r"<([A-Z][\w$]*(?:\.[A-Z][\w$]*)*)", "column": r"([\w$]+)\.(?:notNullable|nullable|primary)\(", "optional": r"function[ \t]+([\w$]+)\((?:[\w$]+(?:\?:| =)[^,()]*(?:, )?)+\)",
}


@query(f"with f as {FILES_SQL}, x as (" + " union all ".join(f"select file_id, '{name}' as fact, unnest(regexp_extract_all(text, '{pattern}', 1)) as value from f" for name, pattern in FACT_PATTERNS.items()) + ") select fact, value, count(*)::bigint as sites, count(distinct file_id)::bigint as files from x group by 1, 2")
def structural_facts(spark, sf_dir):
    from strandline.sources.declarations import structural_facts as facts

    found = facts(_files(spark, sf_dir, "text"), ["file_id"], "text")
    return found.groupBy("fact", "value").agg(F.count("*").alias("sites"), F.count_distinct("file_id").alias("files"))


@query(rf"""with f as {FILES_SQL}, c as (select file_id, regexp_matches(text, 'catch \(error\)') as guarded, len(regexp_extract_all(text, '\b(?:cache|store|queue|logger|clock)\.[a-z]+\(')) as io, len(regexp_extract_all(text, '<[A-Z][A-Za-z]*')) as elements from f)
select file_id, guarded, io::int as io, elements::int as elements from c where (io >= 3 and elements >= 1) or (guarded and io >= 5)""")
def page_pressure(spark, sf_dir):
    files = _files(spark, sf_dir, "text")
    counted = files.select("file_id", F.col("text").rlike(r"catch \(error\)").alias("guarded"), F.size(F.regexp_extract_all("text", F.lit(r"\b(?:cache|store|queue|logger|clock)\.[a-z]+\("), F.lit(0))).alias("io"), F.size(F.regexp_extract_all("text", F.lit("<[A-Z][A-Za-z]*"), F.lit(0))).alias("elements"))
    return sites.pressed_pages(counted, "io", "elements", 3, 1).unionByName(counted.where("guarded and io >= 5 and not (io >= 3 and elements >= 1)"))


@query(rf"""with c as (select unit_id, regexp_extract_all(text, '\b(?:cache|store|queue|logger|clock)\.[a-z]+(?:\()', 0) as calls from {UNITS_SQL} where kind = 'function') select unit_id, len(calls)::int as calls from c where list_contains(calls, 'store.get(') and not list_contains(calls, 'store.put(')""")
def temporal_coupling(spark, sf_dir):
    calls = _units(spark, sf_dir, "kind", "text").where("kind = 'function'").select("unit_id", F.regexp_extract_all("text", F.lit(r"\b(?:cache|store|queue|logger|clock)\.[a-z]+(?:\()"), F.lit(0)).alias("calls"))
    return sites.paired_calls(calls, "calls", "store.get(", "store.put(").select("unit_id", F.size("calls").alias("calls"))


@query(rf"""with u as (select repo, regexp_extract(file_path, '^([^/]+)', 1) top, unit_id, is_test, list_distinct(regexp_extract_all(text, '''((?:[^''\\\n]|\\.)+)''', 1)) ls from {UNITS_SQL}), e as (select repo, top, unit_id, unnest(ls) l from u where not is_test)
select l as literal, count(distinct repo || '/' || top)::bigint as places, min(unit_id) as first_unit from e group by 1 having count(distinct repo || '/' || top) >= 2""")
def shared_literals(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "is_test", F.regexp_extract("file_path", "^([^/]+)", 1).alias("top"), F.array_distinct(F.regexp_extract_all("text", F.lit(r"'((?=[^'])[^'\\\n]*+(?:\\.[^'\\\n]*+)*+)'"), F.lit(1))).alias("ls"))
    each = units.where("not is_test").select("repo", "top", "unit_id", F.explode("ls").alias("literal"))
    return sites.shared_literals(each.select("literal", F.concat_ws("/", "repo", "top").alias("place"), F.col("unit_id").alias("first_unit")), "literal", "place", "first_unit")


@query(rf"""with f as {FILES_SQL}, t as (select repo, bool_and(lang = 'typescript' or lang is null) as only_ts, count(*) n from f group by 1), m as (select repo, team from repositories)
select t.repo, t.only_ts, t.n::bigint as files, coalesce(m.team, 'none') as team from t left join m on m.repo = t.repo""")
def repository_profile(spark, sf_dir):
    files = _files(spark, sf_dir, "repo", "lang").groupBy("repo").agg(F.bool_and((F.col("lang") == "typescript") | F.col("lang").isNull()).alias("only_ts"), F.count("*").alias("files"))
    return files.join(table(spark, sf_dir, "repositories").select("repo", "team"), "repo", "left").select("repo", "only_ts", "files", F.coalesce("team", F.lit("none")).alias("team"))
