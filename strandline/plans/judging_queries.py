"""Queries over resolved types, runs, module roles and what is asked, answered and reported."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import paths, text
from strandline.operators import judging, roles, runs, types
from strandline.plans.code_queries import FILES_SQL, MODULE_SQL, UNITS_SQL, _files, _units
from strandline.plans.registry import query
from strandline.runtime import latest, table


@query(f"""with f as (select lower(repo || '/' || file_path) f, start_pos l, name n, {{'s': -length(array_to_string(list_sort(map_keys(field_types)), ',')), 't': array_to_string(list_sort(map_keys(field_types)), ',')}} d from {UNITS_SQL} where kind <> 'function' and field_types is not null),
s as (select distinct unit_id, lower(repo || '/' || file_path) f, start_pos l, n from (select unit_id, repo, file_path, start_pos, unnest(type_refs) n from {UNITS_SQL}) where n <> ''),
a as (select f, l, min(d) d from f group by 1, 2), b as (select f, n, min(d) d from f where n <> '' group by 1, 2)
select s.unit_id, s.n as name, coalesce(a.d.t, b.d.t) as type from s left join a on a.f = s.f and a.l = s.l left join b on b.f = s.f and b.n = s.n""")
def type_lookup(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", F.concat_ws("/", "repo", "file_path").alias("file"), "start_pos", "name", "type_refs", "field_types")
    facts = units.where("kind <> 'function' and field_types is not null").select("file", F.col("start_pos").alias("line"), "name", F.array_join(F.array_sort(F.map_keys("field_types")), ",").alias("display"))
    sites = units.select("unit_id", F.upper("file").alias("file"), F.col("start_pos").alias("line"), F.explode("type_refs").alias("name")).where("name <> ''").distinct()
    return types.type_at(sites, facts, "file", "line", "name", "display").select("unit_id", "name", "type")


@query(rf"""with t as (select unit_id, list_transform(map_values(field_types), lambda v: regexp_replace(v, '^\??: ', '')) ts from {UNITS_SQL} where field_types is not null)
select unit_id, len(ts) = 0 or len(list_filter(ts, lambda t: trim(t) in ('string', 'Promise<string>') or len(list_filter(string_split(t, '|'), lambda m: trim(m) = 'string')) > 0)) > 0 as strings, len(ts) = 0 or len(list_filter(ts, lambda t: t not in ('number', 'boolean'))) > 0 as data from t""")
def string_capable_units(spark, sf_dir):
    rows = _units(spark, sf_dir, "field_types").where("field_types is not null")
    each = F.transform(F.map_values("field_types"), lambda v: F.regexp_replace(v, r"^\??: ", ""))
    return rows.select("unit_id", each.alias("ts")).select("unit_id", types.string_capable(F.col("ts")).alias("strings"), types.may_yield(F.col("ts"), ["number", "boolean"]).alias("data"))


GUARD = r"^if \(([A-Za-z_$][\w$]*) === null\) ?(return|throw)?"
PARAMETER = r"([A-Za-z_$][\w$]*): ([A-Z][\w$]*(?: \| null)?)[,)]"


@query(rf"""with f as {FILES_SQL}, p as (select repo, path, j, string_split(text, 'if (') ps from f, unnest(range(1, len(string_split(text, 'if (')) + 1)) t(j) where contains(text, 'if (')),
c as (select repo, path, j, sum(length(ps[j]) + 4) over (partition by repo, path order by j rows between unbounded preceding and 1 preceding) - 4 as k, ps[j] as rest from p),
g as (select repo, path, k as guard, regexp_extract('if (' || rest, '{GUARD}', 1) as ref, regexp_extract('if (' || rest, '{GUARD}', 2) as way from c where j > 1),
u as (select repo, file_path as path, start_pos, end_pos, unit_id, text from {UNITS_SQL} where kind = 'function'),
n as (select distinct repo, path, regexp_extract(x, '{PARAMETER}', 1) as name, regexp_extract(x, '{PARAMETER}', 2) as t from (select repo, path, unnest(regexp_extract_all(text, '{PARAMETER}')) x from u)),
h as (select g.repo, g.path, g.guard, g.ref, arg_min(u.unit_id, (u.end_pos - u.start_pos)::bigint * 10000000 + u.start_pos) as unit_id from g join u on u.repo = g.repo and u.path = g.path and g.guard >= u.start_pos and g.guard <= u.end_pos where g.ref <> '' and g.way <> '' group by 1, 2, 3, 4)
select h.repo, h.path, h.guard::bigint as guard, h.unit_id, h.ref from h where exists (select 1 from n where n.repo = h.repo and n.path = h.path and n.name = h.ref and n.t like '%| null')""")
def guards_for_types(spark, sf_dir):
    """Guards against null that leave their function and test a parameter whose declared type admits null."""
    files = _files(spark, sf_dir, "repo", "path", "text").where(F.contains("text", F.lit("if (")))
    # the piece after each place holds the guard's head, so no text is cut out of the whole again
    pieces = files.select("repo", "path", F.posexplode(F.split("text", r"if \(")).alias("n", "piece"))
    sites = text.occurrences(files, ["repo", "path"], "text", "if (")
    from pyspark.sql import Window

    numbered = sites.withColumn("n", F.row_number().over(Window.partitionBy("repo", "path").orderBy("at"))).join(pieces, ["repo", "path", "n"])
    head = F.concat(F.lit("if ("), F.col("piece"))
    guards = numbered.select("repo", "path", F.col("at").cast("long").alias("guard"), F.col("at").alias("a"), F.col("at").alias("b"), (F.regexp_extract(head, GUARD, 2) != "").alias("exits"), F.array(F.regexp_extract(head, GUARD, 1)).alias("refs"))
    units = _units(spark, sf_dir, "kind", "repo", F.col("file_path").alias("path"), "start_pos", "end_pos", "text").where("kind = 'function'")
    params = units.select("repo", "path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(PARAMETER), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(PARAMETER), F.lit(2)).alias("t"))).alias("p")).select("repo", "path", "p.*").distinct()
    nullable = F.when(F.col("t").endswith("| null"), F.array(F.lit("null")))
    facts = params.select("repo", "path", F.col("name").alias("ref"), F.array(F.lit("Object")).alias("flags"), nullable.alias("members"))
    return types.guards_for_types(guards, units, facts, ["repo", "path"], "guard", "a", "b", "exits", "refs", "unit_id", "start_pos", "end_pos", "ref").select("repo", "path", "guard", "unit_id", "ref")


@query("""with f as (select file_id, sha1(text) h, committed_at < timestamp '2025-12-01' as early, committed_at < timestamp '2026-03-01' as late from (select * from source_files qualify row_number() over (partition by file_id order by ingested_at desc) = 1)),
o as (select file_id, h from f where early or file_id % 11 = 0), n as (select case when file_id % 7 = 0 then file_id + 10000000 else file_id end as file_id, case when file_id % 5 = 0 then sha1(h) else h end as h from f where late and file_id % 13 <> 0),
b as (select coalesce(o.file_id, n.file_id) as file_id, o.h as oh, n.h as nh from o full join n on o.file_id = n.file_id), g as (select oh, min(file_id) old_path from b where nh is null group by 1)
select b.file_id, case when b.oh is null then case when g.old_path is not null then 'R100' else 'A' end when nh is null then 'D' else 'M' end as status, case when b.oh is null then g.old_path end as old_path from b left join g on g.oh = b.nh where b.oh is null or b.nh is null or b.oh <> b.nh""")
def change_source(spark, sf_dir):
    """Two snapshots of the files are made from one table: times part them, and keys of some are moved, since the table has no history."""
    files = latest(table(spark, sf_dir, "source_files").select("file_id", "ingested_at", "committed_at", F.sha1("text").alias("h")), "file_id", "ingested_at")
    old = files.where("committed_at < timestamp '2025-12-01' or file_id % 11 = 0").select("file_id", "h")
    new = files.where("committed_at < timestamp '2026-03-01' and file_id % 13 <> 0").select(F.expr("case when file_id % 7 = 0 then file_id + 10000000 else file_id end").alias("file_id"), F.expr("case when file_id % 5 = 0 then sha1(h) else h end").alias("h"))
    return runs.change_source(old, new, "file_id", "h")


@query(f"""with p as (select repo || '/' || path as p, concat_ws(chr(0), repo || '/' || path, sha1(text)) as pair from {FILES_SQL}), d as (select substr(sha1(p), 1, 2) as part, sha1(string_agg(distinct pair, chr(10) order by pair)) as d from p group by 1)
select substr(sha1(coalesce(string_agg(part || ':' || d, chr(10) order by part || ':' || d), '') || chr(10) || '{{"rules":["a","b"],"version":2}}'), 1, 16) as manifest from d""")
def run_manifest(spark, sf_dir):
    files = _files(spark, sf_dir, F.concat_ws("/", "repo", "path").alias("place"), F.sha1("text").alias("digest"))
    return runs.manifest(files, "place", "digest", {"version": 2, "rules": ["a", "b"]})


@query("select distinct substr(sha1(path), 1, 16) as fragment, path as identity from unparsed_files where path is not null")
def baseline_fragments(spark, sf_dir):
    return runs.baseline_fragments(table(spark, sf_dir, "unparsed_files"), "path")


#: edges between files: from that of each scored pair's left unit to that of its right one
EDGES_SQL = f"""(select distinct a.repo || '/' || a.file_path as path, b.repo || '/' || b.file_path as resolved from scored_pairs p join {UNITS_SQL} a on a.unit_id = p.left_id join {UNITS_SQL} b on b.unit_id = p.right_id)"""


def _edges(spark, sf_dir):
    places = _units(spark, sf_dir, F.concat_ws("/", "repo", "file_path").alias("place"))
    pairs = table(spark, sf_dir, "scored_pairs").select("left_id", "right_id").distinct()
    left, right = places.select(F.col("unit_id").alias("left_id"), F.col("place").alias("path")), places.select(F.col("unit_id").alias("right_id"), F.col("place").alias("resolved"))
    return pairs.join(left, "left_id").join(right, "right_id").select("path", "resolved").distinct()


EXPORTS_SQL = f"(select repo || '/' || file_path as path, array_to_string(list_sort(list(name)), ',') as names from {UNITS_SQL} where exported and name is not null {{0}} group by 1)"


@query(f"""with c as (select distinct repo || '/' || file_path as path from {UNITS_SQL} where scanned_at >= timestamp '2026-05-01'), w as {EXPORTS_SQL.format("and scanned_at < timestamp '2026-05-01'")}, n as {EXPORTS_SQL.format('')},
m as (select c.path from c left join w on w.path = c.path left join n on n.path = c.path where coalesce(w.names, '') <> coalesce(n.names, '')), e as (select path, resolved as target from {EDGES_SQL})
select path from c union select e.path from e where target in (select path from m)""")
def affected_files(spark, sf_dir):
    units = _units(spark, sf_dir, F.concat_ws("/", "repo", "file_path").alias("path"), "name", "exported").withColumn("late", F.col("scanned_at") >= F.lit("2026-05-01").cast("timestamp"))
    named = units.where("exported and name is not null")
    before, after = named.where("not late").groupBy("path").agg(F.collect_list("name").alias("names")), named.groupBy("path").agg(F.collect_list("name").alias("names"))
    edges = _edges(spark, sf_dir).select(F.col("path").alias("importer"), F.col("resolved").alias("target"))
    return runs.affected(units.where("late"), edges, before, after, "path", "importer", "target", "names")


MODULE3_SQL = MODULE_SQL.replace("[1:2]", "[1:3]")
GRAPH_SQL = f"(select {MODULE3_SQL} as from_module, {MODULE3_SQL.replace('path', 'resolved')} as to_module from {EDGES_SQL})"


def _module_graph(spark, sf_dir):
    return roles.module_graph(_edges(spark, sf_dir), paths.module_of(F.col("path"), 3), paths.module_of(F.col("resolved"), 3), [])


@query(f"select from_module, to_module, count(*)::bigint as edges from {GRAPH_SQL} where from_module <> to_module group by 1, 2")
def module_graph(spark, sf_dir):
    return _module_graph(spark, sf_dir)


ROLES = {"lib": ("domain", 1), "src": ("application", 2), "packages": ("interface", 3), "apps": ("interface", 3), "server": ("transport", 4)}
ROLES_SQL = f"(select distinct repo, {MODULE3_SQL} as module, case string_split(path, '/')[3] when 'lib' then 'domain' when 'src' then 'application' when 'packages' then 'interface' when 'apps' then 'interface' when 'server' then 'transport' end as role, case string_split(path, '/')[3] when 'lib' then 1 when 'src' then 2 when 'packages' then 3 when 'apps' then 3 when 'server' then 4 end as rank from (select repo, repo || '/' || path as path from {FILES_SQL}))"


def _roles(spark, sf_dir):
    top = F.split_part("place", F.lit("/"), F.lit(3))
    named, rank = F.create_map(*[F.lit(x) for k, (r, _) in ROLES.items() for x in (k, r)]), F.create_map(*[F.lit(x) for k, (_, n) in ROLES.items() for x in (k, n)])
    files = _files(spark, sf_dir, "repo", F.concat_ws("/", "repo", "path").alias("place"))
    return files.select("repo", paths.module_of(F.col("place"), 3).alias("module"), F.try_element_at(named, top).alias("role"), F.try_element_at(rank, top).alias("rank")).distinct()


@query(f"""with g as (select distinct from_module, to_module from {GRAPH_SQL} where from_module <> to_module), r as {ROLES_SQL},
m as (select a.role as from_role, b.role as to_role, g.from_module, g.to_module from g join r a on a.module = g.from_module join r b on b.module = g.to_module where a.role <> b.role and b.rank > a.rank and not starts_with(from_module, to_module || '/') and not starts_with(to_module, from_module || '/'))
select from_role, to_role, arg_min(from_module, from_module || chr(0) || to_module) as from_module, arg_min(to_module, from_module || chr(0) || to_module) as to_module from m group by 1, 2""")
def upward_roles(spark, sf_dir):
    return roles.upward_roles(_module_graph(spark, sf_dir), _roles(spark, sf_dir).drop("repo").distinct(), [])


@query(f"with r as {ROLES_SQL} select distinct repo, role from r where rank = (select max(rank) from r x where x.repo = r.repo)")
def edge_roles(spark, sf_dir):
    return roles.edge_roles(_roles(spark, sf_dir), "role", "rank", ["repo"])


@query(rf"""with u as (select repo, regexp_extract(file_path, '^(.*)/[^/]*$', 1) dir, name, kind, type_refs from {UNITS_SQL}), p as (select repo, dir, list_sort(list_distinct(list(t))) promised from (select repo, dir, unnest(type_refs) t from u) where t <> '' group by 1, 2),
d as (select repo, dir, list_sort(list_distinct(list(name))) declared from u where kind <> 'function' and name is not null group by 1, 2), b as (select p.repo, p.dir, p.promised, d.declared, regexp_extract(p.dir, '([^/]*)$', 1) as pre from p join d on d.repo = p.repo and d.dir = p.dir)
select repo, dir, array_to_string(list_filter(promised, lambda k: k <> 'Provider' and not regexp_matches(k, '^use[A-Z]') and len(list_filter(declared, lambda n: n = k or n = pre || k or ends_with(n, k))) = 0), ',') as missing, array_to_string(list_filter(declared, lambda n: len(list_filter(promised, lambda k: n = k or n = pre || k or ends_with(n, k))) = 0), ',') as orphans from b""")
def missing_and_orphans(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", paths.directory(F.col("file_path")).alias("dir"), "name", "kind", "type_refs")
    promised = units.select("repo", "dir", F.explode("type_refs").alias("t")).where("t <> ''").groupBy("repo", "dir").agg(F.array_sort(F.collect_set("t")).alias("promised"))
    declared = units.where("kind <> 'function' and name is not null").groupBy("repo", "dir").agg(F.array_sort(F.collect_set("name")).alias("declared"))
    both = promised.join(declared, ["repo", "dir"]).withColumn("prefix", paths.base_name(F.col("dir")))
    found = roles.missing_and_orphans(both, "promised", "declared", "prefix")
    return found.select("repo", "dir", F.array_join("missing", ",").alias("missing"), F.array_join("orphans", ",").alias("orphans"))


PAIRS_SQL = f"(select p.pair_id, p.rule_id, p.score, a.repo as la, b.repo as lb, a.kind as ka, a.file_path as fa, b.file_path as fb from scored_pairs p join {UNITS_SQL} a on a.unit_id = p.left_id join {UNITS_SQL} b on b.unit_id = p.right_id)"


@query(f"select pair_id, case when la = lb then 'keep one' when ka = 'interface' then 'expected' when ka = 'type' then 'share' else 'hoist' end as prescription from {PAIRS_SQL}")
def prescriptions(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "kind")
    pairs = table(spark, sf_dir, "scored_pairs").select("pair_id", "left_id", "right_id")
    both = pairs.join(units.select(F.col("unit_id").alias("left_id"), F.col("repo").alias("la"), "kind"), "left_id").join(units.select(F.col("unit_id").alias("right_id"), F.col("repo").alias("lb")), "right_id")
    role = F.when(F.col("kind") == "interface", "wire_contract").when(F.col("kind") == "type", "domain_concept").otherwise("none")
    relation = F.when(F.col("la") == F.col("lb"), "same_package").otherwise("apart")
    return both.select("pair_id", judging.prescription(role, relation).alias("prescription"))


@query(f"select shape_hash, count(*)::bigint as members, count(distinct repo || '/' || file_path)::bigint as files, max(len(tokens))::int as overlap, bool_or(field_types is not null) as typed from {UNITS_SQL} group by 1")
def cluster_facts(spark, sf_dir):
    units = _units(spark, sf_dir, "shape_hash", F.concat_ws("/", "repo", "file_path").alias("file"), F.size("tokens").alias("overlap"), F.col("field_types").isNotNull().alias("typed"))
    return judging.cluster_facts(units, "shape_hash", "file", "overlap", "typed")


@query(f"""with r as (select shape_hash, name, row_number() over (partition by shape_hash order by (case when scanned_at >= timestamp '2026-05-01' then 0 else 1 end), repo, file_path, start_pos, unit_id) k from {UNITS_SQL})
select shape_hash, coalesce(array_to_string(list(name order by k), ','), '') as names from r where k <= 12 group by 1""")
def described_members(spark, sf_dir):
    units = _units(spark, sf_dir, "shape_hash", "repo", "file_path", "start_pos", "name").withColumn("changed", F.col("scanned_at") >= F.lit("2026-05-01").cast("timestamp"))
    return judging.described_members(units, "shape_hash", ["repo", "file_path", "start_pos", "unit_id"], "name", "changed").select("shape_hash", F.array_join("names", ",").alias("names"))


@query(rf"""with e as (select kv.key as field, regexp_replace(kv.value, '^\??: ', '') as t, repo || '/' || file_path as file, start_pos as line from (select repo, file_path, start_pos, unnest(map_entries(field_types)) kv from {UNITS_SQL} where field_types is not null))
select field, count(distinct t)::bigint as n_types, count(distinct (file, line))::bigint as places, min({{'f': file, 'l': line}}).f as file, min({{'f': file, 'l': line}}).l as line from e group by 1 having count(distinct t) > 1""")
def anchored_drift(spark, sf_dir):
    units = _units(spark, sf_dir, F.concat_ws("/", "repo", "file_path").alias("file"), F.col("start_pos").alias("line"), "field_types")
    each = units.select("file", "line", F.explode("field_types").alias("field", "t")).withColumn("t", F.regexp_replace("t", r"^\??: ", ""))
    return judging.anchored_drift(each, "field", "t", "file", "line")


@query("select rule_id, count(*)::bigint as requests, count(*) filter (score is null)::bigint as replayed, count(*) filter (score is not null)::bigint as calls, coalesce(sum(pair_id % 1000) filter (score is not null), 0)::bigint as tokens from scored_pairs group by 1")
def run_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_pairs").select("rule_id", F.col("score").isNull().alias("replayed"), (F.col("pair_id") % 1000).alias("tokens"))
    return judging.run_totals(rows, "replayed", "tokens", ["rule_id"])


@query("""with d as (select pair_id, case when score is null or isnan(score) then 'unreadable' when score < 0.5 then 'gate' else 'budget' end as stage, left_id is null as outside, rule_id = 'close-names' as over from scored_pairs)
select pair_id, case when stage = 'unreadable' and over then 'budget' else stage end as stage from d where not (stage = 'unreadable' and outside)""")
def settled_drops(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_pairs")
    stage = F.when(F.col("score").isNull() | F.isnan("score"), "unreadable").when(F.col("score") < 0.5, "gate").otherwise("budget")
    drops = rows.select("pair_id", stage.alias("stage"))
    return judging.settled_drops(drops, "pair_id", "stage", rows.where("left_id is null").select("pair_id"), rows.where("rule_id = 'close-names'").select("pair_id"))


@query(f"""with a as (select left_id as unit_id, max(score) as p from scored_pairs where score between 0 and 1 group by 1) select u.unit_id, round(coalesce(a.p, 0), 6) as confidence, 0.75::double as exists from {UNITS_SQL} u left join a on a.unit_id = u.unit_id where u.exported order by coalesce(a.p, 0) desc, u.unit_id limit 10""")
def relevance(spark, sf_dir):
    answers = table(spark, sf_dir, "scored_pairs").where("score between 0 and 1 and left_id is not null").groupBy(F.col("left_id").alias("unit_id")).agg(F.max("score").alias("p"))
    ranked = judging.relevance(_units(spark, sf_dir, "exported").where("exported"), answers, "unit_id", "p", 0.75)
    return ranked.select("unit_id", F.round("confidence", 6).alias("confidence"), "exists")


@query(f"with c as (select distinct repo from {UNITS_SQL} where scanned_at >= timestamp '2026-05-01') select unit_id from {UNITS_SQL} where repo in (select repo from c) and exported")
def scoped_run(spark, sf_dir):
    units = _units(spark, sf_dir, "repo", "exported")
    changed = units.where(F.col("scanned_at") >= F.lit("2026-05-01").cast("timestamp")).select("repo")
    planned = judging.scoped_plans(units, "repo", changed)
    return judging.scoped_findings(planned.where("exported"), "repo", changed).select("unit_id")
