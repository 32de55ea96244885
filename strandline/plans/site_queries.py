"""Queries over sites in texts: calls, literals, guards, skips and comments of declarations and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import paths, text
from strandline.operators import imports, sites
from strandline.plans.code_queries import FILES_SQL, IMPORTS_SQL, UNITS_SQL, _files, _imports, _units
from strandline.plans.registry import query

CALL = r"([A-Za-z_$][\w$]*)\("
CALLS_SQL = rf"(select repo, file_path, unit_id, unnest(list_distinct(regexp_extract_all(text, '{CALL}', 1))) as name from {UNITS_SQL} where kind = 'function')"


def _calls(spark, sf_dir):
    """(repo, file, unit_id, name) of the different names each function calls."""
    units = _units(spark, sf_dir, "kind", F.concat_ws("/", "repo", "file_path").alias("file"), "text").where("kind = 'function'")
    return units.select("file", "unit_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(CALL), F.lit(1)))).alias("name"))


# what a clause of an import takes, as in imports.imported_names, for the clauses that have no default beside a brace
CLAUSE_SQL = r"""(select file_id, repo, path, specifier, regexp_extract(s, '(?m)^import[ \t]+([^;''"]*)from', 1) as clause from (select file_id, repo, path, unnest(regexp_extract_all(text, '(?m)^import[ \t]+([^;''"]*)from[ \t]+[''"]([^''"\n]+)[''"]')) s, regexp_extract(s, '(?m)^import[ \t]+([^;''"]*)from[ \t]+[''"]([^''"\n]+)[''"]', 2) as specifier from """ + FILES_SQL + "))"


@query(rf"""with c as (select repo || '/' || path as file, specifier, regexp_replace(trim(clause), '^type[ \t]+', '') as clause from {CLAUSE_SQL}),
n as (select file, specifier, unnest(list_concat(case when regexp_matches(clause, '^[\w$]+') then ['default'] else [] end, case when regexp_matches(clause, '\*\s*as\b') then ['*'] else [] end, list_transform(string_split(regexp_extract(clause, '\{{([^}}]*)\}}', 1), ','), lambda x: regexp_extract(trim(regexp_replace(x, '^\s*type\s+', '')), '^([\w$]+)', 1)))) as name from c)
select specifier, name, count(distinct file)::bigint as importers from n where name <> '' group by 1, 2""")
def importers_of_name(spark, sf_dir):
    used = _imports(spark, sf_dir).select(F.concat_ws("/", "repo", "path").alias("file"), "specifier", imports.imported_names(F.col("clause")).alias("names"))
    return imports.importers_of_name(used, "specifier", "names", "file")


@query(rf"select unit_id, regexp_extract(substr(text, 1, length(regexp_extract(text, '^(?:\s|//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)*'))), '(//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/)\s*$', 1) as comment from {UNITS_SQL}")
def preceding_comments(spark, sf_dir):
    """The comment directly above each declaration's code."""
    head = F.regexp_extract("text", r"^(?:\s|//[^\n]*|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/)*+", 0)
    return _units(spark, sf_dir, "text").select("unit_id", text.preceding_comment(F.col("text"), F.length(head)).alias("comment"))


@query(rf"""with n as (select unit_id, repo || '/' || file_path || '#this.' || coalesce(name, '') as id, file_path from {UNITS_SQL})
select unit_id, regexp_extract(file_path, '[^/]*$') || ':this.' || regexp_extract(id, '#this\.(.*)$', 1) as shown, regexp_extract(id, '[^.#]*$') as tail, regexp_matches(file_path, '(?:^|/)(?:tests?|__tests__|specs?)(?:/|$)|\.(?:spec|test)\.[cm]?[jt]sx?$') as test from n""")
def display_names(spark, sf_dir):
    units = _units(spark, sf_dir, "file_path", F.concat(F.concat_ws("/", "repo", "file_path"), F.lit("#this."), F.coalesce("name", F.lit(""))).alias("id"))
    return units.select("unit_id", paths.display_name(F.col("id")).alias("shown"), paths.method_tail(F.col("id")).alias("tail"), paths.is_test_path(F.col("file_path")).alias("test"))


@query(rf"with c as (select unit_id, unnest(regexp_extract_all(text, '[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*\([^()]*\)){{1,}}')) as chain from {UNITS_SQL}) select unit_id, chain, count(*)::bigint as sites from c group by 1, 2")
def call_chains(spark, sf_dir):
    each = _units(spark, sf_dir, "text").select("unit_id", F.explode(text.call_chains(F.col("text"), 1)).alias("chain"))
    return each.groupBy("unit_id", "chain").agg(F.count("*").alias("sites"))


@query(None)
def normalised_groups(spark, sf_dir):
    """Declarations that are equal but for comments, blanks and the names they bind themselves."""
    units = _units(spark, sf_dir, "kind", "text").where("kind = 'function'").select("unit_id", F.sha1(text.normalise(F.col("text"))).alias("shape"))
    return units.groupBy("shape").agg(F.count("*").alias("members"), F.min("unit_id").alias("first_unit")).where("members > 1")


FIELDS_SQL = rf"(select repo || '/' || file_path as file, coalesce(name, '?') as owner, kind, kv.key as field, regexp_replace(kv.value, '^\??: ', '') as t from (select repo, file_path, name, kind, unnest(map_entries(field_types)) kv from {UNITS_SQL} where field_types is not null))"


def _fields(spark, sf_dir):
    units = _units(spark, sf_dir, F.concat_ws("/", "repo", "file_path").alias("file"), F.coalesce("name", F.lit("?")).alias("owner"), "kind", "field_types")
    return units.select("file", "owner", "kind", F.explode("field_types").alias("field", "t")).withColumn("t", F.regexp_replace("t", r"^\??: ", ""))


@query(f"""with f as {FIELDS_SQL}, s as (select distinct file, field from f where kind = 'interface' and t not like '%number%'), d as (select distinct file, owner, field from f where t like '%number%'),
r as (select s.field, s.file, d.file as partner_file, d.owner as partner_name, row_number() over (partition by s.field, s.file order by (d.file = s.file), d.file, d.owner) k from s join d on d.field = s.field)
select field, file, partner_file, partner_name from r where k = 1""")
def preferred_partners(spark, sf_dir):
    """Fields that an interface doesn't hold to be numbers, with a declaration that does, best one of another file."""
    fields = _fields(spark, sf_dir)
    rows = fields.where("kind = 'interface' and not t like '%number%'").select("field", "file").distinct()
    partners = fields.where("t like '%number%'").select("field", "file", F.col("owner").alias("name"))
    return sites.preferred_partner(rows, partners, "field", "file", "name").select("field", "file", "partner_file", "partner_name")


LITERAL = r"'([^'\\\n]*(?:\\.[^'\\\n]*)*)'"


@query(rf"""with c as (select distinct name, repo || '/' || file_path as file from {CALLS_SQL}), a as (select name, count(*) as n from c group by 1),
u as (select unit_id, repo || '/' || file_path as file, name, regexp_extract_all(text, '{LITERAL.replace("'", "''")}', 1) as ls from {UNITS_SQL} where kind = 'function' and exported and name is not null and length(text) <= 1500),
w as (select u.unit_id, a.n - (case when exists (select 1 from c where c.name = u.name and c.file = u.file) then 1 else 0 end) as callers, list_filter(ls, lambda x: length(x) >= 4 and regexp_matches(x, '[a-z]'))[1:3] as ls from u join a on a.name = u.name)
select unit_id, unnest(ls) as literal, callers::bigint as callers from w where callers >= 2""")
def caller_literals(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", "exported", F.concat_ws("/", "repo", "file_path").alias("file"), "name", "text").where("kind = 'function' and exported and name is not null and length(text) <= 1500")
    return sites.caller_literals(units.select("unit_id", "file", "name", text.string_literals(F.col("text")).alias("ls")), _calls(spark, sf_dir), "unit_id", "file", "name", "ls")


RETURN_TYPE = r"\): ([A-Za-z][\w$.<>\[\] |]*[\w>\]]) \{"


@query(rf"""with c as (select distinct name, repo || '/' || file_path as file from {CALLS_SQL}), u as (select unit_id, repo || '/' || file_path as file, name, contains(text, '${{') as builds, list_filter([regexp_extract(text, '{RETURN_TYPE}', 1)], lambda x: x <> '') as ts from {UNITS_SQL} where kind = 'function'),
h as (select name from c group by 1 having count(*) >= 2 intersect select name from u where name is not null and (len(ts) = 0 or trim(ts[1]) in ('string', 'Promise<string>') or len(list_filter(string_split(ts[1], '|'), lambda m: trim(m) = 'string')) > 0)),
p as (select file, count(*) as helpers from c where name in (select name from h) group by 1)
select u.unit_id, p.helpers::bigint as helpers from u join p on p.file = u.file where u.builds and (u.name is null or u.name not in (select name from h))""")
def strings_beside_helpers(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", F.concat_ws("/", "repo", "file_path").alias("file"), "name", "text").where("kind = 'function'")
    units = units.select("unit_id", "file", "name", F.contains("text", F.lit("${")).alias("builds"), F.filter(F.array(F.regexp_extract("text", RETURN_TYPE, 1)), lambda x: x != "").alias("ts"))
    return sites.strings_beside_helpers(units, _calls(spark, sf_dir), "unit_id", "file", "name", "builds", "ts")


OPTIONAL = r"function [\w$]+\((?:[\w$]+(?:\?:[^,()]*| = [^,()]*)(?:, )?)+\)"
DATA = r"(?:store|ledger|bucket|packet)$"


@query(rf"""with f as (select distinct name, repo || '/' || file_path as file from {UNITS_SQL} where kind = 'function' and name is not null and regexp_matches(text, '{OPTIONAL}')), d as (select distinct repo || '/' || path as file from {IMPORTS_SQL} where regexp_matches(specifier, '{DATA}')),
r as (select f.name, f.file as callee_file from f where f.file in (select file from d)) select distinct c.unit_id, c.name, r.callee_file from {CALLS_SQL} c join r on r.name = c.name""")
def unbounded_reads(spark, sf_dir):
    functions = _units(spark, sf_dir, "kind", F.concat_ws("/", "repo", "file_path").alias("file"), "name", F.col("text").rlike(OPTIONAL).alias("all_optional")).where("kind = 'function' and name is not null")
    data = _imports(spark, sf_dir).where(F.col("specifier").rlike(DATA)).select(F.concat_ws("/", "repo", "path").alias("file"))
    return sites.unbounded_reads(_calls(spark, sf_dir), functions, data, "unit_id", "name", "file")


COMPARED = r"return [^;\n]*(?:===|!==|<=|>=| < | > )"


@query(rf"""with u as (select unit_id, text, list_distinct(type_refs) d, type_refs from {UNITS_SQL} where kind = 'function' and regexp_matches(text, '{COMPARED}')), o as (select unit_id, text, t, min(i) as n from (select unit_id, text, unnest(type_refs) t, unnest(range(1, len(type_refs) + 1)) i from u) where t is not null group by 1, 2, 3),
b as (select owner as t, field from {FIELDS_SQL} where t = 'boolean'), m as (select o.unit_id, o.t as type, min(b.field) as flag, min(o.n) as n from o join b on b.t = o.t where not contains(o.text, b.field) group by 1, 2)
select unit_id, arg_min(type, n) as type, arg_min(flag, n) as flag from m group by 1""")
def inferred_flags(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", "text", "type_refs").where("kind = 'function'").withColumn("compares", F.col("text").rlike(COMPARED))
    fields = _fields(spark, sf_dir).where("t = 'boolean'").select("owner", "field")
    return sites.inferred_flags(units, fields, "unit_id", "text", "type_refs", "compares", "owner", "field")


@query(rf"""with u as (select unit_id, len(regexp_extract_all(text, '\bcontinue\b|\.filter\(')) as skips, list_filter([regexp_extract(text, '{RETURN_TYPE}', 1)], lambda x: x <> '') as ts from {UNITS_SQL} where kind = 'function' and exported and not is_test)
select unit_id, skips::int as skips from u where skips > 0 and (len(ts) = 0 or ts[1] not in ('void', 'undefined', 'null', 'boolean', 'bigint', 'symbol', 'never'))""")
def unaccounted_skips(spark, sf_dir):
    units = _units(spark, sf_dir, "kind", "exported", "is_test", F.size(F.regexp_extract_all("text", F.lit(r"\bcontinue\b|\.filter\("), F.lit(0))).alias("skips"), F.filter(F.array(F.regexp_extract("text", RETURN_TYPE, 1)), lambda x: x != "").alias("ts")).where("kind = 'function'")
    return sites.unaccounted_skips(units, "exported", "is_test", "skips", "ts").select("unit_id", "skips")


@query(rf"""select unit_id, case when regexp_matches(text, 'if \([^()\n]* === null\)[^{{}}]*\{{[^{{}}]*\b(?:throw|return)\b') then 'guard' else 'catch' end as shape from {UNITS_SQL} where kind = 'function' and (regexp_matches(text, 'if \([^()\n]* === null\)[^{{}}]*\{{[^{{}}]*\b(?:throw|return)\b') or regexp_matches(text, 'catch \(\w+\)[^{{}}]*\{{[^{{}}]*\b(?:throw|return)\b'))""")
def outage_shapes(spark, sf_dir):
    """In these tables no handler answers with a status, so what leaves a guard or a catch stands for it."""
    units = _units(spark, sf_dir, "kind", "text").where("kind = 'function'")
    return sites.outage_shapes(units, "text", r"if \([^()\n]* === null\)", r"catch \(\w+\)", r"\b(?:throw|return)\b", ["unit_id"])


@query(rf"""with e as (select repo, file_path as path, count(*) filter (exported)::bigint as exports from {UNITS_SQL} group by 1, 2), l as (select repo, path, len(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^[ \t\r]*$') and not regexp_matches(x, '^[ \t]*(?://|/\*|\*)') and not regexp_matches(x, '^[ \t]*import\b')))::bigint as lines from {FILES_SQL})
select repo, path, exports, lines from e join l using (repo, path) where exports >= 2 and lines / exports < 12""")
def shallow_files(spark, sf_dir):
    exports = _units(spark, sf_dir, "repo", F.col("file_path").alias("path"), "exported").groupBy("repo", "path").agg(F.count(F.when(F.col("exported"), 1)).alias("exports"))
    files = _files(spark, sf_dir, "repo", "path", "text").select("repo", "path", text.code_lines(F.col("text")).cast("long").alias("lines"))
    return sites.shallow_files(files.join(exports, ["repo", "path"]), "lines", "exports", 2, 12.0).select("repo", "path", "exports", "lines")


@query(rf"""with n as (select distinct specifier, repo || '/' || path as file, path from {IMPORTS_SQL}) select specifier, count(*)::bigint as users from n group by 1 having bool_and(regexp_matches(path, '(?:^|/)(?:tests?|__tests__|specs?)(?:/|$)|\.(?:spec|test)\.[cm]?[jt]sx?$'))""")
def used_by_tests_only(spark, sf_dir):
    used = _imports(spark, sf_dir).select("specifier", "repo", "path").distinct()
    return sites.only_such_users(used, ["specifier"], paths.is_test_path(F.col("path")))
