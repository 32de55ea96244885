"""Queries over documents and other texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import hashing, paths, text
from strandline.operators import packing, report, similarity
from strandline.plans.registry import query
from strandline.runtime import table

TOKEN_SQL = r"regexp_extract_all(text, '[A-Za-z0-9_$]+|[^ \t\n\r\f\x0BA-Za-z0-9_$]')"
SHINGLE_SQL = "list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || chr(0) || t[i + 1]))"


@query(f"select doc_id, len({TOKEN_SQL})::bigint as n_tokens, len(list_distinct({TOKEN_SQL}))::bigint as n_distinct from documents where text is not null")
def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("select substr(sha1(text), 1, 16) as digest, count(*)::bigint as members, min(doc_id) as first_doc, count(distinct source)::bigint as sources from documents where text is not null group by 1 having count(*) > 1")
def exact_duplicate_clusters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", hashing.sha16(F.col("text")).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("members"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources")).where("members > 1")


NEAR_SQL = f"""d as (select doc_id, {TOKEN_SQL} t from documents where text is not null), q as (select doc_id, list_sort({SHINGLE_SQL}) s from d where len(t) >= 40), c as (select s, min(doc_id) as class_id, count(*) as members from q group by 1),
e as (select class_id, unnest(s) g, len(s) n from c),
p as (select a.class_id left_id, b.class_id right_id, count(*) k, any_value(a.n) na, any_value(b.n) nb from e a join e b on a.g = b.g and a.class_id < b.class_id and a.n >= 0.8 * b.n - 1e-9 and b.n >= 0.8 * a.n - 1e-9 group by 1, 2),
l as (select left_id, right_id, round(k / (na + nb - k), 6) as likeness from p where k >= 0.8 * (na + nb - k) - 1e-9)"""


def _pair_sets(spark, sf_dir):
    return similarity.shingle_sets(table(spark, sf_dir, "documents"), "doc_id", "text", 40)


@query(f"with {NEAR_SQL} select left_id, right_id, likeness from l")
def near_duplicate_pairs(spark, sf_dir):
    return similarity.similar_class_pairs(_pair_sets(spark, sf_dir), "doc_id", "shingles", 0.8)


@query(f"with {NEAR_SQL}, n as (select class_id, count(*) as links from (select left_id as class_id from l union all select right_id from l) group by 1) select q.doc_id, c.class_id, c.members::bigint as members, coalesce(n.links, 0)::bigint as links from q join c on c.s = q.s left join n on n.class_id = c.class_id")
def near_duplicate_classes(spark, sf_dir):
    return similarity.similar_classes(_pair_sets(spark, sf_dir), "doc_id", "shingles", 0.8).select("doc_id", "class_id", "members", F.col("links").cast("long").alias("links"))


@query(f"""with d as (select doc_id, {TOKEN_SQL} t from documents where text is not null), e as (select unnest({SHINGLE_SQL}) g from d)
select replace(g, chr(0), ' ') as gram, count(*)::bigint as records from e group by g having count(*) >= 5""")
def gram_document_frequency(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.shingles(text.tokens(F.col("text"))).alias("s"))
    return similarity.gram_frequency(docs, "doc_id", "s").where("records >= 5").select(F.replace("gram", F.lit("\0"), F.lit(" ")).alias("gram"), "records")


@query("""with w as (select doc_id, unnest(range(1, len(p) + 1)) i, p from (select doc_id, string_split(text, ' ') p from documents where text is not null)),
x as (select doc_id, i, p[i] word, case when i > 1 then p[i - 1] end prev from w)
select regexp_extract(word, '^[A-Z][a-z]{3,}') as term, count(*)::bigint as mentions from x where regexp_matches(word, '^[A-Z][a-z]{3,}') and prev is not null and prev <> '' and not regexp_matches(prev, '[.!?:\n]$') group by 1 having count(*) >= 3""")
def word_drift(spark, sf_dir):
    words = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "word"))
    from strandline.operators.sequences import beside

    seen = beside(words, "doc_id", ["at"], "word").where(F.col("word").rlike("^[A-Z][a-z]{3,}") & F.col("before").isNotNull() & (F.col("before") != "") & ~F.col("before").rlike(r"[.!?:\n]\z"))
    return seen.groupBy(F.regexp_extract("word", "^[A-Z][a-z]{3,}", 0).alias("term")).agg(F.count("*").alias("mentions")).where("mentions >= 3")


@query("""with l as (select doc_id, i, string_split(text, chr(10)) as ls from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) t(i) where text is not null),
x as (select doc_id, i, ls[i] as line, coalesce(sum(length(ls[i]) + 1) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as start from l),
p as (select doc_id, i, start, j, string_split(line, 'the') as ps from x, unnest(range(1, len(string_split(line, 'the')) + 1)) t(j) where contains(line, 'the')),
c as (select doc_id, i, start, j, sum(length(ps[j]) + 3) over (partition by doc_id, i order by j rows between unbounded preceding and 1 preceding) - 3 as k from p)
select doc_id, (start + k)::bigint as at, i::bigint as line, (k + 1)::bigint as col from c where j > 1""")
def offset_positions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return text.occurrences(docs, ["doc_id"], "text", "the").select("doc_id", F.col("at").cast("long").alias("at"), "line", F.col("col").cast("long").alias("col"))


@query(r"""select file_id, max(len(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '^[ \t\r]*$') and not regexp_matches(x, '^[ \t]*(?://|/\*|\*)') and not regexp_matches(x, '^[ \t]*import\b'))))::bigint as code_lines from source_files group by 1""")
def code_line_counts(spark, sf_dir):
    files = table(spark, sf_dir, "source_files").select("file_id", text.code_lines(F.col("text")).cast("long").alias("n"))
    return files.groupBy("file_id").agg(F.max("n").alias("code_lines"))


@query(r"""select file_id, max(length(text))::bigint as length, max(len(regexp_replace(text, '(?s)(?:^|\n)import[^;\n]*;', '', 'g')))::bigint as outside from source_files group by 1""")
def import_regions(spark, sf_dir):
    files = table(spark, sf_dir, "source_files").select("file_id", "text", text.blank_outside(F.col("text"), r"(?:^|\n)import[^;\n]*;").alias("kept"))
    sizes = files.select("file_id", F.length("kept").alias("length"), F.length(F.regexp_replace("text", r"(?:^|\n)import[^;\n]*;", "")).alias("outside"))
    return sizes.groupBy("file_id").agg(F.max("length").cast("long").alias("length"), F.max("outside").cast("long").alias("outside"))


@query("""with q as (select unnest(['nightly', 'job', 'copies', 'crash', 'view', 'field']) w)
select doc_id, count(*)::int as hits from documents, q where text is not null and contains(lower(concat_ws(' ', doc_path, text)), w) group by 1 order by hits desc, doc_id limit 200""")
def keyword_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return report.keyword_search(docs, "nightly job copies a crash of view or field", ["doc_path", "text"], "doc_id")


@query("""with k as (select lower(trim(source)) as src, doc_id, n_chars from documents where source is not null and n_chars is not null),
r as (select *, row_number() over (partition by src order by doc_id) n, sum(n_chars) over (partition by src order by doc_id rows unbounded preceding) s from k)
select src, doc_id, n_chars from r where n = 1 or s <= 20000""")
def fit_to_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source is not null and n_chars is not null").select(F.lower(F.trim("source")).alias("src"), "doc_id", "n_chars")
    return packing.fit_to_budget(docs, ["src"], ["doc_id"], "n_chars", 20000)


@query("""with recursive k as (select src, doc_id, n_chars::double c, row_number() over (partition by src order by doc_id) n from (select distinct repo as src, doc_id, n_chars from documents where repo is not null and n_chars is not null)),
r as (select src, doc_id, n, c as used, 0 as chunk from k where n = 1 union all
select k.src, k.doc_id, k.n, case when r.used + k.c > 4000 then k.c else r.used + k.c end, case when r.used + k.c > 4000 then r.chunk + 1 else r.chunk end from r join k on k.src = r.src and k.n = r.n + 1)
select src, doc_id, chunk::int as chunk from r""")
def packed_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("repo is not null and n_chars is not null").select(F.col("repo").alias("src"), "doc_id", "n_chars")
    return packing.next_fit(docs, "src", ["doc_id"], "doc_id", "n_chars", 4000)


@query("""with recursive k as (select src, doc_id, n_chars::double c, row_number() over (partition by src order by doc_id) n from (select repo as src, doc_id, n_chars from documents where repo is not null and n_chars is not null)),
r as (select src, doc_id, n, case when c <= 4000 then c else 0 end as used, c <= 4000 as taken from k where n = 1 union all
select k.src, k.doc_id, k.n, case when r.used + k.c <= 4000 then r.used + k.c else r.used end, r.used + k.c <= 4000 from r join k on k.src = r.src and k.n = r.n + 1)
select src, doc_id, taken from r""")
def budget_skip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("repo is not null and n_chars is not null").select(F.col("repo").alias("src"), "doc_id", "n_chars")
    return packing.greedy_skip(docs, "src", ["doc_id"], "doc_id", "n_chars", 4000)


@query("""with r as (select doc_id, repo, row_number() over (partition by repo order by n_chars desc nulls last, doc_id) n from documents where repo is not null)
select doc_id, repo, case when n <= 5 then 'kept' else 'budget' end as state from r""")
def budget_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("repo is not null")
    return packing.first_k(docs, ["repo"], [F.col("n_chars").desc_nulls_last(), "doc_id"], 5).select("doc_id", "repo", "state")


@query("select doc_id, (length(text) <= 1500) as short, coalesce(n_chars, length(text))::bigint as size from documents where text is not null and length(text) <= 1500")
def short_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null and length(text) <= 1500")
    return docs.select("doc_id", F.lit(True).alias("short"), F.coalesce("n_chars", F.length("text")).cast("long").alias("size"))


@query("""select regexp_extract(doc_path, '(\\.[^./]+)$', 1) as extension, count(*)::bigint as files from documents where doc_path is not null group by 1""".replace("\\\\", "\\"))
def extension_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("doc_path is not null")
    return docs.groupBy(paths.extension(F.col("doc_path")).alias("extension")).agg(F.count("*").alias("files")).orderBy(F.col("files").desc(), "extension")


@query("""select doc_id, '{"a":' || doc_id || ',"b":["x",' || coalesce(n_chars, 0) || ']}' as canonical, 'a' || substr(sha1('{"a":' || doc_id || ',"b":["x",' || coalesce(n_chars, 0) || ']}'), 1, 16) as fact_id from documents""")
def canonical_facts(spark, sf_dir):
    raw = F.concat(F.lit('{ "b" : ["x", '), F.coalesce("n_chars", F.lit(0)).cast("string"), F.lit('], "a": '), F.col("doc_id").cast("string"), F.lit(" }"))
    made = table(spark, sf_dir, "documents").select("doc_id", hashing.canonical_json(raw).alias("canonical"))
    return made.select("doc_id", "canonical", hashing.fact_id(F.col("canonical")).alias("fact_id"))


@query("""select f.ext as ext, count(*)::bigint as documents, 'doc ' || f.ext as label from (select coalesce(nullif(regexp_extract(doc_path, '[^/]*$'), ''), '-') as base, coalesce(nullif(regexp_extract(doc_path, '^([^/]*)/', 1), ''), '-') as ext from documents) f group by f.ext""")
def path_heads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.coalesce(F.nullif(F.regexp_extract("doc_path", "^([^/]*)/", 1), F.lit("")), F.lit("-")).alias("ext"))
    return docs.groupBy("ext").agg(F.count("*").alias("documents")).select("ext", "documents", report.fill("doc {{ext}}", ext=F.col("ext")).alias("label"))


