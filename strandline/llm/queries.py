"""The queries of the ten training-data problems over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.components import connected_components
from strandline.llm.cooccurrence import item_pairs
from strandline.llm.docpairs import documented_functions
from strandline.llm.encoding import encode_texts
from strandline.llm.handwritten import file_origins
from strandline.llm.mixture import mix_sources
from strandline.llm.neardup import near_duplicate_groups
from strandline.llm.parsecheck import parse_rates, parse_verdicts
from strandline.llm.setjoin import similar_set_pairs
from strandline.llm.subjects import subject_scores
from strandline.runtime import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "units").select("unit_id", "tokens", "scanned_at")
    return near_duplicate_groups(units, "unit_id", "tokens", "scanned_at", threshold=0.7)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_verdicts(table(spark, sf_dir, "source_files")).where("not valid").select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_rates(parse_verdicts(table(spark, sf_dir, "source_files")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_origins(table(spark, sf_dir, "source_files")).where("not handwritten").select("file_id")


def _field_names(fields):
    return F.array_distinct(F.transform(F.map_keys(fields), lambda k: F.replace(F.lower(k), F.lit("_"), F.lit(""))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "units").select("unit_id", "scanned_at", "type_refs", "field_types")
    named = F.filter("type_refs", lambda t: t.isNotNull() & (t != ""))
    sets = units.select("unit_id", "scanned_at", F.explode(F.array(F.struct(F.lit("type_refs").alias("field_name"), named.alias("members")), F.struct(F.lit("field_types").alias("field_name"), _field_names("field_types").alias("members")))).alias("s")).select("unit_id", "scanned_at", "s.*")
    pairs = similar_set_pairs(sets, "unit_id", "field_name", "members", "scanned_at", threshold=0.7, least=4)
    return pairs.select("field_name", "left_id", "right_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "units").select("unit_id", "scanned_at", _field_names("field_types").alias("items"))
    return item_pairs(units, "unit_id", "items", "scanned_at", least=6, lift=3.0).select("item_a", "item_b")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "units")).where("adjacent").select("unit_id")


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documented_functions(table(spark, sf_dir, "units")).drop("weight", "adjacent")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "scored_pairs").where("score between 0.7 and 1.0 and not isnan(score)")
    groups = connected_components(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))
    return groups.select(F.col("vertex").alias("unit_id"), "group_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k", keep=("doc_id",))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return subject_scores(documents, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")).select("doc_id", "subject")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}

_UNITS = "(select * from units qualify row_number() over (partition by unit_id order by scanned_at desc) = 1)"

ORACLE: dict[str, str] = {
    "p1_found": f"""with recursive s as (select unit_id, list_distinct(list_transform(range(1, len(tokens)), lambda i: tokens[i] || chr(0) || tokens[i + 1])) g from {_UNITS}),
e as (select unit_id, unnest(g) x, len(g) n from s), l as (select a.unit_id a, b.unit_id b from e a join e b on a.x = b.x and a.unit_id < b.unit_id and a.n >= 0.7 * b.n - 1e-9 and b.n >= 0.7 * a.n - 1e-9 group by 1, 2 having count(*) * 10 >= 7 * (any_value(a.n) + any_value(b.n) - count(*))),
u as (select a x, b y from l union select b, a from l), r as (select x, x as y from u union select r.x, u.y from r join u on u.x = r.y)
select x as unit_id, min(y) as group_id from r group by 1""",
    "p3_found": f"""with s as (select unit_id, 'field_types' as f, list_distinct(list_transform(map_keys(field_types), lambda k: replace(lower(k), '_', ''))) m from {_UNITS} where field_types is not null union all
select unit_id, 'type_refs', list_distinct(list_filter(type_refs, lambda t: t is not null and t <> '')) from {_UNITS} where type_refs is not null), e as (select f, unit_id, len(m) n, unnest(m) w from s where len(m) >= 4)
select a.f as field_name, a.unit_id as left_id, b.unit_id as right_id from e a join e b on a.f = b.f and a.w = b.w and a.unit_id < b.unit_id group by 1, 2, 3 having count(*) * 10 >= 7 * (any_value(a.n) + any_value(b.n) - count(*))""",
    "p5_found": f"""with i as (select distinct unit_id, replace(lower(k), '_', '') w from (select unit_id, unnest(map_keys(field_types)) k from {_UNITS})), n as (select w, count(*) k from i group by 1), t as (select count(distinct unit_id) c from i),
p as (select a.w a, b.w b, count(*) k from i a join i b on a.unit_id = b.unit_id and a.w < b.w group by 1, 2)
select p.a as item_a, p.b as item_b from p join n x on x.w = p.a join n y on y.w = p.b, t where p.k >= 6 and p.k * t.c >= 3 * x.k * y.k""",
    "p7_found": """with recursive l as (select distinct left_id a, right_id b from scored_pairs where left_id is not null and right_id is not null and left_id <> right_id and score >= 0.7 and score <= 1),
u as (select a x, b y from l union select b, a from l), r as (select x, x as y from u union select r.x, u.y from r join u on u.x = r.y)
select x as unit_id, min(y) as group_id from r group by 1""",
}
