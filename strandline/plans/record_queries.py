"""Queries over orders, events, pairs and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import answers, duplicates, fields, gates, graph, intervals, layers, report, scope, sequences, sites
from strandline.plans.registry import query
from strandline.runtime import table

CALLS_SQL = "(select user_id, list(event_type order by ts, event_id) s from events group by 1)"


def _event_sequences(spark, sf_dir):
    return sequences.sequences(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(f"select array_to_string(s, '|') as signature, count(*)::bigint as members, min(user_id) as first from {CALLS_SQL} where len(s) >= 4 group by 1 having count(*) > 1")
def equal_event_sequences(spark, sf_dir):
    return sequences.equal_sequences(_event_sequences(spark, sf_dir), "user_id", 4)


@query(None)
def shared_event_runs(spark, sf_dir):
    runs = sequences.shared_runs(_event_sequences(spark, sf_dir), "user_id", 7, None)
    return runs.select("left_id", "right_id", F.col("run").cast("long").alias("run"), F.col("left_at").cast("long").alias("left_at"), F.col("right_at").cast("long").alias("right_at"))


SESSIONS_SQL = "(select user_id * 100 + day(ts) as user_id, list(event_type order by ts, event_id) s from events group by 1)"


@query(f"""with q as {SESSIONS_SQL}, e as (select user_id, unnest(range(2, len(s) - 1)) i, s from q where len(s) > 3), x as (select user_id, len(s) - i + 1 as length, array_to_string(s[i:], '|') sig from e where len(s) - i + 1 >= 3),
w as (select array_to_string(s, '|') sig, min(user_id) whole_key from q where len(s) >= 3 group by 1), h as (select x.user_id, w.whole_key, x.length, row_number() over (partition by x.user_id order by length desc, whole_key) k from x join w using (sig) where x.user_id <> w.whole_key)
select user_id, whole_key, length::int as length from h where k = 1""")
def suffix_is_whole(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    sessions = sequences.sequences(events, "user_id", ["ts", "event_id"], "event_type")
    return sequences.suffix_is_whole(sessions, "user_id", 3)


@query(f"select array_to_string(s, '|') as signature, count(*)::bigint as members, min(user_id) as first from {SESSIONS_SQL} where len(s) >= 4 group by 1 having count(*) > 1")
def equal_session_sequences(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return sequences.equal_sequences(sequences.sequences(events, "user_id", ["ts", "event_id"], "event_type"), "user_id", 4)


@query("select user_id * 100 + day(ts) as session, count(*) filter (event_type = 'signup')::bigint as with_one from events group by 1 having count(*) filter (event_type = 'signup') > 0 and count(*) filter (event_type = 'purchase') = 0")
def paired_event_gap(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("session", F.col("user_id") * 100 + F.dayofmonth("ts"))
    return duplicates.paired_gap(events, "session", "event_type", "signup", "purchase")


@query("select event_id, event_type, lag(event_type) over w as before, lead(event_type) over w as after from events window w as (partition by user_id order by ts, event_id)")
def event_neighbours(spark, sf_dir):
    return sequences.beside(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "event_type", "before", "after")


@query("""with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select event_id mark, user_id, ts mark_ts from events where event_type = 'click')
select p.event_id, p.user_id, max(v.mark_ts) as mark_ts from p left join v on v.user_id = p.user_id and v.mark_ts <= p.ts group by 1, 2""")
def last_click_before_purchase(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    marks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("mark"), F.col("ts").alias("mark_ts"))
    return intervals.nearest_before(points, marks, ["user_id"], "event_id", "ts", "mark", "mark_ts").select("event_id", "user_id", "mark_ts")


@query("""with s as (select o_orderkey, o_custkey, o_orderdate a, o_orderdate + interval 60 day b from orders)
select l.l_orderkey, l.l_linenumber, s.o_custkey from lineitem l join s on s.o_orderkey = l.l_orderkey where l.l_shipdate >= s.a and l.l_shipdate < s.b""")
def interval_containment(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("interval 60 days")).alias("b"))
    sites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return intervals.contained(sites, spans, ["l_orderkey"], "l_shipdate", "a", "b").select("l_orderkey", "l_linenumber", "o_custkey")


@query("select l_partkey, count(distinct l_suppkey)::bigint as sources from lineitem group by 1 having count(distinct l_suppkey) >= 12")
def reverse_index_reach(spark, sf_dir):
    return duplicates.reach(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey", 12)


@query("""select o_custkey, count(*)::bigint as orders, round(max(o_totalprice), 2) as dearest from orders group by 1 having count(*) >= 5 and count(distinct o_orderpriority) < 5""")
def export_ratio(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 2).alias("dearest"), F.count_distinct("o_orderpriority").alias("kinds"))
    return per.where("orders >= 5 and kinds < 5").drop("kinds")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders group by 1 having bool_and(o_orderpriority <> '5-LOW') and count(*) > 0)")
def only_such_users(spark, sf_dir):
    held = sites.only_such_users(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderpriority") != "5-LOW")
    return table(spark, sf_dir, "customer").join(held, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""with c as (select part, reason from (select p_partkey as part, 'size' as reason from part where p_size >= 49 union all select l_partkey, 'returned' from lineitem where l_returnflag = 'R' and l_quantity >= 49 union all select l_partkey, 'shipped' from lineitem where l_linestatus = 'O' and l_quantity >= 49) group by 1, 2)
select part, string_agg(reason, '|' order by reason) as reasons from c group by 1""")
def cascade_sites(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").withColumnRenamed("l_partkey", "part")
    return graph.cascade([("size", table(spark, sf_dir, "part").where("p_size >= 49").withColumnRenamed("p_partkey", "part")), ("returned", lines.where("l_returnflag = 'R'")), ("shipped", lines.where("l_linestatus = 'O'"))], "part")


PARTS_SQL = r"(select p_partkey, string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' ') w, p_brand from part)"


@query(f"""with n as (select p_partkey id, p_brand, list_sort(list_distinct(list_filter(w, lambda x: x <> ''))) ws, list_filter(w, lambda x: x <> '')[1] head from {PARTS_SQL}),
c as (select p_brand, head, ws, min(id) id, count(*) k from n where len(ws) >= 2 group by 1, 2, 3)
select least(a.id, b.id) as left_id, greatest(a.id, b.id) as right_id, len(a.ws)::bigint as shared, round(len(a.ws) / len(b.ws), 6) as likeness, (case when a.id < b.id then a.k else b.k end)::bigint as left_members, (case when a.id < b.id then b.k else a.k end)::bigint as right_members
from c a join c b on a.p_brand = b.p_brand and a.head = b.head and len(b.ws) = len(a.ws) + 1 and list_has_all(b.ws, a.ws) where round(len(a.ws) / len(b.ws), 6) >= 0.5""")
def name_drift_pairs(spark, sf_dir):
    from strandline.functions.text import name_words
    from strandline.operators.similarity import blocked_name_pairs

    names = table(spark, sf_dir, "part").select("p_partkey", "p_brand", name_words(F.lower(F.concat_ws(" ", "p_name", "p_type")), expand=False).alias("w"))
    return blocked_name_pairs(names, "p_partkey", "w", ["p_brand"])


LAYERS = [("low", ["A*", "E*"], 1), ("middle", ["M*"], 2), ("high", ["*"], 3)]
LAYER_SQL = "case when {0} like 'A%' or {0} like 'E%' then 1 when {0} like 'M%' then 2 else 3 end"
NATIONS_SQL = "(select distinct a.r_name as src, b.r_name as dst from lineitem l join orders o on o.o_orderkey = l.l_orderkey join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey join region a on a.r_regionkey = n.n_regionkey join supplier s on s.s_suppkey = l.l_suppkey join nation m on m.n_nationkey = s.s_nationkey join region b on b.r_regionkey = m.n_regionkey)"


def _region_edges(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    placed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    pairs = pairs.select("o_custkey", "l_suppkey").distinct()
    pairs = pairs.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = pairs.select("c_nationkey", "s_nationkey").distinct()
    return pairs.join(placed.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("src")), "c_nationkey").join(placed.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("dst")), "s_nationkey").select("src", "dst").distinct()


@query(f"""select src, dst, case {LAYER_SQL.format('src')} when 1 then 'low' when 2 then 'middle' else 'high' end as from_layer, case {LAYER_SQL.format('dst')} when 1 then 'low' when 2 then 'middle' else 'high' end as to_layer from {NATIONS_SQL} where src <> dst and {LAYER_SQL.format('dst')} > {LAYER_SQL.format('src')}""")
def layer_violations(spark, sf_dir):
    return layers.upward_edges(_region_edges(spark, sf_dir), "src", "dst", LAYERS)


@query(f"""select distinct src, dst, pattern from {NATIONS_SQL}, (values ('low', 'AS*'), ('high', 'EUROPE')) f(layer, pattern) where layer = case {LAYER_SQL.format('src')} when 1 then 'low' when 2 then 'middle' else 'high' end and ((pattern = 'AS*' and dst like 'AS%') or dst = pattern)""")
def forbidden_edges(spark, sf_dir):
    return layers.forbidden_edges(_region_edges(spark, sf_dir), "src", "dst", [("low", "AS*"), ("high", "EUROPE")], LAYERS)


@query(f"select src, dst, case when least({LAYER_SQL.format('src')}, {LAYER_SQL.format('dst')}) > 1 then least({LAYER_SQL.format('src')}, {LAYER_SQL.format('dst')}) - 1 end as shared_rank from {NATIONS_SQL}")
def shared_lower_layer(spark, sf_dir):
    placed = _region_edges(spark, sf_dir).withColumns({"a": layers.layer_expression("src", LAYERS)["rank"], "b": layers.layer_expression("dst", LAYERS)["rank"]})
    return layers.shared_lower_layer(placed, "a", "b", [1, 2, 3]).select("src", "dst", "shared_rank")


SCORED_SQL = "(select distinct least(left_id, right_id) a, greatest(left_id, right_id) b from scored_pairs where left_id is not null and right_id is not null and left_id <> right_id and score >= 0.95 and score <= 1)"


def _strong_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "scored_pairs").where("score between 0.95 and 1 and left_id <> right_id")
    return pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id")).distinct()


@query(f"""with recursive e as {SCORED_SQL}, u as (select a x, b y from e union select b, a from e), r as (select x, x as y from u union select r.x, u.y from r join u on u.x = r.y)
select x as node, min(y) as component from r group by 1""")
def scored_components(spark, sf_dir):
    return graph.components(_strong_pairs(spark, sf_dir), "left_id", "right_id")


@query(None)
def scored_cliques(spark, sf_dir):
    return graph.greedy_cliques(_strong_pairs(spark, sf_dir))


@query("""with s as (select case when score is null or isnan(score) then null else score end as score, rule_id from scored_pairs)
select rule_id, count(*)::bigint as n, round(quantile_cont(score, 0.5), 6) as median, round(min(score), 6) as low, round(max(score), 6) as high, count(*) filter (score >= 0.5)::bigint as fired,
case when count(*) < 5 then 'skipped' when count(*) filter (score >= 0.5) / count(*) >= 0.6 then 'noisy' when max(score) < 0.7 and quantile_cont(score, 0.5) >= 0.25 then 'weak' else 'decisive' end as verdict from s group by 1""")
def calibration_summary(spark, sf_dir):
    scores = table(spark, sf_dir, "scored_pairs").select("rule_id", F.when(~F.isnan("score"), F.col("score")).alias("score"))
    return gates.calibration(scores, ["rule_id"], "score")


PROBABILITY_SQL = "(select pair_id, left_id, right_id, rule_id, scored_at, least(greatest(score, 0), 1) as p from scored_pairs where score is not null and not isnan(score))"


def _probabilities(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_pairs").where("score is not null and not isnan(score)")
    return rows.withColumn("p", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))


@query(f"""select pair_id, round(p, 6) as mass, round(abs(2 * p - 1), 6) as gap, case when p < 0.5 then 'drop' when abs(2 * p - 1) < 0.25 then 'review' when rule_id = 'close-docs' and p * 0.9 < 0.6 then 'review' else 'act' end as band from {PROBABILITY_SQL}""")
def quality_gate(spark, sf_dir):
    rows = _probabilities(spark, sf_dir)
    shares = F.create_map(F.lit("yes"), F.col("p"), F.lit("no"), 1 - F.col("p"))
    judged = rows.select("pair_id", "rule_id", "p", gates.violating_mass(shares, ["yes"], F.lit(None).cast("string")).alias("mass"), F.round(gates.margin(shares), 6).alias("gap"))
    confidence = F.when(F.col("rule_id") == "close-docs", F.col("p") * 0.9)
    return judged.select("pair_id", F.round("mass", 6).alias("mass"), "gap", gates.quality(F.col("mass"), F.abs(2 * F.col("p") - 1), confidence).alias("band"))


@query(f"""with y as (select pair_id, case when rule_id = 'same-shape' then null when p >= 0.5 then 'merge' else 'move' end as proposed, case when rule_id = 'close-names' then 'split' when p < 0.5 then null when left_id is null or right_id is null then null when p >= 0.8 then 'merge' else 'move' end as derived, abs(2 * p - 1) as gap, case when rule_id = 'close-docs' then p * 0.9 end as confidence from {PROBABILITY_SQL})
select pair_id, proposed, derived, case when proposed is null then 'drop' when derived is null then case when gap < 0.25 then 'review' when confidence < 0.6 then 'review' else 'act' end when proposed = derived then 'act' else 'review' end as settled from y""")
def settle_operation(spark, sf_dir):
    rows = _probabilities(spark, sf_dir)
    proposed = F.when(F.col("rule_id") == "same-shape", F.lit(None)).when(F.col("p") >= 0.5, "merge").otherwise("move")
    candidate = F.when(F.col("rule_id") == "close-names", "overloaded").otherwise("duplicated")
    difference = F.when(F.col("left_id").isNull() | F.col("right_id").isNull(), "unclear").when(F.col("p") >= 0.8, "value").otherwise("meaning")
    confidence = F.when(F.col("rule_id") == "close-docs", F.col("p") * 0.9)
    read = rows.withColumns({"proposed": proposed, "derived": gates.derived_operation(candidate, F.col("p"), difference)})
    return read.select("pair_id", "proposed", "derived", gates.settle(F.col("proposed"), F.col("derived"), F.abs(2 * F.col("p") - 1), confidence).alias("settled"))


@query(f"""select rule_id, count(*)::bigint as n, round(avg(p), 6) as mean, round(greatest(avg((p >= 0.5)::int), 1 - avg((p >= 0.5)::int)), 6) as agreement from {PROBABILITY_SQL} group by 1""")
def repeat_consistency(spark, sf_dir):
    return gates.repeats(_probabilities(spark, sf_dir), "rule_id", "p")


@query(f"""with a as (select rule_id || ':' || least(left_id, right_id) || ':' || greatest(left_id, right_id) as key, p, scored_at, left_id < right_id as ours from {PROBABILITY_SQL} where left_id is not null and right_id is not null and rule_id is not null),
r as (select *, row_number() over (partition by key order by scored_at desc nulls last, ours desc, p desc) k from a) select key, round(p, 6) as p, scored_at from r where k = 1""")
def answers_merge(spark, sf_dir):
    rows = _probabilities(spark, sf_dir).where("left_id is not null and right_id is not null and rule_id is not null")
    keyed = rows.select(F.concat_ws(":", "rule_id", F.least("left_id", "right_id").cast("string"), F.greatest("left_id", "right_id").cast("string")).alias("key"), F.round("p", 6).alias("p"), "scored_at", (F.col("left_id") < F.col("right_id")).alias("ours"))
    one = keyed.groupBy("key", "ours").agg(F.max(F.struct("scored_at", "p")).alias("m")).select("key", "ours", "m.p", "m.scored_at")
    return answers.merge(one.where("ours").drop("ours"), one.where("not ours").drop("ours"), "key", "scored_at")


@query("""with k as (select pair_id::varchar as key, scored_at, 100 + length(rule_id) as size from scored_pairs where scored_at >= timestamp '2025-06-01' and rule_id is not null),
r as (select *, sum(size) over (order by scored_at desc, key desc rows unbounded preceding) s from k) select key, scored_at, size from r where s <= 40000""")
def answers_prune(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_pairs").where("rule_id is not null").select(F.col("pair_id").cast("string").alias("key"), "scored_at", (F.length("rule_id") + 100).alias("size"))
    return answers.prune(rows, "key", "scored_at", "size", F.to_timestamp(F.lit("2025-06-01")), 40000)


@query("""select rule_id, stage, count(*)::bigint as dropped, min(pair_id) as example from (select pair_id, rule_id, case when left_id is null or right_id is null then 'unreadable' when score is null or isnan(score) then 'unanswered' when score < 0.5 then 'gate' else 'scope' end as stage from scored_pairs) group by 1, 2""")
def funnel_by_stage(spark, sf_dir):
    stage = F.when(F.col("left_id").isNull() | F.col("right_id").isNull(), "unreadable").when(F.col("score").isNull() | F.isnan("score"), "unanswered").when(F.col("score") < 0.5, "gate").otherwise("scope")
    return report.funnel(table(spark, sf_dir, "scored_pairs").withColumn("stage", stage), ["rule_id", "stage"], "pair_id")


@query("select p_brand as rule, count(*)::bigint as total, count(*) filter (p_size < 10)::bigint as warnings, count(*) filter (p_size between 10 and 40)::bigint as notices from part group by 1")
def census_by_rule(spark, sf_dir):
    findings = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule"), F.when(F.col("p_size") < 10, "warning").when(F.col("p_size") <= 40, "info").otherwise("error").alias("severity"))
    return report.census(findings, ["rule"])


@query("with p as (select p_name, count(*) n, count(distinct p_type) k from part group by 1) select count(*)::bigint as concepts, sum(n)::bigint as declarations, sum(case when n > 1 then n else 0 end)::bigint as duplicated, count(*) filter (k > 1)::bigint as overloaded from p")
def structure_metrics(spark, sf_dir):
    return duplicates.structure(table(spark, sf_dir, "part"), "p_name", "p_type")


FINDING_SQL = "(select coalesce(rule_id, '?') as rule, coalesce(left_id, 0)::varchar as path, coalesce(right_id, 0)::int as line, pair_id::int as col, case when score >= 0.9 then 'error' when score >= 0.7 then 'warning' else 'info' end as severity, score from scored_pairs where score is not null and not isnan(score))"


def _findings(spark, sf_dir):
    rows = table(spark, sf_dir, "scored_pairs").where("score is not null and not isnan(score)")
    severity = F.when(F.col("score") >= 0.9, "error").when(F.col("score") >= 0.7, "warning").otherwise("info")
    return rows.select(F.coalesce("rule_id", F.lit("?")).alias("rule"), F.coalesce("left_id", F.lit(0)).cast("string").alias("path"), F.coalesce("right_id", F.lit(0)).cast("int").alias("line"), F.col("pair_id").cast("int").alias("col"), severity.alias("severity"), F.lit("likely copy").alias("message"), "score")


@query(f"select path || ':' || line || ':' || col || ': likely copy [' || severity || '/' || rule || ']' as line_text from {FINDING_SQL}")
def rendered_report(spark, sf_dir):
    return report.rendered(report.sorted_findings(_findings(spark, sf_dir)), "unix")


@query(f"""select 'text' as form, path || ':' || line || ':' || col || ' ' || severity || ' likely copy (' || rule || ')' as line_text from {FINDING_SQL} union all select 'stylish', '  ' || line || ':' || col || '  ' || severity || '  likely copy  ' || rule from {FINDING_SQL}
union all select 'github', '::' || case severity when 'error' then 'error' when 'warning' then 'warning' else 'notice' end || ' file=' || path || ',line=' || line || ',col=' || col || '::likely copy' from {FINDING_SQL}
union all select 'json', '{{"path":"' || path || '","line":' || line || ',"col":' || col || ',"severity":"' || severity || '","rule":"' || rule || '","message":"likely copy"}}' from {FINDING_SQL}""")
def rendered_forms(spark, sf_dir):
    forms = [report.rendered(_findings(spark, sf_dir), form).select(F.lit(form).alias("form"), "line_text") for form in ("text", "stylish", "github", "json")]
    return forms[0].unionByName(forms[1]).unionByName(forms[2]).unionByName(forms[3])


@query(f"select rule, path, line, col, round(score, 6) as score, case rule when 'close-names' then 'error' else severity end as severity from {FINDING_SQL} where rule <> 'same-shape' and not (path like '1%') and (rule <> 'close-docs' or path like '%5')")
def configured_findings(spark, sf_dir):
    found = scope.configured(_findings(spark, sf_dir), "path", ["1*"], {"close-docs": ["*5"]}, {"close-names": "error", "same-shape": "off"})
    return found.select("rule", "path", "line", "col", F.round("score", 6).alias("score"), "severity")


@query(f"select rule, path, line, col, severity, round(score, 6) as score from {FINDING_SQL} order by score desc, path, line limit 200000000")
def ranked_report(spark, sf_dir):
    return report.ranked(_findings(spark, sf_dir)).select("rule", "path", "line", "col", "severity", F.round("score", 6).alias("score"))


@query("with k as (select c_mktsegment, list(distinct c_nationkey order by c_nationkey) n from customer group by 1) select c_mktsegment, case when len(n) <= 4 then array_to_string(n, ', ') else array_to_string(n[1:4], ', ') || ' and ' || (len(n) - 4) || ' more' end as nations from k")
def listed_members(spark, sf_dir):
    sets = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.array_sort(F.collect_set("c_nationkey")).alias("n"))
    return sets.select("c_mktsegment", report.listed(F.col("n").cast("array<string>")).alias("nations"))


@query("select s_nationkey, arg_max(s_suppkey, s_acctbal) as s_suppkey, count(*)::bigint as members from supplier group by 1")
def representatives(spark, sf_dir):
    return duplicates.representative(table(spark, sf_dir, "supplier"), ["s_nationkey"], [(-F.col("s_acctbal")).alias("o"), F.col("s_suppkey").alias("k")], ["s_suppkey"])


@query("""with f as (select o_orderkey, o_custkey, o_orderpriority, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) k from orders), c as (select c_custkey, c_mktsegment from customer)
select o_custkey, o_orderpriority, c_mktsegment from f join c on c_custkey = o_custkey where k = 1 and (o_orderpriority like '1%') <> (c_mktsegment = 'BUILDING')""")
def last_declared_drift(spark, sf_dir):
    last = fields.last_declared(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderpriority")
    columns = last.withColumn("nullable", F.col("o_orderpriority").like("1%"))
    mapped = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", (F.col("c_mktsegment") == "BUILDING").alias("nullable"))
    return fields.nullability_drift(columns, mapped, ["o_custkey"]).select("o_custkey", "o_orderpriority", "c_mktsegment")


@query("select s_nationkey, case when count(distinct s_suppkey % 7) <= 1 then 'merge,move' else 'move' end as permitted from supplier group by 1")
def permitted_operations(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count_distinct(F.col("s_suppkey") % 7).alias("n")).select("s_nationkey", gates.permitted(F.col("n")).alias("permitted"))
