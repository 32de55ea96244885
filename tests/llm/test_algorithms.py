"""Near-duplicates, set pairs, item pairs, components, mixing: brute force on small random inputs, and awkward rows."""

import itertools
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import neardup
from strandline.llm.components import connected_components
from strandline.llm.cooccurrence import item_pairs
from strandline.llm.mixture import draw_slots, mix_sources, permuted, plan_mix
from strandline.llm.neardup import near_duplicate_groups, pair_hashes, set_groups, trees_needed
from strandline.llm.setjoin import similar_set_classes, similar_set_pairs


def grouped(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("hot", [3, 100_000])
def test_components(spark, hot):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(40)]
    messy = edges + edges[:20] + [(b, a) for a, b in edges[:20]] + [(None, 1), (1, None), (7, 7)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in messy], "a long, b long, vertex string")
    got = {r.vertex: r.group_id for r in connected_components(frame, hot_degree=hot).collect()}
    assert got == grouped([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([(3, 3), (None, 2)], "a long, b long")).collect() == []


def token_rows(seed):
    rng = random.Random(seed)
    rows = []
    for g in range(25):
        base = [f"t{rng.randrange(300)}" for _ in range(rng.randrange(20, 60))]
        for _ in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(1000)}"
            rows.append(copy)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    texts = token_rows(1) + [["same"] * 5, ["same"] * 5, [], ["one"], None, [], ["a", None, "b"], ["a", None, "b"]] + [["hot", "group", "of", "equal", "rows"]] * 60
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(0, ["stale", "row", "of", "zero"], 0, "c"), (None, ["x", "y", "z"], 1, "c"), (3, texts[3], 2, "c")]
    frame = spark.createDataFrame(rows, "unit_id long, tokens array<string>, scanned_at int, group_id string")
    sets = {i: {((a or ""), (b or "")) for a, b in zip(t, t[1:])} for i, t in enumerate(texts) if t and len(t) > 1}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9]
    got = {r.unit_id: r.group_id for r in near_duplicate_groups(frame).collect()}
    assert got == grouped(links)
    assert near_duplicate_groups(frame.limit(0)).collect() == []


@pytest.mark.parametrize("small", [1, 3, 1000])
def test_large_buckets_are_joined_exactly(spark, small):
    # families that share their opening meet in many buckets without being alike
    rng = random.Random(7)
    texts = []
    for family in range(6):
        own = [f"f{family}_{i}" for i in range(14)]
        for _ in range(12):
            copy = [f"c{i}" for i in range(30)] + own
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(30, 44)] = f"e{rng.randrange(500)}"
            texts.append(copy)
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t array<string>").select("id", F.lit(1).alias("seen"), pair_hashes(F.col("t")).alias("hashes"))
    sets = {i: set(zip(t, t[1:])) for i, t in enumerate(texts)}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9]
    got = {r.id: r.group_id for r in set_groups(frame, 0.7, depth=2, small=small).collect()}
    assert got == grouped(links) and len(set(got.values())) > 1


def test_trees_reach_the_recall():
    for threshold, depth in ((0.7, 6), (0.9, 16)):
        n = trees_needed(threshold, depth, 0.9985)
        assert 1 - (1 - threshold**depth) ** n >= 0.9985 > 1 - (1 - threshold**depth) ** (n - 1)


@pytest.mark.parametrize("home", [0.0, 0.1, 0.3])
def test_set_pairs_equal_brute_force(spark, home):
    rng = random.Random(8)
    rows = []
    for i in range(160):
        if rows and rng.random() < 0.5:
            base = list(rng.choice(rows)[2])
            if base and rng.random() < 0.7:
                base[rng.randrange(len(base))] = f"m{rng.randrange(60)}"
        else:
            base = [f"m{rng.randrange(60)}" for _ in range(rng.randrange(3, 9))]
        rows.append((rng.choice("fg"), i, base, 1))
    sets = {(p, i): frozenset(m) for p, i, m, _ in rows if len(set(m)) >= 4}
    want = sorted((a[0], *sorted((a[1], b[1]))) for a, b in itertools.combinations(sets, 2) if a[0] == b[0] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]) - 1e-9)
    messy = rows + [("f", 500, None, 1), ("f", 501, [], 1), ("f", 502, [None, None], 1), ("g", None, ["a", "b", "c", "d"], 1), (rows[0][0], 0, ["old", "row", "of", "zero"], 0)]
    frame = spark.createDataFrame(messy, "part string, id long, m array<string>, seen int")
    got = similar_set_pairs(frame, "id", "part", "m", "seen", 0.7, 4, home=home)
    assert sorted((r.part, r.left_id, r.right_id) for r in got.collect()) == want and want
    assert similar_set_pairs(frame.limit(0), "id", "part", "m", "seen").collect() == []


def test_set_pairs_between_two_tables(spark):
    rows = [("p", 1, ["a", "b"], "l"), ("p", 2, ["a", "b"], "r"), ("p", 3, ["a", "b"], "l"), ("p", 1, ["a", "b"], "r")]
    frame = spark.createDataFrame(rows, "part string, id long, m array<string>, side string")
    got = sorted((r.left_id, r.right_id) for r in similar_set_pairs(frame, "id", "part", "m", side="side").collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 3)]


def test_set_classes_count_links(spark):
    rows = [("p", i, ["a", "b", "c"]) for i in range(5)] + [("p", 9, ["a", "b", "c", "d"]), ("p", 10, ["x"]), ("q", 11, ["a", "b", "c"]), ("p", 12, None)]
    got = similar_set_classes(spark.createDataFrame(rows, "part string, id long, m array<string>"), "id", "part", "m", threshold=0.7).collect()
    assert {(r.part, r.id): (r.class_id, r.members, r.links) for r in got} == {**{("p", i): (0, 5, 1) for i in range(5)}, ("p", 9): (9, 1, 1), ("p", 10): (10, 1, 0), ("q", 11): (11, 1, 0)}


def test_item_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    baskets = {i: {f"i{min(rng.randrange(12), rng.randrange(12))}" for _ in range(rng.randrange(0, 5))} for i in range(300)}
    for i in range(0, 60, 5):
        baskets[i] |= {"u", "v"}
    rows = [(i, sorted(b) + sorted(b)[:1], 1) for i, b in baskets.items()] + [(900, None, 1), (901, [], 1), (902, [None], 1), (0, ["stale"], 0)]
    frame = spark.createDataFrame(rows, "k long, items array<string>, seen int")
    single, pair = Counter(x for b in baskets.values() for x in b), Counter(p for b in baskets.values() for p in itertools.combinations(sorted(b), 2))
    n = sum(bool(b) for b in baskets.values())
    want = {p: c for p, c in pair.items() if c >= 6 and c * n >= 3 * single[p[0]] * single[p[1]]}
    got = {(r.item_a, r.item_b): r.together for r in item_pairs(frame, "k", "items", "seen").collect()}
    assert got == want and ("u", "v") in got
    assert item_pairs(frame.limit(0), "k", "items", "seen").collect() == []


def test_permutations_are_permutations(spark):
    for size in (1, 2, 7, 100):
        rows = spark.range(size).select(permuted(F.col("id"), F.lit(size).cast("long"), F.lit(5).cast("long")).alias("x"))
        assert sorted(r.x for r in rows.collect()) == list(range(size))


def test_mix(spark):
    docs = [(i, f"word{i} and some more text {i}" * 3, "Big ") for i in range(200)] + [(1000 + i, f"small {i} " * 4, "small") for i in range(15)] + [(2000, None, "big"), (2001, "", "big"), (2002, "x y z", None), (2003, "no target", "other")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("SMALL", 0.3, 3), ("absent", 0.2, 2), (None, 0.1, 1)], "source_name string, target_share double, max_repeats int")
    mix, shares = mix_sources(frame, targets, block=32, shards=3)
    rows = mix.collect()
    assert {r.shard for r in rows} == {0, 1, 2} and max(Counter((r.source_name, r.block) for r in rows if r.source_name == "small").values()) <= 3
    assert max(Counter((r.source_name, r.block) for r in rows if r.source_name == "big").values()) == 1
    assert all(r.n_tokens == len(r.ids) <= 32 for r in rows)
    got = {r.source_name: r for r in shares.collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"].actual_share == 0
    assert abs(got["big"].actual_share - 0.625) < 0.03
    empty, none = mix_sources(frame.limit(0), targets, block=32)
    assert empty.count() == 0 and none.count() == 3


def test_a_mix_packs_every_token_once_per_pass(spark):
    from strandline.llm.encoding import VOCABULARIES, encoder

    docs = [(i, f"text number {i} " * (i % 5), "s") for i in range(60)]
    targets = spark.createDataFrame([("s", 1.0, 1)], "source_name string, target_share double, max_repeats int")
    mix, _ = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets, block=16)
    encode = encoder("byte_bpe_50k", VOCABULARIES).encode
    assert Counter(t for r in mix.collect() for t in r.ids) == Counter(t for _, x, _ in docs for t in encode(x))


def test_slots_are_drawn_for_each_source(spark):
    taken = plan_mix([("a", 1000, 0.5, 1), ("b", 300, 0.3, 4), ("c", 0, 0.2, 2)], block=10)
    blocks = {"a": 100, "b": 30}
    rows = draw_slots(spark, taken, blocks, 7, 3).collect()
    assert Counter(r.source for r in rows) == taken and plan_mix([], 10) == {} and {r.shard for r in rows} == set(range(7))
    for name in taken:
        for p in {r["pass"] for r in rows}:
            once = [r.block for r in rows if r.source == name and r["pass"] == p]
            assert len(once) == len(set(once)) and all(0 <= b < blocks[name] for b in once)


def test_draws_are_multinomial_at_any_size(spark):
    # the spread of the counts is that of independent draws
    many = draw_slots(spark, {"a": 400_000, "b": 200_000}, {"a": 400_000, "b": 50_000}, 64, 5).groupBy("source", "shard").count().collect()
    for name, total in (("a", 400_000), ("b", 200_000)):
        counts = [r["count"] for r in many if r.source == name]
        mean, expected = sum(counts) / 64, total / 64 * (1 - 1 / 64)
        variance = sum((c - mean) ** 2 for c in counts) / 63
        assert len(counts) == 64 and sum(counts) == total and 0.5 < variance / expected < 1.7
    assert draw_slots(spark, {}, {}, 1, 5).collect() == []


def test_a_mix_with_long_and_repeated_documents(spark):
    docs = [(1, "long text " * 3000, "s"), (2, "short", "s"), (2, "short", "s"), (3, "else", "s"), (None, "no id", "s")]
    targets = spark.createDataFrame([("s", 1.0, 2)], "source_name string, target_share double, max_repeats int")
    mix, shares = mix_sources(spark.createDataFrame(docs, "doc_id long, text string, source string"), targets, block=64)
    rows = mix.collect()
    tokens = shares.first().tokens_available
    assert Counter(r["pass"] for r in rows) == {0: -(-tokens // 64), 1: -(-tokens // 64)} and sum(r.n_tokens for r in rows) == 2 * tokens
    assert Counter(d for r in rows for d in r.doc_ids)[2] == 2


def test_sets_are_hashed_in_pieces_that_stay_in_the_cache(monkeypatch):
    rng = random.Random(4)
    sets = [[rng.randrange(-(2**62), 2**62) for _ in range(n)] for n in [60] * 3000 + [neardup.HASHED + 7, 1, 5]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sets))), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])
    pieces, plain = [], neardup.signatures
    monkeypatch.setattr(neardup, "signatures", lambda values, starts, n: pieces.append((len(values), len(starts))) or plain(values, starts, n))
    got = pa.Table.from_batches(neardup._forest_keys(3, 2)(iter([batch, batch.slice(0, 0), batch.slice(2999, 3)])))
    assert max(n for n, records in pieces if records > 1) <= neardup.HASHED and sum(records for _, records in pieces) == len(sets) + 3
    # the same keys as of each set alone
    rows = got.to_pylist()
    alone = [r for i in (0, 1700, 2999, 3000, 3001, 3002) for r in pa.Table.from_batches(neardup._forest_keys(3, 2)(iter([batch.slice(i, 1)]))).to_pylist()]
    assert len(rows) == 3 * (len(sets) + 3) and all(r in rows for r in alone)
