"""Items that appear together: stripes of neighbour counts, merged by item, then the log-likelihood ratio.

A stripe is one item's associative array of neighbours. Each task folds the records it reads into
stripes and sends those; the merge is by item and a slice of the neighbours' hash space, so the
stripe of an item that stands in a third of all records is merged in many places at once. Items
below the wanted count are left out beforehand, since no pair can occur more often than its items.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import cut

#: Neighbour entries a task holds before it sends its stripes and starts anew.
STRIPE_ENTRIES = 1_000_000
#: Slices of the neighbours' hash space in which the stripe of one item is merged.
SLICES = 16

#: Items up to which their counts go to every task, so that no item's occurrences are gathered; it is checked against the count.
FEW_ITEMS = 200_000

_STRIPE = "item string, slice int, neighbours array<string>, counts array<bigint>"


def _send(stripes: dict[tuple[str, int], dict[str, int]]) -> pa.RecordBatch:
    keys = list(stripes)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([list(stripes[k]) for k in keys], pa.list_(pa.string())),
            pa.array([list(stripes[k].values()) for k in keys], pa.list_(pa.int64())),
        ],
        names=["item", "slice", "neighbours", "counts"],
    )


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (items, slices), the items sorted, to stripes: each item with those after it."""
    stripes: dict[tuple[str, int], dict[str, int]] = defaultdict(lambda: defaultdict(int))
    entries = 0
    for batch in batches:
        for items, slices in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i, item in enumerate(items):
                for neighbour, piece in zip(items[i + 1 :], slices[i + 1 :]):
                    stripe = stripes[item, piece]
                    if neighbour not in stripe:
                        entries += 1
                    stripe[neighbour] += 1
            if entries >= STRIPE_ENTRIES:
                yield _send(stripes)
                stripes.clear()
                entries = 0
    if stripes:
        yield _send(stripes)


def _merge(least: int):
    """Stripes sorted by item and slice to (item_a, item_b, together), without pairs below `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, rows = None, defaultdict(int), ([], [], [])

        def close() -> None:
            for neighbour, n in total.items():
                if n >= least:
                    rows[0].append(key[0])
                    rows[1].append(neighbour)
                    rows[2].append(n)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], names=["item_a", "item_b", "together"])
            for r in rows:
                r.clear()
            return made

        for batch in batches:
            for item, piece, neighbours, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if (item, piece) != key:
                    close()
                    key, total = (item, piece), defaultdict(int)
                for neighbour, n in zip(neighbours, counts):
                    total[neighbour] += n
            if len(rows[0]) > 50_000:
                yield out()
        close()
        yield out()

    return run


def log_likelihood_ratio(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's G2 of the two-by-two table of records with both items, one of them, or none."""

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    both, a, b, n = (c.cast("double") for c in (both, a, b, n))
    cells = ((both, a * b), (a - both, a * (n - b)), (b - both, (n - a) * b), (n - a - b + both, (n - a) * (n - b)))
    return F.lit(2.0) * sum((part(o, e / n) for o, e in cells[1:]), part(cells[0][0], cells[0][1] / n))


def item_pairs(records: DataFrame, key: str, items: str, order: str | None = None, least: int = 6, lift: float = 3.0, significance: float = 3.841) -> DataFrame:
    """(item_a, item_b, together, n_a, n_b, n, lift, llr) of pairs that occur together clearly more often than chance.

    `items` is an array of strings; within a record each item counts once, null items don't count, and a
    record without items doesn't count in n. Rows of one key count once, the one with the greatest `order`
    (without `order`, any). Kept: together >= least, together * n >= lift * n_a * n_b, and llr >= significance
    (one degree of freedom, 0.05; every pair with together >= 6 and lift >= 3 reaches it). item_a < item_b.
    """
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_distinct(F.array_compact(items)).alias("items"), (F.col(order) if order else F.lit(0)).alias("seen"))
    rows = cut(rows.groupBy("id").agg(F.max_by("items", "seen").alias("items")).where(F.size("items") > 0))
    total = rows.agg(F.count("*").alias("n"))
    each = rows.select("id", F.explode("items").alias("item"))
    counts = cut(each.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least))
    wanted = counts.select("item")
    if counts.count() <= FEW_ITEMS:
        wanted = F.broadcast(wanted)
    baskets = each.join(wanted, "item").groupBy("id").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    slices = F.transform("items", lambda x: F.pmod(F.xxhash64(x), F.lit(SLICES)).cast("int"))
    stripes = baskets.select("items", slices.alias("slices")).mapInArrow(_fold, _STRIPE)
    merged = stripes.repartition("item", "slice").sortWithinPartitions("item", "slice").mapInArrow(_merge(least), "item_a string, item_b string, together long")
    named = merged.join(counts.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), "item_a").join(counts.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), "item_b")
    # one row of one number: its size is fixed
    named = named.crossJoin(F.broadcast(total))
    # products of counts are exact in doubles below 2**53
    by_chance = F.col("n_a").cast("double") * F.col("n_b")
    seen = F.col("together").cast("double") * F.col("n")
    kept = named.where(seen >= by_chance * F.lit(lift))
    ratio = seen / by_chance
    scored = kept.withColumns({"lift": ratio, "llr": log_likelihood_ratio(F.col("together"), F.col("n_a"), F.col("n_b"), F.col("n"))})
    return scored.where(F.col("llr") >= significance).select("item_a", "item_b", "together", "n_a", "n_b", "n", "lift", "llr")
