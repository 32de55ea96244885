"""Mixing sources to target weights, in blocks of tokens.

The tokens of each source are laid end to end in a pseudorandom order and cut into blocks of one length.
The size of the mix follows from the targets and what each source can give with its repeats. Each slot of a
source draws its output shard, so that the counts of the sources in the shards are multinomial draws whose
totals are the wanted numbers; a slot's running number in its source is mapped by a
pseudorandom permutation of the source's block numbers, a new one for each repeat, and blocks are joined
by number. No source is ever in one place: slots are made in runs, offsets come from sums over pieces of it.
The driver holds one row for each source, whatever the number of blocks or shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.encoding import VOCABULARIES, encode_texts
from strandline.runtime import cut

#: Tokens of one block.
BLOCK = 512
#: Documents of a source that are laid end to end in one task.
PIECE = 4_000
#: Slots that one row stands for before they are made one by one, and blocks of one output shard on average.
RUN = 100_000
SHARD_BLOCKS = 4_096
SEED = 11
#: Sources with targets that are mixed at once: their counts are held on the driver.
MOST_SOURCES = 10_000


def normal_source(source: Column) -> Column:
    """Sources are compared without letter case and outer blanks."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def permuted(number: Column, size: Column, key: Column, rounds: int = 40) -> Column:
    """A pseudorandom permutation of 0..size-1 for each key: rounds of swap-or-not, which need no table."""
    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        coin = F.pmod(F.xxhash64(key, r, F.greatest(x, partner), F.lit("coin")), F.lit(2))
        return F.when(coin == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), number.cast("long"), swap)


def _laid_out(sized: DataFrame, seed: int) -> DataFrame:
    """(source, doc_id, row, n, start) of sized(source, doc_id, row, n): where each document's tokens begin in its source's stream."""
    pieces = sized.groupBy("source").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces"))
    order = F.xxhash64("doc_id", F.lit(seed))
    placed = sized.join(pieces, "source").withColumns({"order": order, "piece": F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), "pieces").cast("int")})
    within = Window.partitionBy("source", "piece").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("source", "piece").agg(F.sum("n").alias("piece_tokens"))
    ahead = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.coalesce(F.sum("piece_tokens").over(ahead), F.lit(0)))
    started = placed.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets.select("source", "piece", "offset"), ["source", "piece"])
    return started.select("source", "doc_id", "row", "n", (F.col("offset") + F.col("before")).alias("start"))


def plan_mix(sources: list[tuple[str, int, float, int]], block: int, tokens: int | None = None) -> dict[str, int]:
    """Blocks to take of each (source, tokens it has, target share, most repeats); shares of absent sources go to the others in proportion.

    Without `tokens` the mix is as large as the targets allow; with it, no larger than that.
    """
    present = [s for s in sources if s[1] > 0 and s[2] > 0 and s[3] > 0]
    if not present:
        return {}
    total = sum(s[2] for s in present)
    largest = min(s[1] * s[3] / (s[2] / total) for s in present)
    size = min(largest, tokens) if tokens is not None else largest
    taken = {}
    for name, has, share, most in present:
        blocks = -(-has // block)
        # a source's last block is shorter, so blocks count by their mean length
        taken[name] = min(blocks * most, int(round(size * share / total / (has / blocks))))
    return taken


def draw_slots(spark: SparkSession, taken: dict[str, int], blocks: dict[str, int], shards: int, seed: int) -> DataFrame:
    """(source, number, shard, pass, block): the slots of each source with the shard each draws and the block it takes.

    Every slot draws for itself, uniformly, by a hash of its source, number and seed: the counts of a source in
    the shards are then one multinomial draw with its total. Slots are made from runs of RUN numbers, so neither
    the driver nor a task ever holds all slots of a source.
    """
    rows = [(n, k, blocks[n], -(-k // RUN)) for n, k in sorted(taken.items()) if k]
    runs = spark.createDataFrame(rows, "source string, taken long, blocks long, runs long")
    runs = runs.select("source", "taken", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"))
    if sum(r[3] for r in rows) > 1:
        runs = runs.repartition("source", "run")
    first = F.col("run") * RUN
    numbered = runs.select("source", "blocks", F.explode(F.sequence(first, F.least(first + RUN, F.col("taken")) - 1)).alias("number"))
    drawn = numbered.withColumns({"shard": F.pmod(F.xxhash64("source", "number", F.lit(seed), F.lit("shard")), F.lit(shards)), "pass": F.expr("number div blocks").cast("int")})
    return drawn.withColumn("block", permuted(F.pmod("number", "blocks"), F.col("blocks"), F.xxhash64("source", "pass", F.lit(seed)))).drop("blocks")


def mix_sources(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shards: int | None = None, tokens: int | None = None, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(mix, shares) of documents(doc_id, text, source) by targets(source_name, target_share, max_repeats).

    mix is (shard, slot, source_name, block, pass, n_tokens, doc_ids, ids): the blocks of the mix with their
    tokens; no block, and so no document, is taken more than max_repeats times. shares is (source_name,
    target_share, max_repeats, tokens_available, tokens_taken, actual_share, passes), one row for each target.
    Sources are compared without letter case and outer blanks; those without target (null ones too) stay out;
    null and empty texts add nothing; rows of one doc_id count once (any of them, if they differ); a target that
    names a source twice counts with its summed share. An absent source reaches 0 and the others share its part
    in proportion.
    """
    spark = documents.sparkSession
    wanted = targets.where("source_name is not null").groupBy(normal_source(F.col("source_name")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    encoded = encode_texts(documents.where("doc_id is not null").withColumn("source", normal_source(F.col("source"))).join(wanted.select("source"), "source", "left_semi"), vocabulary=vocabulary, folder=folder, keep=("doc_id", "source"))
    stream = cut(encoded.where(F.size("ids") > 0).withColumn("row", F.monotonically_increasing_id()))
    sized = stream.groupBy("doc_id").agg(F.min_by(F.struct("source", "row", F.size("ids").cast("long").alias("n")), "row").alias("r")).select("doc_id", "r.*")
    have = wanted.join(sized.groupBy("source").agg(F.sum("n").alias("has")), "source", "left").select("source", F.coalesce("has", F.lit(0)).alias("has"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    rows = [tuple(r) for r in have.limit(MOST_SOURCES + 1).collect()]
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources with targets")
    taken = plan_mix(rows, block, tokens)
    blocks = {n: -(-has // block) for n, has, _, _ in rows if has}
    shards = shards or max(1, sum(taken.values()) // SHARD_BLOCKS)
    slots = draw_slots(spark, taken, blocks, shards, seed)

    laid = _laid_out(sized, seed)
    # each row goes on with its own part of the tokens only
    begin, end = F.col("start"), F.col("start") + F.col("n") - 1
    low = lambda b: F.greatest(b * block - begin, F.lit(0))
    high = lambda b: F.least((b + 1) * block - begin, F.col("n"))
    pieces = F.transform(F.sequence(F.floor(begin / block), F.floor(end / block)), lambda b: F.struct(b.alias("block"), F.greatest(begin, b * block).alias("start"), F.slice("ids", (low(b) + 1).cast("int"), (high(b) - low(b)).cast("int")).alias("ids")))
    spread = laid.join(stream.select("row", "ids"), "row").select("source", "doc_id", F.explode(pieces).alias("p"))
    parts = spread.select("source", "p.block", F.struct("p.start", "doc_id", "p.ids").alias("part"))
    # a block holds at most `block` tokens, so at most that many documents
    packed = parts.groupBy("source", "block").agg(F.array_sort(F.collect_list("part")).alias("parts")).select("source", "block", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("ids"))
    mixed = slots.join(packed, ["source", "block"]).select(F.col("shard").cast("int").alias("shard"), "source", "block", "pass", "number", "doc_ids", "ids")
    within = Window.partitionBy("shard").orderBy(F.xxhash64("source", "number", F.lit(seed)), "source", "number")
    mix = cut(mixed.select("shard", (F.row_number().over(within) - 1).alias("slot"), F.col("source").alias("source_name"), "block", "pass", F.size("ids").alias("n_tokens"), "doc_ids", "ids"))
    reached = mix.groupBy("source_name").agg(F.sum("n_tokens").alias("tokens_taken"))
    whole = reached.agg(F.sum("tokens_taken").alias("whole"))
    shares = (
        have.withColumnRenamed("source", "source_name").join(reached, "source_name", "left").crossJoin(F.broadcast(whole))
        .select("source_name", "target_share", "max_repeats", F.col("has").alias("tokens_available"), F.coalesce("tokens_taken", F.lit(0)).alias("tokens_taken"),
                F.round(F.coalesce(F.col("tokens_taken") / F.col("whole"), F.lit(0.0)), 6).alias("actual_share"), F.round(F.coalesce(F.col("tokens_taken") / F.when(F.col("has") > 0, F.col("has")), F.lit(0.0)), 6).alias("passes"))
    )
    return mix, shares
