"""Mixing sources to target weights, in DataFrame functions only.

1.  A source's documents, in a fixed order, are one stream of words, packed into blocks of
    ``BLOCK`` words; the last block is shorter. A document's place comes from totals per
    (source, chunk of documents), so no task sees a whole source.
2.  Targets share all words by weight, at most ``MOST`` times a source's size; what is above goes to the
    others by weight until none is above (the level is found by running sums over the sources).
3.  A source has as many output slots as its target needs: some whole rounds of its blocks and a part of one. The
    slots are filled shard by shard: each shard of ``SHARD`` slots draws its counts per
    source multinomially, a draw a slot; a source that has had all its slots takes no more, and what the draws left
    over fills shards at the end.
4.  The n-th slot of a source holds block ``permuted(n mod blocks)`` of the round ``n div blocks``, where each source and round
    has its own pseudorandom permutation (swap or not: a keyed involution per step, so a bijection on any
    number of blocks), and joins the block's pieces by (source, block).

All draws are hashes of places and the seed: reruns and retried tasks agree.

Sizes count runs of characters other than ASCII white space; NULL text has none, and documents
without words take nothing. A NULL source is a source of its own, last in order. Repeated doc_ids are summed
per doc_id and source in ``taken``; the query returns each row. An empty table gives empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldwatch.llm.tables import documents, free_name, partitions
from coldwatch.session import freeze

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
SHARD = 4096
CHUNKS = 4096
MOST = 3
STEPS = 24
SEED = 7
WEIGHTS = (5, 2, 1)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row per source.

    Weights repeat over the sources in order of code points. With sources in order of size by weight,
    those that their cap holds come first; the first that isn't held by its cap sets the level that
    all later ones share (for those, the level that they would set is lower).
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cap = F.lit(MOST) * F.col("source_size")
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ratio = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    behind, ahead = ratio.rowsBetween(W.unboundedPreceding, -1), ratio.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(behind), F.lit(0))) / F.sum("weight").over(ahead)
    return (
        known.withColumn("own_level", level)
        .withColumn("level", F.max(F.when(cap >= F.col("own_level") * F.col("weight"), F.col("own_level"))).over(everything))
        .select("source", "source_size",
                F.least(F.col("level") * F.col("weight"), cap.cast("double")).alias("target"))
    )


def permuted(place: Column, count: Column, key: Column, back: bool = False) -> Column:
    """A pseudorandom bijection on 0 to count - 1: at each step a place and its mirror swap, or not."""
    def step(x: Column, i: Column) -> Column:
        # in one lambda, so that the expression doesn't double from step to step
        mirror = F.pmod(F.pmod(F.xxhash64(key, i), count) - x, count)
        return F.when(F.xxhash64(key, i, F.greatest(x, mirror)) % 2 == 0, mirror).otherwise(x)

    steps = F.sequence(F.lit(STEPS), F.lit(1)) if back else F.sequence(F.lit(1), F.lit(STEPS))
    return F.aggregate(steps, place.cast("long"), step)


def pieces(sizes: DataFrame) -> DataFrame:
    """Where documents lie in their source's blocks: row, source, block, start, words."""
    placed = sizes.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(CHUNKS)))
    running = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    firsts = placed.groupBy("source", "chunk").agg(F.sum("size").alias("words")).select(
        "source", "chunk", F.coalesce(F.sum("words").over(running), F.lit(0)).alias("first"))
    within = W.partitionBy("source", "chunk").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    offset = placed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).alias("p").join(
        firsts.alias("f"), F.col("p.source").eqNullSafe(F.col("f.source")) & (F.col("p.chunk") == F.col("f.chunk"))
    ).select("row", "p.source", "size", (F.col("before") + F.col("first")).alias("at"))
    last = F.floor((F.col("at") + F.col("size") - 1) / BLOCK)
    begin = F.greatest(F.col("at"), F.col("block") * BLOCK)
    return offset.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / BLOCK), last))).select(
        "row", "source", "block", (begin - F.col("block") * BLOCK).alias("start"),
        (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * BLOCK) - begin).alias("words"))


def quotas(target: DataFrame, seed: int = SEED) -> DataFrame:
    """Each source's blocks and slots, and how many words its last slot holds."""
    size, block = F.greatest(F.col("source_size"), F.lit(1)), F.lit(BLOCK)
    short = size - (F.col("blocks") - 1) * BLOCK
    near = F.col("part") <= F.col("gap") * BLOCK
    some = F.col("part") - F.col("gap") * BLOCK
    slots = (F.when(F.col("part") == 0, 0).when(near, F.ceil(F.col("part") / block)).when(some <= short, F.col("gap") + 1)
             .otherwise(F.col("gap") + 1 + F.ceil((some - short) / block)))
    left = F.when(near, F.pmod(F.col("part") - 1, block) + 1).when(some <= short, some).otherwise(
        F.pmod(some - short - 1, block) + 1)
    return (
        target.where("source_size > 0")
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("blocks", F.ceil(size / block))
        .withColumn("rounds", F.floor(F.col("words") / size))
        .withColumn("part", F.col("words") - F.col("rounds") * size)
        .withColumn("gap", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64(F.lit(seed), "source", "rounds"), back=True))
        .select("source", "blocks", (F.col("rounds") * F.col("blocks") + slots).cast("long").alias("slots"),
                F.when(F.col("part") > 0, left).otherwise(BLOCK).cast("long").alias("last_words"))
        .where("slots > 0")
    )


def shards(quota: DataFrame, seed: int = SEED) -> DataFrame:
    """shard, source, first, n: a shard takes the source's slots first to first + n - 1.

    A slot's draw is a hash, compared with the sources' running shares, which are gathered into
    one row of two arrays (there is a row per source in them, not per document).
    """
    total = F.sum("slots").over(W.partitionBy(F.lit(0)))
    share = F.sum("slots").over(W.orderBy(F.col("source").asc_nulls_last())) / total
    table = quota.withColumn("upto", share).withColumn("all", total)
    deal = table.agg(F.max("all").alias("all"), F.array_sort(F.collect_list("upto")).alias("upto"))
    numbered = table.withColumn("number", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int"))
    draws = (
        deal.select("upto", "all", F.explode(F.sequence(F.lit(0), F.floor((F.col("all") - 1) / SHARD))).alias("shard"))
        .repartition(F.col("shard"))
        .select("shard", "upto", F.explode(F.sequence(F.col("shard") * SHARD, F.least((F.col("shard") + 1) * SHARD, F.col("all")) - 1)).alias("slot"))
        .withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("slot")), 11) / F.lit(float(1 << 53)))
        .select("shard", F.size(F.filter("upto", lambda x: x <= F.col("u"))).alias("number"))
        .groupBy("shard", "number").agg(F.count(F.lit(1)).alias("drawn"))
    )
    upto = F.sum("drawn").over(W.partitionBy("number").orderBy("shard"))
    taken = draws.withColumn("upto", upto).join(
        numbered.select("number", "source", "blocks", "slots", "last_words", "all"), "number")
    first = F.col("upto") - F.col("drawn")
    drawn = taken.where(first < F.col("slots")).select(
        "shard", "source", "blocks", "slots", "last_words", first.alias("first"),
        F.least(F.col("drawn"), F.col("slots") - first).alias("n"))
    had = drawn.groupBy("source").agg(F.sum("n").alias("had"))
    rest = quota.alias("q").join(had.alias("h"), F.col("q.source").eqNullSafe(F.col("h.source")), "left").select(
        "q.*", F.coalesce("had", F.lit(0)).alias("first")).where("first < slots").select(
        "*", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - F.col("first") - 1) / SHARD))).alias("k"))
    end = deal.select(F.floor((F.col("all") - 1) / SHARD).alias("last_shard"))
    tail = rest.join(F.broadcast(end)).select(  # one row: where the drawn shards end
        (F.col("last_shard") + 1 + F.col("k")).alias("shard"), "source", "blocks", "slots", "last_words",
        (F.col("first") + F.col("k") * SHARD).alias("first"),
        F.least(F.lit(SHARD), F.col("slots") - F.col("first") - F.col("k") * SHARD).alias("n"))
    return drawn.unionByName(tail)


def mix(sizes: DataFrame, quota: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: shard, slot, source, block, row, start, words; a row for each document piece in a slot."""
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))
    dealt = shards(quota, seed).repartition(partitions(sizes.sparkSession), "shard", "source")
    slots = dealt.select("*", slot.alias("slot")).select(
        "shard", "slot", "source",
        permuted(F.col("slot") % F.col("blocks"), F.col("blocks"),
                 F.xxhash64(F.lit(seed), "source", F.floor(F.col("slot") / F.col("blocks")))).alias("block"),
        F.when(F.col("slot") == F.col("slots") - 1, F.col("last_words")).otherwise(BLOCK).alias("room"))
    same = F.col("s.source").eqNullSafe(F.col("p.source")) & (F.col("s.block") == F.col("p.block"))
    return slots.alias("s").join(pieces(sizes).alias("p"), same).where("start < room").select(
        "shard", "slot", "s.source", "s.block", "row", "start",
        F.least(F.col("words"), F.col("room") - F.col("start")).alias("words"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row per document.

    Sizes are written once: all later steps, and every rerun of one, number the same rows.
    """
    rows = sized(docs).withColumn("row", F.xxhash64("doc_id", "source", "size"))
    again = W.partitionBy("row").orderBy("doc_id")
    # rows alike in doc_id, source and size are told apart by a count
    sizes = freeze(rows.withColumn("row", F.struct("row", F.row_number().over(again).alias("copy"))), "sizes")
    target = freeze(targets(sizes, weights), "targets")
    taken = mix(sizes, quotas(target, seed), seed).groupBy("row").agg(F.sum("words").alias("taken"))
    return (
        sizes.join(taken, "row", "left").alias("d")
        .join(target.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", "d.source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The documents as often as the mix takes them: whole copies, the part of one rounded by chance.

    On average a document has taken / size copies, and never more than ``MOST``.
    """
    share = mixture(docs, weights, seed).where("size > 0").groupBy("doc_id", "source", "size").agg(
        (F.sum("taken") / F.sum("size")).alias("rate"))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("d.doc_id"), F.xxhash64("d.text")), 11) / F.lit(float(1 << 53))
    n = F.floor(F.col("m.rate") + chance).cast("int")
    own, size = [F.col(f"d.`{c}`") for c in docs.columns], free_name(docs, "words")
    keyed = docs.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = (F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("d.source").eqNullSafe(F.col("m.source"))
            & (F.col(f"d.{size}") == F.col("m.size")))
    joined = keyed.alias("d").join(share.alias("m"), same).where(n >= 1)
    return joined.withColumn(free_name(joined, "copy"), F.explode(F.sequence(F.lit(1), n))).select(*own)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")
