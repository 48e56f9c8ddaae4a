"""A trie of conversations by their first turns, from digests of blocks of turns.

1.  A turn's digest is two hashes of its role and text; a prefix's digest is the exclusive or of its turns' digests, each mixed with
    its place. It can be taken in any order and in parts, so that one endless conversation is no task's burden: places and
    sums come from totals per (conversation, chunk), then from within the chunk.
2.  Conversations are cut into blocks of ``BLOCK`` turns, the last one shorter, and grouped by the digests at both ends of each
    block: one row per distinct block behind a distinct prefix, with its members' count and least conv_id.
3.  Where all that pass a prefix go on with the same block, its inner turns are nodes as they stand. Only where blocks differ
    are they taken apart, and their turns grouped anew, from the distinct blocks with their counts.
4.  A node is known by its least member and its depth. The nodes that one conversation is the least member of are the end of its path:
    a chain, hung on a node of a chain with a smaller conv_id. What subtrees hold is summed over the tree of chains by
    doubling (each round adds what lies twice as far below, so rounds grow with the logarithm of the tree's height),
    then along each chain from its end.
5.  The conv_ids that end at a node are joined to texts per range of conv_id, and these are hashed one after the other.

Turns are ordered by ``turn`` (NULL first), ties by digest. NULL role or text is empty. Rows without conv_id belong to no conversation.
Repeated rows are turns of their own. Other columns are not read. An empty table gives no rows. Two different prefixes are taken for one only if 128 bits of digest agree.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldwatch.llm.sharding import CRC32, crc32_sql
from coldwatch.llm.tables import Buckets
from coldwatch.session import freeze

BLOCK = 4
CHUNK = 4096       # turns or depths of one conversation that meet in a sort
SHARE = 100        # conversations c - c % SHARE lend their first turns
LENT = 6           # fewer turns than this
IDS_PER_RANGE = 100_000
EMPTY = hashlib.sha256(b"").hexdigest()


def joined_on(left: str, right: str, names: list[str]) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return on


def running(df: DataFrame, chunk: Column, order: list, totals: dict[str, tuple], down: bool = False) -> DataFrame:
    """Adds running totals per conv_id (own row included). ``totals``: name to (column, "sum" or "xor").

    ``chunk`` goes up along the order (``down``: goes down). Rows of a chunk meet in a sort; a
    chunk starts from the totals of those before it.
    """
    fold = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}
    df = df.withColumn("chunk", chunk)
    along = W.partitionBy("conv_id").orderBy(F.col("chunk").desc() if down else F.col("chunk").asc_nulls_first())
    parts = df.groupBy("conv_id", "chunk").agg(*(fold[how][0](c).alias(f"{n}_own") for n, (c, how) in totals.items())).select(
        "conv_id", "chunk", *(F.coalesce(fold[how][0](f"{n}_own").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"{n}_before")
                              for n, (_, how) in totals.items()))
    within = W.partitionBy("conv_id", "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = df.alias("a").join(parts.alias("b"), joined_on("a", "b", ["conv_id", "chunk"])).select("a.*", *(f"b.{n}_before" for n in totals))
    return both.withColumns({n: fold[how][1](fold[how][0](c).over(within), F.col(f"{n}_before")) for n, (c, how) in totals.items()}).drop(
        "chunk", *(f"{n}_before" for n in totals))


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 1), d1, d2, chars: each turn of each conversation, without its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("d1"),
        F.xxhash64(text, F.lit(1), role).alias("d2"), F.char_length(text).cast("long").alias("chars"))
    order = [F.col("turn").asc_nulls_first(), "d1", "d2"]
    return running(turns, F.floor(F.col("turn") / CHUNK), order, {"place": (F.lit(1).cast("long"), "sum")}).drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, place, x1, x2, chars), and all conversations (conv_id) with or without any.

    A conversation's first turns, as many as crc32 of its id leaves by ``LENT``, come from the one that lends to its hundred.
    """
    lends = F.col("conv_id") % SHARE == 0
    sizes = freeze(turns.groupBy("conv_id").agg(F.max("place").alias("n")), "conversations")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT
    lender = sizes.where(lends).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    plan = freeze(sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % SHARE).alias("base"), h.alias("h")).join(lender, "base", "left").select(
        "conv_id", "base", "h", (F.col("h") - F.least(F.col("h"), F.coalesce("base_n", F.lit(0)))).alias("lack")), "plan")
    first = turns.where(lends & (F.col("place") < LENT)).withColumnRenamed("conv_id", "base")
    lent = plan.where("h > 0").join(first, "base").where("place <= h").select("conv_id", "place", "d1", "d2", "chars")
    own = turns.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("lack")).alias("place"), "d1", "d2", "chars")
    return lent.unionByName(own).select(
        "conv_id", "place", F.xxhash64("place", "d1", "d2").alias("x1"), F.xxhash64("d2", "d1", "place").alias("x2"), "chars"), plan.select("conv_id")


def distinct_blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, s1, s2, e1, e2, members, least, n, and x1_i, x2_i, chars_i: the distinct blocks behind distinct prefixes."""
    at = (F.col("place") - 1) % block
    number = F.floor((F.col("place") - 1) / block)
    columns = [f"{c}_{i}" for i in range(block) for c in ("x1", "x2", "chars")]
    own = turns.groupBy("conv_id", number.alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"),
        *(F.max(F.when(at == i, F.col(c))).alias(f"{c}_{i}") for i in range(block) for c in ("x1", "x2", "chars")))
    ends = running(own, F.floor(F.col("block") / CHUNK), ["block"], {"e1": (F.col("x1"), "xor"), "e2": (F.col("x2"), "xor")})
    return ends.withColumns({"s1": F.col("e1").bitwiseXOR(F.col("x1")), "s2": F.col("e2").bitwiseXOR(F.col("x2"))}).groupBy(
        "block", "s1", "s2", "e1", "e2").agg(F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.max("n").alias("n"),
                                             *(F.max(c).alias(c) for c in columns))


def nodes(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, p1, p2, q1, q2, n_convs, chars: the trie's nodes below the root, with their own and their parent's digest."""
    differ = blocks.groupBy("block", "s1", "s2").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    judged = blocks.join(differ, ["block", "s1", "s2"], "left").withColumn("apart", F.col("kinds").isNotNull())
    steps, p1, p2 = [], F.col("s1"), F.col("s2")
    for i in range(block):
        q1, q2 = p1, p2
        p1, p2 = p1.bitwiseXOR(F.col(f"x1_{i}")), p2.bitwiseXOR(F.col(f"x2_{i}"))
        steps.append(F.struct((F.col("block") * block + i + 1).alias("depth"), p1.alias("p1"), p2.alias("p2"), q1.alias("q1"), q2.alias("q2"),
                              F.col(f"chars_{i}").alias("chars")))
    turns = judged.select("apart", "members", "least", F.explode(F.slice(F.array(*steps), F.lit(1), F.col("n").cast("int"))).alias("t")).select(
        "apart", F.col("least").alias("conv_id"), "t.depth", "t.p1", "t.p2", "t.q1", "t.q2", F.col("members").alias("n_convs"), "t.chars")
    again = turns.where("apart").groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.sum("n_convs").alias("n_convs"), F.max("chars").alias("chars"))
    return turns.where("NOT apart").drop("apart").unionByName(again)


def subtree_totals(tree: DataFrame, sums: list[str]) -> DataFrame:
    """id and ``sums`` over all that hangs below each row of ``tree`` (id, up, sums), itself included.

    Each round adds the totals of those that lie 1, 2, 4, ... steps below, then looks twice as far up.
    """
    while True:
        tree = freeze(tree, "tree")
        if tree.where("up IS NOT NULL").isEmpty():
            return tree.drop("up")
        below = tree.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(*(F.sum(c).alias(f"{c}_below") for c in sums))
        ahead = tree.where("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("next"))
        tree = tree.join(ahead, "up", "left").join(below, "id", "left").select(
            "id", F.col("next").alias("up"), *((F.col(c) + F.coalesce(F.col(f"{c}_below"), F.lit(0))).alias(c) for c in sums))


def endings(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """depth, p1, p2, ends_sha256: for each node where conversations end, the hash of their ids."""
    ranges = Buckets(conversations, "conv_id", IDS_PER_RANGE)
    whole = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    zero = F.lit(0).cast("long")
    ends = conversations.join(whole, "conv_id", "left").select(
        "conv_id", *(F.coalesce(F.col(c), zero).alias(c) for c in ("depth", "p1", "p2")), ranges.number(F.col("conv_id")).alias("range"))
    key = ["depth", "p1", "p2"]
    texts = ends.groupBy(*key, "range").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if node != held:
                    if held is not None:
                        done.append((*held, digest.hexdigest()))
                    held, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield table(done)
        if held is not None:
            yield table([(*held, digest.hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 4
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*key, "ends_sha256"])

    # a row per node and range of ids: what one hash must take in one after the other
    return texts.repartition(*key).sortWithinPartitions(*key, "range").select(*key, "ids").mapInArrow(
        digests, "depth long, p1 long, p2 long, ends_sha256 string")


def trie(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, conversations = rebuilt(freeze(placed(rows), "turns"))
    turns = freeze(turns, "rebuilt")
    blocks = freeze(distinct_blocks(turns, block), "blocks")
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv_id", *(zero.alias(c) for c in ("depth", "p1", "p2")), *(F.lit(None).cast("long").alias(c) for c in ("q1", "q2")), "n_convs", zero.alias("chars"))
    known = freeze(nodes(blocks, block).unionByName(root), "nodes")
    saved = (F.col("n_convs") - 1) * F.col("chars")

    # chains: the nodes of one least member, and the node they hang on
    chains = known.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max("depth").alias("last"), F.min_by("q1", "depth").alias("q1"),
                                          F.min_by("q2", "depth").alias("q2"), F.sum(saved).alias("saved"))
    above = known.select(F.col("conv_id").alias("up"), (F.col("depth") + 1).alias("first"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    hung = freeze(chains.join(above, ["first", "q1", "q2"], "left").select("conv_id", "first", "last", "up", "saved"), "chains")
    children = hung.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("first") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    tips = hung.select("conv_id", F.col("last").alias("depth"), "up", "saved").join(children, ["conv_id", "depth"], "left")
    totals = subtree_totals(tips.select(F.col("conv_id").alias("id"), "up", F.col("hung").isNull().cast("long").alias("leaves"), "saved"), ["leaves", "saved"])
    inflow = hung.where("up IS NOT NULL").select("conv_id", "up", (F.col("first") - 1).alias("depth")).join(
        totals.withColumnRenamed("id", "conv_id"), "conv_id")
    none = F.lit(None).cast("long")
    marks = (
        inflow.select(F.col("up").alias("conv_id"), "depth", F.lit(1).alias("hung"), "leaves", "saved", zero.alias("tip"), none.alias("parent"))
        .unionByName(hung.select("conv_id", F.col("last").alias("depth"), F.lit(0).alias("hung"), zero.alias("leaves"), zero.alias("saved"),
                                 F.lit(1).cast("long").alias("tip"), none.alias("parent")))
        .unionByName(hung.where("up IS NOT NULL").select("conv_id", F.col("first").alias("depth"), F.lit(0).alias("hung"), zero.alias("leaves"),
                                                         zero.alias("saved"), zero.alias("tip"), F.col("up").alias("parent")))
        .groupBy("conv_id", "depth").agg(F.sum("hung").alias("hung"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                                         F.max("tip").alias("tip"), F.max("parent").alias("parent")))
    or_none = {c: F.coalesce(F.col(c), zero) for c in ("hung", "leaves", "saved", "tip")}
    full = known.withColumn("own", saved).join(marks, ["conv_id", "depth"], "left").join(endings(turns, conversations), ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "n_convs", "ends_sha256", (or_none["hung"] + 1 - or_none["tip"]).alias("n_children"),
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), (F.col("own") + or_none["saved"]).alias("saved"),
        (or_none["leaves"] + F.when((or_none["tip"] == 1) & (or_none["hung"] == 0), 1).otherwise(0)).alias("leaves"))
    summed = running(full, F.floor(F.col("depth") / CHUNK), [F.col("depth").desc()],
                     {"n_leaves": (F.col("leaves"), "sum"), "saved_tokens": (F.col("saved"), "sum")}, down=True)
    return summed.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                         F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH RECURSIVE {CRC32.strip()}
own AS (
    SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lent AS (
    SELECT conv_id, turns, {crc32_sql("conv_id::VARCHAR")} % {LENT} AS h FROM own, bytes),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
    FROM lent c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {SHARE}),
prefixes AS (
    SELECT conv_id, len(turns) AS n, d, turns[d].text AS last, sha256(to_json(turns[1:d])::VARCHAR) AS key, sha256(to_json(turns[1:d - 1])::VARCHAR) AS up
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT d AS depth, key, CASE WHEN d > 0 THEN any_value(up) END AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends, coalesce(any_value(length(last)), 0) AS chars
    FROM prefixes GROUP BY d, key),
kids AS (SELECT up AS key, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
    SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id
    FROM nodes n LEFT JOIN kids k ON k.key = n.key AND k.depth = n.depth LEFT JOIN nodes p ON p.key = n.up AND p.depth = n.depth - 1),
below AS (
    SELECT a.d AS depth, a.key, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens
    FROM full_nodes f JOIN prefixes o ON o.conv_id = f.conv_id AND o.d = f.depth JOIN prefixes a ON a.conv_id = o.conv_id AND a.d <= o.d
    GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM full_nodes JOIN below USING (depth, key)
"""
