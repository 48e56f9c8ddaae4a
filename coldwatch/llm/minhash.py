"""Near-duplicate documents by a chosen-path similarity join over minwise tokens.

Documents with the same shingle set are one class; everything below is about classes. A class has ``TOKENS``
minwise tokens: place i holds the least of its shingles' i-th hashes, so two classes agree at
a place with probability equal to their Jaccard similarity.

Each tree branches a class recursively: the hash of a node picks one or two places (``1 /
LEAST_SIMILARITY`` on average), and the class goes on to the child named by node, place and
its token there. A pair at the limit so keeps one common child a level on average; it meets in a tree with probability 0.64 at
depth ``DEPTH`` and 0.38 at ``DEEPEST``. ``TREES`` says how many trees each depth takes: so many that all of them miss a pair at
the limit at most once in 27,000, counting that they share the tokens (averaged over how many of a pair's tokens agree).
The nodes of a class depend on it alone, so no shuffle is needed until the leaves.

In a node, members link to the node's first class first (a line of comparisons, not a square). Nodes whose members
are then in one component have nothing more to say about components. In the others, members outside the largest
component are compared with all members of other components if the node, or their number, is small (``SMALL``); larger
nodes branch on while that takes them apart, to ``DEEPEST`` levels at most, after which they are compared so, too. With each level
the classes of large nodes get further trees from the root, up to that depth's number, for the pairs that the level parts.

No pair is a row. Sizes and ``SKETCH`` one-bit tokens (sets of ``LEAST_SKETCHED`` shingles and more) tell which members of a
node can have a partner; these are dealt to blocks of bounded size, and a task that compares two blocks reads their full
shingle sets, counts common shingles of all its pairs at once, and returns a forest of the links between different components.

NULL texts and texts without words have the empty set, which links with nothing. Rows that share a doc_id
are one document, linked where any of its texts is. A NULL doc_id links with nothing, has component NULL and is kept.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.components import components
from coldwatch.llm.tables import documents, free_name, lean, short_batches
from coldwatch.session import freeze

TOKENS = 128
DEPTH = 3
TREES = (12, 15, 18, 21, 26, 30, 36)  # by depth from DEPTH on
DEEPEST = DEPTH + len(TREES) - 1
SMALL = 2000
FIRSTS = 5
SKETCH, AGREE, LEAST_SKETCHED = 64, 44, 32
SIFTED = 2048  # nodes of more members are compared without asking the sketches
LEAST_PERCENT = 80
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 18, 2048
ROWS = 1000
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)  # fixed values: odd multipliers


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit value for each."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX[3])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(32))


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    seeds = (mixed(np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(MIX[0])) >> np.uint64(32)).astype(np.uint32)
    return seeds[:TOKENS] | np.uint32(1), seeds[TOKENS:]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``size`` words; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(values) - size + 1)
    out = np.full(n, np.uint64(min(len(words), size)))
    for k in range(min(size, len(values))):
        out = mixed(out * np.uint64(MIX[0]) + values[k:k + n])
    return np.unique(out)


def tokens(values: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set: for each place the least of 32-bit hashes."""
    factor, shift = multipliers()
    least, short = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        hashes = short[at:at + 1024, None] * factor
        hashes += shift
        least = np.minimum(least, hashes.min(0))
    return least


def sketches(table: np.ndarray) -> np.ndarray:
    """One bit of each of the first ``SKETCH`` tokens, of all bits of token and place."""
    spread = mixed(table[:, :SKETCH].astype(np.uint64) + (np.arange(1, SKETCH + 1, dtype=np.uint64) << np.uint64(32)))
    return np.packbits((spread >> np.uint64(63)).astype(np.uint8), axis=1).view("<i8").ravel()


def signed(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, set1, set2 (a digest of the set) and tokens of each row."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, out = whole.slice(at, ROWS), []
                for text in batch.column("text"):
                    values = shingles(text.as_py(), shingle)
                    digest = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), "<i8").tolist()
                    out.append((len(values), *digest, tokens(values).tobytes() if len(values) else None))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))],
                    ["doc_id", "n", "set1", "set2", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        lambda batches: lean(sign(batches)), "doc_id long, n long, set1 long, set2 long, tokens binary")


def roots(trees: range, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row in the root of each tree: row and node."""
    return np.repeat(np.arange(rows), len(trees)), np.tile(mixed(np.array(trees, np.uint64) + np.uint64(1)), rows)


def descended(table: np.ndarray, row: np.ndarray, node: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and node ``levels`` deeper, for a table of tokens."""
    places = table.shape[1]
    for _ in range(levels):
        draw = mixed(node * np.uint64(MIX[2]) + np.uint64(1))
        first = (draw % np.uint64(places)).astype(int)
        second = (first + 1 + ((draw >> np.uint64(8)) % np.uint64(places - 1)).astype(int)) % places
        twice = (draw >> np.uint64(32)) % np.uint64(LEAST_PERCENT) < np.uint64(100 - LEAST_PERCENT)
        place = np.concatenate([first, second[twice]])
        row, node = np.concatenate([row, row[twice]]), np.concatenate([node, node[twice]])
        node = mixed(mixed(node + place.astype(np.uint64) * np.uint64(MIX[0])) + table[row, place].astype(np.uint64))
    return row, node


def branched(rows: DataFrame, start: str | None, levels: int, trees: range = range(0)) -> DataFrame:
    """Nodes ``levels`` deeper than ``start`` (the roots of ``trees`` without it) for rows of id, n, tokens."""
    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                table = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
                bits = sketches(table)
                if start:
                    row, node = np.arange(batch.num_rows), batch.column(start).to_numpy().view(np.uint64)
                else:
                    row, node = roots(trees, batch.num_rows)
                row, node = descended(table, row, node, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view(np.int64)), batch.column("id").take(pa.array(row)), batch.column("n").take(pa.array(row)), pa.array(bits[row])],
                    ["node", "id", "n", "bits"])

    columns = ["id", "n", "tokens", *([start] if start else [])]
    return rows.select(*columns).mapInArrow(lambda batches: lean(branch(batches)), "node long, id long, n long, bits long").dropDuplicates(["node", "id"])


def shared(nodes: DataFrame) -> DataFrame:
    """Nodes with more than one member, written once: node, id, n, bits, members, low (the first member's id, n and bits).

    Which member is first differs among ``FIRSTS`` kinds of nodes: where a large group meets in many nodes, those
    that the first member of one doesn't link find that of another.
    """
    order = F.struct(F.xxhash64("id", F.pmod("node", F.lit(FIRSTS))), "id")
    counts = nodes.groupBy("node").agg(
        F.count(F.lit(1)).alias("members"), F.min_by(F.struct("id", "n", "bits"), order).alias("low")).where("members > 1")
    return freeze(nodes.join(counts, "node"), "nodes")


def near(n: Column, bits: Column, other_n: Column, other_bits: Column) -> Column:
    """Sizes and one-bit tokens that a pair at the limit would have."""
    sizes = 100 * F.least(n, other_n) >= LEAST_PERCENT * F.greatest(n, other_n)
    return sizes & ((F.least(n, other_n) < LEAST_SKETCHED) | (F.bit_count(bits.bitwiseXOR(other_bits)) <= SKETCH - AGREE))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys, of batches that are sorted by these."""
    open_run, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.column_stack([batch.column(k).to_numpy() for k in keys])
        starts = [0, *(np.flatnonzero((columns[1:] != columns[:-1]).any(1)) + 1).tolist(), len(columns)]
        for low, high in zip(starts, starts[1:]):
            now = tuple(columns[low].tolist())
            if now != key and open_run:
                yield pa.Table.from_batches(open_run)
                open_run = []
            key = now
            open_run.append(batch.slice(low, high - low))
    if open_run:
        yield pa.Table.from_batches(open_run)


def with_partner(n: np.ndarray, bits: np.ndarray, component: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Which members have one of another component, of which one asks, that sizes and sketches let through."""
    found = np.zeros(len(n), bool)
    for at in np.array_split(np.flatnonzero(asks), -(-int(asks.sum()) // 256)):
        least, most = np.minimum(n[at, None], n), np.maximum(n[at, None], n)
        ok = (100 * least >= LEAST_PERCENT * most) & (component[at, None] != component)
        ok &= (least < LEAST_SKETCHED) | (np.bitwise_count((bits[at, None] ^ bits).view(np.uint64)) <= SKETCH - AGREE)
        found |= ok.any(0)
        found[at] |= ok.any(1)
    return found


def sifted(ready: DataFrame) -> DataFrame:
    """node, id, n, component, asks (outside the largest component) of members that can have a partner."""
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["node"]):
            n, bits, component, asks = (table.column(c).to_numpy() for c in ("n", "bits", "component", "asks"))
            kept = table.select(columns).filter(pa.array(with_partner(n, bits, component, asks)))
            yield from kept.combine_chunks().to_batches()

    columns = ["node", "id", "n", "component", "asks"]
    rows = ready.withColumn("asks", F.col("component") != F.col("largest"))
    small = rows.where(F.col("members") <= SIFTED).select(*columns, "bits").repartition("node").sortWithinPartitions("node")
    left = small.mapInArrow(lambda batches: lean(sift(batches)), "node long, id long, n long, component long, asks boolean")
    return freeze(left.unionByName(rows.where(F.col("members") > SIFTED).select(*columns)), "sifted")


def blocks_of(members: Column, shingled: Column) -> Column:
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingled / BLOCK_SHINGLES)).cast("long")


def block_pairs(members: DataFrame) -> DataFrame:
    """node, first, second (two blocks of the node, or one twice), block, id, component: who is to be compared with whom.

    Blocks of those who ask meet all blocks of the node, the others these only.
    """
    asks = F.col("asks")
    sizes = members.groupBy("node").agg(
        blocks_of(F.count_if(asks), F.sum(F.when(asks, F.col("n")).otherwise(0))).alias("asking"),
        blocks_of(F.count_if(~asks), F.sum(F.when(asks, 0).otherwise(F.col("n")))).alias("others")).where("asking > 0")
    place = F.xxhash64("id", "node")
    dealt = members.join(sizes, "node").withColumn(
        "block", F.when(asks, F.pmod(place, "asking")).otherwise(F.col("asking") + F.pmod(place, F.greatest("others", F.lit(1)))))
    meets = F.sequence(F.lit(0).cast("long"), F.col("asking") + F.when(asks, F.col("others")).otherwise(0) - 1)
    met = dealt.withColumn("other", F.explode(meets))
    return met.select("node", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "id", "component")


def star_pairs(nodes: DataFrame) -> DataFrame:
    """The same for each first member (block 0 of a node named by its id) and the members of its nodes."""
    rays = freeze(nodes.where((F.col("id") != F.col("low.id")) & near(F.col("n"), F.col("bits"), F.col("low.n"), F.col("low.bits")))
                  .select(F.col("low.id").alias("node"), "id", "n").distinct(), "rays")
    sizes = rays.groupBy("node").agg(blocks_of(F.count(F.lit(1)), F.sum("n")).alias("blocks"))
    zero = F.lit(0).cast("long")
    dealt = rays.join(sizes, "node").select(
        "node", zero.alias("first"), (1 + F.pmod(F.xxhash64("id", "node"), "blocks")).alias("second"), "id")
    middle = sizes.select("node", zero.alias("first"), F.explode(F.sequence(zero + 1, "blocks")).alias("second"), F.col("node").alias("id"))
    return dealt.withColumn("block", F.col("second")).unionByName(middle.withColumn("block", zero)).withColumn("component", F.col("id"))


def common(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``sets`` shares with each of ``others``; all are sorted and distinct."""
    if len(sets) <= 4:
        ends = np.cumsum([0, *map(len, others)])
        values, out = np.concatenate(others), []
        for one in sets:
            at = np.minimum(np.searchsorted(one, values), len(one) - 1)
            out.append(np.diff(np.concatenate([[0], np.cumsum(one[at] == values)])[ends]))
        return np.array(out)
    rows = [*sets, *others]
    _, column, times = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(rows)), [*map(len, rows)])
    several = times[column] > 1  # what only one has is shared by none
    column, owner = (np.cumsum(times > 1) - 1)[column[several]], owner[several]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(others)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        start, end = np.searchsorted(column, (low, low + COLUMNS))
        table = np.zeros((len(rows), COLUMNS), np.float32)
        table[owner[start:end], column[start:end] - low] = 1
        out += table[:len(sets)] @ table[len(sets):].T
    return out.astype(np.int64)


def forest(ids: list[int], others: list[int], component: np.ndarray, other_component: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components to what all of ``linked`` would."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            up = above[x]
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    linked = linked & (component[:, None] != other_component)
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        a, b = top(int(component[i])), top(int(other_component[j]))
        if a != b:
            above[max(a, b)] = min(a, b)
            out.append((min(ids[i], others[j]), max(ids[i], others[j])))
    return out


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A forest of links (a, b) whose full shingle sets reach the limit, for each two blocks."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["node", "first", "second"]):
            block, component = table.column("block").to_numpy(), table.column("component").to_numpy()
            left, right = block == table.column("first")[0].as_py(), block == table.column("second")[0].as_py()
            if not left.any() or not right.any():
                continue
            ids = table.column("id").to_numpy()
            values = [np.frombuffer(v.as_py(), "<u8") for v in table.column("shingles")]
            one, other = ([values[k] for k in np.flatnonzero(side)] for side in (left, right))
            both = common(one, other)
            union = np.array([*map(len, one)])[:, None] + np.array([*map(len, other)]) - both
            links = forest(ids[left].tolist(), ids[right].tolist(), component[left], component[right], 100 * both >= LEAST_PERCENT * union)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    keys = ["node", "first", "second"]
    rows = pairs.join(sets, "id").select(*keys, "block", "component", "id", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: lean(compare(batches)), "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """id and shingles (sorted hashes as bytes) of each class in a node, written once."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shingles(text.as_py(), shingle).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    wanted = texts.join(nodes.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "text"])
    return freeze(wanted.mapInArrow(lambda batches: lean(build(batches)), "id long, shingles binary").where(F.octet_length("shingles") > 0), "sets")


def several_components(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes whose members are in more than one component (an id without link is its own), with
    component, largest (the one with most members) and outsiders (how many are in others)."""
    named = nodes.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = named.groupBy("node", "component").count()
    spread = sizes.groupBy("node").agg(
        F.max_by("component", F.struct("count", "component")).alias("largest"),
        (F.sum("count") - F.max("count")).alias("outsiders")).where("outsiders > 0")
    return freeze(named.join(spread, "node"), "open")


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row per row of ``docs``."""
    with short_batches(docs.sparkSession, ROWS):
        return grouped_documents(docs, shingle)


def grouped_documents(docs: DataFrame, shingle: int) -> DataFrame:
    rows = freeze(signed(docs, shingle), "signed")
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("set1", "set2").agg(
        F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    classes = freeze(sets, "classes")
    # a document with several texts links its classes
    aliases = rows.where("n > 0").join(classes.select("set1", "set2", "id"), ["set1", "set2"]).where("doc_id <> id").select(
        F.col("doc_id").alias("a"), F.col("id").alias("b"))
    several = rows.where("n > 0").groupBy("doc_id").agg(F.countDistinct("set1", "set2").alias("sets")).where("sets > 1")
    links = freeze(aliases.join(several, F.col("a") == F.col("doc_id"), "left_semi"), "links")
    nodes, depth, before = shared(branched(classes, None, DEPTH, range(TREES[0]))), DEPTH, None
    sets = shingle_sets(docs, nodes, shingle)
    while True:
        links = links.unionByName(freeze(confirmed(star_pairs(nodes), sets), "links"))
        parts = components(links)
        open_nodes = several_components(nodes, parts)
        large = open_nodes.where(F.least("members", "outsiders") > SMALL).select("node", "id")
        n_large = large.count()
        # another level helps only if the last one took the large nodes of a tree apart
        a_tree = n_large / TREES[depth - DEPTH]
        last = depth >= DEEPEST or not n_large or (before is not None and 2 * a_tree > before)
        # with few outsiders their comparisons are a few lines, however large the node
        ready = open_nodes if last else open_nodes.where(F.least("members", "outsiders") <= SMALL)
        links = links.unionByName(freeze(confirmed(block_pairs(sifted(ready)), sets), "links"))
        if last:
            break
        depth, before = depth + 1, a_tree
        signs = classes.select("id", "n", "tokens")
        deeper = branched(large.join(signs, "id"), "node", 1)
        further = branched(signs.join(large.select("id").distinct(), "id", "left_semi"), None, depth, range(*TREES[depth - DEPTH - 1:depth - DEPTH + 1]))
        nodes = shared(deeper.unionByName(further))
    parts = components(links)
    return (
        rows.join(classes.select("set1", "set2", "id"), ["set1", "set2"], "left")
        .withColumn("id", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("id")).otherwise(F.col("doc_id")))
        .join(parts, "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The given rows of one document of each group, and of all that have no duplicate.

    Of rows that share the kept doc_id one stays if they have equal texts, too. Columns of any other name travel unchanged.
    """
    # the few that go are joined away; nothing but their ids travels
    name = free_name(docs, "gone")
    gone = near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
    return left.dropDuplicates(["doc_id", "text"])


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=2)
