"""Repeated passages by a distributed suffix array over sampled suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere else. Sorting the suffixes of
every byte would multiply the table, so suffixes start at *anchors*: in each window of ``LENGTH`` bytes the ``GRAM``-byte
string with the least hash (the leftmost at ties). The choice depends on the window's bytes alone, so equal windows have their
anchors at the same place, and comparing what surrounds equal anchors finds every repeated window, exactly.

1.  Consecutive windows with one anchor form a *region*: the anchor's hash, a hash of all its bytes.
    Regions whose anchor occurs once hold no repeat. Of those left, regions that occur twice as a whole repeat in all their windows.
2.  For anchors with other regions besides, one region of each content goes to a suffix array: sampled splitters
    range-partition suffixes by the anchor, the bytes behind it, then those before it, so that a bucket takes no more than
    its share also where all suffixes go on alike; each bucket sorts its suffixes in the same order by
    multikey quicksort, a word of eight bytes at a time and only among ties; neighbours are compared, also the last of
    a bucket and the first of the next. The same is done with the bytes before the anchor, read backwards.
    Two neighbours that agree for L bytes before and R bytes behind the anchor share all windows within.
3.  The nearest neighbours bound what any other region can share: windows beyond their L or R repeat nowhere. *Open* are windows
    within both bounds that no neighbour has shown: their partners, if any, stand apart in both orders. Where an anchor has open
    windows at an offset, so are the windows of the regions that stand first, in the order of the bytes behind, of those next to each other that share
    theirs, and these are compared with the open ones by their hashes. Regions that share a window with the one before them are spoken for by it, so a
    passage in many documents gives few rows. With that every window is settled, and no group of equal anchors, however large, meets in one task:
    joins by anchor or content deal only keys of few rows by key, and frequent ones, few by their number, are broadcast.

Buckets of suffixes grow in number with the suffixes (``PER_BUCKET``). NULL texts count as empty; texts shorter than ``LENGTH`` bytes have no repeat. Repeated rows are repeats of each other.
Rows are known by doc_id and a hash of their text, so a repeated doc_id does no harm.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.tables import documents, partitions, short_batches
from coldwatch.session import freeze

LENGTH = 400
GRAM = 64
AT_ONCE = 1 << 21
ROWS = 500
PER_BUCKET = 40_000  # suffixes, about 2 KB each while they are sorted
FREQUENT = 1000  # rows of one key
FREQUENT_KEYS = 10_000  # at most so many are broadcast
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # fixed values: odd multipliers
LOW32 = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@cache
def powers(base: int, size: int) -> np.ndarray:
    """1, base, base^2, ... in 64-bit arithmetic."""
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def sums(data: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sums, so that the hash of any stretch is a difference."""
    size = 1 << max(12, int(len(data)).bit_length())
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * powers(base, size)[:len(data)], out=out[1:])
    return out


def hashes(running: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    size = 1 << max(12, int(len(running) - 1).bit_length())
    back = powers(pow(base, -1, 1 << 64), size)
    return mixed((running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def regions(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Regions as arrays: first window, number of windows, place of the anchor, anchor hash, content hash.

    Very long texts are read in stretches; a region cut by one is two.
    """
    for at in range(0, max(1, len(text) - LENGTH + 1), AT_ONCE):
        data = np.frombuffer(text, np.uint8, min(len(text) - at, AT_ONCE + LENGTH - 1), at).astype(np.uint64) if text else np.empty(0, np.uint64)
        windows, width = len(data) - LENGTH + 1, LENGTH - GRAM + 1
        if windows < 1:
            return
        running = sums(data, BASES[0])
        grams = np.arange(len(data) - GRAM + 1)
        gram = hashes(running, grams, grams + GRAM, BASES[0])
        ranked = np.full(-(-len(gram) // width) * width, np.iinfo(np.uint64).max)
        ranked[:len(gram)] = (gram & ~LOW32) | grams.astype(np.uint64)
        blocks = ranked.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], ahead[width - 1:width - 1 + windows]) & LOW32).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        count = np.diff(np.r_[first, windows])
        content = hashes(sums(data, BASES[1]), first, first + count - 1 + LENGTH, BASES[1])
        yield at + first, count, at + anchor[first], gram[anchor[first]].view(np.int64), content.view(np.int64)


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("text_id"), "text")


def met(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with what ``keys`` has for their key, where ``n`` says how many rows have it. Rows of a frequent key stay where they are. Both are read twice."""
    most = max(FREQUENT, rows.count() // FREQUENT_KEYS)
    often, seldom = keys.where(F.col("n") > most).drop("n"), keys.where(F.col("n") <= most).drop("n")
    others = rows.join(F.broadcast(often.select(on)), on, "left_anti")
    return rows.join(F.broadcast(often), on).unionByName(others.join(seldom, on))


REGION = "doc_id long, text_id long, first int, windows int, at int, anchor long, content long"


def found_regions(docs: DataFrame) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch, rows, parts = whole.slice(start, ROWS), [], []
                for i, text in enumerate(batch.column("text")):
                    for part in regions(text.as_py().encode("utf-8", "surrogatepass")):
                        parts.append(part)
                        rows.append(np.full(len(part[0]), i))
                if not parts:
                    continue
                row = pa.array(np.concatenate(rows))
                first, windows, at, anchor, content = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("text_id").take(row), *(pa.array(x.astype(np.int32)) for x in (first, windows, at)),
                     pa.array(anchor), pa.array(content)], ["doc_id", "text_id", "first", "windows", "at", "anchor", "content"])

    return docs.mapInArrow(find, REGION)


SUFFIX = "anchor long, content long, single boolean, doc_id long, text_id long, first int, windows int, at int, before binary, behind binary"


def suffixes(kinds: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes around each wanted region's anchor: ``before`` (backwards) and ``behind``."""
    wanted = kinds.groupBy("doc_id", "text_id").agg(
        F.collect_list(F.struct("anchor", "content", "single", "first", "windows", "at")).alias("wanted"))
    # texts stream past a hash table of what is wanted, instead of being sorted
    joined = docs.alias("d").join(wanted.hint("shuffle_hash").alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_id") == F.col("w.text_id"))).select(
        "d.doc_id", "d.text_id", "d.text", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.strip().split(" ")[0] for x in SUFFIX.split(",")]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                out = []
                for row in whole.slice(start, ROWS).to_pylist():
                    text = row["text"].encode("utf-8", "surrogatepass")
                    for w in row["wanted"]:
                        before = text[w["first"]:w["at"]][::-1]
                        behind = text[w["at"]:w["first"] + w["windows"] - 1 + LENGTH]
                        out.append((w["anchor"], w["content"], w["single"], row["doc_id"], row["text_id"], w["first"], w["windows"], w["at"],
                                    before, behind))
                types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return freeze(joined.mapInArrow(cut, SUFFIX), "suffixes")


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of equal width, and their lengths."""
    values = column.to_pylist()
    flat = b"".join(v.ljust(width, b"\0") for v in values)
    return np.frombuffer(flat, np.uint8).reshape(len(values), width), np.fromiter(map(len, values), np.int64, len(values))


def multikey(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by anchor, then by bytes: a word at a time, each among those that all words before left tied."""
    words = rows.view(">u8").astype(np.uint64)
    order = np.argsort(anchor, kind="stable")
    run = np.cumsum(np.r_[True, anchor[order][1:] != anchor[order][:-1]]) - 1
    for depth in range(words.shape[1]):
        size = np.bincount(run)
        tied = np.flatnonzero(size[run] > 1)
        if not len(tied):
            break
        word = words[order[tied], depth]
        inner = np.lexsort((word, run[tied]))
        order[tied] = order[tied][inner]
        word, owner = word[inner], run[tied]
        new = np.zeros(len(run), np.int64)
        new[tied[1:]] = (word[1:] != word[:-1]) & (owner[1:] == owner[:-1])
        run = run + np.cumsum(new)
    return order


def agreement(one: np.ndarray, other: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading bytes two sets of rows have in common, at most ``most``."""
    out = np.empty(len(one), np.int64)
    for at in range(0, len(one), 4096):
        differ = one[at:at + 4096] != other[at:at + 4096]
        out[at:at + 4096] = np.where(differ.any(1), differ.argmax(1), differ.shape[1])
    return np.minimum(out, most)


SIDES = {"behind": LENGTH * 2, "before": LENGTH}
MATCH = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("single", pa.bool_()), ("doc_id", pa.int64()), ("text_id", pa.int64()),
    ("first", pa.int32()), ("windows", pa.int32()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("most", pa.int32()), ("second", pa.bool_()),
    ("bucket", pa.int32()), ("edge", pa.int32()), ("before", pa.binary()), ("behind", pa.binary()),
])
MATCH_DDL = ("anchor long, content long, single boolean, doc_id long, text_id long, first int, windows int, at int, low int, high int, "
             "most int, second boolean, bucket int, edge int, before binary, behind binary")
OWN = ["anchor", "content", "single", "doc_id", "text_id", "first", "windows", "at"]


def compared(table: pa.Table, side: str) -> tuple[pa.Table, np.ndarray]:
    """What neighbours in the order of ``side`` share: for each region low to high, the windows (from the anchor) they have in common, and
    how far the side agreed, whether the neighbour stands before it; and the order."""
    anchor, content = table.column("anchor").to_numpy(), table.column("content").to_numpy()
    bytes_, sizes = zip(*(matrix(table.column(name), SIDES[name]) for name in SIDES))
    at = list(SIDES).index(side)
    order = multikey(anchor, np.hstack([bytes_[at], bytes_[1 - at]]))
    one, other = order[:-1], order[1:]
    same = (anchor[one] == anchor[other]) & (content[one] != content[other])
    one, other = one[same], other[same]
    behind, before = (agreement(b[one], b[other], np.minimum(s[one], s[other])) for b, s in zip(bytes_, sizes))
    rows = np.concatenate([one, other])
    own = table.select(OWN).take(pa.array(rows))
    low, high, most = (pa.array(np.tile(x, 2).astype(np.int32)) for x in (-before, behind - LENGTH, behind if side == "behind" else before))
    second = pa.array(np.repeat([False, True], len(one)))
    nothing = pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.binary())
    out = pa.Table.from_arrays([*own.columns, low, high, most, second, *nothing], schema=MATCH)
    return out, order


def dealt(found: DataFrame, side: str) -> DataFrame:
    """Suffixes in buckets of about equal size, by all that tells them apart: however many share an anchor and what follows."""
    other = next(name for name in SIDES if name != side)
    buckets = max(12, partitions(found.sparkSession), -(-found.count() // PER_BUCKET))
    return found.repartitionByRange(buckets, "anchor", side, other)


def neighbours(found: DataFrame, side: str) -> DataFrame:
    """Shared windows of neighbours in one order of suffixes, bucket by bucket and across buckets."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        table = pa.Table.from_batches(kept).combine_chunks()
        out, order = compared(table, side)
        yield from out.to_batches()
        ends = table.take(pa.array(order[[0, -1]]))
        zero = pa.nulls(2, pa.int32())
        edge = pa.Table.from_arrays(
            [*ends.select(OWN).columns, zero, zero, zero, pa.nulls(2, pa.bool_()), pa.array([TaskContext.get().partitionId()] * 2, pa.int32()), pa.array([0, 1], pa.int32()),
             ends.column("before"), ends.column("behind")], schema=MATCH)
        yield from edge.to_batches()

    matches = freeze(dealt(found, side).mapInArrow(sort, MATCH_DDL), "neighbours")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        edges = pa.Table.from_batches(kept).sort_by([("bucket", "ascending"), ("edge", "ascending")]).combine_chunks()
        for at in range(1, len(edges) - 1, 2):
            out, _ = compared(edges.slice(at, 2).combine_chunks(), side)
            yield from out.to_batches()

    # two rows per bucket
    edges = matches.where("edge IS NOT NULL").coalesce(1).mapInArrow(across, MATCH_DDL)
    return matches.where("edge IS NULL").unionByName(edges).select(*OWN, "low", "high", F.lit(side).alias("side"), "most", "second")


def shown(found: DataFrame) -> DataFrame:
    """doc_id, text_id, start, end: repeated stretches of regions that occur once as a whole."""
    pairs = freeze(neighbours(found, "behind").unionByName(neighbours(found, "before")), "pairs")
    own_low, own_high = F.col("first") - F.col("at"), F.col("first") - F.col("at") + F.col("windows") - 1
    clipped = pairs.withColumns({"low": F.greatest("low", own_low), "high": F.least("high", own_high)})
    direct = clipped.where("single AND low <= high").select(
        "doc_id", "text_id", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high") + LENGTH).alias("end"))
    # offsets within both bounds, and those that neighbours have shown: at most four neighbours, times cut texts
    shared = F.when(F.col("low") <= F.col("high"), F.struct("low", "high"))
    bounds = clipped.groupBy("anchor", "content").agg(
        F.max(F.when(F.col("side") == "before", F.col("most"))).alias("most_before"),
        F.max(F.when(F.col("side") == "behind", F.col("most"))).alias("most_behind"),
        F.first("single").alias("single"), F.first(own_low).alias("own_low"), F.first(own_high).alias("own_high"),
        F.collect_list(shared).alias("seen"),
        F.collect_list(F.when((F.col("side") == "behind") & F.col("second"), shared)).alias("spoken_for"))
    low, high = F.greatest(-F.col("most_before"), F.col("own_low")), F.least(F.col("most_behind") - LENGTH, F.col("own_high"))
    bounds = freeze(bounds.select("anchor", "content", "single", low.alias("low"), high.alias("high"), "seen", "spoken_for").where("low <= high"), "bounds")
    lies_in = lambda offset, stretches: F.exists(stretches, lambda s: (s["low"] <= offset) & (offset <= s["high"]))
    regions_of = bounds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    asked = (
        bounds.where("single")
        .select("anchor", F.explode(F.filter(F.sequence("low", "high"), lambda o: ~lies_in(o, "seen"))).alias("offset"))
        .groupBy("anchor").agg(F.collect_set("offset").alias("offsets"))  # at most LENGTH offsets
        .join(regions_of, "anchor"))
    wanted = F.filter("offsets", lambda o: (F.col("low") <= o) & (o <= F.col("high")) & ~lies_in(o, "spoken_for"))
    open_ = met(bounds, freeze(asked, "asked"), ["anchor"]).select("anchor", "content", wanted.alias("offsets")).where(F.size("offsets") > 0)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text, first = row["before"][::-1] + row["behind"], row["first"] - row["at"]
                for offset in row["offsets"]:
                    piece = text[offset - first:offset - first + LENGTH]
                    one, two = np.frombuffer(xxhash.xxh3_128_digest(piece), "<i8").tolist()
                    out.append((row["anchor"], offset, one, two, row["content"], row["single"], row["doc_id"], row["text_id"], row["at"] + offset))
            if out:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 ["anchor", "offset", "one", "two", "content", "single", "doc_id", "text_id", "start"])

    looked = freeze(found.join(open_, ["anchor", "content"]).mapInArrow(
        windows, "anchor long, offset int, one long, two long, content long, single boolean, doc_id long, text_id long, start int"), "windows")
    key = ["anchor", "offset", "one", "two"]
    twice = looked.groupBy(*key).agg(F.min("content").alias("x"), F.max("content").alias("y")).where("x <> y").select(*key)
    more = looked.where("single").join(twice, key, "left_semi").select("doc_id", "text_id", "start", (F.col("start") + LENGTH).alias("end"))
    return direct.unionByName(more)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, start, end: byte stretches made of repeated strings; they may overlap."""
    every = freeze(found_regions(docs), "every")
    often = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    doubtful = freeze(met(every, freeze(often, "often"), ["anchor"]), "regions")
    kinds = doubtful.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "text_id", "first", "windows", "at")).alias("one"))
    kinds = freeze(kinds.select("anchor", "content", "n", (F.col("n") == 1).alias("single"), "one.*"), "kinds")
    uneven = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("open")).where("open AND n > 1").select("anchor", "n")
    found = suffixes(met(kinds.drop("n"), freeze(uneven, "uneven"), ["anchor"]), docs)
    whole = met(doubtful, kinds.where("NOT single").select("anchor", "content", "n"), ["anchor", "content"]).select(
        "doc_id", "text_id", F.col("first").alias("start"), (F.col("first") + F.col("windows") - 1 + LENGTH).alias("end"))
    return whole.unionByName(shown(found))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_kept, n_spans, kept_sha256: a row per row of ``docs``."""
    with short_batches(docs.sparkSession, ROWS):
        return freeze(_without_repeats(docs), "kept")


def _without_repeats(docs: DataFrame) -> DataFrame:
    known = identified(docs)
    spans = repeated(known).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = known.alias("d").join(
        spans.hint("shuffle_hash").alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_id") == F.col("s.text_id")), "left"
    ).select("d.doc_id", "d.text", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch, out = whole.slice(at, ROWS), []
                for text, stretches in zip(batch.column("text"), batch.column("spans")):
                    data, cut = text.as_py().encode("utf-8", "surrogatepass"), []
                    for s in sorted((s["start"], s["end"]) for s in stretches.as_py() or ()):
                        if cut and s[0] <= cut[-1][1]:
                            cut[-1][1] = max(cut[-1][1], s[1])
                        else:
                            cut.append([*s])
                    kept = b"".join(data[a:b] for a, b in zip([0, *(c[1] for c in cut)], [*(c[0] for c in cut), len(data)]))
                    out.append((len(data), len(data) - len(kept), len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())))],
                    ["doc_id", "n_bytes", "n_removed", "n_kept", "n_spans", "kept_sha256"])

    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_kept long, n_spans long, kept_sha256 string")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir))
