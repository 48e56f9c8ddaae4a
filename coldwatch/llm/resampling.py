"""Importance resampling towards a target distribution, drawn by parallel sorting with regular samples.

1.  Texts are lower-cased (A-Z only); a word is a run of bytes of 0-9, a-z or beyond ASCII. Features are all runs of
    1 to 2 words, repeats counted, and fall into ``BUCKETS`` by their crc32. That of a pair is worked out from those of
    its words: checksums are linear, so the first word's is moved on by as many zero bytes as follow and joined to the rest's.
    A document's bucket numbers are written once, two bytes each.
2.  Counts per bucket over all documents and over the target texts give an array of ``BUCKETS`` gains; a document's
    weight is the floored mean over its features. Only this array goes through the driver. A hash of doc_id adds Gumbel noise, so the
    highest scores are a draw without replacement in proportion to exp(weight / 1000).
3.  Each task's rows are a run, sorted by score (high first), doc_id (NULL last), then by what else they hold, and run. Regular
    samples of the runs, at most ``SAMPLES`` in all, give splitters; rows are exchanged by the segment between two
    splitters, a segment is sorted, and counts of the segments before it turn places into exact ranks. As runs and places make all
    keys distinct, no segment can hold many more rows than others, however many scores are alike.

NULL text has no words. A document without features has weight 0. NULL doc_id hashes as empty text. Repeated rows are rows of their own, with the
same score; their ranks are consecutive. Texts of any length are read whole. An empty target gives each bucket the gain of
its absence. Columns other than doc_id and text are not read.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from coldwatch.llm.sharding import CRC32, crc32_sql
from coldwatch.llm.tables import documents, long_rows, partitions
from coldwatch.session import freeze

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
SAMPLES = 1 << 16
ROWS_PER_SEGMENT = 200_000
WORDS_KEPT = 1 << 20       # entries of a worker's table of words
BYTES_KEPT = 64 << 20      # and the bytes of these words
WORDS_AT_ONCE = 1 << 20
SHORT = 64                 # longer words are checked byte by byte


def _moves() -> np.ndarray:
    """moves[n][k][b]: byte k of a checksum, of value b, moved on by n zero bytes."""
    byte = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        byte[b] = c
    table = np.zeros((SHORT + 1, 4, 256), np.uint32)
    for k in range(4):
        table[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHORT + 1):
        table[n] = (table[n - 1] >> np.uint32(8)) ^ byte[table[n - 1] & np.uint32(255)]
    return table


class Words:
    """Numbers of words and, by number, their checksums alone and behind a space. A worker keeps one."""

    def __init__(self):
        self.moves = _moves()
        self.plain = bytes.maketrans(
            bytes(range(128)), bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)))
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.bytes = 0
        self.alone, self.behind, self.length = (np.zeros(1024, np.uint32) for _ in range(3))

    def split(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").translate(self.plain).split()

    def numbered(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        if len(numbers) > WORDS_KEPT or self.bytes > BYTES_KEPT:
            self.clear()
            numbers = self.numbers
        try:
            return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in numbers]
        first = len(numbers)
        while first + len(new) > len(self.alone):
            self.alone, self.behind, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.alone, self.behind, self.length))
        numbers.update(zip(new, range(first, first + len(new))))
        place = slice(first, first + len(new))
        self.alone[place] = np.fromiter(map(zlib.crc32, new), np.uint32, len(new))
        self.behind[place] = np.fromiter((zlib.crc32(b" " + w) for w in new), np.uint32, len(new))
        self.length[place] = np.fromiter((len(w) + 1 for w in new), np.uint32, len(new))
        self.bytes += sum(map(len, new))
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def checksums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """crc32 of each word, and of each pair of neighbours with a space between."""
        at = self.numbered(words)
        alone = self.alone[at]
        left, rest, n = alone[:-1], self.behind[at[1:]], self.length[at[1:]]
        far = n > SHORT
        flat, base = self.moves.reshape(-1), np.where(far, 0, n).astype(np.int64) * 1024
        byte = np.uint32(255)
        pairs = rest.copy()
        for k in range(4):
            pairs ^= flat[base + 256 * k + ((left >> np.uint32(8 * k)) & byte)]
        for i in np.flatnonzero(far):
            pairs[i] = zlib.crc32(b" " + words[i + 1], int(left[i]))
        return alone, pairs


@cache
def vocabulary() -> Words:
    return Words()


def bucket_numbers(texts: list[str | None], buckets: int = BUCKETS) -> list[tuple[int, np.ndarray]]:
    """For each text its number of words and the buckets of its features (words first, then pairs)."""
    table, out = vocabulary(), []
    for text in texts:
        words = table.split(text) if text else []
        if not words:
            out.append((0, np.zeros(0, np.uint16)))
            continue
        parts, pairs = [], []
        for start in range(0, len(words), WORDS_AT_ONCE):  # a piece starts with the last word of the one before
            first = max(0, start - 1)
            one, two = table.checksums(words[first:start + WORDS_AT_ONCE])
            parts.append(one[start - first:])
            pairs.append(two)
        out.append((len(words), (np.concatenate(parts + pairs) % np.uint32(buckets)).astype(np.uint16)))
    return out


FEATURES = "doc_id long, n_words long, buckets binary"
COUNTS = "bucket int, n long"


def features(docs: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets: two bytes a feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit two bytes")
    long_rows(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = bucket_numbers(part.column(1).to_pylist(), buckets)
                yield pa.record_batch([
                    part.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([b.tobytes() for _, b in found], pa.binary()),
                ], ["doc_id", "n_words", "buckets"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(read, FEATURES)


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall into each bucket: summed in each task, then over tasks; ``buckets`` numbers reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), np.uint16), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in rows.select("buckets").mapInArrow(count, COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain: floor(1000 * ln of its share in the target over its share in all), both shares smoothed by one."""
    size = len(raw)
    all_raw, all_target = float(raw.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, the same at every run."""
    text = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, weights = batch.column(0), [], []
            for value in batch.column(2):
                held = np.frombuffer(value.as_buffer(), np.uint16)
                sizes.append(len(held))
                weights.append(int(gain[held].sum()) // len(held) if len(held) else 0)
            scores = [w + noise(i, seed) for w, i in zip(weights, ids.to_pylist())]
            yield pa.record_batch([ids, batch.column(1), *(pa.array(c, pa.int64()) for c in (sizes, weights, scores))],
                                  ["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


KEY = ("score", "doc_id", "n_features", "weight", "run", "place")


def order() -> list:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")]


def key_of(score: int, doc_id: int | None, *rest: int) -> tuple:
    """What ``order`` sorts by, then run and place: smaller is earlier, and no two rows are alike."""
    return (-score, doc_id is None, doc_id or 0, *rest)


def segmented(runs: DataFrame, cuts: list[tuple]) -> DataFrame:
    """``segment``: how many of the sorted splitters ``cuts`` lie at or before a row."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(*(batch.column(name).to_pylist() for name in KEY))
            yield batch.append_column("segment", pa.array([bisect_right(cuts, key_of(*k)) for k in keys], pa.int32()))

    return runs.mapInArrow(mark, StructType(runs.schema.fields + [StructField("segment", IntegerType())]))


def ranked(rows: DataFrame) -> tuple[DataFrame, int]:
    """``rows`` (doc_id, n_features, weight, score) with ``rank`` 1, 2, 3, ... by ``order``, and their number."""
    spark = rows.sparkSession
    number = F.monotonically_increasing_id()  # the task, then the place within it
    runs = freeze(rows.sortWithinPartitions(*order()).withColumn("number", number).withColumns({
        "run": F.shiftright("number", 33), "place": F.col("number").bitwiseAND((1 << 33) - 1)}).drop("number"), "runs")
    sizes = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("runs")).first()
    segments = min(SAMPLES // 8, max(partitions(spark), -(-total.n // ROWS_PER_SEGMENT)))
    each = max(1, min(segments, SAMPLES // max(total.runs, 1)))
    step = F.floor(F.col("n") / (each + 1)) + 1
    picked = runs.join(sizes.select("run", step.alias("step")), "run").where((F.col("place") + 1) % F.col("step") == 0)
    samples = sorted(key_of(*row) for row in picked.select(*KEY).collect())
    cuts = sorted({samples[i * len(samples) // segments] for i in range(1, segments)}) if samples else []
    marked = freeze(segmented(runs, cuts), "segments")
    earlier = W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)  # a row per segment, SAMPLES / 8 at most
    offsets = freeze(marked.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).select(
        "segment", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "offsets")
    place = F.row_number().over(W.partitionBy("segment").orderBy(*order(), "run", "place"))
    return marked.join(offsets, "segment").withColumn("rank", F.col("before") + place).drop("segment", "before", "run", "place"), total.n


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
              target_key: str = "item_id", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: every document; ``rank`` is NULL where it isn't drawn.

    Of the N documents of at least ``least_words`` words, floor(percent * N / 100) are drawn.
    """
    held = freeze(features(docs, buckets=buckets), "features")
    gain = gains(bucket_counts(held, buckets), bucket_counts(features(target, target_key, buckets), buckets))
    rows = freeze(scored(held, gain, seed), "scores")
    able, n = ranked(rows.where(F.col("n_words") >= least_words))
    drawn = percent * n // 100
    return able.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampled(documents(spark, sf_dir), target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = f"""
WITH RECURSIVE {CRC32.strip()}
texts AS (
    SELECT row_number() OVER () AS id, doc_id, text, 0 AS kind FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, text, 1 FROM benchmark),
words AS (
    SELECT id, doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM texts),
features AS (
    SELECT id, kind, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM words),
known AS (
    SELECT feature, {crc32_sql("feature")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM features), bytes),
held AS (SELECT id, kind, bucket, count(*) AS n FROM features JOIN known USING (feature) GROUP BY ALL),
counts AS (SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t FROM held GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counts),
gain AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + {BUCKETS}))))::BIGINT AS gain
    FROM counts, sums),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM held JOIN gain USING (bucket) WHERE kind = 0 GROUP BY id),
scores AS (
    SELECT id, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words LEFT JOIN weights USING (id) WHERE kind = 0),
able AS (
    SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS rank, {PERCENT} * count(*) OVER () // 100 AS drawn
    FROM scores WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, rank FROM scores LEFT JOIN (SELECT id, rank FROM able WHERE rank <= drawn) USING (id)
"""
