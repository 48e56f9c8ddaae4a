"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A document's shingles are its runs of five words (lower case; all words together if there are fewer). The
fingerprint keeps the hash of every shingle below a fixed share of the hash range, ``1 / SCALE``, so sketches grow with
their documents, merge by union, and the share of one sketch found in another estimates
containment however unequal the two are. A document none of whose hashes is below keeps its
least hash, so every document with a word has a fingerprint; one without words has the empty one.

Written as the sorted hashes, twelve hex digits each. Likeness is the shared part of the two sketches'
union (1 for equal fingerprints, two empty ones included; 0 if only one is empty).

``edited`` pairs each document with the next one in ascending doc_id (NULL first, ties by text;
after the last comes the first). Documents are dealt to ranges of doc_id, each with a copy of the next
range's first document at its end, so the next one is read within the range. NULL text counts as empty.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldwatch.llm.tables import Buckets, documents

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SHINGLE = 5
SCALE = 4
BITS = 48
ROWS_PER_RANGE = 20_000


def sketch(words: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted distinct shingle hashes of an array of word hashes, as whole numbers below 2^48."""
    n = F.size(words)
    run = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + k) for k in range(shingle))), 64 - BITS)
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - shingle, F.lit(0))), run)
    below = F.filter(hashes, lambda h: h < (1 << BITS) // scale)
    kept = F.when(F.size(below) > 0, below).otherwise(F.array(F.array_min(hashes)))
    return F.when(n > 0, F.array_sort(F.array_distinct(kept))).otherwise(F.array().cast("array<bigint>"))


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(text), GAP, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def fingerprint(text: Column) -> Column:
    return sketch(word_hashes(text))


def written(hashes: Column) -> Column:
    return F.concat_ws("", F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")))


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / F.greatest(either, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Which share of ``a`` lies in ``b``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def in_ranges(docs: DataFrame) -> DataFrame:
    """place, copy, doc_id, text: documents by range, each range ending with the next one's first document (copy)."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    buckets = Buckets(rows.select("doc_id"), "doc_id", ROWS_PER_RANGE)
    placed = rows.select(buckets.number(F.col("doc_id")).alias("place"), "doc_id", "text")
    # NULL ids sort first, so a range's first document is its least (doc_id, text)
    firsts = placed.groupBy("place").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    order = W.orderBy("place")  # a row per range
    around = W.partitionBy(F.lit(0)).orderBy("place")
    behind = firsts.select(
        F.coalesce(F.lag("place").over(order), F.last("place").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("place"),
        F.lit(True).alias("copy"), "first.doc_id", "first.text")
    return placed.select("place", F.lit(False).alias("copy"), "doc_id", "text").unionByName(behind)


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, hashes, next_hashes: each document, its edited text, and two sketches."""
    order = W.partitionBy("place").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return (
        in_ranges(docs)
        .withColumn("words", word_hashes(F.col("text")))
        .withColumn("hashes", sketch(F.col("words"))).drop("words")
        .withColumns({"next": F.lead("text").over(order), "next_hashes": F.lead("hashes").over(order)})
        .where(~F.col("copy"))
        .select("doc_id", "text", "hashes", "next_hashes",
                F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)).alias("edited"))
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (
        edited(documents(spark, sf_dir))
        .withColumn("words", word_hashes(F.col("edited")))
        .withColumn("edited_hashes", sketch(F.col("words")))
    )
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("hashes")).alias("fingerprint"), written(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
