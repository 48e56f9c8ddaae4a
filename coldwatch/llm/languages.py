"""Language identification by nearest centroids of character n-gram vectors.

A text's vector counts its runs of one to three characters (lower case; what is no letter is one
blank), hashed to ``BUCKETS`` places, damped by logarithm, weighted by inverse document frequency and
normalised. ``train`` clusters each language's vectors by spherical k-means into at most ``CENTROIDS``
centroids of ``MEMBERS`` texts or more, from about ``PER_LANGUAGE`` documents of each language, drawn by a hash of doc_id: the one bounded sample
here. ``predict`` reads whole texts; the language is that of the nearest centroid by cosine, the score that cosine.

A text is rejected if it has no letter (``und``, score 0), or if its cosine is below the limit of its length class (numbers of
n-grams from one power of two to the next). The limit is the ``QUANTILE`` of held-back cosines: half of each language's
sample against centroids of the other half, and the other way round, whole and cut to each length. Classes with fewer than
``SEEN`` of them are taken together with shorter ones. Rejection is a column; the prediction stays.

NULL text has no letter. NULL labels aren't learnt from. Without any training document all predictions
are ``und``. Repeated rows are kept; ``predict`` keeps the given columns (its own names must be free).
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.tables import documents, free_name, lean
from coldwatch.session import freeze

BUCKETS = 4096
CENTROIDS = 4
PER_LANGUAGE = 400
ROUNDS = 12
MEMBERS = 5
QUANTILE = 0.01
SEEN = 400
CUTS = range(2, 16)  # powers of two
CLASSES = 40
UNKNOWN = "und"
CHARS_AT_ONCE, TEXTS_AT_ONCE = 1 << 18, 64
FACTORS = tuple(np.uint32(f) for f in (2654435761, 2246822519, 3266489917))  # fixed values: odd multipliers


@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, a row per text, for few texts at a time."""
    joined = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 1 for t in texts])[:len(joined)]
    letter = letters()[joined]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters only the first behind a letter, as a blank
    codes, owner = np.where(letter, joined, 32)[keep].astype(np.uint32), owner[keep]
    out = np.zeros(len(texts) * BUCKETS)
    if not len(codes):
        return out.reshape(len(texts), BUCKETS)
    mixed = np.zeros(len(codes), np.uint32)
    for n, factor in enumerate(FACTORS):
        size = len(codes) - n
        if size <= 0:
            break
        mixed = (mixed[:size] + codes[n:] * factor) * FACTORS[0]
        place = ((mixed ^ (mixed >> 15)) * FACTORS[1]) >> 20
        same = owner[:size] == owner[n:]
        out += np.bincount((owner[:size] * BUCKETS + place)[same], minlength=len(out))
    return out.reshape(len(texts), BUCKETS)


def vectors(texts: list[str], idf: np.ndarray | None) -> Iterator[np.ndarray]:
    """Normalised TF-IDF rows in blocks (raw counts without ``idf``); rows without letters are zero."""
    for block in blocks(texts):
        yield block if idf is None else weighted(block, idf)


def weighted(block: np.ndarray, idf: np.ndarray) -> np.ndarray:
    block = np.log1p(block) * idf
    return block / np.maximum(np.sqrt((block * block).sum(1, keepdims=True)), 1e-12)


def blocks(texts: list[str]) -> Iterator[np.ndarray]:
    """Counts of texts, few at a time."""
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and end - at < TEXTS_AT_ONCE and (end == at or chars + len(texts[end]) <= CHARS_AT_ONCE):
            chars += len(texts[end])
            end += 1
        yield counts(texts[at:end])
        at = end


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray


def clusters(rows: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means, from k-means++ starts; those of fewer than ``MEMBERS`` rows give way to the others."""
    draw = np.random.default_rng(k)
    starts = [int(draw.integers(len(rows)))]
    while len(starts) < min(k, len(rows)):
        far = np.maximum(1 - (rows @ rows[starts].T).max(1), 0)
        if far.sum() < 1e-9:
            break
        starts.append(int(draw.choice(len(rows), p=far / far.sum())))
    centroids = rows[starts]
    for _ in range(ROUNDS):
        nearest = (rows @ centroids.T).argmax(1)
        size = np.bincount(nearest, minlength=len(centroids))
        sums = np.stack([rows[nearest == i].sum(0) for i in np.flatnonzero(size >= min(MEMBERS, size.max()))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def length_class(size: np.ndarray) -> np.ndarray:
    """The class of texts with so many n-grams."""
    return np.minimum(np.log2(np.maximum(size, 1)).astype(int), CLASSES - 1)


def held_back(texts: list[str], rows: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length classes and cosines of each half of the texts, whole and cut, with centroids of the other half."""
    half = np.random.default_rng(0).permutation(len(texts)) % 2
    classes, cosines = [np.empty(0, int)], [np.empty(0)]
    for side in (0, 1):
        if not (half != side).any():
            continue
        centroids = clusters(rows[half != side], CENTROIDS)
        own = [t for t, h in zip(texts, half) if h == side]
        for raw in blocks([*own, *(t[:1 << c] for t in own for c in CUTS if len(t) > 1 << c)]):
            block = weighted(raw, idf)
            known = block.any(1)
            classes.append(length_class(raw.sum(1))[known])
            cosines.append((block @ centroids.T).max(1)[known])
    return np.concatenate(classes), np.concatenate(cosines)


def limits(classes: np.ndarray, cosines: np.ndarray) -> np.ndarray:
    """The limit of each length class; 0 where nothing is known of it or of shorter ones."""
    out = np.zeros(CLASSES)
    for c in range(CLASSES):
        low = next((x for x in range(c, 0, -1) if ((classes >= x) & (classes <= c)).sum() >= SEEN), 0)
        seen = cosines[(classes >= low) & (classes <= c)]
        if len(seen):
            out[c] = np.quantile(seen, QUANTILE, method="lower")
    return out


def train(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, lang); rows without text or lang are left out."""
    known = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    # written once, a row per language: of known size, the join with it moves no text
    share = freeze(known.groupBy("lang").agg((F.lit(PER_LANGUAGE) / F.count(F.lit(1))).alias("share")), "shares")
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("language")), 11) / F.lit(float(1 << 53))
    sample = freeze(known.join(share, "lang").where(draw < F.col("share")).select("lang", "text"), "language-sample")

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            have, rows = np.zeros(BUCKETS), 0
            for block in vectors(frame["text"].tolist(), None):
                have += (block > 0).sum(0)
                rows += int((block.sum(1) > 0).sum())
            yield pd.DataFrame({"rows": [rows], "have": [have.tolist()]})

    parts = sample.mapInPandas(seen, "rows long, have array<double>").collect()  # a row per batch of the bounded sample
    total, have = sum(p.rows for p in parts), sum((np.array(p.have) for p in parts), np.zeros(BUCKETS))
    idf = np.log((total + 1) / (have + 1)) + 1

    def cluster(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame["text"].sort_values().tolist()
        rows = np.vstack([*vectors(texts, idf)])
        texts, rows = [t for t, known in zip(texts, rows.any(1)) if known], rows[rows.any(1)]
        if not len(rows):
            return pd.DataFrame({"lang": [], "centroid": [], "classes": [], "cosines": []})
        classes, cosines = held_back(texts, rows, idf)
        found = clusters(rows, CENTROIDS).tolist()
        nothing = [[]] * (len(found) - 1)
        return pd.DataFrame({"lang": key[0], "centroid": found, "classes": [classes.tolist(), *nothing], "cosines": [cosines.tolist(), *nothing]})

    rows = sample.groupBy("lang").applyInPandas(cluster, "lang string, centroid array<double>, classes array<int>, cosines array<double>").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.centroid))  # CENTROIDS rows per language
    classes, cosines = (np.array([x for r in rows for x in r[name]]) for name in ("classes", "cosines"))
    return Model([r.lang for r in rows], np.array([r.centroid for r in rows], np.float32).reshape(-1, BUCKETS), limits(classes, cosines), idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The given columns with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS rows per language, of fixed width
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN])

        def judged(column: pa.Array) -> pa.Array:
            out = []
            parts = (column.slice(at, TEXTS_AT_ONCE).to_pylist() for at in range(0, len(column), TEXTS_AT_ONCE))
            for raw in (raw for part in parts for raw in blocks([t or "" for t in part])):
                block, size = weighted(raw, known.idf), raw.sum(1)
                if known.languages:
                    cosines = block.astype(np.float32) @ known.centroids.T
                    best = cosines.argmax(1)
                    score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
                else:
                    best, score = np.full(len(block), -1), np.zeros(len(block))
                empty = ~block.any(1)
                best, score = np.where(empty, len(known.languages), best), np.where(empty, 0.0, score)
                out.append((names[best], score, empty | (score < known.limits[length_class(size)])))
            columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], fields=list(schema))

        yield from lean(map(judged, batches))

    name = free_name(docs, "guess")
    guess = docs.withColumn(name, nearest(F.col("text").cast("string")))
    return guess.select(*(F.col(f"`{c}`") for c in docs.columns), f"{name}.*")


def known_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are not rejected, with their own columns, whatever these are called."""
    mark = free_name(docs, "judged")
    judged = predict(docs.select(F.struct("*").alias(mark), "text"), model).where("NOT rejected")
    return judged.select(f"{mark}.*")


def held_out() -> Column:
    """One document in four by the CRC of its id; NULL ids are neither learnt from nor held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnt_from(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), train(learnt_from(docs))).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")
