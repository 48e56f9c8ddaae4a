"""Near-duplicate vectors by product quantisation, with every link found.

Vectors that are equal in label and components are one class with a count. Classes are scaled to length 1, where a cosine of
``c`` is a distance of ``sqrt(2 - 2c)``, the *reach*.

1.  *Coarse lists.* Centroids of k-means on one bounded sample (``SAMPLE`` vectors) deal the classes of a label to lists; the
    rest to the centroid is coded in ``PARTS`` subspaces by the nearest of ``CODES`` codewords each (trained on the same
    sample's rests), and how far the code is from the vector is kept with it.
2.  *Sufficient probes.* A query looks into each list whose dividing plane to the query's own list is within
    reach: whatever lies in another list is out of reach. No number of probes is set.
3.  *Table lookups.* In a list, the distances from the query's rest to all codewords form a table; a code's distance is a sum of
    lookups. It is off by at most what was kept with the code, so only sums above reach plus that are passed over.
4.  What is left is compared by exact cosine in double precision.

The bounds make recall 1 whatever the sample was. Lists are cut into blocks of about ``BLOCK`` classes by hash of
the class, queries likewise, so a list with any share of all vectors is many small tasks.
A task gives each query's number of links and, for components, the links of a forest.

Vectors that are NULL, have a NULL label, length 0 or NULL or non-finite components link with nothing; so do vectors of different
dimension. Repeated rows count as other vectors; rows that share a vec_id are vectors of their own.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.components import components
from coldwatch.llm.tables import embeddings, partitions
from coldwatch.session import freeze

COSINE = 0.98
SAMPLE = 8192
LISTS = 1024
BLOCK = 1024
PARTS, CODES = 8, 32
ROUNDS = 8
SLACK = 1e-6


def usable(column: str) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.forall(column, fine) & F.exists(column, lambda x: x != 0)


def k_means(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    k = min(k, len(rows))
    centroids = rows[np.random.default_rng(seed).choice(len(rows), k, replace=False)]
    for _ in range(ROUNDS):
        near = nearest(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        size = np.bincount(near, minlength=k)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centroids)
    return centroids


def squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum((rows * rows).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(1), 0)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(rows[i:i + 4096], centroids).argmin(1) for i in range(0, len(rows), 4096)])


@dataclass
class Quantizer:
    centroids: np.ndarray  # lists x dimension
    codebooks: np.ndarray  # parts x codes x dimension of a part
    reach: float

    def parts(self, rests: np.ndarray) -> np.ndarray:
        """Rests as rows x parts x dimension of a part, filled up with zeros."""
        count, _, width = self.codebooks.shape
        full = np.zeros((len(rests), count * width))
        full[:, :rests.shape[1]] = rests
        return full.reshape(len(rests), count, width)

    def codes(self, rests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each from its rest."""
        parts = self.parts(rests)
        codes = np.stack([nearest(parts[:, m], book) for m, book in enumerate(self.codebooks)], 1)
        decoded = np.stack([book[codes[:, m]] for m, book in enumerate(self.codebooks)], 1)
        return codes.astype(np.uint8), np.sqrt(((parts - decoded) ** 2).sum((1, 2)))

    def probes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own list of each row; and (row, list) for all lists within reach."""
        far = squares(rows, self.centroids)
        own = far.argmin(1)
        apart = np.sqrt(squares(self.centroids, self.centroids))[own]
        plane = (far - far[np.arange(len(rows)), own][:, None]) / np.maximum(2 * apart, 1e-12)
        row, other = np.nonzero((plane <= self.reach + SLACK) | (apart < 1e-9))
        return own, row, other

    def sums(self, rests: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to codes by table lookup."""
        parts, out = self.parts(rests), np.zeros((len(rests), len(codes)))
        for m, book in enumerate(self.codebooks):
            out += squares(parts[:, m], book)[:, codes[:, m]]
        return np.sqrt(out)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def stacked(column: pd.Series | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_numpy() if isinstance(column, pd.Series) else column.to_pylist()), np.float64).reshape(len(column), -1)


def trained(classes: DataFrame, dimension: int, rows: int, groups: int, cosine: float) -> Quantizer:
    """A quantiser from a bounded sample of one dimension's vectors."""
    lists = int(min(LISTS, max(1, rows // (BLOCK * max(1, groups)))))
    share = min(1.0, SAMPLE / rows)
    draw = F.shiftrightunsigned(F.xxhash64("vector"), 11) / F.lit(float(1 << 53))
    sample = classes.where((F.col("dimension") == dimension) & (draw < share)).select("vector").repartition(1)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors = pd.concat([f["vector"] for f in frames] or [pd.Series(dtype=object)]).sort_values()
        if not len(vectors):
            return
        data = unit(stacked(vectors))
        centroids = k_means(data, lists, 1)
        empty = Quantizer(centroids, np.zeros((PARTS, 1, -(-dimension // PARTS))), 0.0)
        rests = empty.parts(data - centroids[nearest(data, centroids)])
        books = [k_means(rests[:, m], CODES, 2 + m) for m in range(PARTS)]
        yield pd.DataFrame({"name": ["centroids", "codebooks"], "data": [centroids.tobytes(), np.stack(books).tobytes()]})

    found = {r.name: np.frombuffer(r.data) for r in sample.mapInPandas(train, "name string, data binary").collect()}  # two rows of fixed size
    width = -(-dimension // PARTS)
    centroids = found.get("centroids", np.zeros(dimension)).reshape(-1, dimension)
    return Quantizer(centroids, found.get("codebooks", np.zeros(PARTS * width)).reshape(PARTS, -1, width), float(np.sqrt(2 - 2 * cosine)))


def placed(classes: DataFrame, model: Quantizer) -> DataFrame:
    """Classes with label and own list, and a row for each list that they probe as a query."""
    shared = classes.sparkSession.sparkContext.broadcast(model)  # at most LISTS centroids

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, row, other = shared.value.probes(unit(stacked(batch.column("vector"))))
                taken = batch.select(["cid", "label", "vectors", "vector"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(other.astype(np.int32)), pa.array(own[row] == other)],
                                                 ["cid", "label", "vectors", "vector", "list", "own"])

    return classes.mapInArrow(place, "cid long, label string, vectors long, vector binary, list int, own boolean")


def forest(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of linked pairs and the least id that each reaches within these links."""
    ids, flat = np.unique(np.concatenate([one, other]), return_inverse=True)
    a, b = flat[:len(one)], flat[len(one):]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return ids, ids[label]
        label = low


def links(classes: DataFrame, model: Quantizer, cosine: float) -> DataFrame:
    """a, b, n: rows with b NULL give how many vectors ``a``'s links hold; the others are links of a forest."""
    rows = freeze(placed(classes, model), "placed")
    sizes = rows.groupBy("label", "list").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("own").cast("int")) / BLOCK)).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("asking"))
    sized = rows.join(sizes, ["label", "list"])
    held = sized.where("own").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks"))).withColumn(
        "ask", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)))
    asked = sized.withColumn("ask", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("asking")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["label", "list", "block", "ask"]
    names = [*key, "cid", "vectors", "vector"]
    # named anew, as both sides come from one table
    cast = lambda df: df.select("label", "list", F.col("block").cast("int"), F.col("ask").cast("int"), *names[4:]).toDF(*names).repartition(count, *key)
    count = max(12, partitions(classes.sparkSession))
    shared = classes.sparkSession.sparkContext.broadcast(model)

    def compare(group: tuple, queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "n": []}
        if len(queries) and len(stored):
            known, x, y = shared.value, unit(stacked(queries["vector"])), unit(stacked(stored["vector"]))
            centre = known.centroids[group[1]]
            codes, off = known.codes(y - centre)
            xs, ys, pairs = queries["cid"].to_numpy(), stored["cid"].to_numpy(), []
            for at in range(0, len(x), 256):
                maybe = known.sums(x[at:at + 256] - centre, codes) <= known.reach + off + SLACK
                row, column = np.nonzero(maybe & (xs[at:at + 256, None] != ys))
                for i in range(0, len(row), 1 << 16):
                    r, c = row[i:i + (1 << 16)] + at, column[i:i + (1 << 16)]
                    linked = (x[r] * y[c]).sum(1) >= cosine
                    pairs.append((r[linked], c[linked]))
            r, c = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.empty(0, int), np.empty(0, int))
            if len(r):
                held = np.bincount(r, stored["vectors"].to_numpy()[c], len(x)).astype(np.int64)
                some = np.flatnonzero(held)
                ids, low = forest(xs[r], ys[c])
                out = {"a": [*xs[some], *ids], "b": [*[None] * len(some), *low], "n": [*held[some], *[0] * len(ids)]}
        return pd.DataFrame(out).astype({"a": "int64", "b": "Int64", "n": "int64"})

    return cast(asked).groupBy(*key).cogroup(cast(held).groupBy(*key)).applyInPandas(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"),
        F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"))  # -0.0 as 0.0
    good = usable("embedding") & F.col("label").isNotNull()
    packed = packed_doubles("embedding")
    rows = rows.select("vec_id", "label", F.size("embedding").alias("dimension"), F.when(good, packed).alias("vector"))
    grouped = rows.where("vector IS NOT NULL").groupBy("label", "dimension", "vector").agg(F.count(F.lit(1)).alias("vectors"))
    classes = freeze(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")
    found = None
    for dimension, n, groups in sorted(classes.groupBy("dimension").agg(F.count(F.lit(1)), F.approx_count_distinct("label")).collect()):
        part = classes.where(F.col("dimension") == dimension)
        some = links(part, trained(classes, dimension, n, groups, cosine), cosine)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"), F.lit(0).cast("long").alias("n")).limit(0)
    found = freeze(found, "vector-links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b IS NOT NULL").select("a", "b"), "vector-parts").withColumnRenamed("id", "cid")
    known = classes.join(counts, "cid", "left").join(parts, "cid", "left").select(
        "label", "dimension", "vector", "vectors", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "cid").alias("component"))
    named = rows.alias("r").join(known.alias("k"), ["label", "dimension", "vector"], "left").select(
        "vec_id", "component", (F.coalesce(F.col("n") + F.col("vectors") - 1, F.lit(0))).alias("n_links"))
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    return named.join(least, "component", "left").select(
        "vec_id", F.col("n_links").cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("least", "vec_id"), F.lit(True)).alias("kept"))


def packed_doubles(column: str) -> Column:
    """The components as little-endian bytes: one key to group by, one buffer to compute on."""
    @F.arrow_udf("binary")
    def pack(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None or any(x is None for x in v) else np.array(v, "<f8").tobytes() for v in values.to_pylist()], pa.binary())

    return pack(column)


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(embeddings(spark, sf_dir))
