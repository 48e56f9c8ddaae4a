"""What the text operators share: reading the tables, ordered buckets, a bounded memo."""
from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 100_000
SPLITTERS = 255


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def long_rows(spark: SparkSession, most: int = 1000) -> None:
    """Lets Arrow batches hold fewer rows than Spark's 10,000, as rows with whole texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))


@contextmanager
def short_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """While it lasts, Arrow batches hold ``most`` rows at most; then the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    long_rows(spark, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@cache
def _trim():
    """The C library's own call for it, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def lean(parts: Iterator, every: int = 16) -> Iterator:
    """Passes ``parts`` on. A Python worker outlives its task: what its allocators hold free goes back to the system, now and then and at the end."""
    try:
        for n, part in enumerate(parts, 1):
            yield part
            if n % every == 0:
                pa.default_memory_pool().release_unused()
                _trim()(0)
    finally:
        pa.default_memory_pool().release_unused()
        _trim()(0)


class Buckets:
    """Consecutive ranges of a whole-number key with about equal rows each.

    One aggregate over the key column gives at most ``SPLITTERS`` quantiles; where more buckets are
    wanted, each range between two quantiles is cut into equal widths. The splitters become
    literals, so every stage, and every retry of one, deals rows out alike. Equal keys share
    a bucket. NULL keys come first, in bucket 0.
    """

    def __init__(self, df: DataFrame, key: str, rows_per_bucket: int = ROWS_PER_BUCKET):
        wanted = 2 * partitions(df.sparkSession)
        cut = [(i + 1) / (SPLITTERS + 1) for i in range(SPLITTERS)]
        row = df.agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"),
            F.percentile_approx(key, cut, 10_000).alias("cuts"),
        ).first()
        self.rows = row.n
        wanted = max(wanted, -(-row.n // rows_per_bucket))
        cuts = sorted({int(c) for c in row.cuts or ()} - {row.low})
        if wanted <= len(cuts):
            step = len(cuts) / wanted
            cuts = sorted({cuts[int(i * step)] for i in range(wanted)})
        self.cuts = cuts
        self.slices = max(1, -(-wanted // (len(cuts) + 1)))
        self.edges = [row.low, *cuts, None if row.high is None else row.high + 1]
        self.count = 1 + (len(cuts) + 1) * self.slices

    def number(self, key: Column) -> Column:
        """The bucket of ``key``: a tree of comparisons, eight deep at most, then a division."""
        def walk(low: int, high: int) -> Column:
            if low == high:
                first = 1 + low * self.slices
                if self.slices == 1 or self.edges[low] is None:
                    return F.lit(first)
                left, right = self.edges[low], self.edges[low + 1]
                width = max(1, -(-(right - left) // self.slices))
                return (F.lit(first) + ((key - F.lit(left)) / F.lit(width)).cast("int")).cast("int")
            middle = (low + high + 1) // 2
            return F.when(key < F.lit(self.cuts[middle - 1]), walk(low, middle - 1)).otherwise(walk(middle, high))

        return F.when(key.isNull(), F.lit(0)).otherwise(walk(0, len(self.cuts))).cast("int")


class Memo(dict):
    """Results by input within one Python worker, at most about ``limit`` of them.

    When full, the older half goes; what is needed again is computed again.
    """

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit = compute, limit

    def room(self, items: int) -> None:
        """Makes room for so many new items."""
        if len(self) + items > self.limit:
            for old in list(islice(self, max(self.limit // 2, len(self) + items - self.limit))):
                del self[old]

    def __missing__(self, item):
        self.room(1)
        value = self[item] = self.compute(item)
        return value
