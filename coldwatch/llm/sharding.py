"""Sharding along a Hilbert curve, in DataFrame functions only.

1.  Each row has a place in a grid with a dimension for every column of ``DIMENSIONS`` and one for its size. A dimension's
    values are quantised by equal shares: a value's step is that of the middle of its rows among all rows in
    order of values (NULL last), of ``2 ** BITS`` steps. Sizes are first rounded down to five significant bits.
2.  Rows are ordered by the curve index of their cell, then by a hash of doc_id, doc_id (NULL first), checksum and
    size. Rows alike in all of these are alike in what is returned.
3.  The order is cut into runs, the shards: by law ``rows`` counts are at most one apart; by law ``bytes``
    a row goes to the shard that the middle of its bytes lies in.

Ranks are exact and no task sees a whole cell: a cell's rows are dealt to chunks by the leading bits of
their hash, a chunk's first rank comes from totals per cell and per chunk, and only a chunk is sorted. Running totals over a
dimension's values are taken in ranges, so many distinct sources are no problem either. The number of
chunks depends on the number of rows; the order does not.

A shard is so a connected part of the curve: few steps in each dimension. ``manifest`` keeps the bounds of
each shard, and ``matching`` names the shards that a filter can concern. Equal texts have equal sizes: where their other
columns agree too, they share a cell, and lie in one shard or in neighbouring ones.

NULL text has size 8 and checksum 0, as the empty text has. NULL doc_id, lang and source are values like others. Repeated rows are
rows of their own. An empty table gives no rows. ``sharded`` keeps all columns and adds one struct, whose
name is free whatever the columns are called.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coldwatch.llm.tables import documents, free_name, partitions
from coldwatch.session import freeze

DIMENSIONS = ("lang", "source")
BITS = 5
SHARDS = 24
EXTRA = 8  # bytes a row has besides its text
ROWS_PER_CHUNK = 50_000
MOST_CHUNK_BITS = 16


def shifted(value: Column, bits: Column, left: bool = False) -> Column:
    return F.call_function("shiftleft" if left else "shiftright", value, bits.cast("int"))


def size_step(size: Column) -> Column:
    """Size to five significant bits, as a whole number that grows with it: 16 steps to a doubling."""
    bits = F.length(F.bin(size))
    return (bits * 16 + shifted(size * 32, bits) - 16).cast("int")


def once(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def hilbert(place: Column, dimensions: int, bits: int) -> Column:
    """The index on the curve of a cell (an array of whole numbers below ``2 ** bits``).

    For each bit from the top but the last, and each axis: where the axis has the bit, the lower bits of the first axis
    are turned over, else they are swapped with those of the axis. A Gray code over axes and bits follows.
    """
    def turn(cell: Column, step: Column) -> Column:
        bit = shifted(F.lit(1), F.lit(bits - 1) - F.floor(step / dimensions), left=True)
        axis = (step % dimensions).cast("int")
        first, own = F.element_at(cell, 1), F.element_at(cell, axis + 1)
        has, low = own.bitwiseAND(bit) != 0, bit - 1
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(cell, lambda value, i: (
            F.when(has, F.when(i == 0, value.bitwiseXOR(low)).otherwise(value))
            .when((axis > 0) & ((i == 0) | (i == axis)), value.bitwiseXOR(swap)).otherwise(value)).cast("int"))

    cell = place.cast("array<int>")
    if bits > 1:
        cell = F.aggregate(F.sequence(F.lit(0), F.lit((bits - 1) * dimensions - 1)), cell, turn)
    powers = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))

    def gray(cell: Column) -> Column:
        """Each axis takes in those before it."""
        return F.transform(F.sequence(F.lit(1), F.lit(dimensions)),
                           lambda n: F.aggregate(F.slice(cell, F.lit(1), n), F.lit(0), lambda a, b: a.bitwiseXOR(b)))

    def flips(code: Column) -> Column:
        def flip(done: Column, power: Column) -> Column:
            bit = shifted(F.lit(1), power, left=True)
            return F.when(F.element_at(code, -1).bitwiseAND(bit) != 0, done.bitwiseXOR(bit - 1)).otherwise(done)

        return F.aggregate(powers, F.lit(0), flip)

    def digits(code: Column) -> Column:
        return F.aggregate(powers, F.lit(0).cast("long"), lambda done, power: F.aggregate(
            code, done, lambda d, v: d * 2 + shifted(v, power).bitwiseAND(F.lit(1))))

    return once(once(cell, gray), lambda code: once(once(flips(code), lambda f: F.transform(code, lambda v: v.bitwiseXOR(f))), digits))


def quantised(profile: DataFrame, names: list[str], bits: int) -> DataFrame:
    """axis, value, step: for each axis and value of it, the step that the middle of its rows falls in.

    ``profile`` has a count ``n`` per combination. Values are ordered in ranges; a range's first row comes from the totals of
    those before it, so that a window sees a range, or one row per range.
    """
    value = F.explode(F.array(*(F.struct(F.lit(i).alias("axis"), F.col(name).alias("value")) for i, name in enumerate(names))))
    order = ("axis", F.col("value").asc_nulls_last())
    counts = profile.select("n", value.alias("v")).groupBy(F.col("v.axis").alias("axis"), F.col("v.value").alias("value")).agg(F.sum("n").alias("n"))
    ranges = freeze(counts.repartitionByRange(partitions(profile.sparkSession), *order).withColumn("part", F.spark_partition_id()), "values")
    earlier = W.partitionBy("axis").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = ranges.groupBy("axis", "part").agg(F.sum("n").alias("m")).select(
        "axis", "part", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("first"),
        F.sum("m").over(W.partitionBy("axis")).alias("all"))
    within = W.partitionBy("axis", "part").orderBy(F.col("value").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("first") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return ranges.join(firsts, ["axis", "part"]).withColumn("before", before).select(
        "axis", "value", F.expr(f"(2 * before + n) * {1 << bits} div (2 * all)").cast("int").alias("step"))


def same(left: str, right: str, names: list[str]) -> Column:
    on = F.lit(True)
    for name in names:
        on = on & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return on


def cells(profile: DataFrame, names: list[str], bits: int) -> DataFrame:
    """names, index, before_rows, before_bytes: the cell of each combination and what lies before the cell."""
    steps = freeze(quantised(profile, names, bits), "steps")
    placed = profile
    for i, name in enumerate(names):
        axis = steps.where(F.col("axis") == i).select(F.col("value").alias("own"), F.col("step").alias(f"step_{i}"))
        placed = placed.join(axis, F.col(name).eqNullSafe(F.col("own"))).drop("own")
    grid = [f"step_{i}" for i in range(len(names))]
    table = freeze(placed, "cells")
    earlier = W.orderBy("index").rowsBetween(W.unboundedPreceding, -1)  # a row per cell, of a grid of fixed size
    totals = table.groupBy(*grid).agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).withColumn(
        "index", hilbert(F.array(*grid), len(grid), bits)).select(
        *grid, "index", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("cell_rows"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("cell_bytes"))
    return freeze(table.join(totals, grid).select(*names, "index", "cell_rows", "cell_bytes"), "curve")


def sharded(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, law: str = "rows",
            bits: int = BITS, keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` of ``docs`` (all) and one struct more (size, text_crc32, index, shard, slot), and the struct's name.

    Reads doc_id, text and ``dimensions`` three times; what is kept travels in one shuffle.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law {law!r} is neither 'rows' nor 'bytes'")
    own, kept = free_name(docs, "place"), docs.columns if keep is None else keep
    names = [f"axis_{i}" for i in range(len(dimensions) + 1)]
    text = F.col("text").cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + EXTRA
    number = F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(
        F.struct(*kept).alias("row"), F.col("doc_id").alias("id"), size.alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"), number.alias("number"),
        *(F.col(d).cast("string").alias(n) for d, n in zip(dimensions, names)), F.lpad(size_step(size), 4, "0").alias(names[-1]))
    profile = freeze(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "profile")
    total = profile.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    chunk_bits = min(MOST_CHUNK_BITS, max(0, total.n // ROWS_PER_CHUNK).bit_length())
    curve = cells(profile, names, bits)
    placed = rows.alias("r").join(curve.alias("c"), same("r", "c", names)).select(
        "r.*", "index", "cell_rows", "cell_bytes", F.shiftright("number", 32 - chunk_bits).alias("chunk"))
    earlier = W.partitionBy("index").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = freeze(placed.groupBy("index", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).select(
        "index", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("chunk_rows"),
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("chunk_bytes")), "chunks")
    order = W.partitionBy("index", "chunk").orderBy("number", F.col("id").asc_nulls_first(), "crc", "size", *names)
    ranked = placed.join(chunks, ["index", "chunk"]).withColumns({
        "rank": F.col("cell_rows") + F.col("chunk_rows") + F.row_number().over(order) - 1,
        "past": F.col("cell_bytes") + F.col("chunk_bytes") + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))})
    if law == "rows":
        cut = ranked.withColumn("shard", F.expr(f"rank * {shards} div {max(total.n, 1)}")).withColumn(
            "slot", F.col("rank") - F.expr(f"(shard * {total.n} + {shards - 1}) div {shards}"))
    else:
        dealt = freeze(ranked.withColumn("shard", F.expr(f"(2 * past - size) * {shards} div {2 * max(total.bytes, 1)}")), "dealt")
        first = dealt.groupBy("shard").agg(F.min("rank").alias("first"))  # a row per shard
        cut = dealt.join(first, "shard").withColumn("slot", F.col("rank") - F.col("first"))
    place = F.struct("size", F.col("crc").alias("text_crc32"), "index", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    return cut.select(*(F.col("row").getField(c).alias(c) for c in kept), place.alias(own)), own


def write(docs: DataFrame, folder: str, dimensions: tuple[str, ...] = DIMENSIONS, rows_per_file: int = 1_000_000, **options) -> DataFrame:
    """Writes shards as Parquet, ``shard=N/`` each, in order of the curve in files of neighbouring slots; returns the manifest."""
    rows, own = sharded(docs, dimensions, **options)
    name = free_name(docs, "shard")
    file = F.expr(f"`{own}`.slot div {rows_per_file}")
    flat = rows.withColumn(name, F.col(own).shard)
    flat.repartition(partitions(docs.sparkSession), F.col(name), file).sortWithinPartitions(
        name, F.col(own).slot).write.partitionBy(name).parquet(folder)
    return manifest(docs.sparkSession.read.parquet(folder), own, name, dimensions)


def manifest(rows: DataFrame, own: str, name: str, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """shard, rows, bytes, and the bounds of each dimension and of the size, a row per shard; ``nulls_X`` counts NULLs."""
    bounds = [f(c) for d in dimensions for f, c in (
        (lambda c: F.min(c).alias(f"low_{c}"), d), (lambda c: F.max(c).alias(f"high_{c}"), d),
        (lambda c: F.count_if(F.col(c).isNull()).alias(f"nulls_{c}"), d))]
    size = F.col(own).getField("size")
    return rows.groupBy(F.col(name).alias("shard")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes"), F.min(size).alias("low_size"), F.max(size).alias("high_size"), *bounds)


def matching(shard_bounds: DataFrame, **wanted) -> list[int]:
    """The shards that can hold rows with the values or (low, high) ranges wanted; None asks for NULL."""
    keep = F.lit(True)
    for name, value in wanted.items():
        if value is None:
            keep = keep & (F.col(f"nulls_{name}") > 0)
        else:
            low, high = value if isinstance(value, tuple) else (value, value)
            keep = keep & (F.col(f"high_{name}") >= F.lit(low)) & (F.col(f"low_{name}") <= F.lit(high))
    return sorted(r.shard for r in shard_bounds.where(keep).select("shard").collect())  # a row per shard


CRC32 = """
    bytes AS (SELECT list(v ORDER BY b) AS step FROM (
        SELECT b, list_reduce(list_concat([b], list_transform(range(8), lambda i: 0::BIGINT)),
            lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)) AS v
        FROM range(256) t(b))),
"""


def crc32_sql(text: str) -> str:
    """SQL for the unsigned crc32 of a text, byte by byte through the table ``bytes`` (which must be joined)."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"""xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {octets}),
            lambda c, o: xor(c >> 8, step[(xor(c, o) & 255) + 1])))"""


ORACLE = f"""
WITH RECURSIVE {CRC32.strip()}
base AS (
    SELECT doc_id, lang AS k0, source AS k1, coalesce(octet_length(encode(text)), 0)::BIGINT + {EXTRA} AS size,
        {crc32_sql("coalesce(text, '')")} AS text_crc32,
        ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS number
    FROM documents, bytes),
rows AS (
    SELECT *, lpad((length(bin(size)) * 16 + ((size * 32) >> length(bin(size))) - 16)::VARCHAR, 4, '0') AS k2 FROM base),
shares AS (
    SELECT axis, value, count(*) AS n FROM (
        SELECT 0 AS axis, k0 AS value FROM rows UNION ALL SELECT 1, k1 FROM rows UNION ALL SELECT 2, k2 FROM rows) GROUP BY ALL),
steps AS (
    SELECT axis, value, ((2 * coalesce(sum(n) OVER (PARTITION BY axis ORDER BY value NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n)
        * {1 << BITS} // (2 * sum(n) OVER (PARTITION BY axis)))::BIGINT AS step FROM shares),
cells AS (
    SELECT DISTINCT a.step AS s0, b.step AS s1, c.step AS s2 FROM rows
    JOIN steps a ON a.axis = 0 AND a.value IS NOT DISTINCT FROM k0
    JOIN steps b ON b.axis = 1 AND b.value IS NOT DISTINCT FROM k1
    JOIN steps c ON c.axis = 2 AND c.value IS NOT DISTINCT FROM k2),
turned(s0, s1, s2, x, y, z, n) AS (
    SELECT s0, s1, s2, s0, s1, s2, 0 FROM cells
    UNION ALL
    SELECT s0, s1, s2,
        CASE n % 3
            WHEN 0 THEN CASE WHEN x & q > 0 THEN xor(x, q - 1) ELSE x END
            WHEN 1 THEN CASE WHEN y & q > 0 THEN xor(x, q - 1) ELSE xor(x, xor(x, y) & (q - 1)) END
            ELSE CASE WHEN z & q > 0 THEN xor(x, q - 1) ELSE xor(x, xor(x, z) & (q - 1)) END END,
        CASE WHEN n % 3 = 1 AND y & q = 0 THEN xor(y, xor(x, y) & (q - 1)) ELSE y END,
        CASE WHEN n % 3 = 2 AND z & q = 0 THEN xor(z, xor(x, z) & (q - 1)) ELSE z END,
        n + 1
    FROM (SELECT *, (1::BIGINT << ({BITS - 1} - n // 3)::INT)::BIGINT AS q FROM turned WHERE n < {3 * (BITS - 1)})),
gray AS (
    SELECT s0, s1, s2, x AS g0, xor(x, y) AS g1, xor(xor(x, y), z) AS g2 FROM turned WHERE n = {3 * (BITS - 1)}),
flipped AS (
    SELECT *, {" + ".join(f"(CASE WHEN xor_of_above & {1 << p} > 0 THEN {1 << p} ELSE 0 END)" for p in range(BITS))} AS flip FROM (
        SELECT *, {"xor(" * (BITS - 2)}{"g2 >> 1"}{"".join(f", g2 >> {k})" for k in range(2, BITS))} AS xor_of_above FROM gray)),
curve AS (
    SELECT s0, s1, s2, {" + ".join(f"(((xor(g{axis}, flip) >> {p}) & 1) << {3 * p + 2 - axis})" for p in range(BITS) for axis in range(3))} AS index
    FROM flipped),
ranked AS (
    SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY index, number, doc_id NULLS FIRST, text_crc32, size) - 1 AS rank, count(*) OVER () AS n
    FROM rows
    JOIN steps a ON a.axis = 0 AND a.value IS NOT DISTINCT FROM k0
    JOIN steps b ON b.axis = 1 AND b.value IS NOT DISTINCT FROM k1
    JOIN steps c ON c.axis = 2 AND c.value IS NOT DISTINCT FROM k2
    JOIN curve ON s0 = a.step AND s1 = b.step AND s2 = c.step),
cut AS (SELECT *, (rank * {SHARDS} // n)::INTEGER AS shard FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY rank) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, own = sharded(documents(spark, sf_dir), keep=["doc_id"])
    place = F.col(own)
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), place["size"].alias("size"), place["text_crc32"].alias("text_crc32"), F.lit("rows").alias("law"),
        place["shard"].alias("shard"), place["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
