"""Secrets in texts: fixed patterns, and strings that pass a battery of randomness tests.

DataFrame functions only. Spans are code points, end exclusive.

*Patterns* (leftmost matches that don't overlap, per kind): assignments of at least 8 characters to a
password-like name, cloud access keys of at least 16, hex strings of at least 32. A match that is too short still uses up its text.

*Random strings.* Candidates are all runs of at least ``SHORTEST`` characters of the base-64 alphabets. The characters say
the encoding, the smallest that holds them: hex (16 symbols), base 32 (32), letters of one case and digits (36), letters and
digits (62), or base 64 (64); the first three in either case. On the symbols' places in their alphabet three
tests ask whether the string could be uniform noise:

- chi-squared against equal frequencies (Wilson-Hilferty normal),
- the number of runs above and below the alphabet's middle (Wald-Wolfowitz),
- lag-1 serial correlation.

A string is noise only if no test rejects at ``REJECT`` / 3. Then it must differ from ordinary
text: ordinary text repeats symbols ``TEXT_REPEATS`` times as often as the alphabet's uniform draw would, so its
chi-squared would lie far higher, the more so the longer it is; the tail of that distribution is
the string's p-value. Over all candidates of the table, Benjamini-Hochberg at ``FALSE_RATE`` with weights
in proportion to length (to a mean of one) holds down the share of ordinary strings among the finds; the step-up limit is
taken from counts on a grid of log p, so no task sorts all candidates. Finds that overlap a pattern span are not
added: those stay as they are.

NULL and empty texts have no spans. Repeated rows are scanned each. Tables without candidates have no random spans.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch.llm.tables import documents, free_name
from coldwatch.session import freeze

# The base patterns, the least length of what each must hold, in the order of kinds.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
# Runs that are too short never match, and none starts within one: the same spans as filtering afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

SHORTEST = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,6}" % SHORTEST
ONE_CASE = {  # symbols and form, smallest first
    "0123456789abcdef": "^(?:[0-9a-f]+|[0-9A-F]+)$",
    "abcdefghijklmnopqrstuvwxyz234567": "^(?:[a-z2-7]+|[A-Z2-7]+)=*$",
    "0123456789abcdefghijklmnopqrstuvwxyz": "^(?:[a-z0-9]+|[A-Z0-9]+)=*$",
}
SYMBOLS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"
REJECT = 0.001
FALSE_RATE = 0.01
TEXT_REPEATS = {16: 1.6, 32: 2.1, 36: 2.3, 62: 3.2, 64: 3.2}
GRID, MOST_LOG = 8, 60
SPAN = "struct<start:int,end:int,kind:string,what:string>"
NONE = f"array<{SPAN}>"


def with_spans(df: DataFrame, name: str, pattern: str, kind: str) -> DataFrame:
    """Adds the matches of ``pattern`` in ``text`` with their places.

    Places come from what lies between matches: the pieces of a split by the same pattern.
    """
    found = F.col("__found")
    gaps = F.slice(F.split("text", pattern, -1), 1, F.size(found))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["match"].alias("what"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span.cast(SPAN))).alias("spans"))

    places = F.aggregate(
        F.arrays_zip(found.alias("match"), gaps.alias("gap")),
        F.struct(F.lit(0).alias("at"), F.array().cast(NONE).alias("spans")), step, lambda acc: acc["spans"])
    return (
        df.withColumn("__found", F.regexp_extract_all("text", F.lit(pattern), 0))
        .withColumn(name, F.when(F.size("__found") > 0, places).otherwise(F.array().cast(NONE)))
        .drop("__found")
    )


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed, then end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"], rank(s), s["end"], s.alias("span")))
    return F.transform(F.array_sort(keyed), lambda s: s["span"])


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and candidates, written once: pattern spans and candidate spans of each document."""
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", CANDIDATE)):
        text = with_spans(text, name, pattern, name)
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["what"], ASSIGN, 1)) >= ASSIGN_LEAST)
    found = text.select("doc_id", ordered(F.concat(long_enough, "access", "hex")).alias("base"), F.col("random").alias("candidates"))
    apart = lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
    return freeze(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.filter("candidates", apart).alias("candidates")), "scanned")


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, within a few percent."""
    x = F.abs(z)
    upper = F.exp(-x * x / 2) / (1.64 * x + F.sqrt(0.76 * x * x + 4))
    return F.when(z >= 0, upper).otherwise(1 - upper)


def tested(candidates: DataFrame) -> DataFrame:
    """Adds log_p, minus ln of the p-value against ordinary text; 0 where a test rejects noise."""
    what, n, k = F.col("what"), F.col("n"), F.col("k")
    alphabet = F.coalesce(*(F.when(what.rlike(form), F.lit(symbols)) for symbols, form in ONE_CASE.items()), F.lit(SYMBOLS))
    bare = F.rtrim(what, F.lit("="))
    plain = F.when(F.col("alphabet") != SYMBOLS, F.lower(bare)).otherwise(F.translate(bare, "-_", "+/"))
    places = F.transform(F.split("symbols", ""), lambda c: F.position(c, F.col("alphabet")) - 1)
    times = lambda p: F.size(F.filter("places", lambda x: x == p))
    total = lambda column, f: F.aggregate(column, F.lit(0.0), lambda acc, x: acc + f(x))
    coded = (
        candidates.withColumn("alphabet", alphabet).withColumn("symbols", plain)
        .withColumn("k", F.when(F.col("alphabet") != SYMBOLS, F.length("alphabet")).when(F.col("symbols").rlike("[+/]"), 64).otherwise(62))
        .withColumn("places", places)
        .withColumn("n", F.size("places")).where(n >= 2)
        .withColumn("squares", total(F.array_distinct("places"), lambda p: times(p) * times(p)))
        .withColumn("above", total("places", lambda x: F.when(x * 2 >= k, 1.0).otherwise(0.0)))
        .withColumn("mean", total("places", lambda x: x) / n)
    )
    steps = F.arrays_zip(F.slice("places", 1, n - 1).alias("x"), F.slice("places", 2, n - 1).alias("y"))
    changed = lambda s: F.when((s["x"] * 2 >= k) != (s["y"] * 2 >= k), 1.0).otherwise(0.0)
    mean = F.col("mean")
    measured = (
        coded.withColumn("chi", k / n * F.col("squares") - n)
        .withColumn("steps", steps)
        .withColumn("runs", 1 + total("steps", changed))
        .withColumn("along", total("steps", lambda s: (s["x"] - mean) * (s["y"] - mean)))
        .withColumn("spread", total("places", lambda x: (x - mean) * (x - mean)))
    )
    df = k - 1
    chi_z = (F.pow(F.col("chi") / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    sides = 2 * F.col("above") * (n - F.col("above")) / n
    # strings of one symbol have no spread: NULL, so no noise
    runs_z = F.try_divide(F.col("runs") - sides - 1, F.sqrt(F.try_divide(sides * (sides - 1), n - 1)))
    serial_z = (F.try_divide(F.col("along"), F.col("spread")) + 1 / n) * F.sqrt(n)
    noise = (
        (F.col("above") > 0) & (F.col("above") < n) & (sides > 1) & (F.col("spread") > 0)
        & (tail(chi_z) > REJECT / 3) & (2 * tail(F.abs(runs_z)) > REJECT / 3) & (2 * tail(F.abs(serial_z)) > REJECT / 3))
    repeats = F.element_at(F.create_map(*(F.lit(x) for kv in TEXT_REPEATS.items() for x in kv)), k)
    q = repeats / k
    like_text = df + (n - 1) * (repeats - 1)
    pairs = n * (n - 1) / 2 * q * (1 - q) + n * (n - 1) * (n - 2) * 0.3 * q * q
    text_z = F.try_divide(like_text - F.col("chi"), 2 * k / n * F.sqrt(pairs))
    return measured.select(
        "row", "start", "end", "n",
        F.when(noise, -F.log(F.greatest(tail(text_z), F.lit(math.exp(-MOST_LOG))))).otherwise(0.0).alias("log_p"))


def finds(scan: DataFrame) -> DataFrame:
    """row and its random spans: candidates within the step-up limit of weighted Benjamini-Hochberg."""
    candidates = scan.select("row", F.explode("candidates").alias("c")).select("row", "c.start", "c.end", "c.what")
    tests = freeze(tested(candidates), "tested")
    all_n, mean_n = tests.agg(F.count(F.lit(1)), F.avg("n")).first()
    if not all_n:
        return tests.select("row", F.array().cast(NONE).alias("random")).limit(0)
    weighted = tests.where("log_p > 0").withColumn(
        "step", F.least(F.floor((F.col("log_p") + F.log(F.col("n") / mean_n)) * GRID), F.lit(MOST_LOG * GRID)))
    counts = {r["step"]: r["count"] for r in weighted.where("step >= 0").groupBy("step").count().collect()}  # at most MOST_LOG * GRID + 1
    limit, beyond = None, 0
    for step in sorted(counts, reverse=True):
        beyond += counts[step]
        if all_n * math.exp(-step / GRID) <= FALSE_RATE * beyond:
            limit = step
    kept = weighted.where(F.col("step") >= F.lit(limit)) if limit is not None else weighted.limit(0)
    span = F.struct(F.col("start"), F.col("end"), F.lit("random").alias("kind"), F.lit("").alias("what")).cast(SPAN)
    return kept.groupBy("row").agg(F.collect_list(span).alias("random"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: for each document its pattern spans, and those with the random ones."""
    scan = scanned(docs)
    return scan.join(finds(scan), "row", "left").select(
        "doc_id", "base", ordered(F.concat("base", F.coalesce("random", F.array().cast(NONE)))).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents' own columns, each secret's characters in ``text`` replaced by ``mark``.

    Overlapping spans are one. Documents without secrets stay as they are.
    """
    names, key, spans = docs.columns, free_name(docs, "key"), free_name(docs, "spans")
    scan = scanned(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"))
    found = scan.join(finds(scan), "row", "left").select(
        F.col("doc_id").alias(key), ordered(F.concat("base", F.coalesce("random", F.array().cast(NONE)))).alias(spans)
    ).where(F.size(spans) > 0).groupBy(key).agg(F.first(spans).alias(spans))

    def cut(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        piece = F.when(apart, F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["text"], piece).alias("text"))

    clean = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), cut,
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    joined = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left")
    return joined.withColumn("text", F.when(F.col(spans).isNotNull(), clean).otherwise(F.col("text"))).select(
        *(F.col(f"`{c}`") for c in names))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets(documents(spark, sf_dir)).select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
