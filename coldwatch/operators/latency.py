"""Detection latency: segments from record timestamps, percentiles, buckets, series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.functions.expressions import app_mode
from coldwatch.functions.ranks import nearest_rank

# Fixed values, in milliseconds.
SANE_MS = 60_000
WINDOW_MS = 300_000
CHART_MS = 15_000
RATE_MS = 5_000
SERIES_POINTS = 60
BUCKET_EDGES = {"le_250ms": 250, "le_1s": 1_000, "le_5s": 5_000}


def _sane(ms: Column) -> Column:
    return F.when(ms.between(0, SANE_MS), ms)


def with_segments(alerts: DataFrame) -> DataFrame:
    """``lat_a`` event to alert, ``lat_b`` message to alert, ``lat_ig`` event to message.

    Measured on fresh detections only; each is NULL outside 0..60 s on its own.
    """
    fresh = F.col("lifecycle_event").isin(S.OPENED, S.ESCALATED) & F.col("alert_kafka_ts").isNotNull()
    event, arrived, alerted = F.col("event_ts"), F.col("input_kafka_ts"), F.col("alert_kafka_ts")
    spans = {"lat_a": alerted - event, "lat_b": alerted - arrived, "lat_ig": arrived - event}
    return alerts.withColumns({name: F.when(fresh, _sane(span)) for name, span in spans.items()})


def samples(alerts: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Detections with at least one sane segment; of the last five minutes if a time is given."""
    df = with_segments(alerts).where(F.coalesce("lat_a", "lat_b", "lat_ig").isNotNull())
    if as_of_ms is not None:
        df = df.where(F.col("alert_kafka_ts").between(as_of_ms - WINDOW_MS, as_of_ms))
    return df.withColumn("mode", app_mode(F.col("source_mode")))


def stacked(measured: DataFrame) -> DataFrame:
    """``samples`` as a row per segment: mode, alert_kafka_ts, segment, ms."""
    return measured.select("mode", "alert_kafka_ts", F.inline(F.array(*[
        F.struct(F.lit(label).alias("segment"), F.col(name).alias("ms"))
        for label, name in [("e2e", "lat_a"), ("pipeline", "lat_b"), ("ingest", "lat_ig")]])))


def percentiles(alerts: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """p50/p95/p99/max per view and segment."""
    return nearest_rank(stacked(samples(alerts, as_of_ms)), ["mode", "segment"], "ms")


def bucket_of(ms: Column) -> Column:
    first_fit = F.coalesce(*[F.when(ms <= edge, F.lit(name)) for name, edge in BUCKET_EDGES.items()])
    return F.coalesce(first_fit, F.lit("gt_5s"))


def buckets(alerts: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Pipeline-latency histogram per view."""
    b = F.col("lat_b")
    name = bucket_of(b)
    return samples(alerts, as_of_ms).where(b.isNotNull()).groupBy("mode").agg(*[
        F.count_if(name == bucket).alias(bucket) for bucket in [*BUCKET_EDGES, "gt_5s"]])


def per_second(df: DataFrame, ts: str, keys: list[str], span_ms: int) -> DataFrame:
    """Rows counted by the first and last whole-second chart slot t that has them within [t - span, t].

    A row exactly on a second reaches one slot further.
    """
    first = F.ceil(F.col(ts) / F.lit(1000.0)).cast("bigint")
    last = F.floor((F.col(ts) + span_ms) / F.lit(1000.0)).cast("bigint")
    return df.groupBy(*keys, first.alias("_first"), last.alias("_last")).agg(F.count("*").alias("hits"))


def _chart_slots(df: DataFrame, ts: str, keys: list[str], as_of_ms: int, span_ms: int) -> DataFrame:
    """Count rows per chart slot. Rows are counted per second before they are copied to the slots
    they show up in, so the copies are of per-second counts."""
    oldest = as_of_ms // 1000 - SERIES_POINTS + 1
    recent = df.where(F.col(ts).between(oldest * 1000 - span_ms, as_of_ms))
    return _slots(per_second(recent, ts, keys, span_ms), keys, as_of_ms)


def _slots(seconds: DataFrame, keys: list[str], as_of_ms: int) -> DataFrame:
    newest = as_of_ms // 1000
    oldest = newest - SERIES_POINTS + 1
    lo, hi = F.greatest("_first", F.lit(oldest)), F.least("_last", F.lit(newest))
    return (seconds.where(lo <= hi)
            .select(*keys, "hits", F.explode(F.sequence(lo, hi)).alias("slot"))
            .groupBy(*keys, "slot").agg(F.sum("hits").alias("hits")))


def _every_slot(df: DataFrame, as_of_ms: int, modes: list[str]) -> DataFrame:
    newest = as_of_ms // 1000
    grid = df.sparkSession.range(newest - SERIES_POINTS + 1, newest + 1).select(
        F.explode(F.array(*map(F.lit, modes))).alias("mode"), F.col("id").alias("slot"))
    return grid.join(df, ["mode", "slot"], "left")


def series(alerts: DataFrame, as_of_ms: int) -> DataFrame:
    """Trailing 15 s p95 of the pipeline latency, one point a second for the last minute."""
    recent = samples(alerts).where(F.col("lat_b").isNotNull())
    counted = _chart_slots(recent, "alert_kafka_ts", ["mode", "lat_b"], as_of_ms, CHART_MS)
    points = nearest_rank(counted, ["mode", "slot"], "lat_b", (95,), weight="hits")
    return _every_slot(points.select("mode", "slot", "p95"), as_of_ms, ["rtm", "mb"]).select(
        "mode", "slot", F.coalesce("p95", F.lit(0)).alias("p95"))


def input_rate(events: DataFrame, as_of_ms: int) -> DataFrame:
    """Arrivals per second over the trailing 5 s, one point a second for the last minute."""
    shared = events.withColumn("mode", F.lit("all"))
    return input_rate_of(_chart_slots(shared, "input_kafka_ts", ["mode"], as_of_ms, RATE_MS), as_of_ms)


def input_rate_of(counted: DataFrame, as_of_ms: int) -> DataFrame:
    """The same from counts per slot."""
    counted = counted.select(F.lit("all").alias("mode"), "slot", "hits")
    rate = F.bround(F.coalesce("hits", F.lit(0)) / F.lit(RATE_MS / 1000.0)).cast("bigint")
    return _every_slot(counted, as_of_ms, ["all"]).select("slot", rate.alias("events_per_s"))


def alert_rate(alerts: DataFrame, as_of_ms: int) -> DataFrame:
    """Alert records per second and view over the trailing 5 s, to one decimal."""
    moded = alerts.withColumn("mode", app_mode(F.col("source_mode")))
    return _alert_rate(_chart_slots(moded, "alert_kafka_ts", ["mode"], as_of_ms, RATE_MS), as_of_ms)


def alert_rate_of(seconds: DataFrame, as_of_ms: int) -> DataFrame:
    """The same from counts of ``per_second`` (by view, over ``RATE_MS``)."""
    return _alert_rate(_slots(seconds, ["mode"], as_of_ms), as_of_ms)


def _alert_rate(counted: DataFrame, as_of_ms: int) -> DataFrame:
    rate = F.round(F.coalesce("hits", F.lit(0)) / F.lit(RATE_MS / 1000.0), 1)
    return _every_slot(counted, as_of_ms, ["rtm", "mb"]).select("mode", "slot", rate.alias("alerts_per_s"))


def compare_modes(alerts: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Both engines side by side: pipeline percentiles, freshness and bucket counts."""
    name = bucket_of(F.col("lat_b"))
    counts = {bucket: name == bucket for bucket in [*BUCKET_EDGES, "gt_5s"]}
    wide = nearest_rank(samples(alerts, as_of_ms), ["mode"], "lat_b", histogram=counts)
    return wide.withColumn("fresh_pct", 100.0 * F.col("le_250ms") / F.col("n"))
