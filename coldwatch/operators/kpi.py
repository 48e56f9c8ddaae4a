"""Fleet KPIs as pure functions of the incident stream and a point in time.

``alerts`` rows carry ``alert_kafka_ts`` (when the record reached the alert log); nothing
after ``as_of_ms`` is looked at. All groupings combine before the shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.functions import rules
from coldwatch.functions.expressions import app_mode, store_label
from coldwatch.operators import latency

ACTIVE_MS = 60_000
FEED_ROWS = 30
TOP_SITES = 4
_STEPS = [S.OPENED, S.ESCALATED, S.HEARTBEAT, S.RESOLVED]


def _until(alerts: DataFrame, as_of_ms: int) -> DataFrame:
    return (alerts.where(F.col("alert_kafka_ts") <= as_of_ms)
            .withColumn("mode", app_mode(F.col("source_mode"))))


def arrival() -> Column:
    """Total order of alert records: log time, then emit time, step and incident."""
    return F.struct("alert_kafka_ts", "emit_ts", rules.rank_of("lifecycle_event", _STEPS), "incident_id")


def open_units(alerts: DataFrame, as_of_ms: int) -> DataFrame:
    """Units in alert per view: their newest record is not a RESOLVED and is under 60 s old.

    The detection latencies are those last measured for the incident, so they survive heartbeats
    and end with it.
    """
    record = F.struct(
        "lifecycle_event", "alert_type", "alert_severity", "site_id", "site_name",
        "incident_id", F.col("alert_kafka_ts").alias("ts"))
    seen = latency.with_segments(_until(alerts, as_of_ms))
    per_incident = seen.groupBy("mode", "freezer_id", "incident_id").agg(
        F.max(arrival()).alias("at"), F.max_by(record, arrival()).alias("r"),
        F.max_by("lat_a", F.when(F.col("lat_a").isNotNull(), arrival())).alias("lat_a"),
        F.max_by("lat_b", F.when(F.col("lat_b").isNotNull(), arrival())).alias("lat_b"),
    )
    latest = per_incident.groupBy("mode", "freezer_id").agg(
        F.max_by(F.struct("r", "lat_a", "lat_b"), "at").alias("u")).select("mode", "freezer_id", "u.*")
    return (
        latest.select("mode", "freezer_id", "r.*", "lat_a", "lat_b")
        .where((F.col("lifecycle_event") != S.RESOLVED) & (F.col("ts") >= as_of_ms - ACTIVE_MS))
        .withColumn("status", rules.rank_of("alert_severity", S.SEVERITIES) + 1)
        .withColumn("store", store_label(F.col("site_id"), F.col("site_name")))
        .drop("lifecycle_event")
    )


def _zero_filled(counts: DataFrame, column: str, names: list[str]) -> DataFrame:
    grid = counts.sparkSession.createDataFrame(
        [(m, n) for m in ("rtm", "mb") for n in names], f"mode string, {column} string")
    return grid.join(F.broadcast(counts), ["mode", column], "left").select(  # a row per view and name
        "mode", column, F.coalesce("n", F.lit(0)).alias("n"))


def open_by_type(units: DataFrame) -> DataFrame:
    counts = units.groupBy("mode", "alert_type").agg(F.count("*").alias("n"))
    label = F.create_map(*[F.lit(x) for kv in S.TYPE_LABELS.items() for x in kv])
    return _zero_filled(counts, "alert_type", S.ALERT_TYPES).withColumn("label", label[F.col("alert_type")])


def open_by_severity(units: DataFrame) -> DataFrame:
    counts = units.groupBy("mode", "alert_severity").agg(F.count("*").alias("n"))
    return _zero_filled(counts, "alert_severity", S.SEVERITIES)


def site_heat(units: DataFrame, sites: DataFrame) -> DataFrame:
    """Worst open severity of every store on the roster (0 when quiet), per view."""
    worst = units.groupBy("mode", "store").agg(F.max("status").alias("worst"))
    roster = sites.select(
        F.explode(F.array(F.lit("rtm"), F.lit("mb"))).alias("mode"),
        store_label(F.col("site_id"), F.col("site_name")).alias("store"))
    return roster.join(worst, ["mode", "store"], "left").select(
        "mode", "store", F.coalesce("worst", F.lit(0)).alias("status"))


def _first_rows(df: DataFrame, rows: int, *order) -> DataFrame:
    """The first ``rows`` rows of each view; Spark cuts each task's share to as many before the shuffle."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy("mode").orderBy(*order))).where(
        F.col("_row") <= rows).drop("_row")


def alert_feed(units: DataFrame, as_of_ms: int, rows: int = FEED_ROWS) -> DataFrame:
    """Newest open units of each view."""
    label = F.create_map(*[F.lit(x) for kv in S.TYPE_LABELS.items() for x in kv])
    ago = F.greatest(F.lit(0), F.bround((as_of_ms - F.col("ts")) / F.lit(1000.0)).cast("bigint"))
    return (
        _first_rows(units, rows, F.desc("ts"), "freezer_id")
        .select("mode", label[F.col("alert_type")].alias("label"), F.col("alert_severity").alias("severity"),
                F.col("site_name").alias("site"), F.col("freezer_id").alias("device"),
                F.col("lat_b").alias("lat_ms"), "ts", ago.alias("ago_s"))
    )


def top_sites(alerts: DataFrame, as_of_ms: int, rows: int = TOP_SITES) -> DataFrame:
    """Sites with the most incidents opened, per view."""
    opened = (
        _until(alerts, as_of_ms)
        .where(F.col("lifecycle_event") == S.OPENED)
        .groupBy("mode", F.coalesce("site_name", F.lit("")).alias("site")).agg(F.count("*").alias("opened"))
    )
    return _first_rows(opened, rows, F.desc("opened"), "site")


_SUMS = ["alerts", *[f"opened_{s}" for s in S.SEVERITIES]]


def per_incident(moded: DataFrame, *more: Column) -> DataFrame:
    """Per view, unit and incident: openings by severity, whether it was critical, its newest record; and ``more``."""
    opening = F.col("lifecycle_event").isin(S.OPENED, S.ESCALATED)
    opened = F.col("lifecycle_event") == S.OPENED
    return moded.groupBy("mode", "freezer_id", "incident_id").agg(
        F.count_if(opened).alias("alerts"),
        *[F.count_if(opened & (F.col("alert_severity") == s)).alias(f"opened_{s}") for s in S.SEVERITIES],
        F.max(opening & (F.col("alert_severity") == "critical")).cast("int").alias("critical_incidents"),
        *more, F.max(F.struct(arrival().alias("at"), "lifecycle_event")).alias("newest"))


def headline(incidents: DataFrame, as_of_ms: int, *more: str) -> DataFrame:
    """``per_incident`` rows to units, then to the view; ``more`` columns are summed."""
    sums = [*_SUMS, "critical_incidents", *more]
    per_unit = incidents.groupBy("mode", "freezer_id").agg(
        *[F.sum(n).alias(n) for n in sums], F.max("newest").alias("newest"))
    in_alert = ((F.col("newest.lifecycle_event") != S.RESOLVED)
                & (F.col("newest.at.alert_kafka_ts") >= as_of_ms - ACTIVE_MS))
    return per_unit.groupBy("mode").agg(
        F.count("*").alias("units_monitored"), *[F.sum(n).alias(n) for n in sums],
        F.count_if(in_alert).alias("units_in_alert"))


def fresh_pct() -> Column:
    return F.coalesce(F.try_divide(100.0 * F.col("fresh"), F.col("measured")), F.lit(0.0))


def business(alerts: DataFrame, as_of_ms: int) -> DataFrame:
    """Headline counts per view, in one pass over the log.

    Records fold to incidents, incidents to units, units to the view: no distinct set is ever
    held for a whole view, and each step combines before its shuffle.
    """
    recent = F.col("alert_kafka_ts") >= as_of_ms - latency.WINDOW_MS
    measured = F.col("lat_b").isNotNull() & recent
    incidents = per_incident(
        latency.with_segments(_until(alerts, as_of_ms)), F.count_if(measured).alias("measured"),
        F.count_if(measured & (F.col("lat_b") <= latency.BUCKET_EDGES["le_250ms"])).alias("fresh"))
    return headline(incidents, as_of_ms, "measured", "fresh").withColumn("fresh_pct", fresh_pct()).drop("measured", "fresh")


def volumes(alerts: DataFrame, events: DataFrame, as_of_ms: int) -> DataFrame:
    """Readings in, alert records out and the newest scenario seen, per view."""
    out = _until(alerts, as_of_ms).groupBy("mode").agg(
        F.count("*").alias("vol_out"),
        F.max_by("scenario_name", F.when(F.col("scenario_name").isNotNull(), arrival())).alias("scenario_name"))
    into = (events.where(F.col("input_kafka_ts") <= as_of_ms)
            .groupBy(app_mode(F.col("source_mode")).alias("mode")).agg(F.count("*").alias("vol_in")))
    return into.join(out, "mode", "full").select(
        "mode", F.coalesce("vol_in", F.lit(0)).alias("vol_in"), F.coalesce("vol_out", F.lit(0)).alias("vol_out"),
        F.coalesce("scenario_name", F.lit("Live")).alias("scenario_name"))
