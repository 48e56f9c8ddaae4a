"""Every operator as a named query over the tables of one scale-factor folder."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.functions import rules
from coldwatch.operators import (
    alerts, fleet, incidents, kpi, latency, metrics, signals,
)
from coldwatch.operators.skew import assign_slices
from coldwatch.session import freeze, scratch_path
from coldwatch.sources import control, events as event_source, fleet_csv
from coldwatch.sources import telemetry_tables as tt
from coldwatch.streaming import carried, live, sinks, tables
from coldwatch.streaming.processor import stream_incidents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LOG_COLUMNS = ["site_id", "site_name", "source_mode", "input_kafka_ts", "scenario_name"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs ------------------------------------------------------------------------

def _enriched(spark: SparkSession, d: str) -> DataFrame:
    return tt.readings(spark, d, enriched=True)


def _judged_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.judge(_enriched(spark, d))


def _incident_input(spark: SparkSession, d: str, **kw) -> DataFrame:
    return tt.incident_readings(spark, d, enriched=True, **kw)


def _as_of(spark: SparkSession, d: str) -> int:
    """Just after the newest incident reading."""
    return tt.newest_ms(spark, d, tt.INCIDENT_SQUEEZE) + 1


def _log(spark: SparkSession, d: str) -> DataFrame:
    return tt.incident_log(incidents.replay(_incident_input(spark, d), carry=LOG_COLUMNS))


def _sliced(spark: SparkSession, d: str) -> DataFrame:
    return assign_slices(_incident_input(spark, d))[0]


def _own(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_context"))


def _late_clock():
    """A processing time up to nine seconds after the reading."""
    return F.col("event_ts") + (F.col("event_id").cast("bigint") * 53) % 9000


# --- fleet ----------------------------------------------------------------------------------

@query
def fleet_load(spark, d):
    return tt.fleet(spark, d)


@query
def fleet_quality(spark, d):
    units, sites = tt.units(spark, d), tt.sites(spark, d)
    repeated = units.where(F.col("freezer_id").endswith("50"))
    return fleet.quality(units.unionByName(repeated), fleet.thresholds(spark),
                         sites.where(~F.col("site_id").endswith("7")))


@query
def fleet_index(spark, d):
    return fleet.with_index(tt.fleet(spark, d)).select("idx", "freezer_id")


@query
def enrich_events(spark, d):
    return fleet.enrich(tt.readings(spark, d), tt.fleet(spark, d)).select(
        "event_id", "event_ts", "freezer_id", "site_id", "temperature_c", *S.ENRICHMENT_COLUMNS)


@query
def enrich_misses(spark, d):
    """Of a fleet that lacks some units and the limits of others."""
    return fleet.misses_by_unit(tt.readings(spark, d), tt.fleet_with_gaps(spark, d))


@query
def reading_accounts(spark, d):
    """Every message is quarantined, missed or judged."""
    return fleet.accounts(event_source.decode_json(_messages(spark, d)), tt.fleet_with_gaps(spark, d))


# --- messages ---------------------------------------------------------------------------------

def _messages(spark, d):
    """Event messages of which some are cut short, lack a field or have a wrong type."""
    n = F.get_json_object("value", "$.event_id").cast("bigint")
    value = (
        F.when(n % 97 == 0, F.substring("value", 1, 40))
        .when(n % 89 == 0, F.regexp_replace("value", '"freezer_id":"[^"]*",', ""))
        .when(n % 83 == 0, F.regexp_replace("value", '"event_ts":', '"event_ts":"soon","x":'))
        .otherwise(F.col("value")))
    return event_source.as_messages(tt.readings(spark, d)).withColumn("value", value)


@query
def events_parse(spark, d):
    return event_source.valid_events(event_source.decode_json(_messages(spark, d)))


@query
def events_quarantine(spark, d):
    bad = event_source.quarantine(event_source.decode_json(_messages(spark, d)))
    return bad.select("problem", "input_kafka_ts")


@query
def event_payload(spark, d):
    payload = alerts.to_payload(tt.readings(spark, d).select(*S.EVENT_COLUMNS), key="freezer_id")
    field = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return payload.select(
        "key", field("event_id", "string"), field("event_ts", "bigint"), field("temperature_c", "double"),
        field("power_state", "string"), field("door_open", "boolean"), field("humidity_pct", "double"))


@query
def alert_payload(spark, d):
    records = alerts.as_record(alerts.stamp(_judged_alerts(spark, d), F.col("source_mode"), _late_clock()))
    field = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return alerts.to_payload(records).select(
        "key", field("freezer_id", "string"), field("alert_type", "string"),
        field("alert_severity", "string"), field("end_to_end_latency_ms", "bigint"),
        field("within_1s", "boolean"), F.col("value").contains("incident_id").alias("has_incident"))


# --- stateless alerts ---------------------------------------------------------------------------

@query
def rule_predicates(spark, d):
    flags = rules.instant_flags()
    names = ["near_limit", "degraded", "temp_high", "door_too_long", "compressor_risk",
             "power_warming", "high_value", "multi"]
    return _enriched(spark, d).select("event_id", *[flags[n].alias(n) for n in names])


@query
def alerts_stateless(spark, d):
    stamped = alerts.stamp(_judged_alerts(spark, d), F.col("source_mode"), _late_clock())
    return alerts.as_record(stamped).drop("temp_trend")


@query
def alert_reasons(spark, d):
    return _judged_alerts(spark, d).select("event_id", "alert_type", "alert_severity", "alert_reason")


@query
def latency_stamp(spark, d):
    stamped = alerts.stamp(_judged_alerts(spark, d), F.col("source_mode"), _late_clock())
    return stamped.select("event_id", "source_mode", "processing_start_ts", "alert_emit_ts",
                          "end_to_end_latency_ms", *alerts.WITHIN_MS)


# --- signals --------------------------------------------------------------------------------------

@query
def temp_ewma(spark, d):
    return _own(signals.with_ewma(_sliced(spark, d), incidents.PART)).select(
        "event_id", "freezer_id", F.round("temp_ewma", 6).alias("temp_ewma"))


@query
def temp_slope(spark, d):
    df = signals.with_slope(_sliced(spark, d), incidents.PART)
    return _own(df).select("event_id", "freezer_id", F.round("slope_c_per_min", 6).alias("slope_c_per_min"))


@query
def temp_trend(spark, d):
    ring = F.col("temp_trend")
    return _own(signals.with_trend(_sliced(spark, d), incidents.PART)).select(
        "event_id", F.size(ring).cast("bigint").alias("points"),
        ring[0]["ts"].alias("first_ts"), ring[0]["temp"].alias("first_temp"),
        F.element_at(ring, -1)["ts"].alias("last_ts"), F.element_at(ring, -1)["temp"].alias("last_temp"))


@query
def defrost_windows(spark, d):
    return _own(signals.with_defrost(_sliced(spark, d), incidents.PART)).select(
        "event_id", "freezer_id", "defrost_until_ts", "in_defrost")


def _held(runs: DataFrame, ms: int, readings: int | None) -> DataFrame:
    held = F.col("until") - F.col("since") >= ms
    if readings is not None:
        held = held | (F.col("readings") >= readings)
    return runs.withColumn("held", held)


@query
def over_limit_runs(spark, d):
    smoothed = signals.with_ewma(_sliced(spark, d), incidents.PART)
    flagged = signals.with_over_run(smoothed, incidents.PART)
    return _held(signals.runs(flagged, "is_over"), S.TEMP_HOLD_MS, S.TEMP_HOLD_READINGS)


@query
def compressor_runs(spark, d):
    flagged = signals.with_compressor_run(_sliced(spark, d), incidents.PART)
    return _held(signals.runs(flagged, "compressor_bad"), S.COMPRESSOR_HOLD_MS, None)


def _slice_rows(spark, d) -> int:
    """So that the hot unit has about ten slices at any scale."""
    return max(100, tt.table(spark, d, "events").count() // 30)


def _signal_columns(classified: DataFrame) -> DataFrame:
    return classified.select(
        "event_id", "freezer_id", "alert_type", "alert_severity", F.round("temp_ewma", 6).alias("temp_ewma"),
        "prev_ts", "in_defrost", "defrost_until_ts", "is_over", "over_since",
        F.col("consecutive_over").cast("bigint").alias("consecutive_over"), "compressor_bad", "health_bad_since", "quiet_since")


@query
def classified_readings(spark, d):
    return _signal_columns(incidents.classified(_incident_input(spark, d)))


@query
def classified_readings_skewed(spark, d):
    """One unit holds a third of the readings and is judged in slices."""
    source = _incident_input(spark, d, one_hot_unit=True)
    return _signal_columns(incidents.classified(source, max_rows=_slice_rows(spark, d)))


# --- incidents ---------------------------------------------------------------------------------------

def _lifecycle_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "freezer_id", "incident_id", "lifecycle_event", "emit_ts", "event_id", "alert_type",
        "alert_severity", "escalation_level", F.round("peak_temp_c", 6).alias("peak_temp_c"),
        F.round("temperature_c", 6).alias("temperature_c"), "closed_by",
        F.size("temp_trend").alias("trend_points"))


@query
def incident_lifecycle(spark, d):
    return _lifecycle_columns(
        incidents.replay(_incident_input(spark, d), carry=["temp_trend"]).where(F.col("lifecycle_event") != S.HEARTBEAT))


@query
def incident_heartbeats(spark, d):
    return _lifecycle_columns(
        incidents.replay(_incident_input(spark, d), carry=["temp_trend"]).where(F.col("lifecycle_event") == S.HEARTBEAT)
    ).drop("closed_by")


@query
def incident_lifecycle_skewed(spark, d):
    """One unit holds a third of the readings and is replayed in slices."""
    source = _incident_input(spark, d, one_hot_unit=True)
    return _lifecycle_columns(incidents.replay(source, max_rows=_slice_rows(spark, d), carry=["temp_trend"]))


@query
def incident_summary(spark, d):
    return incidents.summarize(incidents.replay(_incident_input(spark, d), carry=[])).withColumn(
        "peak_temp_c", F.round("peak_temp_c", 6))


# --- fleet KPIs -----------------------------------------------------------------------------------------

def _open(spark, d):
    return kpi.open_units(_log(spark, d), _as_of(spark, d))


@query
def open_units(spark, d):
    return _open(spark, d)


@query
def open_by_type(spark, d):
    return kpi.open_by_type(_open(spark, d))


@query
def open_by_severity(spark, d):
    return kpi.open_by_severity(_open(spark, d))


@query
def site_heat(spark, d):
    return kpi.site_heat(_open(spark, d), tt.sites(spark, d))


@query
def alert_feed(spark, d):
    return kpi.alert_feed(_open(spark, d), _as_of(spark, d))


@query
def top_sites(spark, d):
    return kpi.top_sites(_log(spark, d), _as_of(spark, d))


@query
def kpi_business(spark, d):
    return kpi.business(_log(spark, d), _as_of(spark, d))


@query
def kpi_tech(spark, d):
    return kpi.volumes(_log(spark, d), tt.incident_readings(spark, d), _as_of(spark, d))


# --- latency ----------------------------------------------------------------------------------------------

@query
def latency_segments(spark, d):
    return latency.with_segments(_log(spark, d)).select(
        "incident_id", "lifecycle_event", "emit_ts", "lat_a", "lat_b", "lat_ig")


@query
def latency_percentiles(spark, d):
    return latency.percentiles(_log(spark, d), _as_of(spark, d))


@query
def latency_buckets(spark, d):
    return latency.buckets(_log(spark, d), _as_of(spark, d))


@query
def latency_series(spark, d):
    return latency.series(_log(spark, d), _as_of(spark, d))


@query
def throughput_series(spark, d):
    return latency.input_rate(tt.readings(spark, d), tt.newest_ms(spark, d, tt.PLAIN_SQUEEZE) + 1)


@query
def alert_rate_series(spark, d):
    return latency.alert_rate(_log(spark, d), _as_of(spark, d))


@query
def mode_comparison(spark, d):
    return latency.compare_modes(_log(spark, d))


# --- query metrics ------------------------------------------------------------------------------------------

def _progress(spark, d):
    """Fixture: progress JSON of two engines, one record per engine and second of readings."""
    second = F.floor(F.col("event_ts") / 1000)
    per_second = tt.readings(spark, d).groupBy("source_mode", second.alias("second")).agg(
        F.count("*").alias("n"), F.max(F.col("event_id").cast("bigint")).alias("top"))
    n, top = F.col("n"), F.col("top")
    text = lambda c: c.cast("string")

    def dist(key50: str, low, key99: str, high):
        return F.create_map(F.lit(key50), low.cast("double"), F.lit(key99), high.cast("double"))

    latencies = F.when(F.col("source_mode") == "rtm", F.create_map(
        F.lit("processingLatencyMs"), dist("p50", n * 2, "p99", n * 3),
        F.lit("sourceQueuingLatencyMs"), dist("P50", n, "P99", n * 2),
        F.lit("e2eLatencyMs"), dist("50", n * 4, "99", n * 5)))
    lag = F.when(top % 5 != 0, F.array(F.struct(F.struct(
        text(top % 13).alias("maxOffsetsBehindLatest"), text(top % 7).alias("avgOffsetsBehindLatest")
    ).alias("metrics"))))
    body = F.to_json(F.struct(
        F.concat(F.col("source_mode"), F.lit("-consumer")).alias("name"),
        F.concat(F.lit("q-"), F.col("source_mode")).alias("id"), F.lit("run-1").alias("runId"),
        F.col("second").alias("batchId"), n.alias("numInputRows"),
        F.when(top % 11 != 0, n / F.lit(2.0)).alias("inputRowsPerSecond"),
        F.when(top % 11 == 0, F.lit("none")).otherwise(text(n)).alias("processedRowsPerSecond"),
        F.struct((n * 7).alias("triggerExecution")).alias("durationMs"),
        lag.alias("sources"), latencies.alias("latencies")))
    return per_second.select("source_mode", body.alias("progress"), (F.col("second") * 1000).alias("emit_ts"))


@query
def metrics_records(spark, d):
    return metrics.flatten_progress(_progress(spark, d))


@query
def metrics_latest(spark, d):
    return metrics.latest(metrics.flatten_progress(_progress(spark, d)))


# --- scenarios ------------------------------------------------------------------------------------------------

SCENARIO_OF_EVENT = {"view": "door_open", "error": "compressor_failure", "signup": "power_outage",
                     "purchase": "fleet_hot_zone", "click": "normal"}


def _scenario_of(event_type):
    names = F.create_map(*[F.lit(x) for kv in SCENARIO_OF_EVENT.items() for x in kv])
    return names[event_type]


@query
def scenario_resolve(spark, d):
    ev = tt.table(spark, d, "events")
    chosen = F.when(F.col("event_id") % 4 == 0, F.lit("maintenance")).when(
        F.col("event_id") % 4 != 1, _scenario_of(F.col("event_type")))
    return control.newest(ev.select(
        chosen.alias("scenario"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts")))


@query
def scenario_from_folder(spark, d):
    """The control folder: records written as JSON files, read back, the newest counts."""
    ev, folder = tt.table(spark, d, "events"), scratch_path(spark, "control")
    chosen = F.when(F.col("event_id") % 4 == 0, F.lit("maintenance")).when(
        F.col("event_id") % 4 != 1, _scenario_of(F.col("event_type")))
    control.append_records(ev.select(chosen.alias("scenario"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts")), folder)
    return control.newest(control.read_records(spark, folder))


@query
def fleet_from_csv(spark, d):
    """The three dimensions written as CSV with headers, read back with declared types and joined."""
    folder = scratch_path(spark, "fleet-csv")
    for name, rows in (("freezer_metadata", tt.units(spark, d).select(*S.UNIT_COLUMNS)), ("device_thresholds", fleet.thresholds(spark)),
                       ("site_metadata", tt.sites(spark, d).select(*S.SITE_COLUMNS))):
        rows.write.option("header", True).csv(f"{folder}/{name}")
    return fleet_csv.load_fleet(spark, folder, suffix="")


# --- streams ----------------------------------------------------------------------------------------------------

def _event_stream(spark, d):
    path = f"{d}/events.parquet*"  # the pattern lets one file or a folder of parts be followed
    schema = tt.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path)


def _run_to_table(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    out = scratch_path(spark, label)
    sinks.start(df, "parquet", f"{out}/_checkpoint", {"path": f"{out}/table"}).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/table")


@query
def stream_alerts(spark, d):
    """The stateless consumer over a file stream of the events."""
    readings = tt.readings(spark, d, _event_stream(spark, d))
    stamped = alerts.stamp(alerts.judge(fleet.enrich(readings, tt.fleet(spark, d))),
                           F.col("source_mode"), _late_clock())
    return _run_to_table(alerts.as_record(stamped).drop("temp_trend"), "stream-alerts")


FILES, ROWS_PER_FILE = 4, 100_000


def _files(rows: int) -> int:
    """How many files ``rows`` are written to and followed by: more with the rows, so that tasks grow in number and not in size."""
    return max(FILES, -(-rows // ROWS_PER_FILE))


LOG_CUTS = 5


def _follow_log(spark, d, *reductions: str) -> tuple[list[str], int]:
    """A stream over the incident log, cut into files, that arrived by the newest reading; the folder of each of the
    ``reductions``, which follow the same log side by side, and that time."""
    as_of, root = _as_of(spark, d), scratch_path(spark, "live-log")
    log = _log(spark, d).where(F.col("alert_kafka_ts") <= as_of)
    cut = -(-tt.table(spark, d, "events").count() // (LOG_CUTS * ROWS_PER_FILE)) or 1  # files in each
    log.repartition(LOG_CUTS * cut, "incident_id", "emit_ts").write.parquet(f"{root}/log")
    records = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2 * cut).parquet(f"{root}/log")
    running = [live.follow(records, name, f"{root}/{name}", f"{root}/{name}-checkpoint") for name in reductions]
    for one in running:
        one.awaitTermination()
    return [f"{root}/{name}" for name in reductions], as_of


@query
def stream_open_units(spark, d):
    [folder], as_of = _follow_log(spark, d, "unit_states")
    return live.open_units(spark, folder, as_of)


@query
def stream_alert_rate(spark, d):
    [folder], as_of = _follow_log(spark, d, "second_counts")
    return live.alert_rate(spark, folder, as_of)


@query
def stream_incidents_log(spark, d):
    """The stateful consumer over a file stream of the events, on the event clock."""
    readings = tt.incident_readings(spark, d, _event_stream(spark, d))
    emitted = stream_incidents(fleet.enrich(readings, tt.fleet(spark, d)), clock="event", output_mode="Append", carry=[])
    return _run_to_table(_lifecycle_columns(emitted), "stream-incidents")


@query
def stream_latency_percentiles(spark, d):
    """From counts that follow the log and have been folded once on the way."""
    [folder], as_of = _follow_log(spark, d, "latency_counts")
    live.compact(spark, folder, "latency_counts")
    return live.latency_percentiles(spark, folder, as_of)


@query
def stream_kpi_business(spark, d):
    [counts, latencies], as_of = _follow_log(spark, d, "incident_counts", "latency_counts")
    return live.business(spark, counts, latencies, as_of)


def _in_parts(df: DataFrame, number: Column, parts: int, label: str) -> tuple[DataFrame, str]:
    """A stream that brings ``df`` part by part, a micro-batch each; and a folder for what follows it."""
    spark, root = df.sparkSession, scratch_path(df.sparkSession, label)
    whole = df.withColumn("_part", number)
    whole = freeze(whole, label) if parts > 1 else whole  # a single part is all there is: it is written once, below
    rows = [r["count"] for r in whole.groupBy("_part").count().collect()]
    # one number, as it cuts the micro-batches: no more than also the smallest part fills
    files = max(FILES, min(_files(max(rows)), min(rows) // 1000)) if rows else FILES
    for i in range(parts):
        whole.where(F.col("_part") == i).drop("_part").repartition(files).write.parquet(f"{root}/input/{i}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{root}/input/*")
    return stream, root


def _time_part(ts: str, begin: int, end: int, parts: int):
    return F.least(F.lit(parts - 1), F.floor((F.col(ts) - begin) * parts / (end - begin))).cast("int")


def _third(spark, d, squeeze: int):
    newest = tt.newest_ms(spark, d, squeeze)
    return _time_part("event_ts", tt.BASE_MS, newest + 1, 3)


@query
def stream_incidents_sliced(spark, d):
    """A stream with a third of the readings in one unit, which is replayed in slices batch by batch."""
    rows = tt.table(spark, d, "events").count()
    readings = tt.incident_readings(spark, d, one_hot_unit=True).repartition(_files(rows))  # else the hot unit's messages are made in one task
    newest = tt.newest_ms(spark, d, tt.INCIDENT_SQUEEZE)
    sent = F.get_json_object("value", "$.event_ts").cast("long")
    number = F.least(F.lit(2), F.floor((sent - tt.BASE_MS) * 3 / (newest + 1 - tt.BASE_MS))).cast("int")
    stream, root = _in_parts(event_source.as_messages(readings), number, 3, "stream-sliced")
    consumer = tables.TableConsumer(spark, f"{root}/tables", tt.fleet(spark, d), max_rows=_slice_rows(spark, d) // 3)
    tables.follow(stream, consumer, f"{root}/checkpoint").awaitTermination()
    return _lifecycle_columns(tables.table(spark, f"{root}/tables", "alerts"))


@query
def stream_incidents_resumed(spark, d):
    """The first two thirds replayed as a table, the rest as a stream that goes on from what the replay carried over."""
    readings = freeze(tt.incident_readings(spark, d).withColumn("_third", _third(spark, d, tt.INCIDENT_SQUEEZE)), "readings")
    past = fleet.enrich(readings.where("_third < 2").select(*S.EVENT_COLUMNS, "input_kafka_ts"), tt.fleet(spark, d))
    columns = [*S.EVENT_COLUMNS, "input_kafka_ts", *S.ENRICHMENT_COLUMNS]
    before, state = carried.advance(past.select(*columns), carried.nothing(spark, past.select(*columns).schema))
    messages = event_source.as_messages(readings.where("_third = 2"))
    stream, root = _in_parts(messages, F.lit(0), 1, "stream-resumed")
    carried.save(state, f"{root}/resume")
    consumer = tables.TableConsumer(spark, f"{root}/tables", tt.fleet(spark, d), resume=f"{root}/resume")
    tables.follow(stream, consumer, f"{root}/checkpoint").awaitTermination()
    return _lifecycle_columns(before).unionByName(_lifecycle_columns(tables.table(spark, f"{root}/tables", "alerts")))


@query
def stream_accounts(spark, d):
    """Messages, some of them broken, of units some of which are unknown, in an order that makes many late."""
    messages = _messages(spark, d)
    number = F.coalesce(F.regexp_extract("value", '"event_id":"([0-9]+)"', 1).try_cast("bigint") % 3, F.lit(0)).cast("int")
    stream, root = _in_parts(messages, number, 3, "stream-accounts")
    consumer = tables.TableConsumer(spark, f"{root}/tables", tt.fleet_with_gaps(spark, d))
    tables.follow(stream, consumer, f"{root}/checkpoint").awaitTermination()
    return tables.accounts(spark, f"{root}/tables")


@query
def stream_input_rate(spark, d):
    """Sliding counts of arrivals; every seventh reading arrives up to three minutes after its time."""
    readings = tt.readings(spark, d).select("event_id", "event_ts", "input_kafka_ts")
    newest = tt.newest_ms(spark, d, tt.PLAIN_SQUEEZE)
    seen = F.col("event_ts") + F.when(F.col("event_id").cast("bigint") % 7 == 0, 180_000).otherwise(0)
    number = F.least(F.lit(3), F.floor((seen - tt.BASE_MS) * 4 / (newest + 1 - tt.BASE_MS))).cast("int")
    stream, root = _in_parts(readings, number, 4, "stream-input-rate")
    live.follow_updates(live.input_rate_counts(stream), f"{root}/parts", f"{root}/checkpoint").awaitTermination()
    return live.input_rate(spark, f"{root}/parts", newest + 1)


@query
def stream_metrics_latest(spark, d):
    progress = _progress(spark, d)
    newest = tt.newest_ms(spark, d, tt.PLAIN_SQUEEZE)
    stream, root = _in_parts(progress, _time_part("emit_ts", tt.BASE_MS, newest + 1, 3), 3, "stream-metrics")
    updates = live.metric_updates(metrics.flatten_progress(stream))
    live.follow_updates(updates, f"{root}/parts", f"{root}/checkpoint").awaitTermination()
    return live.latest_metrics(spark, f"{root}/parts")
