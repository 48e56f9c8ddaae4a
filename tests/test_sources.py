"""Decoding, quarantine, control folder, CSV fleet, metrics records."""
import json

import pytest
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.operators import fleet, metrics
from coldwatch.sources import control, events, fleet_csv
from samples import BASE, T0, frame, reading


def messages(spark, *bodies):
    return spark.createDataFrame([("k", b) for b in bodies], "key string, value string").withColumn(
        "timestamp", F.timestamp_millis(F.lit(T0 + 5)))


GOOD = {n: BASE[n] for n in S.EVENT_COLUMNS}


def test_decode_keeps_good_and_names_bad(spark):
    lacking = {k: v for k, v in GOOD.items() if k != "temperature_c"}
    wrong = {**GOOD, "event_ts": "soon"}
    df = events.decode_json(messages(
        spark, json.dumps(GOOD), json.dumps(lacking), json.dumps(wrong), "{oops", "", None, "[]"))
    good = events.valid_events(df).collect()
    assert len(good) == 1 and good[0]["input_kafka_ts"] == T0 + 5 and good[0]["temperature_c"] == -18.0
    bad = events.quarantine(df).collect()
    assert len(bad) == 6
    assert {r["problem"] for r in bad} <= {"malformed", *[f"missing:{n}" for n in S.REQUIRED_EVENT_COLUMNS]}
    assert [r["raw"] for r in bad if r["problem"] == "missing:temperature_c"] == [json.dumps(lacking)]


def test_messages_round_trip(spark):
    df = frame(spark, [reading(temperature_c=-14.123456789012345)])
    back = events.valid_events(events.decode_json(events.as_messages(df))).first()
    assert back["temperature_c"] == -14.123456789012345 and back["input_kafka_ts"] == T0


def test_control_folder(spark, tmp_path):
    folder = str(tmp_path / "control")
    assert control.current_scenario(spark, folder, "normal") == "normal"
    assert control.current_scenario(spark, None, "door_open") == "door_open"
    control.append_scenario(spark, folder, "power_outage", 10)
    control.append_scenario(spark, folder, "door_open", 20)
    spark.createDataFrame([("siesta", 30), (None, 40)], control.CONTROL_SCHEMA).write.mode("append").json(folder)
    assert control.current_scenario(spark, folder, "normal") == "door_open"
    with pytest.raises(ValueError):
        control.append_scenario(spark, folder, "siesta")


def test_fleet_loads_from_csv(spark, tmp_path):
    tables = {
        "freezer_metadata": "freezer_id,freezer_type,site_id,maintenance_priority,inventory_value_band\na,dairy_case,S1,low,high\nb,toaster,S2,low,low\n",
        "device_thresholds": "freezer_type,temperature_upper_limit,door_open_limit_seconds\ndairy_case,4.0,60\n",
        "site_metadata": "site_id,site_name,site_region\nS1,one,TX\n",
    }
    for name, text in tables.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows = {r["freezer_id"]: r for r in fleet_csv.load_fleet(spark, str(tmp_path)).collect()}
    assert rows["a"]["temperature_upper_limit"] == 4.0 and rows["a"]["site_name"] == "one"
    assert rows["b"]["temperature_upper_limit"] is None and rows["b"]["site_region"] is None


def test_every_reading_is_judged_or_missed(spark):
    readings = frame(spark, [reading(freezer_id=f, event_id=f"{f}{i}") for f in ("known", "bare", "absent") for i in range(4)]).select(*S.EVENT_COLUMNS)
    blank = {n: F.lit(None).cast("string") for n in S.ENRICHMENT_COLUMNS}
    dims = spark.createDataFrame([("known", -15.0), ("bare", None)], "freezer_id string, temperature_upper_limit double").withColumns(
        {n: c for n, c in blank.items() if n != "temperature_upper_limit"})
    assert {r["freezer_id"]: r["readings"] for r in fleet.misses_by_unit(readings, dims).collect()} == {"bare": 4, "absent": 4}
    assert fleet.misses(readings, dims).columns == readings.columns
    assert fleet.misses(readings, dims).count() == 8
    counted = fleet.accounts(readings.withColumn("problem", F.when(F.col("event_id") == "bare1", "malformed")), dims).first()
    assert counted.asDict() == {"messages": 12, "quarantined": 1, "missed": 7, "judged": 4}


def test_fleet_joins_and_index(spark):
    units = spark.createDataFrame(
        [("b", "dairy_case", "S1", "low", "low"), ("a", "toaster", "S9", "low", "low")],
        ", ".join(f"{n} string" for n in S.UNIT_COLUMNS))
    sites = spark.createDataFrame([("S1", "one", "TX"), ("S1", "uno", "TX")], "site_id string, site_name string, site_region string")
    limits = fleet.thresholds(spark)
    problems = {r["problem"]: r["n"] for r in fleet.quality(units, limits, sites).collect()}
    assert problems == {"duplicate_unit": 0, "duplicate_type": 0, "duplicate_site": 1,
                        "unit_without_limits": 1, "unit_without_site": 1}
    built = fleet.assemble(units, limits, sites.limit(1))
    assert {r["freezer_id"]: r["temperature_upper_limit"] for r in built.collect()} == {"a": None, "b": 4.0}
    many = spark.range(1000).select(F.format_string("FZ-%05d", F.col("id") * 7919 % 1000).alias("freezer_id"))
    index = fleet.with_index(many).orderBy("idx").collect()
    assert [r["idx"] for r in index] == list(range(1000))
    assert [r["freezer_id"] for r in index] == sorted(r["freezer_id"] for r in index)


def test_enrich_broadcasts_only_what_is_small(spark):
    readings = frame(spark, [reading()]).select(*S.EVENT_COLUMNS, "input_kafka_ts")
    dims = spark.range(50).select(F.concat(F.lit("FZ-"), "id").alias("freezer_id"),
                                  *[F.lit(None).cast("string").alias(n) for n in S.ENRICHMENT_COLUMNS])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(fleet.enrich(readings, dims))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan(fleet.enrich(readings, dims))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


PROGRESS = {
    "name": "c", "id": "q", "runId": "r", "batchId": 5, "timestamp": "2026-09-21T00:00:05.000Z",
    "numInputRows": 1000, "inputRowsPerSecond": 200.0, "processedRowsPerSecond": 205.0,
    "durationMs": {"triggerExecution": 120},
    "sources": [{"metrics": {"maxOffsetsBehindLatest": "3", "avgOffsetsBehindLatest": "1"}}],
}
LATENCIES = {"processingLatencyMs": {"p50": 40.0, "p99": 120.0}, "sourceQueuingLatencyMs": {"P50": 5.0, "P99": 30.0},
             "e2eLatencyMs": {"50": 60.0, "p95": 150.0, "99": 180.0}}


def flat(spark, *bodies):
    rows = [("rtm" if "latencies" in b else "microbatch", json.dumps(b), i) for i, b in enumerate(bodies)]
    return metrics.flatten_progress(spark.createDataFrame(rows, "source_mode string, progress string, emit_ts bigint"))


def test_progress_records(spark):
    rich, plain, sparse = flat(spark, {**PROGRESS, "latencies": LATENCIES}, PROGRESS, {"batchId": 0}).orderBy("emit_ts").collect()
    assert rich.asDict().keys() == set(metrics.RECORD_COLUMNS)
    assert rich["is_rtm"] and rich["batch_id"] == 5 and rich["trigger_duration_ms"] == 120
    assert rich["offsets_behind_latest_max"] == 3.0 and rich["input_rows_per_second"] == 200.0
    assert (rich["proc_latency_p99_ms"], rich["queue_latency_p50_ms"], rich["e2e_latency_p50_ms"],
            rich["e2e_latency_p95_ms"], rich["e2e_latency_p99_ms"]) == (120.0, 5.0, 60.0, 150.0, 180.0)
    assert not plain["is_rtm"] and plain["e2e_latency_p50_ms"] is None
    assert not sparse["is_rtm"] and sparse["input_rows_per_second"] is None and sparse["offsets_behind_latest_max"] is None


def test_latest_metrics_keep_the_last_known(spark):
    got = {r["mode"]: r for r in metrics.latest(flat(
        spark, {**PROGRESS, "latencies": LATENCIES}, {"numInputRows": 7, "latencies": {"e2eLatencyMs": {"p50": 61}}},
        PROGRESS)).collect()}
    assert (got["rtm"]["vol_in"], got["rtm"]["lag"], got["rtm"]["e2e_latency_p50_ms"]) == (1007, 3.0, 61.0)
    assert got["rtm"]["proc_latency_p50_ms"] is None
    assert got["mb"]["e2e_latency_p50_ms"] is None and got["mb"]["input_rows_per_second"] == 200
