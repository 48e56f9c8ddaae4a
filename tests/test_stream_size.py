"""What streams cost as their input grows: cells handed to Python, passes over a batch, files, replays."""
import glob

from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.functions import rules
from coldwatch.operators import incidents, signals, skew
from coldwatch.plans import queries
from coldwatch.sources import telemetry_tables as tt
from coldwatch.streaming import carried, processor, sinks
from samples import BAD_COMPRESSOR, DOOR, NO_POWER, WIDE_OPEN, frame, sequence


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def readings(spark):
    return frame(spark, [r for u in range(3) for r in sequence(f"FZ-{u}", [
        (1000 + 7000 * i + 90 * u, DOOR if (i // (4 + u)) % 2 else {"temperature_c": -14.5 + (i % 3) / 4}) for i in range(40)])])


def test_python_is_handed_few_cells(spark, tmp_path):
    """only what is judged and what is carried goes to the state; the rows stay those of the replay."""
    df = readings(spark)
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    made = processor.stream_incidents(source, clock="event", output_mode="Append", carry=["site_id"])
    assert set(processor.with_flags(df).columns) - set(df.columns) == {"_flags"}
    assert "door_open" not in made.columns and {"site_id", "temp_trend"} <= set(made.columns)
    sinks.start(made, "parquet", str(tmp_path / "cp"), {"path": str(tmp_path / "out")}).awaitTermination()
    names = ["freezer_id", "event_id", "site_id", "lifecycle_event", "emit_ts", "alert_type", "escalation_level", "peak_temp_c", "closed_by", "temp_trend"]
    got = spark.read.schema(made.schema).parquet(str(tmp_path / "out")).select(*names).collect()
    last = df.groupBy("freezer_id").agg(F.max("event_ts").alias("last"))
    want = incidents.replay(df).join(last, "freezer_id").where("emit_ts <= last").select(*names).collect()
    assert len(got) > 30 and sorted(map(str, got)) == sorted(map(str, want))


def test_last_readings_come_from_the_same_pass(spark):
    """what a batch carries over is marked while its readings are judged; they are not smoothed a second time."""
    df = readings(spark)
    _, after = carried.advance(df, carried.nothing(spark, df.schema))
    assert "Window" not in plan(after.context)
    rows = after.context.groupBy("freezer_id").agg(F.count("*").alias("n"), F.max("event_ts").alias("newest")).collect()
    newest = {r.freezer_id: r.newest for r in df.groupBy("freezer_id").agg(F.max("event_ts").alias("newest")).collect()}
    assert {r.freezer_id: r.newest for r in rows} == newest and all(r.n >= 16 for r in rows)


def test_windows_copy_few_columns(spark, monkeypatch):
    """F1 of round 4: what no window looks at goes through all of them in one piece, and comes out as it was."""
    written, freeze = {}, carried.freeze
    monkeypatch.setattr(carried, "freeze", lambda df, label: written.setdefault(label, df) and freeze(df, label))
    df = readings(spark)
    _, after = carried.advance(df, carried.nothing(spark, df.schema))
    node, seen = written["lifecycle-rows"]._jdf.queryExecution().optimizedPlan(), []
    while node.children().size():
        if node.nodeName() == "Window":
            seen.append([node.output().apply(i).name() for i in range(node.output().size())])
        node = node.children().apply(0)
    assert 5 < len(seen) < 10 and not any({"site_name", "power_state", "door_open", "producer_ts"} & set(names) for names in seen)
    kept = {r.event_id: r for r in df.collect()}
    assert all(tuple(r[n] for n in df.columns) == tuple(kept[r.event_id]) for r in after.context.collect())


def test_units_are_counted_once(spark, monkeypatch):
    """F1 of round 4: the pass that tells a batch's units tells their sizes too, together with what they carry."""
    seen, plan_slices = [], skew.plan_slices
    monkeypatch.setattr(skew, "plan_slices", lambda *a, **kw: seen.append((a[0], kw["per_unit"])) or plan_slices(*a, **kw))
    df = readings(spark)
    _, after = carried.advance(df.where("event_ts < 150000"), carried.nothing(spark, df.schema))
    carried.advance(df.where("event_ts >= 150000"), after, max_rows=20)
    for both, per_unit in seen:
        assert "ExistingRDD" not in plan(per_unit) and "FileScan" in plan(per_unit)
        assert sorted(per_unit.collect()) == sorted(skew.counts(both).collect())
    assert [r.rows > 30 for _, per_unit in seen for r in per_unit.collect()].count(True) >= 3  # behind the second batch lie 16 readings a unit


def test_bits_stand_for_their_columns(spark):
    """F1 of round 4: verdicts from bits are those from the columns, unknown values among them."""
    odd = [DOOR, WIDE_OPEN, {**NO_POWER, "temperature_c": -15.5}, BAD_COMPRESSOR, {"temperature_c": -12.5}, {"temperature_c": -12.5, "inventory_value_band": "high", **DOOR},
           {"defrost_cycle_active": True}]
    unknown = [{n: None} for n in ("door_open", "door_open_limit_seconds", "compressor_on", "compressor_health", "power_state", "battery_pct",
                                   "defrost_cycle_active", "inventory_value_band", "maintenance_priority", "temperature_upper_limit")]
    steps = [{**o, **u} for o in odd for u in [{}, *unknown] for _ in range(4)]
    rows = sequence("FZ-1", [(1000 + 4000 * i, s) for i, s in enumerate(steps)])
    schema = S.T.StructType([S.T.StructField(f.name, f.dataType) for f in S.ENRICHED_SCHEMA.fields])
    df = spark.createDataFrame([tuple(r[n] for n in schema.names) for r in rows], schema)
    looked_at = ["door_open", "door_open_seconds", "door_open_limit_seconds", "compressor_on", "compressor_health", "power_state", "battery_pct",
                 "defrost_cycle_active", "inventory_value_band", "maintenance_priority"]
    judged = [signals.classify(each).select("event_id", "alert_type", "alert_severity", "health_bad_since", "defrost_until_ts")
              for each in (df, rules.with_flags(df).drop(*looked_at))]
    assert sorted(map(str, judged[0].collect())) == sorted(map(str, judged[1].collect()))
    assert {r.alert_type for r in judged[0].collect()} >= {*S.ALERT_TYPES, None}


def test_events_are_unfolded_as_numbers(spark):
    """F1 of round 4: no function is called for each event; a reading's own event and its timers come from one list of steps."""
    rows = incidents.freeze(incidents.lifecycle_rows(incidents.with_stretches(incidents.judged(skew.whole(readings(spark)))),
                                                     F.lit(400_000).cast("bigint"), readings(spark).columns), "rows")
    made = incidents.events_on(rows, incidents.freeze(incidents.carried_incidents(incidents.stretches(rows)), "open"), F.lit(400_000).cast("bigint"))
    assert "lambda" not in plan(made) and "transform(" not in plan(made)
    assert {r[0] for r in made.select("lifecycle_event").collect()} >= {S.OPENED, S.HEARTBEAT, S.RESOLVED}


def test_nothing_carried_costs_no_join(spark):
    df = readings(spark)
    assert "Join" not in plan(carried.with_lateness(df, carried.nothing(spark, df.schema)))


def test_files_grow_with_the_rows(spark, monkeypatch):
    """each part of a stream has as many files as its rows call for, and is one micro-batch."""
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 1000)
    df = spark.range(0, 16_000, 1, 2).select("id")
    stream, root = queries._in_parts(df, (F.col("id") % 2).cast("int"), 2, "grow")
    assert [len(glob.glob(f"{root}/input/{i}/*.parquet")) for i in range(2)] == [8, 8]
    sizes = []
    stream.writeStream.foreachBatch(lambda b, _: sizes.append(sorted(r[0] for r in b.groupBy(F.col("id") % 2).count().select("count").collect()))) \
        .option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sizes == [[8000], [8000]]


def test_a_single_part_is_written_once(spark, monkeypatch):
    """F1 of round 4: what comes as one part isn't written whole before; its rows are all there."""
    frozen, freeze = [], queries.freeze
    monkeypatch.setattr(queries, "freeze", lambda df, label: frozen.append(label) or freeze(df, label))
    df = spark.range(0, 3_000, 1, 2).select("id")
    for parts, number in ((1, F.lit(0)), (2, (F.col("id") % 2).cast("int"))):
        _, root = queries._in_parts(df, number, parts, f"parts-{parts}")
        assert sorted(r.id for r in spark.read.parquet(f"{root}/input/*").collect()) == list(range(3_000))
    assert frozen == ["parts-2"]


def test_hot_units_messages_are_made_in_many_tasks(spark, small, monkeypatch):
    """messages are made behind a deal that knows no unit."""
    seen = []
    monkeypatch.setattr(queries, "_in_parts", lambda df, *_: seen.append(plan(df)) or (_ for _ in ()).throw(StopIteration))
    try:
        queries.stream_incidents_sliced(spark, small)
    except StopIteration:
        pass
    assert "RoundRobinPartitioning" in seen[0]


def test_one_replay_feeds_all_reductions(spark, small, monkeypatch):
    """headline counts and latencies follow the same log. F4: its files grow with the events."""
    made, log = [], queries._log
    monkeypatch.setattr(queries, "_log", lambda *a: made.append(a) or log(*a))
    monkeypatch.setattr(queries, "ROWS_PER_FILE", 100)
    events = tt.table(spark, small, "events").count()
    folders, _ = queries._follow_log(spark, small, "incident_counts", "latency_counts")
    assert len(made) == 1 and len(folders) == 2
    assert len(glob.glob(f"{folders[0].rsplit('/', 1)[0]}/log/*.parquet")) > min(events // 200, 5)
