"""Streams end to end: micro-batches, restart from a checkpoint, sinks, listener, timers, live KPIs."""
import json
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.operators import alerts, fleet, incidents, kpi, latency
from coldwatch.sources import events as event_source
from coldwatch.sources import telemetry_tables as tt
from coldwatch.streaming import carried, jobs, listener, live, sinks, tables
from coldwatch.streaming.processor import IncidentProcessor, stream_incidents
from samples import DOOR, WIDE_OPEN, frame, reading, sequence

KEY = ["incident_id", "lifecycle_event", "emit_ts", "event_id", "alert_type", "escalation_level"]


@pytest.fixture(scope="module")
def feed(spark, small, tmp_path_factory):
    """The enriched incident readings cut into five files by time."""
    folder = tmp_path_factory.mktemp("feed")
    df = fleet.enrich(tt.incident_readings(spark, small), tt.fleet(spark, small)).cache()
    edges = df.approxQuantile("event_ts", [0.2, 0.4, 0.6, 0.8], 0.0)
    for i, (lo, hi) in enumerate(zip([0, *edges], [*edges, 2 ** 60])):
        part = df.where((F.col("event_ts") > lo) & (F.col("event_ts") <= hi)).coalesce(1)
        part.write.mode("append").parquet(str(folder / f"part{i}"))
    return df, folder


def _stream(spark, df, folder, parts):
    """A file stream over copies of the first ``parts`` parts, one file per micro-batch."""
    return (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
            .option("latestFirst", "false").parquet(str(folder / parts)))


def _rows(df):
    return sorted(tuple(r[k] for k in KEY) for r in df.select(*KEY).collect())


def test_micro_batches_and_restart_match_the_replay(spark, feed, tmp_path):
    df, folder = feed
    landing = tmp_path / "landing"
    landing.mkdir()
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def land(i):
        for name in os.listdir(folder / f"part{i}"):
            if name.endswith(".parquet"):
                target = landing / f"{i}-{name}"
                target.write_bytes((folder / f"part{i}" / name).read_bytes())
                os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in this order

    def run():
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(landing))
        made = stream_incidents(source, clock="event", output_mode="Append")
        q = sinks.start(made, "parquet", checkpoint, {"path": out})
        q.awaitTermination()
        return made.schema

    for i in range(3):
        land(i)
    run()
    for i in (3, 4):
        land(i)
    schema = run()  # a new query on the old checkpoint: state carries over
    got = _rows(spark.read.schema(schema).parquet(out))
    # the stream ends with each unit's last reading; the replay would go on
    last = df.groupBy("freezer_id").agg(F.max("event_ts").alias("last"))
    want = _rows(incidents.replay(df).join(last, "freezer_id").where("emit_ts <= last"))
    assert len(got) > 500 and got == want


def test_stateful_consumer_sends_payloads(spark, small, feed, tmp_path):
    df, folder = feed
    events = _stream(spark, df, folder, "part0").select(*S.EVENT_COLUMNS, "input_kafka_ts")
    out = str(tmp_path / "out")
    jobs.run_consumer(events, tt.fleet(spark, small), "microbatch", "parquet", {"path": out},
                      str(tmp_path / "cp"), {"once": True}).awaitTermination()
    sent = spark.read.schema("key string, value string").parquet(out).collect()
    first = json.loads(sent[0]["value"])
    assert sent[0]["key"] == first["event_id"] and first["source_mode"] == "microbatch"
    assert set(first) <= set(S.ALERT_COLUMNS) and first["lifecycle_event"] in ("OPENED", "ESCALATED", "RESOLVED", "HEARTBEAT")


def test_timers_need_an_open_ended_trigger(spark, small, feed, tmp_path):
    df, folder = feed
    with pytest.raises(ValueError):
        jobs.run_consumer(_stream(spark, df, folder, "part0"), tt.fleet(spark, small), "rtm", "noop", {},
                          str(tmp_path / "cp"), {"availableNow": True})


def test_stateless_consumer_equals_the_batch(spark, small, feed, tmp_path):
    df, folder = feed
    events = _stream(spark, df, folder, "part1").select(*S.EVENT_COLUMNS, "input_kafka_ts")
    out = str(tmp_path / "out")
    jobs.run_consumer(events, tt.fleet(spark, small), "rtm", "parquet", {"path": out}, str(tmp_path / "cp"),
                      {"availableNow": True}, stateful=False).awaitTermination()
    sent = {r["key"] for r in spark.read.schema("key string, value string").parquet(out).collect()}
    batch = spark.read.schema(df.schema).parquet(str(folder / "part1"))
    assert sent == {r["event_id"] for r in alerts.judge(batch).select("event_id").collect()}


def test_message_stream_is_decoded_and_checked(spark, feed, tmp_path):
    df, _ = feed
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    sent = event_source.as_messages(df)
    broken = sent.limit(5).withColumn("value", F.lit("{"))
    sent.unionByName(broken).write.parquet(inbox)
    arriving = event_source.read_events(spark, "parquet", {"path": inbox}, sent.schema)
    assert arriving.isStreaming
    sinks.start(arriving, "parquet", str(tmp_path / "cp"), {"path": out}).awaitTermination()
    got = spark.read.schema(arriving.schema).parquet(out)
    assert got.count() == df.count()
    assert got.exceptAll(df.select(*S.EVENT_COLUMNS, "input_kafka_ts")).isEmpty()


def test_batch_table_is_idempotent(spark, tmp_path):
    write = sinks.batch_table(str(tmp_path / "t"), lambda b: b.withColumn("x", F.lit(1)))
    for _ in range(2):
        write(spark.range(5), 3)
    write(spark.range(2), 4)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 7 and set(back.columns) == {"id", "x", "query_id", "batch_id"}


def test_row_sender(spark, feed, tmp_path):
    df, folder = feed
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    target = str(inbox)

    def client():
        class Client:
            def __init__(self):
                import os
                import time
                self.f = open(f"{target}/{os.getpid()}-{time.time_ns()}", "w")

            def send(self, key, value):
                self.f.write(f"{key}\t{value}\n")

            def close(self):
                self.f.close()
        return Client()

    payload = alerts.to_payload(_stream(spark, df, folder, "part2").select(*S.EVENT_COLUMNS), key="freezer_id")
    q = (payload.writeStream.foreach(sinks.RowSender(client)).option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    lines = [line for p in inbox.iterdir() for line in p.read_text().splitlines()]
    want = spark.read.schema(df.schema).parquet(str(folder / "part2"))
    assert sorted(line.split("\t")[0] for line in lines) == sorted(r[0] for r in want.select("freezer_id").collect())


def test_listener_records_progress(spark, feed, tmp_path):
    df, folder = feed
    seen, metrics_folder = [], str(tmp_path / "metrics")
    keep = listener.FolderPublisher(spark, metrics_folder, records=1000)

    def publish(record):
        seen.append(record)
        keep(record)

    watch = listener.ProgressListener("microbatch", publish)
    spark.streams.addListener(watch)
    try:
        q = sinks.start(_stream(spark, df, folder, "part3"), "noop", str(tmp_path / "cp"))
        q.awaitTermination()
        for _ in range(100):
            if seen:
                break
            time.sleep(0.1)
        time.sleep(1.0)
    finally:
        spark.streams.removeListener(watch)
    keep.flush()
    rows = listener.read_records(spark, metrics_folder).collect()
    assert len(rows) == len(seen) >= 1
    assert sum(r["num_input_rows"] for r in rows) == spark.read.schema(df.schema).parquet(str(folder / "part3")).count()
    assert not rows[0]["is_rtm"] and rows[0]["source_mode"] == "microbatch"


def test_listener_warns_once_and_goes_on(capsys):
    class Event:
        class progress:
            json = "{}"

    def broken(record):
        raise OSError("full")

    watch = listener.ProgressListener("rtm", broken)
    watch.onQueryProgress(Event)
    watch.onQueryProgress(Event)
    assert capsys.readouterr().err.count("metrics not published") == 1


def test_timers_fire_on_the_engine(spark, tmp_path):
    """One alerting reading, then silence: the engine's own timer brings the heartbeat."""
    inbox = str(tmp_path / "inbox")
    frame(spark, [reading(door_open=True, door_open_seconds=200)]).write.parquet(inbox)
    source = spark.readStream.schema(spark.read.parquet(inbox).schema).parquet(inbox)
    query = sinks.start(stream_incidents(source), "memory", str(tmp_path / "cp"), trigger={"processingTime": "1 second"},
                        output_mode="update", name="beats")
    try:
        deadline = time.time() + 90
        while time.time() < deadline:
            events = [r["lifecycle_event"] for r in spark.table("beats").orderBy("emit_ts").collect()]
            if "HEARTBEAT" in events:
                break
            time.sleep(2)
    finally:
        query.stop()
    assert events[:2] == ["OPENED", "HEARTBEAT"]


def test_time_to_live_outlasts_open_incidents(spark):
    with pytest.raises(ValueError, match="open incidents"):
        IncidentProcessor(S.ENRICHED_SCHEMA, ttl_ms=S.STALE_MS)


def test_live_kpis_and_folds(spark, small, tmp_path):
    """The same before any fold, after one, and after more parts and a second one."""
    readings = fleet.enrich(tt.incident_readings(spark, small), tt.fleet(spark, small))
    log = tt.incident_log(incidents.replay(readings)).cache()
    span = log.agg(F.min("alert_kafka_ts"), F.max("alert_kafka_ts")).first()
    middle, end = (span[0] + span[1]) // 2, span[1]
    folder = tmp_path / "live"
    early = log.where(F.col("alert_kafka_ts") <= middle).repartition(2)
    early.write.parquet(str(folder / "log"))

    def take_in():
        records = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 2).parquet(str(folder / "log"))
        for name in live.REDUCTIONS:
            live.follow(records, name, str(folder / name), str(folder / f"{name}-cp")).awaitTermination()

    def as_the_log_says(at):
        at_hand = log.where(F.col("alert_kafka_ts") <= at)
        same(live.open_units(spark, str(folder / "unit_states"), at), kpi.open_units(log, at))
        same(live.alert_rate(spark, str(folder / "second_counts"), at), latency.alert_rate(log, at))
        same(live.latency_percentiles(spark, str(folder / "latency_counts"), at), latency.percentiles(log, at))
        whole = kpi.business(log, at)
        same(live.business(spark, str(folder / "incident_counts"), str(folder / "latency_counts"), at).select(whole.columns), whole)
        exact = {r.mode: r for r in kpi.business(at_hand, at).collect()}
        for r in live.estimated_counts(spark, str(folder / "distinct_sketches")).collect():
            assert r.units_monitored == pytest.approx(exact[r.mode].units_monitored, rel=0.05)
            assert r.critical_incidents == pytest.approx(exact[r.mode].critical_incidents, rel=0.05, abs=1)

    take_in()
    as_the_log_says(middle)
    for name in live.REDUCTIONS:
        live.compact(spark, str(folder / name), name)
    as_the_log_says(middle)
    log.where(F.col("alert_kafka_ts") > middle).repartition(2).write.mode("append").parquet(str(folder / "log"))
    take_in()
    as_the_log_says(end)
    for name in live.REDUCTIONS:
        live.compact(spark, str(folder / name), name)
    as_the_log_says(end)
    # a fold that was cut off is not read
    (folder / "unit_states" / "_folded" / "fold-000000009").mkdir()
    as_the_log_says(end)


def test_input_rate_takes_late_rows_until_the_watermark(spark, tmp_path):
    base = 1_700_000_000_000
    for i, times in enumerate([[base, base + 1000, base + 200_000], [base + 999, base + 1500], [base + 600_000], [base + 600_001], [base + 1600]]):
        spark.createDataFrame([(t,) for t in times], "input_kafka_ts long").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("input_kafka_ts long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    live.follow_updates(live.input_rate_counts(stream), str(tmp_path / "parts"), str(tmp_path / "cp")).awaitTermination()
    counts = {r.slot: r.hits for r in live._newest_rows(spark, str(tmp_path / "parts"), ["slot"]).collect()}
    # 999 and 1500 are three minutes late and count, 1600 comes after the watermark has passed it
    assert counts[base // 1000 + 2] == 4 and counts[base // 1000 + 5] == 4 and counts[base // 1000 + 6] == 2


def _carried_rows(df):
    return sorted(map(str, df.select(*KEY).collect()))


def test_batches_behind_what_was_carried(spark, tmp_path):
    """Any cut of the readings into batches gives the replay's rows; a column added on the way is NULL in what came before."""
    rows = [r for u in range(4) for r in sequence(f"FZ-{u}", [
        (1000 + 7000 * i + 90 * u, DOOR if (i // (4 + u)) % 2 else {"temperature_c": -14.5 + (i % 3) / 4}) for i in range(60)])]
    df = frame(spark, rows)
    whole = incidents.replay(df, as_of_ms=0)
    state, out, cuts = carried.nothing(spark, df.schema), [], [0, 50_000, 50_500, 260_000, 10**9]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:])):
        batch = df.where(F.col("event_ts").between(low, high - 1))
        if n >= 2:
            batch = batch.withColumn("firmware", F.lit("v2"))
        events, state = carried.advance(batch, state, max_rows=25)
        out += _carried_rows(events)
        if n == 2:  # rows on readings carried from before have no value in the new column
            assert {r.firmware for r in events.select("firmware").collect()} <= {None, "v2"}
        carried.save(state, str(tmp_path / str(n)))
        schema = batch.schema if n != 1 else batch.withColumn("firmware", F.lit("v2")).schema
        state = carried.load(spark, str(tmp_path / str(n)), schema)
    assert sorted(out) == _carried_rows(whole)
    spark.range(1).select(F.lit(99).alias("version")).write.mode("overwrite").parquet(str(tmp_path / "3" / "version"))
    with pytest.raises(ValueError, match="later version"):
        carried.load(spark, str(tmp_path / "3"), df.schema)


def test_a_batch_is_valid_whole_or_not_at_all(spark, tmp_path):
    units = frame(spark, [reading(freezer_id=u) for u in ("FZ-1", "FZ-2")]).select("freezer_id", *S.ENRICHMENT_COLUMNS)
    root = str(tmp_path / "tables")
    consumer = tables.TableConsumer(spark, root, units)

    def messages(*rows, extra=()):
        good = event_source.as_messages(frame(spark, list(rows)).select(*S.EVENT_COLUMNS, "input_kafka_ts")).select("value", "timestamp")
        bad = spark.createDataFrame([(x,) for x in extra], "value string").withColumn("timestamp", F.lit(0).cast("timestamp"))
        return good.unionByName(bad)

    first = messages(reading(event_ts=1000, event_id="a", **DOOR), reading(freezer_id="FZ-9", event_id="b"), extra=["{"])
    consumer(first, 0)
    consumer(first, 0)  # again, as after a failure: nothing twice
    second = messages(reading(event_ts=2000, event_id="c", **WIDE_OPEN), reading(event_ts=500, event_id="d", **DOOR))
    consumer(second, 1)
    account = tables.accounts(spark, root).first().asDict()
    assert account == {"messages": 5, "quarantined": 1, "missed": 1, "late": 1, "judged": 2}
    assert [r.raw for r in tables.table(spark, root, "quarantine").select(F.col("_raw").alias("raw")).collect()] == ["{"]
    assert [r.event_id for r in tables.table(spark, root, "late").collect()] == ["d"]
    assert [r.event_id for r in tables.table(spark, root, "missed").collect()] == ["b"]
    got = sorted((r.event_id, r.lifecycle_event) for r in tables.table(spark, root, "alerts").collect())
    assert got == [("a", "OPENED"), ("c", "ESCALATED")]
    # cut off before its manifest: readers see nothing of it
    shutil.rmtree(f"{root}/manifest/batch_id=1")
    assert tables.accounts(spark, root).first().messages == 3 and tables.table(spark, root, "late").isEmpty()
    consumer(second, 1)
    assert tables.accounts(spark, root).first().asDict() == account


def same(one, other):
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
