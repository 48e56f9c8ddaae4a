"""Fleet KPIs and latency figures on hand-made alert logs."""
import random

import pytest
from pyspark.sql import functions as F

from coldwatch.functions.ranks import nearest_rank
from coldwatch.operators import kpi, latency

T = 1_000_000
DDL = ("source_mode string, freezer_id string, site_id string, site_name string, alert_type string, "
       "alert_severity string, lifecycle_event string, event_ts bigint, input_kafka_ts bigint, "
       "incident_id string, emit_ts bigint, alert_kafka_ts bigint")
BASE = dict(source_mode="rtm", freezer_id="FZ-0142-01", site_id="S0142", site_name="Store 0142 Austin",
            alert_type="TEMP_HIGH", alert_severity="warning", lifecycle_event="OPENED", event_ts=T,
            input_kafka_ts=T, incident_id="FZ-0142-01:1", emit_ts=T, alert_kafka_ts=T)


def log(spark, *records):
    names = [part.split()[0] for part in DDL.split(", ")]
    rows = [{**BASE, "emit_ts": r.get("alert_kafka_ts", T), **r} for r in records]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], DDL)


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_open_alert_counts(spark):
    alerts = log(spark, dict(alert_type="DOOR_OPEN_TOO_LONG", alert_severity="serious"))
    head = by(kpi.business(alerts, T), "mode")["rtm"]
    assert (head["alerts"], head["units_in_alert"], head["opened_serious"]) == (1, 1, 1)
    units = kpi.open_units(alerts, T)
    kinds = by(kpi.open_by_type(units), "mode", "alert_type")
    assert kinds["rtm", "DOOR_OPEN_TOO_LONG"]["n"] == 1 and kinds["mb", "DOOR_OPEN_TOO_LONG"]["n"] == 0
    assert len(kinds) == 10
    assert by(kpi.open_by_severity(units), "mode", "alert_severity")["rtm", "serious"]["n"] == 1
    feed = kpi.alert_feed(units, T).where("mode = 'rtm'").first()
    assert (feed["device"], feed["severity"], feed["label"]) == ("FZ-0142-01", "serious", "Door open too long")


def test_views_are_separate(spark):
    alerts = log(spark, {}, dict(source_mode="microbatch", freezer_id="FZ-2", incident_id="FZ-2:1"))
    head = by(kpi.business(alerts, T), "mode")
    assert head["rtm"]["alerts"] == head["mb"]["alerts"] == 1
    assert head["rtm"]["units_in_alert"] == head["mb"]["units_in_alert"] == 1


def test_resolved_closes_the_unit(spark):
    alerts = log(spark, {}, dict(lifecycle_event="RESOLVED", alert_kafka_ts=T + 1000))
    assert kpi.open_units(alerts, T).count() == 1       # not yet
    assert kpi.open_units(alerts, T + 1000).count() == 0
    assert by(kpi.business(alerts, T + 1000), "mode")["rtm"]["units_in_alert"] == 0


def test_critical_counts_incidents_not_records(spark):
    alerts = log(spark, dict(alert_severity="critical", incident_id="i1"),
                 dict(alert_severity="critical", incident_id="i1", lifecycle_event="ESCALATED", alert_kafka_ts=T + 500))
    head = kpi.business(alerts, T + 500).first()
    assert (head["alerts"], head["critical_incidents"]) == (1, 1)


def test_units_unseen_for_a_minute_drop_out(spark):
    alerts = log(spark, {})
    assert kpi.open_units(alerts, T + 60_000).count() == 1
    assert kpi.open_units(alerts, T + 60_001).count() == 0


def test_latency_survives_heartbeats(spark):
    alerts = log(spark, dict(input_kafka_ts=T - 120),
                 dict(lifecycle_event="HEARTBEAT", alert_kafka_ts=T + 20_000))
    unit = kpi.open_units(alerts, T + 20_000).first()
    assert (unit["lat_b"], unit["ts"]) == (120, T + 20_000)


def test_site_heat_fills_the_roster(spark):
    sites = spark.createDataFrame([("S0142", "a"), ("S0331", "b"), ("none", "Depot"), (None, None)],
                                  "site_id string, site_name string")
    units = kpi.open_units(log(spark, dict(alert_severity="critical"), dict(freezer_id="x", incident_id="x")), T)
    heat = {r["store"]: r["status"] for r in kpi.site_heat(units, sites).where("mode = 'rtm'").collect()}
    assert heat == {"0142": 3, "0331": 0, "Depot": 0, "?": 0}


def test_freshness(spark):
    alerts = log(spark, dict(input_kafka_ts=T - 100, incident_id="a"),
                 dict(input_kafka_ts=T - 500, incident_id="b", freezer_id="FZ-2"))
    assert kpi.business(alerts, T).first()["fresh_pct"] == 50.0


def test_percentiles_and_buckets(spark):
    alerts = log(spark, *[dict(freezer_id=f"FZ-{i}", incident_id=f"i{i}", input_kafka_ts=T - ms)
                          for i, ms in enumerate([100, 300, 2000, 8000])])
    row = by(latency.percentiles(alerts, T), "segment")["pipeline"]
    assert (row["p50"], row["max"], row["n"]) == (2000, 8000, 4)
    b = latency.buckets(alerts, T).first()
    assert (b["le_250ms"], b["le_1s"], b["le_5s"], b["gt_5s"]) == (1, 1, 1, 1)
    both = latency.compare_modes(alerts).first()
    assert (both["p50"], both["fresh_pct"], both["gt_5s"]) == (2000, 25.0, 1)


@pytest.mark.parametrize("over, expected", [
    (dict(), (0, 0, 0)),
    (dict(lifecycle_event="HEARTBEAT"), (None, None, None)),
    (dict(lifecycle_event="RESOLVED"), (None, None, None)),
    (dict(event_ts=T - 60_000), (60_000, 0, 60_000)),
    (dict(event_ts=T - 60_001), (None, 0, None)),
    (dict(input_kafka_ts=T + 1), (0, None, 1)),
    (dict(input_kafka_ts=None), (0, None, None)),
])
def test_segments(spark, over, expected):
    row = latency.with_segments(log(spark, over)).first()
    assert (row["lat_a"], row["lat_b"], row["lat_ig"]) == expected


def test_nearest_rank_against_sorting(spark):
    rnd, rows = random.Random(3), []
    for group in range(40):
        rows += [(group, rnd.randrange(50)) for _ in range(rnd.choice([1, 2, 3, 19, 20, 21, 100, 333]))]
    got = nearest_rank(spark.createDataFrame(rows, "g int, v int"), ["g"], "v").collect()
    assert len(got) == 40
    for r in got:
        values = sorted(v for g, v in rows if g == r["g"])
        for p in (50, 95, 99):
            assert r[f"p{p}"] == values[min(len(values) - 1, int(p / 100 * len(values)))]


def test_series_windows_include_both_ends(spark):
    at = T  # a whole second
    alerts = log(spark, dict(input_kafka_ts=at - 700))
    points = {r["slot"]: r["p95"] for r in latency.series(alerts, at + 20_000).where("mode = 'rtm'").collect()}
    on = [s for s, v in points.items() if v == 700]
    assert (min(on), max(on)) == (at // 1000, at // 1000 + 15) and len(points) == 60


def test_input_rate(spark):
    events = spark.createDataFrame([(T - 5 * i,) for i in range(1000)], "input_kafka_ts bigint")
    rates = {r["slot"]: r["events_per_s"] for r in latency.input_rate(events, T).collect()}
    assert rates[T // 1000] == 200 and len(rates) == 60
    assert latency.input_rate(events.limit(0), T).agg(F.sum("events_per_s")).first()[0] == 0


def test_top_sites_break_ties_by_name(spark):
    alerts = log(spark, *[dict(site_name=s, incident_id=f"{s}{i}") for s, n in
                          [("a", 1), ("b", 2), ("c", 1), ("d", 3), ("e", 1)] for i in range(n)])
    top = [(r["site"], r["opened"]) for r in kpi.top_sites(alerts, T).where("mode = 'rtm'").collect()]
    assert top == [("d", 3), ("b", 2), ("a", 1), ("c", 1)]
