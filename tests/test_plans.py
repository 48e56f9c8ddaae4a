"""The physical plans the operators are meant to have."""
import re

import pytest
from pyspark.sql import functions as F

from coldwatch.functions import rules
from coldwatch.operators import alerts, fleet, incidents, skew
from coldwatch.plans.queries import QUERIES
from coldwatch.session import freeze
from coldwatch.sources import events
from coldwatch.sources import telemetry_tables as tt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    """Exchanges that move rows by key (broadcasts and scalar subqueries aside)."""
    return re.findall(r"Exchange (?:hash|range|RoundRobin)\w*", plan(df))


@pytest.fixture(scope="module")
def enriched(spark, small):
    return fleet.enrich(tt.incident_readings(spark, small), tt.fleet(spark, small))


def test_stateless_alerts_do_not_shuffle(spark, small):
    df = alerts.alert_records(tt.readings(spark, small), tt.fleet(spark, small), "rtm", 0)
    assert shuffles(df) == []
    assert "BatchEvalPython" not in plan(df) and "ArrowEvalPython" not in plan(df)


def test_a_large_fleet_is_joined_once(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES["alerts_stateless"](spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") == 1 and text.count("Exchange hash") == 2


def _rows(enriched):
    readings = incidents.with_stretches(incidents.judged(skew.sliced_by(enriched, None)))
    return incidents.lifecycle_rows(readings, F.lit(0).cast("bigint"), enriched.columns)


def test_readings_shuffle_once_and_sort_twice(enriched):
    text = plan(_rows(enriched))
    assert len(shuffles(_rows(enriched))) == 1
    assert len(re.findall(r"\bSort \[", text)) == 2
    assert shuffles(incidents.replay(enriched, as_of_ms=0)) == []


def test_no_reading_reaches_python(enriched):
    """Python folds a row per stretch; readings are judged, reduced and turned into events by expressions."""
    for df in (_rows(enriched), incidents.replay(enriched, as_of_ms=0)):
        assert "MapIn" not in plan(df) and "Python" not in plan(df)
    folded = plan(incidents.carried_incidents(incidents.stretches(freeze(_rows(enriched), "rows"))))
    assert folded.count("MapInArrow") == 1
    first = re.search(r"HashAggregate\(keys=\[(.*?)\]", folded[folded.index("MapInArrow"):])
    assert [re.sub(r"#\d+L?", "", k) for k in first[1].split(", ")] == incidents.KEY


def test_replay_carries_only_what_is_asked_for(enriched):
    lean = incidents.replay(enriched, carry=["site_id"])
    assert "site_name" not in lean.columns and "alert_reason" not in lean.columns
    full = incidents.replay(enriched)
    assert set(enriched.columns) < set(full.columns) and "alert_reason" in full.columns
    keys = ["incident_id", "lifecycle_event", "emit_ts", "peak_temp_c"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*keys).collect())
    assert rows(lean) == rows(full)


def test_message_text_is_parsed_once(spark):
    raw = spark.range(3).select(F.concat(F.lit("{"), "id", F.lit("}")).alias("value"), F.current_timestamp().alias("timestamp"))
    text = plan(events.valid_events(events.decode_json(raw)))
    assert text.count("from_json(") == 1


def test_both_rule_sets_share_their_ladder(enriched):
    flags = rules.instant_flags()
    both = rules.sustained_flags(flags["temp_high"], F.lit(False), F.lit(True), F.lit(True), F.lit(False))
    differ = enriched.where(~rules.verdict(flags).eqNullSafe(rules.verdict(both)))
    assert differ.isEmpty()
