"""A hot unit cut into slices gives the same incidents, signals and runs as the SQL oracle."""
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from check_oracles import _table, open_tables
from coldwatch.operators import fleet, incidents, signals, skew
from coldwatch.plans.queries import _lifecycle_columns, _signal_columns
from coldwatch.sources import telemetry_tables as tt
from oracles.incidents import _COLUMNS, SQL, _runs, lifecycle, signal_steps

START = dt.datetime(2024, 1, 1)
# around every time limit of the rules, in ms of reading time
GAPS = [0, 1, 200, 900, 2_000, 5_000, 9_999, 10_000, 15_000, 20_000, 29_999, 30_000, 30_001,
        60_000, 89_999, 90_000, 90_001, 95_000, 101_000, 109_999, 110_000, 110_001, 150_000, 400_000]
CALM = [0] * 6 + [200, 900, 2_000, 5_000, 9_999, 10_000]


def _events(seed):
    """A unit with most of the readings, in stretches of busy and of patchy reporting; one
    that alerts without end; and a few small ones."""
    rnd, rows, n = random.Random(seed), [], 0
    kinds = ["view", "click", "purchase", "signup", "error"]
    for unit, count in ((3, 2200), (4, 900), (1, 40), (2, 40), (7, 25)):
        at, busy = 0, True
        for _ in range(count):
            if rnd.random() < 0.02:
                busy = not busy
            at += rnd.choice(CALM if busy else GAPS)
            quiet = unit != 4 and rnd.random() < 0.6
            kind = "view" if unit == 4 else rnd.choice(kinds)
            value = 1.0 if quiet else (95.0 if unit == 4 else round(rnd.uniform(0, 130), 2))
            rows.append((n, START + dt.timedelta(milliseconds=at * 600), unit, "click" if quiet else kind, value,
                         '{"k": %d}' % (60 if quiet else rnd.randrange(100))))
            n += 1
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


@pytest.fixture(scope="module", params=[1, 2])
def world(request, spark, small, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp(f"skew{request.param}"))
    events = _events(request.param)
    events["ts"] = events["ts"].astype("datetime64[us]")
    events.to_parquet(f"{folder}/events.parquet", index=False)
    con = open_tables(small)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    raw = spark.read.schema(tt.TABLE_SCHEMAS["events"]).parquet(f"{folder}/events.parquet")
    enriched = fleet.enrich(tt.incident_readings(spark, small, raw), tt.fleet(spark, small))
    return con, enriched


def _want(con, sql):
    cur = con.execute(sql)
    return _table([c[0] for c in cur.description], cur.fetchall())


def _got(df):
    return _table(df.columns, df.collect())


@pytest.mark.parametrize("max_rows", [10_000, 700, 150, 40])
def test_replay(world, max_rows):
    con, enriched = world
    got = _got(_lifecycle_columns(incidents.replay(enriched, max_rows=max_rows)))
    want = _want(con, f"WITH RECURSIVE {lifecycle()} SELECT {_COLUMNS}, closed_by, trend_points FROM log")
    assert got == want


def test_signals(world):
    con, enriched = world
    judged = incidents.classified(enriched, max_rows=150).select("event_id", F.round("temp_ewma", 6).alias("e"))
    assert _got(judged) == _want(con, f"WITH RECURSIVE {signal_steps()} SELECT event_id, round(e, 6) AS e FROM signals")


@pytest.mark.parametrize("max_rows", [10_000, 700, 150, 40])
def test_every_signal_is_the_same_sliced(world, max_rows):
    """Among the readings is a unit that alerts without end: runs far longer than any context."""
    con, enriched = world
    got = _got(_signal_columns(incidents.classified(enriched, max_rows=max_rows)))
    assert got == _want(con, SQL["classified_readings"])


@pytest.mark.parametrize("max_rows", [10_000, 40])
def test_runs(world, max_rows):
    con, enriched = world
    sliced, hot = skew.assign_slices(enriched, max_rows)
    assert hot == (max_rows == 40)
    flagged = signals.with_over_run(signals.with_ewma(sliced, incidents.PART), incidents.PART)
    want = _want(con, _runs("over_since", "true").replace(", true AS held", ""))
    # equal times at both ends of a run can make two runs look alike; compare what they hold
    assert _got(signals.runs(flagged, "is_over")) == want


def test_slices_cover_every_reading_once(world):
    _, enriched = world
    sliced, _ = skew.assign_slices(enriched, 150)
    own = sliced.where(~F.col("is_context"))
    assert own.count() == enriched.count() == own.select("event_id").distinct().count()
    sizes = own.where("freezer_id = 'FZ-000003'").groupBy("slice").count().collect()
    assert len(sizes) > 5


def test_cold_units_are_not_touched(world):
    _, enriched = world
    sliced, hot = skew.assign_slices(enriched, 1_000_000)
    assert not hot and sliced.where("is_context or slice <> 0 or not last_slice").isEmpty()


def test_smoothing_is_carried_by_maps_not_by_context(world):
    """A slice starts from the composed maps of all readings before it; its context holds a trend and the time windows, no more."""
    con, enriched = world
    plan, _ = skew.plan_slices(enriched, 150)
    sliced = skew.sliced_by(enriched, plan)
    smoothed = signals.with_ewma(sliced, incidents.PART).select("event_id", F.round("temp_ewma", 9).alias("e")).distinct()
    want = _want(con, f"WITH RECURSIVE {signal_steps()} SELECT event_id, round(e, 9) AS e FROM signals")
    assert _got(smoothed) == want  # the context rows' own values are exact too
    slices = sliced.where("is_context").groupBy("freezer_id", "slice").agg(
        F.count("*").alias("n"), (F.max("event_ts") - F.min("event_ts")).alias("span")).where(f"span > {2 * skew.CONTEXT_MS}")
    assert slices.where(f"n > {4 * skew.CONTEXT_ROWS}").isEmpty()
