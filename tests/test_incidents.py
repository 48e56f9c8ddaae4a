"""Lifecycle sequences through the batch replay and through the stream processor."""
import random

import pytest

from coldwatch import schemas as S
from coldwatch.operators import incidents, signals
from coldwatch.streaming import processor as P
from samples import BAD_COMPRESSOR, DOOR, NO_POWER, WIDE_OPEN, frame, sequence

HOT = {"temperature_c": -13.0}
MULTI = {**WIDE_OPEN, "temperature_c": -12.0, "inventory_value_band": "high"}
O, E, R, H = S.OPENED, S.ESCALATED, S.RESOLVED, S.HEARTBEAT

# unit -> (steps, expected (event, ts) without heartbeats)
CASES = {
    "hold_by_count": ([(1000, HOT), (6000, HOT), (11000, HOT)], [(O, 11000)]),
    "hold_by_time": ([(1000, HOT), (16000, HOT)], [(O, 16000)]),
    "not_held": ([(1000, HOT), (15999, HOT)], []),
    "spike": ([(1000, {"temperature_c": -20.0}), (6000, {"temperature_c": -14.0}),
               (11000, {"temperature_c": -20.0})], []),
    "at_limit": ([(1000 + 5000 * i, {"temperature_c": -15.0}) for i in range(6)], []),
    "steady_power": ([(1000 + 5000 * i, NO_POWER) for i in range(6)], []),
    "warming_power": ([(1000, NO_POWER), (6000, {**NO_POWER, "temperature_c": -17.5})], [(O, 6000)]),
    "escalates": ([(1000, DOOR), (2000, MULTI)], [(O, 1000), (E, 2000)]),
    "same_again": ([(1000 * i, DOOR) for i in range(1, 5)], [(O, 1000)]),
    "severity_up": ([(1000, DOOR), (2000, WIDE_OPEN), (3000, DOOR)], [(O, 1000), (E, 2000)]),
    "recovers": ([(1000, DOOR), (5000, {}), (40000, {})], [(O, 1000), (R, 40000)]),
    "recovery_reset": ([(1000, DOOR), (5000, {}), (30000, DOOR), (36000, {}), (65000, {})], [(O, 1000)]),
    "reopens": ([(1000, DOOR), (40000, {}), (75000, {}), (80000, DOOR)], [(O, 1000), (R, 75000), (O, 80000)]),
    "silent": ([(1000, DOOR), (200000, {})], [(O, 1000), (R, 101000)]),
    "gap_just_fits": ([(1000, DOOR), (101000, DOOR)], [(O, 1000)]),
    "gap_too_long": ([(1000, DOOR), (101001, DOOR)], [(O, 1000), (R, 101000), (O, 101001)]),
    "compressor": ([(1000, BAD_COMPRESSOR), (10999, BAD_COMPRESSOR), (11000, BAD_COMPRESSOR)], [(O, 11000)]),
    "compressor_breaks": ([(1000, BAD_COMPRESSOR), (6000, {}), (12000, BAD_COMPRESSOR)], []),
    "defrost": ([(1000, {"defrost_cycle_active": True}), *[(t, HOT) for t in range(2000, 120000, 5000)]], []),
    "defrost_over": ([(1000, {"defrost_cycle_active": True}), *[(t, HOT) for t in range(2000, 125000, 5000)]],
                     [(O, 122000)]),
    "defrost_closes": ([(1000, HOT), (6000, HOT), (11000, HOT), (12000, {**HOT, "defrost_cycle_active": True}),
                        (30000, HOT), (42000, HOT)], [(O, 11000), (R, 42000)]),
}
AS_OF = 130_000


@pytest.fixture(scope="module")
def replayed(spark):
    rows = [r for unit, (steps, _) in CASES.items() for r in sequence(unit, steps)]
    random.Random(7).shuffle(rows)
    out = incidents.replay(frame(spark, rows), as_of_ms=AS_OF).collect()
    return {unit: sorted((r for r in out if r["freezer_id"] == unit), key=lambda r: r["emit_ts"]) for unit in CASES}


@pytest.mark.parametrize("unit", CASES)
def test_replay(replayed, unit):
    got = [(r["lifecycle_event"], r["emit_ts"]) for r in replayed[unit] if r["lifecycle_event"] != H]
    # a unit silent at the end closes on the replay clock; the listed cases stop before that
    assert [g for g in got if g[0] != R or g in CASES[unit][1] or g[1] <= CASES[unit][0][-1][0]] == CASES[unit][1]


def test_incident_rows(replayed):
    opened, raised = replayed["escalates"][:2]
    assert opened["incident_id"] == raised["incident_id"] == "escalates:1000"
    assert (opened["alert_type"], opened["escalation_level"]) == ("DOOR_OPEN_TOO_LONG", 0)
    assert (raised["alert_type"], raised["escalation_level"], raised["peak_temp_c"]) == (
        "MULTI_SIGNAL_CRITICAL", 2, -12.0)
    down = replayed["severity_up"]
    assert all(r["alert_severity"] == "critical" for r in down if r["emit_ts"] >= 2000)
    assert [r["closed_by"] for r in replayed["silent"] if r["lifecycle_event"] == R] == ["stale"]
    assert [r["closed_by"] for r in replayed["recovers"] if r["lifecycle_event"] == R] == ["recovery"]


def test_heartbeats_every_20s_with_the_last_reading(replayed):
    beats = [(r["emit_ts"], r["event_id"]) for r in replayed["recovers"] if r["lifecycle_event"] == H]
    assert beats == [(21000, "recovers-0001")]
    silent = [r["emit_ts"] for r in replayed["silent"] if r["lifecycle_event"] == H]
    assert silent == [21000, 41000, 61000, 81000]


def test_trend_keeps_sixteen_points(spark):
    rows = sequence("t", [(1000 * i, DOOR if i == 21 else {"temperature_c": -20.0 + i / 10}) for i in range(1, 22)])
    row = incidents.replay(frame(spark, rows), as_of_ms=22000).first()
    assert [p["ts"] for p in row["temp_trend"]] == list(range(6000, 22000, 1000))
    ring = signals.with_trend(frame(spark, rows)).orderBy("event_ts").collect()[-1]["temp_trend"]
    assert ring == row["temp_trend"]


# --- the stream processor, driven by hand -------------------------------------------------------

class Handle:
    """Stands in for the engine: one value state and a set of timers."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema, ttl=None):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def drive(clock="processing", **kw):
    handle = Handle()
    proc = P.IncidentProcessor(S.ENRICHED_SCHEMA, clock, **kw)
    proc.init(handle)
    return proc, handle


def flagged(spark, rows):
    return P.with_flags(frame(spark, rows)).collect()


@pytest.fixture(scope="module")
def case_rows(spark):
    rows = flagged(spark, [r for unit, (steps, _) in CASES.items() for r in sequence(unit, steps)])
    return {unit: [r for r in rows if r["freezer_id"] == unit] for unit in CASES}


@pytest.mark.parametrize("unit", CASES)
@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_processor_on_the_event_clock(case_rows, unit, batch):
    proc, _ = drive("event")
    rows = sorted(case_rows[unit], key=lambda r: r["event_ts"])
    out = []
    for i in range(0, len(rows), batch):
        out += proc.handleInputRows((unit,), iter(reversed(rows[i:i + batch])), None)
    got = [(r["lifecycle_event"], r["emit_ts"]) for r in out if r["lifecycle_event"] != H]
    assert got == CASES[unit][1]


def test_processor_timers(case_rows):
    proc, handle = drive()
    rows = case_rows["recovers"]
    out = list(proc.handleInputRows(("u",), iter(rows[:1]), Clock(5_000_000)))
    assert [r["lifecycle_event"] for r in out] == [O] and handle.timers == [5_020_000]
    handle.timers.clear()  # the engine removes a timer that fired
    beat = list(proc.handleExpiredTimer(("u",), Clock(5_020_300), None))
    assert [(r["lifecycle_event"], r["emit_ts"]) for r in beat] == [(H, 5_020_300)]
    assert handle.timers == [5_040_300]
    handle.timers.clear()
    stale = list(proc.handleExpiredTimer(("u",), Clock(5_090_000), None))
    assert [(r["lifecycle_event"], r["closed_by"]) for r in stale] == [(R, "stale")] and handle.timers == []
    assert list(proc.handleExpiredTimer(("u",), Clock(5_100_000), None)) == []


def test_processor_clears_timers_on_recovery(case_rows):
    proc, handle = drive()
    for r in sorted(case_rows["recovers"], key=lambda r: r["event_ts"]):
        list(proc.handleInputRows(("u",), iter([r]), Clock(r["event_ts"])))
    assert handle.timers == []


def test_late_readings(case_rows):
    rows = sorted(case_rows["recovers"], key=lambda r: r["event_ts"])
    for late, expected in (("drop", []), ("keep", [O])):
        proc, _ = drive("event", late=late)
        list(proc.handleInputRows(("u",), iter(rows[1:]), None))
        out = list(proc.handleInputRows(("u",), iter(rows[:1]), None))
        assert [r["lifecycle_event"] for r in out] == expected
