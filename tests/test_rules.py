"""Stateless rules, severities, precedence, reasons and the alert record."""
import pytest

from coldwatch import schemas as S
from coldwatch.operators import alerts
from samples import BAD_COMPRESSOR, DOOR, NO_POWER, T0, WIDE_OPEN, frame, reading

CASES = {
    "healthy": ({}, None, None),
    "warm": ({"temperature_c": -14.0}, "TEMP_HIGH", "warning"),
    "hot": ({"temperature_c": -12.0}, "TEMP_HIGH", "critical"),
    "at_limit": ({"temperature_c": -15.0}, None, None),
    "door": (DOOR, "DOOR_OPEN_TOO_LONG", "warning"),
    "door_long": (WIDE_OPEN, "DOOR_OPEN_TOO_LONG", "critical"),
    "door_shut": ({"door_open_seconds": 300}, None, None),
    "compressor": (BAD_COMPRESSOR, "COMPRESSOR_FAILURE_RISK", "serious"),
    "compressor_over": ({**BAD_COMPRESSOR, "temperature_c": -14.0}, "COMPRESSOR_FAILURE_RISK", "critical"),
    "compressor_cold": ({**BAD_COMPRESSOR, "temperature_c": -18.0}, None, None),
    "power": ({**NO_POWER, "temperature_c": -15.5}, "POWER_AND_WARMING", "critical"),
    "power_cold": (NO_POWER, None, None),
    "power_full": ({**NO_POWER, "battery_pct": 30.0, "temperature_c": -15.5}, None, None),
    "multi": ({**WIDE_OPEN, "temperature_c": -12.0, "inventory_value_band": "high"},
              "MULTI_SIGNAL_CRITICAL", "critical"),
    "multi_priority": ({"temperature_c": -14.5, "compressor_health": 0.4, "maintenance_priority": "high"},
                       "MULTI_SIGNAL_CRITICAL", "critical"),
    "multi_low_value": ({**WIDE_OPEN, "temperature_c": -12.0}, "DOOR_OPEN_TOO_LONG", "critical"),
    "multi_beats_power": ({**WIDE_OPEN, **NO_POWER, "temperature_c": -12.0, "inventory_value_band": "high"},
                          "MULTI_SIGNAL_CRITICAL", "critical"),
    "no_limits": ({"temperature_upper_limit": None, "door_open_limit_seconds": None, **DOOR}, None, None),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [reading(event_id=name, **over) for name, (over, _, _) in CASES.items()]
    return {r["event_id"]: r for r in alerts.judge(frame(spark, rows)).collect()}


@pytest.mark.parametrize("name", CASES)
def test_case(judged, name):
    _, kind, severity = CASES[name]
    got = judged.get(name)
    assert (got and got["alert_type"], got and got["alert_severity"]) == (kind, severity)


def test_reasons(judged):
    assert judged["hot"]["alert_reason"] == "Temperature -12.0°C exceeds -15.0°C limit"
    assert judged["door"]["alert_reason"] == "Door open 200s (limit 120s)"
    assert judged["compressor"]["alert_reason"] == "Compressor off, health 0.30, temp -15.5°C near -15.0°C limit"
    assert judged["power"]["alert_reason"] == (
        "Power outage, battery 10%, temp -15.5°C warming toward -15.0°C limit")
    assert judged["multi"]["alert_reason"] == (
        "Multiple risk factors on high-value asset: temp -12.0°C over -15.0°C limit")


@pytest.mark.parametrize("late, within", [(200, (True, True, True)), (1000, (False, True, True)),
                                          (3000, (False, False, True)), (5001, (False, False, False))])
def test_latency_windows(spark, late, within):
    row = alerts.stamp(frame(spark, [reading()]), "rtm", T0 + late).first()
    assert row["end_to_end_latency_ms"] == late
    assert (row["within_250ms"], row["within_1s"], row["within_5s"]) == within


def test_record_has_34_columns_in_order(spark):
    record = alerts.as_record(alerts.stamp(alerts.judge(frame(spark, [reading(**DOOR)])), "rtm", T0))
    assert record.columns == S.ALERT_COLUMNS and len(record.columns) == 34
    assert record.schema["temp_trend"].dataType.simpleString() == S.TREND_TYPE
    assert record.first()["incident_id"] is None


def test_payload_drops_nulls_unless_asked(spark):
    record = alerts.as_record(alerts.stamp(alerts.judge(frame(spark, [reading(**DOOR)])), "rtm", T0))
    lean, full = alerts.to_payload(record).first(), alerts.to_payload(record, keep_nulls=True).first()
    assert lean["key"] == "e" and "incident_id" not in lean["value"]
    assert '"incident_id":null' in full["value"]
