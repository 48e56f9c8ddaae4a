"""Readings for the tests: one healthy base reading and overrides."""
from coldwatch import schemas as S

T0 = 1_000_000

BASE = {
    "event_id": "e", "event_ts": T0, "device_id": "FZ-1", "freezer_id": "FZ-1", "site_id": "S0142",
    "temperature_c": -18.0, "humidity_pct": None, "door_open": False, "door_open_seconds": 0,
    "compressor_on": True, "compressor_health": 0.95, "power_state": "normal", "battery_pct": 100.0,
    "ambient_temp_c": None, "defrost_cycle_active": False, "scenario_name": "normal",
    "synthetic_severity": None, "producer_ts": T0, "input_kafka_ts": T0,
    "site_name": "Store 0142 Austin", "site_region": "TX", "freezer_type": "walk_in_freezer",
    "temperature_upper_limit": -15.0, "door_open_limit_seconds": 120,
    "maintenance_priority": "low", "inventory_value_band": "low",
}
DOOR = {"door_open": True, "door_open_seconds": 200}
WIDE_OPEN = {"door_open": True, "door_open_seconds": 300}
NO_POWER = {"power_state": "outage", "battery_pct": 10.0}
BAD_COMPRESSOR = {"compressor_on": False, "compressor_health": 0.3, "temperature_c": -15.5}


def reading(**over):
    row = {**BASE, **over}
    if "freezer_id" in over and "device_id" not in over:
        row["device_id"] = over["freezer_id"]
    return row


def frame(spark, rows):
    names = S.ENRICHED_SCHEMA.names
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], S.ENRICHED_SCHEMA)


def sequence(unit, steps):
    """Readings of one unit from (ts, overrides)."""
    return [reading(freezer_id=unit, event_ts=ts, event_id=f"{unit}-{i:04d}", **over)
            for i, (ts, over) in enumerate(steps)]
