"""Record contracts shared by every operator.

All times are epoch milliseconds (bigint). The names, their order, the enumerations
and the numeric limits below are fixed values: downstream readers depend on them.
"""
from __future__ import annotations

from pyspark.sql import types as T

_STR, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_DBL, _BOOL = T.DoubleType(), T.BooleanType()


# --- sensor event: one JSON object per message ---------------------------------------
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", _STR, False),
    T.StructField("event_ts", _LONG, False),
    T.StructField("device_id", _STR, False),
    T.StructField("freezer_id", _STR, False),
    T.StructField("site_id", _STR, False),
    T.StructField("temperature_c", _DBL, False),
    T.StructField("humidity_pct", _DBL),
    T.StructField("door_open", _BOOL, False),
    T.StructField("door_open_seconds", _INT, False),
    T.StructField("compressor_on", _BOOL, False),
    T.StructField("compressor_health", _DBL, False),
    T.StructField("power_state", _STR, False),
    T.StructField("battery_pct", _DBL, False),
    T.StructField("ambient_temp_c", _DBL),
    T.StructField("defrost_cycle_active", _BOOL),
    T.StructField("scenario_name", _STR, False),
    T.StructField("synthetic_severity", _STR),
    T.StructField("producer_ts", _LONG, False),
])
EVENT_COLUMNS = EVENT_SCHEMA.names
REQUIRED_EVENT_COLUMNS = [f.name for f in EVENT_SCHEMA.fields if not f.nullable]
# What a control record may name.
SCENARIOS = ["normal", "door_open", "compressor_failure", "power_outage", "fleet_hot_zone"]

# --- static dimensions -----------------------------------------------------------------
UNIT_COLUMNS = ["freezer_id", "freezer_type", "site_id", "maintenance_priority", "inventory_value_band"]
SITE_COLUMNS = ["site_id", "site_name", "site_region"]
THRESHOLD_SCHEMA = T.StructType([
    T.StructField("freezer_type", _STR, False),
    T.StructField("temperature_upper_limit", _DBL, False),
    T.StructField("door_open_limit_seconds", _INT, False),
])
# Type, upper limit in Celsius, door limit in seconds.
DEVICE_THRESHOLDS = [
    ("walk_in_freezer", -15.0, 180),
    ("reach_in_freezer", -15.0, 90),
    ("display_freezer", -12.0, 60),
    ("walk_in_cooler", 4.0, 180),
    ("dairy_case", 4.0, 60),
]
ENRICHMENT_COLUMNS = [
    "site_name", "site_region", "freezer_type", "temperature_upper_limit",
    "door_open_limit_seconds", "maintenance_priority", "inventory_value_band",
]
ENRICHED_SCHEMA = T.StructType(
    EVENT_SCHEMA.fields
    + [T.StructField("input_kafka_ts", _LONG)]
    + [T.StructField(n, {"temperature_upper_limit": _DBL, "door_open_limit_seconds": _INT}.get(n, _STR))
       for n in ENRICHMENT_COLUMNS]
)

# --- alert record: 34 columns in this order ------------------------------------------------
ALERT_COLUMNS = [
    "event_id", "source_mode", "event_ts", "producer_ts", "input_kafka_ts",
    "processing_start_ts", "alert_emit_ts", "end_to_end_latency_ms", "device_id",
    "freezer_id", "site_id", "site_name", "site_region", "alert_type",
    "alert_severity", "alert_reason", "incident_id", "lifecycle_event",
    "incident_started_ts", "escalation_level", "peak_temp_c", "temperature_c",
    "temperature_upper_limit", "door_open", "door_open_seconds", "compressor_on",
    "compressor_health", "power_state", "battery_pct", "scenario_name", "temp_trend",
    "within_250ms", "within_1s", "within_5s",
]
TREND_TYPE = "array<struct<ts:bigint,temp:double>>"
INCIDENT_COLUMN_TYPES = {
    "incident_id": "string", "lifecycle_event": "string", "incident_started_ts": "bigint",
    "escalation_level": "int", "peak_temp_c": "double", "temp_trend": TREND_TYPE,
}

# --- enumerations (list position is the rank) ---------------------------------------------------
ALERT_TYPES = [
    "MULTI_SIGNAL_CRITICAL", "POWER_AND_WARMING", "COMPRESSOR_FAILURE_RISK",
    "DOOR_OPEN_TOO_LONG", "TEMP_HIGH",
]
SEVERITIES = ["warning", "serious", "critical"]
OPENED, ESCALATED, HEARTBEAT, RESOLVED = "OPENED", "ESCALATED", "HEARTBEAT", "RESOLVED"
TYPE_LABELS = {
    "TEMP_HIGH": "Temperature high",
    "DOOR_OPEN_TOO_LONG": "Door open too long",
    "COMPRESSOR_FAILURE_RISK": "Compressor failure risk",
    "POWER_AND_WARMING": "Power + warming",
    "MULTI_SIGNAL_CRITICAL": "Multi-signal critical",
}

# --- rule limits and time constants (fixed values) -------------------------------------------------
DEGRADED_HEALTH = 0.5
LOW_BATTERY_PCT = 30.0
NEAR_LIMIT_C = 1.0
CRITICAL_OVER_C = 2.0
EWMA_ALPHA = 0.4
TEMP_HOLD_MS = 15_000
TEMP_HOLD_READINGS = 3
COMPRESSOR_HOLD_MS = 10_000
DEFROST_GRACE_MS = 120_000
RECOVERY_MS = 30_000
HEARTBEAT_MS = 20_000
STALE_MS = 90_000
TREND_POINTS = 16

# Smoothed temperatures closer together than this are the same temperature: far below any
# sensor's resolution, far above double rounding, so that a unit resting exactly on its
# limit does not count as over it because sums were taken in a different order.
TIE_C = 1e-13
