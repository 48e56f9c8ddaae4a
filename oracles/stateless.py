"""Fleet, messages, stateless rules."""
from oracles.views import FLEET, PREDICATES, READINGS, STATELESS

_JUDGED = "SELECT freezer_id FROM fleet WHERE right(freezer_id, 1) NOT IN ('4', '9')"
_ENRICHMENT = ("site_name, site_region, freezer_type, temperature_upper_limit, "
               "door_open_limit_seconds, maintenance_priority, inventory_value_band")

_PARSED = f"""{READINGS},
messages AS (
  SELECT *, CASE WHEN num % 97 = 0 THEN 'malformed'
                 WHEN num % 89 = 0 THEN 'missing:freezer_id'
                 WHEN num % 83 = 0 THEN 'malformed' END AS problem
  FROM readings
)"""

_RECORD = """
  event_id, source_mode, event_ts, producer_ts, input_kafka_ts,
  now_ms AS processing_start_ts, now_ms AS alert_emit_ts, now_ms - producer_ts AS end_to_end_latency_ms,
  device_id, freezer_id, site_id, site_name, site_region, alert_type, alert_severity, alert_reason,
  CAST(NULL AS VARCHAR) AS incident_id, CAST(NULL AS VARCHAR) AS lifecycle_event,
  CAST(NULL AS BIGINT) AS incident_started_ts, CAST(NULL AS INT) AS escalation_level,
  CAST(NULL AS DOUBLE) AS peak_temp_c, temperature_c, temperature_upper_limit, door_open, door_open_seconds,
  compressor_on, compressor_health, power_state, battery_pct, 'normal' AS scenario_name,
  now_ms - producer_ts <= 250 AS within_250ms, now_ms - producer_ts <= 1000 AS within_1s,
  now_ms - producer_ts <= 5000 AS within_5s"""

_ALERT_TABLE = f"WITH {STATELESS} SELECT {_RECORD} FROM alerted"

SQL = {
    "fleet_load": f"WITH {FLEET} SELECT * FROM fleet",
    "fleet_quality": f"""
WITH {FLEET},
units AS (
  SELECT freezer_id, site_id, freezer_type FROM fleet
  UNION ALL SELECT freezer_id, site_id, freezer_type FROM fleet WHERE right(freezer_id, 2) = '50'
),
sites AS (
  SELECT 'S' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS site_id FROM nation WHERE n_nationkey % 10 <> 7
)
SELECT 'duplicate_unit' AS problem, count(*) AS n
  FROM (SELECT freezer_id FROM units GROUP BY freezer_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_type', CAST(0 AS BIGINT)
UNION ALL SELECT 'duplicate_site', count(*) FROM (SELECT site_id FROM sites GROUP BY site_id HAVING count(*) > 1)
UNION ALL SELECT 'unit_without_limits', count(*) FROM units WHERE freezer_type IS NULL
UNION ALL SELECT 'unit_without_site', count(*) FROM units WHERE site_id NOT IN (SELECT site_id FROM sites)
""",
    "fleet_index": f"WITH {FLEET} SELECT row_number() OVER (ORDER BY freezer_id) - 1 AS idx, freezer_id FROM fleet",
    "enrich_events": f"""
WITH {READINGS},
bare AS (SELECT event_id, event_ts, freezer_id, site_id, temperature_c FROM readings)
SELECT bare.*, {_ENRICHMENT}
FROM bare LEFT JOIN (SELECT freezer_id, {_ENRICHMENT} FROM fleet) USING (freezer_id)
""",
    "enrich_misses": f"""
WITH {READINGS}
SELECT freezer_id, count(*) AS readings, min(event_ts) AS first_ts, max(event_ts) AS last_ts
FROM readings WHERE freezer_id NOT IN ({_JUDGED}) GROUP BY freezer_id
""",
    "reading_accounts": f"""
WITH {_PARSED}
SELECT count(*) AS messages, count(problem) AS quarantined,
  count(*) FILTER (problem IS NULL AND freezer_id NOT IN ({_JUDGED})) AS missed,
  count(*) FILTER (problem IS NULL AND freezer_id IN ({_JUDGED})) AS judged FROM messages
""",
    "events_parse": f"""
WITH {_PARSED}
SELECT event_id, event_ts, device_id, freezer_id, site_id, temperature_c,
       CAST(NULL AS DOUBLE) AS humidity_pct, door_open, door_open_seconds, compressor_on, compressor_health,
       power_state, battery_pct, CAST(NULL AS DOUBLE) AS ambient_temp_c, defrost_cycle_active,
       'normal' AS scenario_name, CAST(NULL AS VARCHAR) AS synthetic_severity, producer_ts, input_kafka_ts
FROM messages WHERE problem IS NULL
""",
    "events_quarantine": f"WITH {_PARSED} SELECT problem, input_kafka_ts FROM messages WHERE problem IS NOT NULL",
    "event_payload": f"""
WITH {READINGS}
SELECT freezer_id AS key, event_id, event_ts, temperature_c, power_state, door_open,
       CAST(NULL AS DOUBLE) AS humidity_pct FROM readings
""",
    "rule_predicates": f"WITH {READINGS} SELECT event_id, {PREDICATES} FROM readings",
    "alerts_stateless": _ALERT_TABLE,
    "stream_alerts": _ALERT_TABLE,
    "alert_reasons": f"WITH {STATELESS} SELECT event_id, alert_type, alert_severity, alert_reason FROM alerted",
    "alert_payload": f"""
WITH {STATELESS}
SELECT event_id AS key, freezer_id, alert_type, alert_severity, now_ms - producer_ts AS end_to_end_latency_ms,
       now_ms - producer_ts <= 1000 AS within_1s, false AS has_incident FROM alerted
""",
    "latency_stamp": f"""
WITH {STATELESS}
SELECT event_id, source_mode, now_ms AS processing_start_ts, now_ms AS alert_emit_ts,
       now_ms - producer_ts AS end_to_end_latency_ms, now_ms - producer_ts <= 250 AS within_250ms,
       now_ms - producer_ts <= 1000 AS within_1s, now_ms - producer_ts <= 5000 AS within_5s
FROM alerted
""",
}

# a reading is late if its unit had a newer one in an earlier part of the stream; parts go by the number modulo 3
SQL["stream_accounts"] = f"""
WITH {_PARSED},
good AS (
  SELECT freezer_id, event_ts, CAST(event_id AS VARCHAR) AS id, num % 3 AS part FROM messages
  WHERE problem IS NULL AND freezer_id IN ({_JUDGED})),
lateness AS (
  SELECT count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS judged FROM (
    SELECT EXISTS (SELECT 1 FROM good b WHERE b.freezer_id = a.freezer_id AND b.part < a.part
                   AND (b.event_ts > a.event_ts OR (b.event_ts = a.event_ts AND b.id > a.id))) AS late FROM good a))
SELECT count(*) AS messages, count(problem) AS quarantined,
  count(*) FILTER (problem IS NULL AND freezer_id NOT IN ({_JUDGED})) AS missed, any_value(late) AS late, any_value(judged) AS judged
FROM messages, lateness
"""
SQL["fleet_from_csv"] = SQL["fleet_load"]
