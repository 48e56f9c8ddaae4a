"""Latency and fleet KPIs over the incident log."""
from oracles.incidents import lifecycle
from oracles.views import READINGS

AS_OF = "(SELECT as_of FROM clock)"

_TYPES = ("(VALUES ('TEMP_HIGH','Temperature high'), ('DOOR_OPEN_TOO_LONG','Door open too long'), "
          "('COMPRESSOR_FAILURE_RISK','Compressor failure risk'), ('POWER_AND_WARMING','Power + warming'), "
          "('MULTI_SIGNAL_CRITICAL','Multi-signal critical')) AS t(alert_type, label)")
_MODES = "(VALUES ('rtm'), ('mb')) AS m(mode)"

_LOG = f"""{lifecycle()},
alerts AS (
  SELECT *, CASE source_mode WHEN 'microbatch' THEN 'mb' ELSE 'rtm' END AS mode,
    list_position(['OPENED','ESCALATED','HEARTBEAT','RESOLVED'], lifecycle_event) AS step,
    CASE WHEN fresh AND alert_kafka_ts - event_ts BETWEEN 0 AND 60000 THEN alert_kafka_ts - event_ts END AS lat_a,
    CASE WHEN fresh AND alert_kafka_ts - input_kafka_ts BETWEEN 0 AND 60000 THEN alert_kafka_ts - input_kafka_ts END AS lat_b,
    CASE WHEN fresh AND input_kafka_ts - event_ts BETWEEN 0 AND 60000 THEN input_kafka_ts - event_ts END AS lat_ig
  FROM (SELECT *, lifecycle_event IN ('OPENED', 'ESCALATED') AS fresh FROM log)
)"""

_OPEN = f"""{_LOG},
past AS (SELECT * FROM alerts WHERE alert_kafka_ts <= {AS_OF}),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY mode, freezer_id
            ORDER BY alert_kafka_ts DESC, emit_ts DESC, step DESC, incident_id DESC) AS r FROM past
),
first_seen AS (
  SELECT mode, freezer_id, incident_id,
    arg_max(lat_a, (alert_kafka_ts, emit_ts, step, incident_id)) FILTER (lat_a IS NOT NULL) AS lat_a,
    arg_max(lat_b, (alert_kafka_ts, emit_ts, step, incident_id)) FILTER (lat_b IS NOT NULL) AS lat_b
  FROM past GROUP BY mode, freezer_id, incident_id
),
units AS (
  SELECT n.mode, n.freezer_id, alert_type, alert_severity, site_id, site_name, incident_id, alert_kafka_ts AS ts,
    f.lat_a, f.lat_b,
    CAST(list_position(['warning','serious','critical'], alert_severity) AS INT) AS status,
    CASE WHEN regexp_replace(site_id, '[^0-9]', '', 'g') <> '' THEN regexp_replace(site_id, '[^0-9]', '', 'g')
         ELSE coalesce(nullif(site_name, ''), '?') END AS store
  FROM newest n JOIN first_seen f USING (mode, freezer_id, incident_id)
  WHERE r = 1 AND lifecycle_event <> 'RESOLVED' AND alert_kafka_ts >= {AS_OF} - 60000
)"""


def _ranked(source: str, keys: str, value: str, percents=(50, 95, 99)) -> str:
    rank = ", ".join(f"max({value}) FILTER (i = least(n - 1, {p} * n // 100)) AS p{p}" for p in percents)
    return f"""
  SELECT {keys}, {rank}, max({value}) AS max, max(n) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) - 1 AS i,
               count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE {value} IS NOT NULL)
  GROUP BY {keys}"""


_WINDOW = f"alert_kafka_ts BETWEEN {AS_OF} - 300000 AND {AS_OF}"
_BUCKETS = ("count(*) FILTER (lat_b <= 250) AS le_250ms, count(*) FILTER (lat_b > 250 AND lat_b <= 1000) AS le_1s, "
            "count(*) FILTER (lat_b > 1000 AND lat_b <= 5000) AS le_5s, count(*) FILTER (lat_b > 5000) AS gt_5s")
_SLOTS = "SELECT unnest(generate_series(as_of // 1000 - 59, as_of // 1000)) AS slot FROM clock"

_ALERT_RATE = f"""
WITH RECURSIVE {_LOG}
SELECT m.mode, s.slot, round(count(a.incident_id) / CAST(5 AS DOUBLE), 1) AS alerts_per_s
FROM ({_SLOTS}) s CROSS JOIN {_MODES}
LEFT JOIN alerts a ON a.mode = m.mode AND a.alert_kafka_ts BETWEEN s.slot * 1000 - 5000 AND s.slot * 1000
GROUP BY m.mode, s.slot
"""

SQL = {
    "stream_open_units": f"WITH RECURSIVE {_OPEN} SELECT * FROM units",
    "latency_segments": f"WITH RECURSIVE {_LOG} SELECT incident_id, lifecycle_event, emit_ts, lat_a, lat_b, lat_ig FROM alerts",
    "latency_percentiles": f"""
WITH RECURSIVE {_LOG},
stacked AS (
  SELECT mode, 'e2e' AS segment, lat_a AS ms FROM alerts WHERE {_WINDOW}
  UNION ALL SELECT mode, 'pipeline', lat_b FROM alerts WHERE {_WINDOW}
  UNION ALL SELECT mode, 'ingest', lat_ig FROM alerts WHERE {_WINDOW}
)
{_ranked('stacked', 'mode, segment', 'ms')}
""",
    "latency_buckets": f"""
WITH RECURSIVE {_LOG}
SELECT mode, {_BUCKETS} FROM alerts WHERE lat_b IS NOT NULL AND {_WINDOW} GROUP BY mode
""",
    "latency_series": f"""
WITH RECURSIVE {_LOG},
hits AS (
  SELECT a.mode, s.slot, a.lat_b FROM ({_SLOTS}) s
  JOIN alerts a ON a.lat_b IS NOT NULL AND a.alert_kafka_ts BETWEEN s.slot * 1000 - 15000 AND s.slot * 1000
),
points AS ({_ranked('hits', 'mode, slot', 'lat_b', (95,))})
SELECT m.mode, s.slot, coalesce(p.p95, 0) AS p95
FROM ({_SLOTS}) s CROSS JOIN {_MODES} LEFT JOIN points p ON p.mode = m.mode AND p.slot = s.slot
""",
    "throughput_series": f"""
WITH {READINGS},
clock AS (SELECT max(event_ts) + 1 AS as_of FROM readings),
slots AS ({_SLOTS})
SELECT slot, CAST(round_even(count(event_id) / CAST(5 AS DOUBLE), 0) AS BIGINT) AS events_per_s
FROM slots LEFT JOIN readings ON input_kafka_ts BETWEEN slot * 1000 - 5000 AND slot * 1000 GROUP BY slot
""",
    "alert_rate_series": _ALERT_RATE,
    "stream_alert_rate": _ALERT_RATE,
    "mode_comparison": f"""
WITH RECURSIVE {_LOG},
ranked AS ({_ranked('alerts', 'mode', 'lat_b')}),
counted AS (SELECT mode, {_BUCKETS} FROM alerts WHERE lat_b IS NOT NULL GROUP BY mode)
SELECT mode, n, p50, p95, p99, max, CAST(100 AS DOUBLE) * le_250ms / n AS fresh_pct, le_250ms, le_1s, le_5s, gt_5s
FROM ranked JOIN counted USING (mode)
""",
    "open_units": f"WITH RECURSIVE {_OPEN} SELECT * FROM units",
    "open_by_type": f"""
WITH RECURSIVE {_OPEN}
SELECT m.mode, t.alert_type, count(u.freezer_id) AS n, t.label
FROM {_MODES} CROSS JOIN {_TYPES} LEFT JOIN units u ON u.mode = m.mode AND u.alert_type = t.alert_type
GROUP BY m.mode, t.alert_type, t.label
""",
    "open_by_severity": f"""
WITH RECURSIVE {_OPEN}
SELECT m.mode, s.alert_severity, count(u.freezer_id) AS n
FROM {_MODES} CROSS JOIN (VALUES ('warning'), ('serious'), ('critical')) AS s(alert_severity)
LEFT JOIN units u ON u.mode = m.mode AND u.alert_severity = s.alert_severity
GROUP BY m.mode, s.alert_severity
""",
    "site_heat": f"""
WITH RECURSIVE {_OPEN}
SELECT m.mode, lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS store, coalesce(max(u.status), 0) AS status
FROM nation CROSS JOIN {_MODES}
LEFT JOIN units u ON u.mode = m.mode AND u.store = lpad(CAST(n_nationkey AS VARCHAR), 4, '0')
GROUP BY m.mode, n_nationkey
""",
    "alert_feed": f"""
WITH RECURSIVE {_OPEN}
SELECT mode, t.label, alert_severity AS severity, site_name AS site, freezer_id AS device, lat_b AS lat_ms, ts,
       CAST(greatest(0, round_even(({AS_OF} - ts) / CAST(1000 AS DOUBLE), 0)) AS BIGINT) AS ago_s
FROM units JOIN {_TYPES} USING (alert_type) QUALIFY row_number() OVER (PARTITION BY mode ORDER BY ts DESC, freezer_id) <= 30
""",
    "top_sites": f"""
WITH RECURSIVE {_OPEN}
SELECT mode, coalesce(site_name, '') AS site, count(*) AS opened FROM past
WHERE lifecycle_event = 'OPENED' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY mode ORDER BY opened DESC, site) <= 4
""",
    "kpi_business": f"""
WITH RECURSIVE {_OPEN},
counts AS (
  SELECT mode, count(DISTINCT freezer_id) AS units_monitored,
    count(*) FILTER (lifecycle_event = 'OPENED') AS alerts,
    count(*) FILTER (lifecycle_event = 'OPENED' AND alert_severity = 'warning') AS opened_warning,
    count(*) FILTER (lifecycle_event = 'OPENED' AND alert_severity = 'serious') AS opened_serious,
    count(*) FILTER (lifecycle_event = 'OPENED' AND alert_severity = 'critical') AS opened_critical,
    count(DISTINCT incident_id) FILTER (fresh AND alert_severity = 'critical') AS critical_incidents
  FROM past GROUP BY mode
)
SELECT c.*, (SELECT count(*) FROM units u WHERE u.mode = c.mode) AS units_in_alert,
  coalesce((SELECT CAST(100 AS DOUBLE) * count(*) FILTER (lat_b <= 250) / count(*) FROM alerts a
            WHERE a.mode = c.mode AND lat_b IS NOT NULL AND {_WINDOW}), 0) AS fresh_pct
FROM counts c
""",
    "kpi_tech": f"""
WITH RECURSIVE {_OPEN},
ins AS (SELECT CASE source_mode WHEN 'microbatch' THEN 'mb' ELSE 'rtm' END AS mode, count(*) AS vol_in
        FROM readings WHERE input_kafka_ts <= {AS_OF} GROUP BY 1),
outs AS (SELECT mode, count(*) AS vol_out FROM past GROUP BY mode)
SELECT mode, coalesce(vol_in, 0) AS vol_in, coalesce(vol_out, 0) AS vol_out,
  CASE WHEN vol_out > 0 THEN 'normal' ELSE 'Live' END AS scenario_name FROM ins FULL JOIN outs USING (mode)
""",
}

SQL |= {"stream_latency_percentiles": SQL["latency_percentiles"], "stream_kpi_business": SQL["kpi_business"],
        "stream_input_rate": SQL["throughput_series"]}
