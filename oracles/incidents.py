"""Signals and the incident lifecycle, stepped one reading at a time by recursion.

Nothing here shares an idea with the Spark side: no windows for the signals, no slices, no
prefix sums; each step computes the next state of every unit from the one before.
"""
from oracles.views import incident_readings


def signal_steps(one_hot_unit: bool = False) -> str:
    """``signals``: one row per reading with its signals and its verdict."""
    return f"""{incident_readings(one_hot_unit)},
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY freezer_id ORDER BY event_ts, event_id) AS rn,
         lead(event_ts) OVER (PARTITION BY freezer_id ORDER BY event_ts, event_id) AS next_ts
  FROM readings WHERE temperature_upper_limit IS NOT NULL
),
steps AS (
  SELECT freezer_id, rn, event_ts, temperature_c AS e, CAST(NULL AS DOUBLE) AS pe, CAST(NULL AS BIGINT) AS prev_ts,
    CASE WHEN temperature_c > temperature_upper_limit THEN event_ts END AS over_since,
    CASE WHEN temperature_c > temperature_upper_limit THEN 1 ELSE 0 END AS over_n,
    CASE WHEN NOT compressor_on AND compressor_health < 0.5
          AND temperature_c >= temperature_upper_limit - 1 THEN event_ts END AS bad_since,
    CASE WHEN defrost_cycle_active THEN event_ts + 120000 END AS defrost_until
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT freezer_id, rn, event_ts, e, pe, prev_ts,
    CASE WHEN e > lim THEN coalesce(over_since, event_ts) END,
    CASE WHEN e > lim THEN over_n + 1 ELSE 0 END,
    CASE WHEN bad THEN coalesce(bad_since, event_ts) END,
    CASE WHEN defrosting THEN event_ts + 120000 ELSE defrost_until END
  FROM (
    SELECT r.freezer_id, r.rn, r.event_ts, s.e AS pe, s.event_ts AS prev_ts, s.over_since, s.over_n, s.bad_since,
      s.defrost_until, r.temperature_upper_limit AS lim, r.defrost_cycle_active AS defrosting,
      CAST(0.4 AS DOUBLE) * r.temperature_c + CAST(0.6 AS DOUBLE) * s.e AS e,
      NOT r.compressor_on AND r.compressor_health < 0.5 AND r.temperature_c >= r.temperature_upper_limit - 1 AS bad
    FROM steps s JOIN ordered r ON r.freezer_id = s.freezer_id AND r.rn = s.rn + 1
  )
),
gated AS (
  SELECT o.*, s.e, s.pe, s.prev_ts, s.over_since, s.over_n, s.bad_since, s.defrost_until,
    s.pe IS NOT NULL AND s.e > s.pe AS rising,
    s.over_since IS NOT NULL AND (o.event_ts - s.over_since >= 15000 OR s.over_n >= 3) AS over_held,
    s.bad_since IS NOT NULL AND o.event_ts - s.bad_since >= 10000 AS bad_held,
    coalesce(o.event_ts < s.defrost_until, false) AS in_defrost,
    o.door_open AND o.door_open_seconds > o.door_open_limit_seconds AS door_too_long
  FROM ordered o JOIN steps s ON s.freezer_id = o.freezer_id AND s.rn = o.rn
),
typed AS (
  SELECT *, CASE
    WHEN temperature_c > temperature_upper_limit AND (door_too_long OR compressor_health < 0.5)
      AND (inventory_value_band = 'high' OR maintenance_priority = 'high') THEN 0
    WHEN power_state IN ('battery', 'outage') AND battery_pct < 30
      AND (rising OR temperature_c >= temperature_upper_limit - 1) THEN 1
    WHEN bad_held THEN 2
    WHEN door_too_long THEN 3
    WHEN e > temperature_upper_limit AND over_held AND NOT in_defrost THEN 4 END AS prec
  FROM gated
),
signals AS (
  SELECT *, CASE
    WHEN prec IN (0, 1) THEN 2
    WHEN prec = 2 THEN CASE WHEN e > temperature_upper_limit THEN 2 ELSE 1 END
    WHEN prec = 3 THEN CASE WHEN door_open_seconds > 2 * door_open_limit_seconds THEN 2 ELSE 0 END
    WHEN prec = 4 THEN CASE WHEN temperature_c - temperature_upper_limit >= 2 THEN 2 ELSE 0 END END AS sev
  FROM typed
)"""


TYPE_NAME = ("list_extract(['MULTI_SIGNAL_CRITICAL','POWER_AND_WARMING','COMPRESSOR_FAILURE_RISK',"
             "'DOOR_OPEN_TOO_LONG','TEMP_HIGH'], CAST({} AS INT) + 1)")
SEV_NAME = "list_extract(['warning','serious','critical'], CAST({} AS INT) + 1)"


def lifecycle(one_hot_unit: bool = False, tail: bool = True) -> str:
    """``log``: the incident stream. Without ``tail`` nothing happens after a unit's last reading."""
    return f"""{signal_steps(one_hot_unit)},
clock AS (SELECT max(event_ts) + 1 AS as_of FROM readings),
-- state after each reading, and what happened on the way to it
life AS (
  SELECT freezer_id, rn, event_ts,
    CASE WHEN prec IS NOT NULL THEN event_ts END AS opened, prec AS itype, sev AS level,
    CASE WHEN prec IS NOT NULL THEN temperature_c END AS peak, CAST(NULL AS BIGINT) AS cleared,
    CASE WHEN prec IS NOT NULL THEN 'OPENED' END AS ev,
    CAST(NULL AS BIGINT) AS stale_at, CAST(NULL AS BIGINT) AS ended_opened,
    CAST(NULL AS INT) AS ended_type, CAST(NULL AS INT) AS ended_level, CAST(NULL AS DOUBLE) AS ended_peak
  FROM signals WHERE rn = 1
  UNION ALL
  SELECT freezer_id, rn, event_ts,
    CASE WHEN recovers THEN NULL WHEN prec IS NULL THEN opened1 ELSE coalesce(opened1, event_ts) END,
    CASE WHEN recovers THEN NULL WHEN prec IS NULL THEN itype1 ELSE least(coalesce(itype1, prec), prec) END,
    CASE WHEN recovers THEN NULL WHEN prec IS NULL THEN level1 ELSE greatest(coalesce(level1, sev), sev) END,
    CASE WHEN recovers THEN NULL WHEN prec IS NULL THEN peak1
         ELSE greatest(coalesce(peak1, temperature_c), temperature_c) END,
    CASE WHEN prec IS NULL AND NOT recovers THEN cleared1 END,
    CASE WHEN recovers THEN 'RESOLVED'
         WHEN prec IS NOT NULL AND opened1 IS NULL THEN 'OPENED'
         WHEN prec < itype1 OR sev > level1 THEN 'ESCALATED' END,
    CASE WHEN goes_stale THEN silent_at END,
    CASE WHEN goes_stale OR recovers THEN opened END, CASE WHEN goes_stale OR recovers THEN itype END,
    CASE WHEN goes_stale OR recovers THEN level END, CASE WHEN goes_stale OR recovers THEN peak END
  FROM (
    SELECT *, prec IS NULL AND opened1 IS NOT NULL AND event_ts - cleared1 >= 30000 AS recovers FROM (
      SELECT *,
        CASE WHEN NOT goes_stale THEN opened END AS opened1, CASE WHEN NOT goes_stale THEN itype END AS itype1,
        CASE WHEN NOT goes_stale THEN level END AS level1, CASE WHEN NOT goes_stale THEN peak END AS peak1,
        CASE WHEN opened IS NOT NULL AND NOT goes_stale THEN coalesce(cleared, event_ts) END AS cleared1
      FROM (
        SELECT r.freezer_id, r.rn, r.event_ts, r.prec, r.sev, r.temperature_c,
          l.opened, l.itype, l.level, l.peak, l.cleared,
          l.opened + 20000 * ((l.event_ts + 90000 - l.opened + 19999) // 20000) AS silent_at,
          coalesce(l.opened + 20000 * ((l.event_ts + 90000 - l.opened + 19999) // 20000) < r.event_ts, false)
            AS goes_stale
        FROM life l JOIN signals r ON r.freezer_id = l.freezer_id AND r.rn = l.rn + 1
      )
    )
  )
),
tail AS (
  SELECT l.*, l.opened + 20000 * ((l.event_ts + 90000 - l.opened + 19999) // 20000) AS silent_at
  FROM life l JOIN (SELECT freezer_id, max(rn) AS rn FROM life GROUP BY freezer_id) USING (freezer_id, rn)
  WHERE l.opened IS NOT NULL
),
spans AS (  -- when each incident was open
  SELECT freezer_id, event_ts AS opened, rn AS opened_rn FROM life WHERE ev = 'OPENED'
),
endings AS (
  SELECT freezer_id, ended_opened AS opened, coalesce(stale_at, event_ts) AS ended FROM life WHERE ended_opened IS NOT NULL
  UNION ALL
  SELECT freezer_id, opened, silent_at FROM tail, clock WHERE {'silent_at < as_of' if tail else 'false'}
),
beats AS (
  SELECT s.freezer_id, s.opened,
         unnest(generate_series(s.opened + 20000, coalesce(e.ended, {'as_of' if tail else 'last_ts'}) - 1, 20000)) AS at
  FROM spans s LEFT JOIN endings e USING (freezer_id, opened), clock,
       (SELECT freezer_id AS fz, max(event_ts) AS last_ts FROM life GROUP BY freezer_id) z
  WHERE z.fz = s.freezer_id
),
readings_at AS (
  SELECT g.*, l.opened, l.itype, l.level, l.peak, l.ev, l.stale_at, l.ended_opened, l.ended_type,
         l.ended_level, l.ended_peak
  FROM signals g JOIN life l USING (freezer_id, rn)
),
emitted AS (
  SELECT freezer_id, rn, opened, ev AS lifecycle_event, event_ts AS emit_ts, itype, level, peak,
         CAST(NULL AS VARCHAR) AS closed_by
    FROM readings_at WHERE ev IN ('OPENED', 'ESCALATED')
  UNION ALL
  SELECT freezer_id, rn, ended_opened, 'RESOLVED', event_ts, ended_type, ended_level, ended_peak, 'recovery'
    FROM readings_at WHERE ev = 'RESOLVED'
  UNION ALL
  SELECT freezer_id, rn - 1, ended_opened, 'RESOLVED', stale_at, ended_type, ended_level, ended_peak, 'stale'
    FROM readings_at WHERE stale_at IS NOT NULL
  UNION ALL
  SELECT freezer_id, rn, opened, 'RESOLVED', silent_at, itype, level, peak, 'stale'
    FROM tail, clock WHERE {'silent_at < as_of' if tail else 'false'}
  UNION ALL
  SELECT b.freezer_id, r.rn, b.opened, 'HEARTBEAT', b.at, r.itype, r.level, r.peak, CAST(NULL AS VARCHAR)
    FROM beats b JOIN readings_at r
      ON r.freezer_id = b.freezer_id AND r.event_ts <= b.at AND (r.next_ts IS NULL OR r.next_ts > b.at)
),
log AS (
  SELECT x.freezer_id, x.freezer_id || ':' || x.opened AS incident_id, x.lifecycle_event, x.emit_ts, g.event_id,
         {TYPE_NAME.format('x.itype')} AS alert_type, {SEV_NAME.format('x.level')} AS alert_severity,
         CAST(x.level AS INT) AS escalation_level, x.peak AS peak_temp_c, g.temperature_c, x.closed_by,
         CAST(least(x.rn, 16) AS INT) AS trend_points, x.opened AS incident_started_ts,
         g.site_id, g.site_name, g.source_mode, g.event_ts, g.input_kafka_ts, g.num,
         CASE WHEN x.lifecycle_event IN ('OPENED', 'ESCALATED') OR x.closed_by = 'recovery'
              THEN g.input_kafka_ts ELSE x.emit_ts END + (g.num * 101) % 7000 AS alert_kafka_ts
  FROM emitted x JOIN signals g ON g.freezer_id = x.freezer_id AND g.rn = x.rn
)"""


_COLUMNS = """freezer_id, incident_id, lifecycle_event, emit_ts, event_id, alert_type, alert_severity,
  escalation_level, round(peak_temp_c, 6) AS peak_temp_c, round(temperature_c, 6) AS temperature_c"""


def _runs(since: str, held: str) -> str:
    return f"""
WITH RECURSIVE {signal_steps()},
runs AS (
  SELECT freezer_id, {since} AS since, max(event_ts) AS until, count(*) AS readings
  FROM gated WHERE {since} IS NOT NULL GROUP BY freezer_id, {since}
)
SELECT *, {held} AS held FROM runs
"""


def _classified(one_hot_unit: bool = False) -> str:
    return f"""
WITH RECURSIVE {signal_steps(one_hot_unit)},
stretches AS (SELECT *, count(prec) OVER (PARTITION BY freezer_id ORDER BY rn) AS alerts_so_far FROM signals)
SELECT event_id, freezer_id, {TYPE_NAME.format('prec')} AS alert_type, {SEV_NAME.format('sev')} AS alert_severity,
  round(e, 6) AS temp_ewma, prev_ts, in_defrost, defrost_until AS defrost_until_ts, e > temperature_upper_limit AS is_over,
  over_since, CAST(over_n AS BIGINT) AS consecutive_over, bad_since IS NOT NULL AS compressor_bad, bad_since AS health_bad_since,
  CASE WHEN prec IS NULL THEN min(event_ts) FILTER (prec IS NULL) OVER (PARTITION BY freezer_id, alerts_so_far) END AS quiet_since
FROM stretches
"""


SQL = {
    "temp_ewma": f"WITH RECURSIVE {signal_steps()} SELECT event_id, freezer_id, round(e, 6) AS temp_ewma FROM signals",
    "temp_slope": f"""
WITH RECURSIVE {signal_steps()}
SELECT event_id, freezer_id, coalesce(round((e - pe) / greatest((event_ts - prev_ts) / CAST(60000 AS DOUBLE),
       CAST(1 AS DOUBLE) / CAST(60 AS DOUBLE)), 6), 0) AS slope_c_per_min FROM signals
""",
    "temp_trend": f"""
WITH {incident_readings()},
t AS (
  SELECT event_id, list(event_ts) OVER w AS ts, list(temperature_c) OVER w AS temps FROM readings
  WINDOW w AS (PARTITION BY freezer_id ORDER BY event_ts, event_id ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)
)
SELECT event_id, len(ts) AS points, ts[1] AS first_ts, temps[1] AS first_temp, ts[-1] AS last_ts,
       temps[-1] AS last_temp FROM t
""",
    "defrost_windows": f"""
WITH RECURSIVE {signal_steps()}
SELECT event_id, freezer_id, defrost_until AS defrost_until_ts, in_defrost FROM signals
""",
    "over_limit_runs": _runs("over_since", "until - since >= 15000 OR readings >= 3"),
    "compressor_runs": _runs("bad_since", "until - since >= 10000"),
    "classified_readings": _classified(),
    "classified_readings_skewed": _classified(one_hot_unit=True),
    "incident_lifecycle": f"""
WITH RECURSIVE {lifecycle()}
SELECT {_COLUMNS}, closed_by, trend_points FROM log WHERE lifecycle_event <> 'HEARTBEAT'
""",
    "incident_heartbeats": f"""
WITH RECURSIVE {lifecycle()}
SELECT {_COLUMNS}, trend_points FROM log WHERE lifecycle_event = 'HEARTBEAT'
""",
    "incident_lifecycle_skewed": f"WITH RECURSIVE {lifecycle(one_hot_unit=True)} SELECT {_COLUMNS}, closed_by, trend_points FROM log",
    "stream_incidents_log": f"WITH RECURSIVE {lifecycle(tail=False)} SELECT {_COLUMNS}, closed_by, trend_points FROM log",
    "incident_summary": f"""
WITH RECURSIVE {lifecycle()}
SELECT freezer_id, incident_id, min(incident_started_ts) AS opened_ts, max(emit_ts) AS last_ts,
       round(max(peak_temp_c), 6) AS peak_temp_c, max(escalation_level) AS max_level,
       {TYPE_NAME.format("min(list_position(['MULTI_SIGNAL_CRITICAL','POWER_AND_WARMING','COMPRESSOR_FAILURE_RISK','DOOR_OPEN_TOO_LONG','TEMP_HIGH'], alert_type)) - 1")} AS final_type,
       count(*) FILTER (lifecycle_event = 'ESCALATED') AS escalations,
       count(*) FILTER (lifecycle_event = 'HEARTBEAT') AS heartbeats,
       coalesce(max(closed_by), 'open') AS outcome
FROM log GROUP BY freezer_id, incident_id
""",
}

SQL["stream_incidents_resumed"] = SQL["stream_incidents_log"]
SQL["stream_incidents_sliced"] = f"WITH RECURSIVE {lifecycle(one_hot_unit=True, tail=False)} SELECT {_COLUMNS}, closed_by, trend_points FROM log"
