"""Query metrics and control records."""
from oracles.views import READINGS

_PROGRESS = f"""{READINGS},
per_second AS (
  SELECT source_mode, event_ts // 1000 AS second, count(*) AS n, max(num) AS top FROM readings GROUP BY 1, 2
),
records AS (
  SELECT source_mode, source_mode || '-consumer' AS query_name, 'q-' || source_mode AS query_id, 'run-1' AS run_id,
    second AS batch_id, CAST(NULL AS VARCHAR) AS timestamp, second * 1000 AS emit_ts, n AS num_input_rows,
    CASE WHEN top % 11 <> 0 THEN n / CAST(2 AS DOUBLE) END AS input_rows_per_second,
    CASE WHEN top % 11 <> 0 THEN CAST(n AS DOUBLE) END AS processed_rows_per_second,
    n * 7 AS trigger_duration_ms,
    CASE WHEN top % 5 <> 0 THEN CAST(top % 13 AS DOUBLE) END AS offsets_behind_latest_max,
    CASE WHEN top % 5 <> 0 THEN CAST(top % 7 AS DOUBLE) END AS offsets_behind_latest_avg,
    source_mode = 'rtm' AS is_rtm,
    CASE WHEN source_mode = 'rtm' THEN CAST(n * 2 AS DOUBLE) END AS proc_latency_p50_ms,
    CASE WHEN source_mode = 'rtm' THEN CAST(n * 3 AS DOUBLE) END AS proc_latency_p99_ms,
    CASE WHEN source_mode = 'rtm' THEN CAST(n AS DOUBLE) END AS queue_latency_p50_ms,
    CASE WHEN source_mode = 'rtm' THEN CAST(n * 2 AS DOUBLE) END AS queue_latency_p99_ms,
    CASE WHEN source_mode = 'rtm' THEN CAST(n * 4 AS DOUBLE) END AS e2e_latency_p50_ms,
    CAST(NULL AS DOUBLE) AS e2e_latency_p95_ms,
    CASE WHEN source_mode = 'rtm' THEN CAST(n * 5 AS DOUBLE) END AS e2e_latency_p99_ms
  FROM per_second
)"""

_PERCENTILES = ["proc_latency_p50_ms", "proc_latency_p99_ms", "queue_latency_p50_ms", "queue_latency_p99_ms",
                "e2e_latency_p50_ms", "e2e_latency_p95_ms", "e2e_latency_p99_ms"]


SQL = {
    "metrics_records": f"WITH {_PROGRESS} SELECT * FROM records",
    "metrics_latest": f"""
WITH {_PROGRESS},
moded AS (SELECT *, CASE source_mode WHEN 'microbatch' THEN 'mb' ELSE 'rtm' END AS mode FROM records)
SELECT mode, CAST(sum(num_input_rows) AS BIGINT) AS vol_in,
  CAST(trunc(arg_max(input_rows_per_second, emit_ts) FILTER (input_rows_per_second IS NOT NULL)) AS INT)
    AS input_rows_per_second,
  coalesce(arg_max(offsets_behind_latest_max, emit_ts) FILTER (offsets_behind_latest_max IS NOT NULL), 0) AS lag,
  {', '.join(f'arg_max({c}, emit_ts) FILTER (is_rtm) AS {c}' for c in _PERCENTILES)}
FROM moded GROUP BY mode
""",
    "scenario_resolve": """
SELECT arg_max(scenario, (ts, scenario)) AS scenario, max(ts) AS ts FROM (
  SELECT CASE event_type WHEN 'view' THEN 'door_open' WHEN 'error' THEN 'compressor_failure'
    WHEN 'signup' THEN 'power_outage' WHEN 'purchase' THEN 'fleet_hot_zone' WHEN 'click' THEN 'normal' END AS scenario,
    epoch_us(ts) // 1000 AS ts
  FROM events WHERE event_id % 4 > 1
) WHERE scenario IS NOT NULL
""",
}

SQL["stream_metrics_latest"] = SQL["metrics_latest"]
SQL["scenario_from_folder"] = SQL["scenario_resolve"]
