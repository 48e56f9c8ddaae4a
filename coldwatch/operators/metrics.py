"""Query-progress JSON to flat metric records, and the latest state per view."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch.functions.expressions import app_mode

# Record field -> (progress object, percentile).
PERCENTILE_FIELDS = {
    "proc_latency_p50_ms": ("processingLatencyMs", "50"),
    "proc_latency_p99_ms": ("processingLatencyMs", "99"),
    "queue_latency_p50_ms": ("sourceQueuingLatencyMs", "50"),
    "queue_latency_p99_ms": ("sourceQueuingLatencyMs", "99"),
    "e2e_latency_p50_ms": ("e2eLatencyMs", "50"),
    "e2e_latency_p95_ms": ("e2eLatencyMs", "95"),
    "e2e_latency_p99_ms": ("e2eLatencyMs", "99"),
}
RECORD_COLUMNS = [
    "source_mode", "query_name", "query_id", "run_id", "batch_id", "timestamp", "emit_ts",
    "num_input_rows", "input_rows_per_second", "processed_rows_per_second",
    "trigger_duration_ms", "offsets_behind_latest_max", "offsets_behind_latest_avg", "is_rtm",
    *PERCENTILE_FIELDS,
]
_PROGRESS = """
    name string, id string, runId string, batchId bigint, timestamp string,
    numInputRows bigint, inputRowsPerSecond string, processedRowsPerSecond string,
    durationMs struct<triggerExecution: bigint>,
    sources array<struct<metrics: map<string, string>>>,
    latencies map<string, map<string, string>>
"""


def _number(text: Column) -> Column:
    return text.try_cast("double")


def flatten_progress(progress: DataFrame) -> DataFrame:
    """Columns ``source_mode``, ``progress`` (JSON), ``emit_ts`` to metric records.

    Absent parts become NULL. Percentile keys may be spelled p50, P50 or 50.
    """
    p = progress.withColumn("_p", F.from_json("progress", _PROGRESS))
    lag = F.get(F.col("_p.sources"), F.lit(0))["metrics"]

    def percentile(source: str, n: str) -> Column:
        found = F.col("_p.latencies")[source]
        return _number(F.coalesce(found[f"p{n}"], found[f"P{n}"], found[n]))

    return p.select(
        "source_mode",
        F.col("_p.name").alias("query_name"),
        F.col("_p.id").alias("query_id"),
        F.col("_p.runId").alias("run_id"),
        F.col("_p.batchId").alias("batch_id"),
        F.col("_p.timestamp").alias("timestamp"),
        "emit_ts",
        F.col("_p.numInputRows").alias("num_input_rows"),
        _number(F.col("_p.inputRowsPerSecond")).alias("input_rows_per_second"),
        _number(F.col("_p.processedRowsPerSecond")).alias("processed_rows_per_second"),
        F.col("_p.durationMs.triggerExecution").alias("trigger_duration_ms"),
        _number(lag["maxOffsetsBehindLatest"]).alias("offsets_behind_latest_max"),
        _number(lag["avgOffsetsBehindLatest"]).alias("offsets_behind_latest_avg"),
        F.coalesce(F.size("_p.latencies") > 0, F.lit(False)).alias("is_rtm"),
        *[percentile(*spec).alias(name) for name, spec in PERCENTILE_FIELDS.items()],
    )


def latest(records: DataFrame) -> DataFrame:
    """Per view: total rows in, newest known input rate and lag, newest engine percentiles."""
    when = F.struct("emit_ts", "batch_id")
    moded = records.withColumn("mode", app_mode(F.col("source_mode")))

    def newest(column: str, known: Column) -> Column:
        return F.max_by(column, F.when(known, when))

    return moded.groupBy("mode").agg(
        F.coalesce(F.sum("num_input_rows"), F.lit(0)).alias("vol_in"),
        newest("input_rows_per_second", F.col("input_rows_per_second").isNotNull())
        .cast("int").alias("input_rows_per_second"),
        F.coalesce(newest("offsets_behind_latest_max", F.col("offsets_behind_latest_max").isNotNull()),
                   F.lit(0.0)).alias("lag"),
        *[newest(name, F.col("is_rtm")).alias(name) for name in PERCENTILE_FIELDS],
    )
