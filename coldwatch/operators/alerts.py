"""Stateless alerting and the alert record."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.functions import rules
from coldwatch.operators import fleet as fleets

WITHIN_MS = {"within_250ms": 250, "within_1s": 1_000, "within_5s": 5_000}


def judge(enriched: DataFrame) -> DataFrame:
    """Keep the readings that trip a rule on their own, with type, severity and reason."""
    return (
        enriched.withColumn("_verdict", rules.verdict(rules.instant_flags()))
        .where(F.col("_verdict").isNotNull())
        .select("*", "_verdict.*").drop("_verdict")
        .withColumn("alert_reason", rules.reason())
    )


def stamp(alerts: DataFrame, source_mode: str | Column, now_ms: int | Column | None = None) -> DataFrame:
    """Add mode, emit time, end-to-end latency and the business windows.

    ``now_ms`` fixes the clock; without it the batch's ``current_timestamp()`` is used.
    """
    if now_ms is None:
        now = F.unix_millis(F.current_timestamp())
    else:
        now = (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)).cast("bigint")
    mode = source_mode if isinstance(source_mode, Column) else F.lit(source_mode)
    latency = F.col("end_to_end_latency_ms")
    stamped = alerts.withColumns({
        "source_mode": mode, "processing_start_ts": now, "alert_emit_ts": now,
        "end_to_end_latency_ms": now - F.col("producer_ts"),
    })
    return stamped.withColumns({name: latency <= ms for name, ms in WITHIN_MS.items()})


def as_record(stamped: DataFrame) -> DataFrame:
    """The fixed 34-column alert record; incident columns are typed NULLs when absent."""
    optional = {**S.INCIDENT_COLUMN_TYPES, "input_kafka_ts": "bigint"}
    missing = {n: F.lit(None).cast(t) for n, t in optional.items() if n not in stamped.columns}
    return stamped.withColumns(missing).select(*S.ALERT_COLUMNS)


def alert_records(events: DataFrame, fleet: DataFrame, source_mode: str | Column,
                  now_ms: int | Column | None = None) -> DataFrame:
    """Readings to stateless alert records: one broadcast join, no shuffle."""
    return as_record(stamp(judge(fleets.enrich(events, fleet)), source_mode, now_ms))


def to_payload(df: DataFrame, key: str = "event_id", keep_nulls: bool = False) -> DataFrame:
    """Message form: string key and the whole row as JSON (NULL fields dropped by default)."""
    body = F.to_json(F.struct("*"), {"ignoreNullFields": str(not keep_nulls).lower()})
    return df.select(F.col(key).cast("string").alias("key"), body.alias("value"))
