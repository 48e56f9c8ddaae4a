"""The running jobs: alerting consumers."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from coldwatch.operators import alerts, fleet
from coldwatch.streaming import sinks
from coldwatch.streaming.processor import stream_incidents


MICRO_BATCH = {"processingTime": "5 seconds"}


def incident_alerts(events: DataFrame, fleet_df: DataFrame, source_mode: str | Column,
                    clock: str = "processing", output_mode: str = "Update",
                    now_ms: int | Column | None = None, **processor) -> DataFrame:
    """Event stream to 34-column incident alert records. One shuffle in the whole query."""
    incidents = stream_incidents(fleet.enrich(events, fleet_df), clock, output_mode=output_mode, **processor)
    return alerts.as_record(alerts.stamp(incidents, source_mode, now_ms))


def run_consumer(events: DataFrame, fleet_df: DataFrame, source_mode: str, sink: str,
                 sink_options: Mapping[str, str], checkpoint: str,
                 trigger: Mapping[str, object] = MICRO_BATCH, stateful: bool = True,
                 clock: str = "processing") -> StreamingQuery:
    """Events to alert messages in a sink. Engines differ in ``trigger`` alone.

    Processing-time timers always leave something to do, so a query with them never runs out
    of work: ``availableNow`` needs the event clock (or the stateless rules).
    """
    if stateful and clock == "processing" and "availableNow" in trigger:
        raise ValueError("availableNow never ends with processing-time timers; use clock='event'")
    mode = "Update" if sink in ("kafka", "memory", "console") else "Append"
    if stateful:
        records = incident_alerts(events, fleet_df, source_mode, clock, mode)
    else:
        records = alerts.alert_records(events, fleet_df, source_mode)
    return sinks.start(alerts.to_payload(records), sink, checkpoint, sink_options, trigger,
                       mode.lower(), f"{source_mode}-consumer")
