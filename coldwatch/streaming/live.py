"""KPIs that follow a stream of alert records.

Each micro-batch is reduced to what a KPI still needs of it and written to its own folder, once
however often it runs; readers combine the folders. All reductions can be combined in any order
and number, so ``compact`` may fold many folders into one at any time: the folded rows and the list of the parts they stand for
become valid together, and readers leave out the parts listed.

Two KPIs need no folders of parts: Spark's own streaming aggregates keep them (``input_rate``, ``latest_metrics``).
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from coldwatch import schemas as S
from coldwatch.functions.expressions import app_mode
from coldwatch.functions.ranks import nearest_rank
from coldwatch.operators import kpi, latency, metrics
from coldwatch.streaming import sinks


def unit_states(alerts: DataFrame) -> DataFrame:
    """The records that decide which units are open: of each incident the newest, and the newest with either latency."""
    seen = latency.with_segments(alerts).withColumn("_at", kpi.arrival())
    key = [app_mode(F.col("source_mode")), "freezer_id", "incident_id"]
    newest = lambda wanted: F.max(F.when(wanted, F.col("_at"))).over(Window.partitionBy(*key))
    marked = seen.withColumns({
        "_any": newest(F.lit(True)), "_a": newest(F.col("lat_a").isNotNull()), "_b": newest(F.col("lat_b").isNotNull())})
    return marked.where("_at = _any OR _at = _a OR _at = _b").select(*alerts.columns)


def second_counts(alerts: DataFrame) -> DataFrame:
    """Records per view, by the first and last chart second that counts them."""
    moded = alerts.withColumn("mode", app_mode(F.col("source_mode")))
    return latency.per_second(moded, "alert_kafka_ts", ["mode"], latency.RATE_MS)


def latency_counts(alerts: DataFrame) -> DataFrame:
    """Measured detections by view, segment, record time and whole milliseconds."""
    stacked = latency.stacked(latency.samples(alerts))
    return stacked.where("ms IS NOT NULL").groupBy("mode", "segment", "alert_kafka_ts", "ms").agg(F.count("*").alias("hits"))


SUMS = ["alerts", *[f"opened_{s}" for s in S.SEVERITIES]]


def incident_counts(alerts: DataFrame) -> DataFrame:
    """What headline counts need of each incident. One row per incident: distinct incidents and units stay exact."""
    return kpi.per_incident(alerts.withColumn("mode", app_mode(F.col("source_mode"))))


def distinct_sketches(alerts: DataFrame) -> DataFrame:
    """The same distinct counts as sketches of fixed size, for fleets with too many incidents to keep."""
    critical = F.col("lifecycle_event").isin(S.OPENED, S.ESCALATED) & (F.col("alert_severity") == "critical")
    return alerts.withColumn("mode", app_mode(F.col("source_mode"))).groupBy("mode").agg(
        F.hll_sketch_agg("freezer_id").alias("units"), F.hll_sketch_agg(F.when(critical, F.col("incident_id"))).alias("critical"))


def _fold_seconds(parts: DataFrame) -> DataFrame:
    return parts.groupBy("mode", "_first", "_last").agg(F.sum("hits").alias("hits"))


def _fold_latencies(parts: DataFrame) -> DataFrame:
    """Records older than any window counts from now on lose their time: what is left of them is a row per millisecond."""
    newest = parts.agg(F.max("alert_kafka_ts")).first()[0]
    at = F.when(F.col("alert_kafka_ts") >= F.lit(newest).cast("long") - latency.WINDOW_MS, F.col("alert_kafka_ts"))
    return parts.groupBy("mode", "segment", at.alias("alert_kafka_ts"), "ms").agg(F.sum("hits").alias("hits"))


def _fold_incidents(parts: DataFrame) -> DataFrame:
    return parts.groupBy("mode", "freezer_id", "incident_id").agg(
        *(F.sum(c).alias(c) for c in SUMS), F.max("critical_incidents").alias("critical_incidents"), F.max("newest").alias("newest"))


def _fold_sketches(parts: DataFrame) -> DataFrame:
    return parts.groupBy("mode").agg(F.hll_union_agg("units").alias("units"), F.hll_union_agg("critical").alias("critical"))


REDUCTIONS = {  # name: how a batch is reduced, how reduced parts are combined
    "unit_states": (unit_states, unit_states),
    "second_counts": (second_counts, _fold_seconds),
    "latency_counts": (latency_counts, _fold_latencies),
    "incident_counts": (incident_counts, _fold_incidents),
    "distinct_sketches": (distinct_sketches, _fold_sketches),
}


def follow(alerts: DataFrame, reduction: str, folder: str, checkpoint: str,
           trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Start a query that keeps ``folder`` up to date with a stream of alert records."""
    return (alerts.writeStream.foreachBatch(sinks.batch_table(folder, REDUCTIONS[reduction][0]))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


PART = ["query_id", "batch_id"]


def _folded(spark: SparkSession, folder: str) -> str | None:
    """The newest valid fold of a folder's parts."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_folded")
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    versions = sorted((f.getPath().toString() for f in store.listStatus(where)), reverse=True)
    path = spark._jvm.org.apache.hadoop.fs.Path
    return next((v for v in versions if store.exists(path(f"{v}/covered/_SUCCESS"))), None)


def _parts(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all parts, those of folded ones through their fold."""
    loose = spark.read.parquet(folder).withColumn("batch_id", F.col("batch_id").cast("long"))
    fold = _folded(spark, folder)
    if fold is None:
        return loose.drop(*PART)
    covered = spark.read.parquet(f"{fold}/covered")
    return loose.join(covered, PART, "left_anti").drop(*PART).unionByName(spark.read.parquet(f"{fold}/rows"))


def compact(spark: SparkSession, folder: str, reduction: str) -> None:
    """Folds all parts of ``folder`` into one. Readers go over to it when its list of parts is whole;
    parts written meanwhile stay as they are."""
    covered = spark.read.parquet(folder).select("query_id", F.col("batch_id").cast("long").alias("batch_id")).distinct()
    before = _folded(spark, folder)
    if before is not None:
        covered = covered.unionByName(spark.read.parquet(f"{before}/covered")).distinct()
    number = 1 + (int(before.rsplit("-", 1)[1]) if before else 0)
    target = f"{folder}/_folded/fold-{number:09d}"
    covered.write.mode("overwrite").parquet(f"{target}/listed")  # fixed before the rows are read
    listed = spark.read.parquet(f"{target}/listed")
    loose = spark.read.parquet(folder).withColumn("batch_id", F.col("batch_id").cast("long"))
    rows = loose.join(listed, PART, "left_semi").drop(*PART)
    if before is not None:
        done = spark.read.parquet(f"{before}/covered")
        rows = loose.join(listed, PART, "left_semi").join(done, PART, "left_anti").drop(*PART).unionByName(spark.read.parquet(f"{before}/rows"))
    REDUCTIONS[reduction][1](rows).write.mode("overwrite").parquet(f"{target}/rows")
    listed.write.mode("overwrite").parquet(f"{target}/covered")


def open_units(spark: SparkSession, folder: str, as_of_ms: int) -> DataFrame:
    """Units in alert now; here and below ``as_of_ms`` must not lie before the newest record."""
    return kpi.open_units(_parts(spark, folder), as_of_ms)


def alert_rate(spark: SparkSession, folder: str, as_of_ms: int) -> DataFrame:
    return latency.alert_rate_of(_parts(spark, folder), as_of_ms)


def latency_percentiles(spark: SparkSession, folder: str, as_of_ms: int) -> DataFrame:
    """p50/p95/p99/max per view and segment over the last five minutes."""
    recent = _parts(spark, folder).where(F.col("alert_kafka_ts").between(as_of_ms - latency.WINDOW_MS, as_of_ms))
    return nearest_rank(recent, ["mode", "segment"], "ms", weight="hits")


def business(spark: SparkSession, incident_folder: str, latency_folder: str, as_of_ms: int) -> DataFrame:
    """Headline counts per view."""
    per_incident = _fold_incidents(_parts(spark, incident_folder))
    recent = _parts(spark, latency_folder).where((F.col("segment") == "pipeline") & F.col("alert_kafka_ts").between(as_of_ms - latency.WINDOW_MS, as_of_ms))
    measured = recent.groupBy("mode").agg(
        F.sum("hits").alias("measured"), F.sum(F.when(F.col("ms") <= latency.BUCKET_EDGES["le_250ms"], F.col("hits")).otherwise(0)).alias("fresh"))
    return kpi.headline(per_incident, as_of_ms).join(measured, "mode", "left").withColumn("fresh_pct", kpi.fresh_pct()).drop("measured", "fresh")


def estimated_counts(spark: SparkSession, folder: str) -> DataFrame:
    """units_monitored and critical_incidents per view, estimated from sketches."""
    both = _fold_sketches(_parts(spark, folder))
    return both.select("mode", F.hll_sketch_estimate("units").alias("units_monitored"), F.hll_sketch_estimate("critical").alias("critical_incidents"))


# --- kept by streaming aggregates -----------------------------------------------------------------------

LATE_MS = 300_000


def input_rate_counts(events: DataFrame, late_ms: int = LATE_MS) -> DataFrame:
    """Stream of events to ``slot`` and ``hits``: arrivals within the 5 s up to each whole second, both ends included.

    Sliding event-time windows under a watermark: rows up to ``late_ms`` late still count, and state is kept no longer than that.
    """
    at = F.timestamp_millis("input_kafka_ts")
    windows = events.select(at.alias("at")).withWatermark("at", f"{late_ms} milliseconds").groupBy(
        F.window("at", f"{latency.RATE_MS + 1} milliseconds", "1 second"))
    return windows.agg(F.count("*").alias("hits")).select(
        (F.unix_millis("window.start") / 1000 + latency.RATE_MS // 1000).cast("long").alias("slot"), "hits")


def follow_updates(stream: DataFrame, folder: str, checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Each batch's changed rows of a streaming aggregate, as a part of ``folder``."""
    return (stream.writeStream.outputMode("update").foreachBatch(sinks.batch_table(folder))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def _newest_rows(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    rows = spark.read.parquet(folder).withColumn("batch_id", F.col("batch_id").cast("long"))
    values = [c for c in rows.columns if c not in (*keys, *PART)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_row")).select(*keys, "_row.*")


def input_rate(spark: SparkSession, folder: str, as_of_ms: int) -> DataFrame:
    """Arrivals per second over the trailing 5 s, one point a second for the last minute."""
    return latency.input_rate_of(_newest_rows(spark, folder, ["slot"]), as_of_ms)


def latest_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Per view: total rows in, newest known input rate and lag, newest engine percentiles (``metrics.latest`` as a stream)."""
    return _newest_rows(spark, folder, ["mode"])


def metric_updates(records: DataFrame) -> DataFrame:
    """Stream of metric records to the latest state per view: a row of state per view, each field the last one known."""
    return metrics.latest(records)
