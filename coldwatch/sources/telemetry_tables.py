"""Telemetry views over the star-schema test tables: units, sites, fleet and readings."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.operators import fleet as fleets
from coldwatch.session import freeze, prepare

BASE_MS = 1_704_067_200_000  # start of the events table

# Market segment -> freezer type.
TYPE_OF_SEGMENT = {
    "AUTOMOBILE": "walk_in_freezer",
    "BUILDING": "reach_in_freezer",
    "FURNITURE": "display_freezer",
    "HOUSEHOLD": "walk_in_cooler",
    "MACHINERY": "dairy_case",
}


# Declared, so that opening a table starts no job to look at its files.
TABLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def unit_id(key: Column) -> Column:
    return F.concat(F.lit("FZ-"), F.lpad(key.cast("string"), 6, "0"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    segment_type = F.create_map(*[F.lit(x) for kv in TYPE_OF_SEGMENT.items() for x in kv])
    return table(spark, sf_dir, "customer").select(
        unit_id(F.col("c_custkey")).alias("freezer_id"),
        segment_type[F.col("c_mktsegment")].alias("freezer_type"),
        F.concat(F.lit("S"), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")).alias("site_id"),
        F.when(balance >= 7000, "high").when(balance >= 3000, "medium").otherwise("low")
        .alias("maintenance_priority"),
        F.element_at(F.array(*map(F.lit, ["low", "medium", "high"])),
                     (F.col("c_custkey") % 3 + 1).cast("int")).alias("inventory_value_band"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("site_id"),
        F.col("n_name").alias("site_name"),
        F.col("r_name").alias("site_region"),
    )


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleets.assemble(units(spark, sf_dir), fleets.thresholds(spark), sites(spark, sf_dir))


def fleet_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fleet without every unit whose number ends in 9, and with no limits where it ends in 4."""
    known = F.when(~F.col("freezer_id").endswith("4"), F.col("temperature_upper_limit"))
    return fleet(spark, sf_dir).where(~F.col("freezer_id").endswith("9")).withColumn("temperature_upper_limit", known)


PLAIN_SQUEEZE, INCIDENT_SQUEEZE = 3600, 600


def newest_ms(spark: SparkSession, sf_dir: str, squeeze: int) -> int:
    """Event time of the newest reading, from one column of the source."""
    ms = F.unix_millis(F.max("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").agg(
        (F.lit(BASE_MS) + F.floor((ms - F.lit(BASE_MS)) / F.lit(squeeze))).cast("bigint")).first()[0]


def _source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_source_events(table(spark, sf_dir, "events"))


def as_source_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "user_id", "event_type", "value",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _readings(src: DataFrame, limits: DataFrame, squeeze: int, episodes: bool, enriched: bool) -> DataFrame:
    """Shape source events into sensor readings; ``squeeze`` shortens the time axis.

    Their temperatures derive from the unit's limit; where ``limits`` is the fleet, the same join
    can bring its other columns.
    """
    ts = F.lit(BASE_MS) + F.floor((F.col("ms") - F.lit(BASE_MS)) / F.lit(squeeze))
    df = src.withColumn("event_ts", ts.cast("bigint")).withColumn("freezer_id", unit_id(F.col("user_id")))
    warm = cold_fault = F.lit(0.0)
    if episodes:
        cycle = (F.col("event_ts") - F.lit(BASE_MS)) % 240_000
        heat = (F.col("user_id") % 5 == 1) & cycle.between(60_000, 120_000)
        fault = (F.col("user_id") % 5 == 2) & cycle.between(120_000, 180_000)
        warm = F.when(heat, F.lit(2.5)).otherwise(F.lit(0.0))
        cold_fault = F.when(fault, F.lit(1.5)).otherwise(F.lit(0.0))
        df = (df.withColumn("event_type", F.when(fault, F.lit("error")).otherwise(F.col("event_type")))
              .withColumn("k", F.when(fault, F.least(F.col("k"), F.lit(40))).otherwise(F.col("k"))))
    temp = F.col("temperature_upper_limit") - F.lit(3.0) + F.col("value") / F.lit(30.0)
    if episodes:
        temp = temp + cold_fault + warm
    kind, k = F.col("event_type"), F.col("k")
    return df.join(limits, "freezer_id", "left").select(
        F.col("event_id").cast("string").alias("event_id"),
        "event_ts",
        F.col("freezer_id").alias("device_id"),
        "freezer_id",
        "site_id",
        temp.alias("temperature_c"),
        F.lit(None).cast("double").alias("humidity_pct"),
        (kind == "view").alias("door_open"),
        F.floor(F.col("value") * 4).cast("int").alias("door_open_seconds"),
        (kind != "error").alias("compressor_on"),
        (k / F.lit(100.0).cast("double")).alias("compressor_health"),
        F.when(kind == "purchase", "battery").when(kind == "signup", "outage").otherwise("normal")
        .alias("power_state"),
        k.cast("double").alias("battery_pct"),
        F.lit(None).cast("double").alias("ambient_temp_c"),
        (k >= 97).alias("defrost_cycle_active"),
        F.lit("normal").alias("scenario_name"),
        F.lit(None).cast("string").alias("synthetic_severity"),
        F.col("event_ts").alias("producer_ts"),
        (F.col("event_ts") + (F.col("event_id") * 37) % 900).alias("input_kafka_ts"),
        F.when(F.col("event_id") % 2 == 0, "rtm").otherwise("microbatch").alias("source_mode"),
        *(S.ENRICHMENT_COLUMNS if enriched else []),
    )


def _limits(spark: SparkSession, sf_dir: str, enriched: bool) -> DataFrame:
    if enriched:
        return freeze(fleet(spark, sf_dir), "fleet")
    limit_of = F.create_map(*[F.lit(x) for name, limit, _ in S.DEVICE_THRESHOLDS for x in (name, limit)])
    return units(spark, sf_dir).select(
        "freezer_id", "site_id", limit_of[F.col("freezer_type")].alias("temperature_upper_limit"))


def readings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None, enriched: bool = False) -> DataFrame:
    """One reading per event, 30 days squeezed to 12 minutes. ``events`` may be a stream.

    ``enriched`` adds the fleet's columns, as enrichment would.
    """
    src = _source_events(spark, sf_dir) if events is None else as_source_events(events)
    return _readings(src, _limits(spark, sf_dir, enriched), PLAIN_SQUEEZE, False, enriched)


def incident_readings(spark: SparkSession, sf_dir: str, events: DataFrame | None = None,
                      one_hot_unit: bool = False, enriched: bool = False) -> DataFrame:
    """One reading per event over 72 minutes, with recurring heat and compressor episodes.

    ``one_hot_unit`` gives a third of all readings to a single unit.
    """
    src = _source_events(spark, sf_dir) if events is None else as_source_events(events)
    if one_hot_unit:
        src = src.withColumn("user_id", F.when(F.col("user_id") % 3 == 0, F.lit(3)).otherwise(F.col("user_id")))
    return _readings(src, _limits(spark, sf_dir, enriched), INCIDENT_SQUEEZE, True, enriched)


def incident_log(incidents: DataFrame) -> DataFrame:
    """Add when each incident record reached the alert log."""
    delay = (F.col("event_id").cast("bigint") * 101) % 7000
    by_reading = F.col("lifecycle_event").isin(S.OPENED, S.ESCALATED) | (F.col("closed_by") == "recovery")
    since = F.when(by_reading, F.col("input_kafka_ts")).otherwise(F.col("emit_ts"))
    return incidents.withColumn("alert_kafka_ts", since + delay)
