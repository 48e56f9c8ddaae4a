"""The static side: fleet assembly, quality checks, enrichment, misses."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.session import freeze

def thresholds(spark: SparkSession) -> DataFrame:
    """The five types as a local relation: its size is known, so joins to it are broadcast."""
    rows = ", ".join(f"('{name}', {limit}D, {seconds})" for name, limit, seconds in S.DEVICE_THRESHOLDS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(S.THRESHOLD_SCHEMA.names)})")


def assemble(units: DataFrame, limits: DataFrame, sites: DataFrame) -> DataFrame:
    """One row per unit: its type's limits and its site's names (NULL where unknown).

    No hint: Spark broadcasts whichever side its statistics show to be small.
    """
    return (
        units.join(limits, "freezer_type", "left")
        .join(sites, "site_id", "left")
        .select("freezer_id", "site_id", *S.ENRICHMENT_COLUMNS)
    )


def quality(units: DataFrame, limits: DataFrame, sites: DataFrame) -> DataFrame:
    """Problems that would make a left join fan out or come up empty, one row each kind."""
    def duplicates(df: DataFrame, key: str, label: str) -> DataFrame:
        return (df.groupBy(key).count().where("count > 1")
                .agg(F.count("*").alias("n")).select(F.lit(label).alias("problem"), "n"))

    def orphans(key: str, dim: DataFrame, label: str) -> DataFrame:
        return (units.join(dim.select(key).distinct(), key, "left_anti")
                .agg(F.count("*").alias("n")).select(F.lit(label).alias("problem"), "n"))

    return (
        duplicates(units, "freezer_id", "duplicate_unit")
        .unionByName(duplicates(limits, "freezer_type", "duplicate_type"))
        .unionByName(duplicates(sites, "site_id", "duplicate_site"))
        .unionByName(orphans("freezer_type", limits, "unit_without_limits"))
        .unionByName(orphans("site_id", sites, "unit_without_site"))
    )


def dimension(fleet: DataFrame) -> DataFrame:
    """What enrichment needs of the fleet, written once: joins then know its size in bytes, and
    broadcast it below ``spark.sql.autoBroadcastJoinThreshold``; above, they shuffle, and AQE splits skew."""
    return freeze(fleet.select("freezer_id", *S.ENRICHMENT_COLUMNS), "fleet")


def enrich(events: DataFrame, fleet: DataFrame) -> DataFrame:
    """Left join on the unit; the event keeps its own site id."""
    return events.join(dimension(fleet), "freezer_id", "left")


def is_miss() -> Column:
    """An enriched reading that can never alert: its unit is unknown or has no limit."""
    return F.col("temperature_upper_limit").isNull()


def misses(events: DataFrame, fleet: DataFrame) -> DataFrame:
    """Readings, stream or table, that can never alert."""
    return enrich(events, fleet).where(is_miss()).select(*events.columns)


def with_index(fleet: DataFrame) -> DataFrame:
    """Dense 0-based position ``idx`` by unit id, without sorting the fleet in one task.

    Range partitions are ordered among themselves, so a row's position is its position in
    its partition plus the sizes of the partitions before it. The numbered rows are frozen
    first: sizes and rows must come from the same split.
    """
    numbered = freeze(
        fleet.repartitionByRange(F.col("freezer_id"))
        .sortWithinPartitions("freezer_id")
        .withColumn("_mono", F.monotonically_increasing_id()),
        "fleet-index",
    ).select("*", F.shiftright("_mono", 33).alias("_part"),
             F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per partition
        numbered.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        numbered.join(offsets, "_part")
        .withColumn("idx", F.col("_offset") + F.col("_pos"))
        .drop("_mono", "_part", "_pos", "_n", "_offset")
    )


def misses_by_unit(events: DataFrame, fleet: DataFrame) -> DataFrame:
    """How many readings each unit without limits sent, and when.

    Readings are counted per unit first: the fleet is joined to a row per unit.
    """
    per_unit = events.groupBy("freezer_id").agg(
        F.count("*").alias("readings"),
        F.min("event_ts").alias("first_ts"),
        F.max("event_ts").alias("last_ts"),
    )
    return per_unit.join(fleet.where(~is_miss()).select("freezer_id"), "freezer_id", "left_anti")


def accounts(decoded: DataFrame, fleet: DataFrame) -> DataFrame:
    """messages, quarantined, missed, judged: nothing that came in is in none of the last three, or in two."""
    per_unit = decoded.groupBy("freezer_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("problem").isNotNull()).alias("quarantined"))
    known = fleet.where(~is_miss()).select("freezer_id", F.lit(True).alias("known"))
    good = F.col("messages") - F.col("quarantined")
    total = lambda rows, name: F.coalesce(F.sum(rows), F.lit(0)).alias(name)
    return per_unit.join(known, "freezer_id", "left").agg(
        total(F.col("messages"), "messages"), total(F.col("quarantined"), "quarantined"),
        total(F.when(F.col("known").isNull(), good), "missed"), total(F.when(F.col("known"), good), "judged"))
