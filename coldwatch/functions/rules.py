"""Rule predicates, the precedence ladder and the reason text, as column expressions."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coldwatch import schemas as S


def base_flags() -> dict[str, Column]:
    """Predicates that need one enriched reading and nothing else."""
    temp, limit = F.col("temperature_c"), F.col("temperature_upper_limit")
    near = temp >= limit - F.lit(S.NEAR_LIMIT_C)
    degraded = F.col("compressor_health") < F.lit(S.DEGRADED_HEALTH)
    over = temp > limit
    door = F.col("door_open") & (F.col("door_open_seconds") > F.col("door_open_limit_seconds"))
    valued = (F.col("inventory_value_band") == "high") | (F.col("maintenance_priority") == "high")
    return {
        "near_limit": near,
        "degraded": degraded,
        "temp_high": over,
        "door_too_long": door,
        "compressor_risk": ~F.col("compressor_on") & degraded & near,
        "weak_power": F.col("power_state").isin("battery", "outage")
        & (F.col("battery_pct") < F.lit(S.LOW_BATTERY_PCT)),
        "high_value": valued,
        "multi": over & (door | degraded) & valued,
    }


# What the sustained rules ask of one reading, as the bits of one column.
BITS = "_flags"
FLAGS = ["near_limit", "door_too_long", "compressor_risk", "weak_power", "multi",
         "door_critical", "hot_critical", "defrosting"]


def with_flags(enriched: DataFrame) -> DataFrame:
    """The single-reading predicates as the bits of one column, which stands for all the columns that they look at."""
    flags = base_flags()
    flags["door_critical"] = F.col("door_open_seconds") > 2 * F.col("door_open_limit_seconds")
    flags["hot_critical"] = F.col("temperature_c") - F.col("temperature_upper_limit") >= S.CRITICAL_OVER_C
    flags["defrosting"] = F.col("defrost_cycle_active")
    return enriched.withColumn(BITS, sum((F.when(flags[n], 1 << i).otherwise(0) for i, n in enumerate(FLAGS)), F.lit(0)))


def told_flags() -> dict[str, Column]:
    """The predicates read back from their bits; one that was NULL is false."""
    return {n: F.col(BITS).bitwiseAND(1 << i) != 0 for i, n in enumerate(FLAGS)}


def instant_flags() -> dict[str, Column]:
    """The rule set for a single reading: raw temperature, near the limit means warming."""
    flags = base_flags()
    flags["power_warming"] = flags["weak_power"] & flags["near_limit"]
    flags["smoothed_over"] = flags["temp_high"]
    return flags


def sustained_flags(smoothed_over: Column, rising: Column, over_held: Column, compressor_held: Column,
                    in_defrost: Column, told: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """The rule set for a unit with history: smoothed temperature, debounced slow rules. ``told``: the predicates, if their bits are there."""
    flags = dict(told or base_flags())
    flags["smoothed_over"] = smoothed_over
    flags["power_warming"] = flags["weak_power"] & (rising | flags["near_limit"])
    flags["compressor_risk"] = flags["compressor_risk"] & compressor_held
    flags["temp_high"] = smoothed_over & over_held & ~in_defrost
    return flags


def verdict(flags: Mapping[str, Column]) -> Column:
    """First matching rule as ``struct<alert_type, alert_severity>``; NULL when quiet."""
    door_s, door_max = F.col("door_open_seconds"), F.col("door_open_limit_seconds")
    door_critical = flags.get("door_critical", door_s > 2 * door_max)
    hot = flags.get("hot_critical", F.col("temperature_c") - F.col("temperature_upper_limit") >= F.lit(S.CRITICAL_OVER_C))

    def either(cond: Column, yes: str, no: str) -> Column:
        return F.when(cond, F.lit(yes)).otherwise(F.lit(no))

    ladder = {
        "MULTI_SIGNAL_CRITICAL": (flags["multi"], F.lit("critical")),
        "POWER_AND_WARMING": (flags["power_warming"], F.lit("critical")),
        "COMPRESSOR_FAILURE_RISK": (
            flags["compressor_risk"], either(flags["smoothed_over"], "critical", "serious")),
        "DOOR_OPEN_TOO_LONG": (
            flags["door_too_long"], either(door_critical, "critical", "warning")),
        "TEMP_HIGH": (flags["temp_high"], either(hot, "critical", "warning")),
    }
    return F.coalesce(*[
        F.when(ladder[name][0], F.struct(F.lit(name).alias("alert_type"),
                                         ladder[name][1].alias("alert_severity")))
        for name in S.ALERT_TYPES
    ])


# The text of each alert type and the columns it quotes.
REASON_TEXT = {
    "MULTI_SIGNAL_CRITICAL": (
        "Multiple risk factors on high-value asset: temp %.1f°C over %.1f°C limit",
        ["temperature_c", "temperature_upper_limit"]),
    "POWER_AND_WARMING": (
        "Power %s, battery %.0f%%, temp %.1f°C warming toward %.1f°C limit",
        ["power_state", "battery_pct", "temperature_c", "temperature_upper_limit"]),
    "COMPRESSOR_FAILURE_RISK": (
        "Compressor off, health %.2f, temp %.1f°C near %.1f°C limit",
        ["compressor_health", "temperature_c", "temperature_upper_limit"]),
    "DOOR_OPEN_TOO_LONG": (
        "Door open %ds (limit %ds)", ["door_open_seconds", "door_open_limit_seconds"]),
    "TEMP_HIGH": (
        "Temperature %.1f°C exceeds %.1f°C limit", ["temperature_c", "temperature_upper_limit"]),
}


def reason(alert_type: str = "alert_type") -> Column:
    """Reason text for the type in ``alert_type``; one expression for tables and streams."""
    return F.coalesce(*[
        F.when(F.col(alert_type) == name, F.format_string(text, *map(F.col, quoted)))
        for name, (text, quoted) in REASON_TEXT.items()
    ])


def rank_of(column: str | Column, names: list[str]) -> Column:
    """Position of a name in an enumeration (0-based), NULL when it is not in it."""
    column = F.col(column) if isinstance(column, str) else column
    at = F.array_position(F.array(*map(F.lit, names)), column)
    return F.when(at > 0, (at - 1).cast("int"))
