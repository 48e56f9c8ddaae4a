"""Splitting a unit that holds an outsized share of the readings into time slices.

Everything per unit is sequential in time, so a hot unit cannot be salted at random: its
readings are cut into consecutive slices of about ``max_rows`` rows, and each slice also
receives *context*, the readings just before it that its time windows look back on. Context
reaches back at least ``CONTEXT_ROWS`` readings (the points of a trend) and past a full ``CONTEXT_MS`` (the longest
time window of the rules), or to the unit's first reading. The smoothed temperature needs none: its steps over
a stretch of readings make one affine map, the maps of consecutive grains compose, and a slice starts from the value that those before
its first row give (``ewma_before``). Units below the threshold stay whole.

A unit that reports so fast that context would outgrow its slices gets longer slices: twice
the readings of one context, so that no more than half of a task's rows are context.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coldwatch.schemas import DEFROST_GRACE_MS, EWMA_ALPHA, TREND_POINTS
from coldwatch.session import freeze

GRAINS_MS = (60_000, 1_000)  # slices begin on a minute, or on a second where minutes are too full
CONTEXT_ROWS = TREND_POINTS
EWMA_GRAINS = 128  # each has a reading at least, and 0.6 ** 128 is below any double's precision
CONTEXT_MS = DEFROST_GRACE_MS
MAX_ROWS = 2_000_000


def counts(readings: DataFrame) -> DataFrame:
    return readings.groupBy("freezer_id").agg(
        F.count("*").alias("rows"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))


def hot_units(per_unit: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Of units and their ``counts``, those with more readings than one task should take (at most rows / max_rows of them),
    with their mean rate and the slice size that suits it."""
    rate = F.col("rows") / (F.col("last_ts") - F.col("first_ts") + 1)
    return (
        per_unit.where(F.col("rows") > max_rows)
        .withColumn("rows_per_ms", rate)
        .withColumn("slice_rows", F.greatest(F.lit(max_rows), F.ceil(rate * 2 * CONTEXT_MS)))
    )


def slice_plan(readings: DataFrame, hot: DataFrame, grain_ms: int = GRAINS_MS[0],
               context_rows: int = CONTEXT_ROWS) -> DataFrame:
    """Which slices each (hot unit, grain of time) belongs to, as its own or as context.

    Works on one row per unit and grain, counted before the shuffle, so a unit's plan is
    bounded by its time span and not by its readings.
    """
    grain = F.floor(F.col("event_ts") / grain_ms)
    per_grain = (
        readings.select("freezer_id", grain.alias("grain"))
        .join(hot.select("freezer_id", "slice_rows"), "freezer_id")
        .groupBy("freezer_id", "slice_rows", "grain").agg(F.count("*").alias("n"))
    )
    in_time = Window.partitionBy("freezer_id").orderBy("grain")
    earlier = F.sum("n").over(in_time.rowsBetween(Window.unboundedPreceding, -1))
    numbered = (
        per_grain.withColumn("before", F.coalesce(earlier, F.lit(0)))
        .withColumn("slice", F.floor(F.col("before") / F.col("slice_rows")))
        .withColumn("opens", F.coalesce(F.lag("slice").over(in_time) != F.col("slice"), F.lit(True)))
        .withColumn("next_grain", F.lead("grain").over(in_time))
        .withColumn("last_slice", F.max("slice").over(Window.partitionBy("freezer_id")) == F.col("slice"))
    )
    # A grain with fewer than context_rows readings between it and a slice's start is within
    # context_rows grains of that start, since every listed grain has readings.
    reach = max(context_rows, CONTEXT_MS // grain_ms + 1)
    ahead = numbered.withColumn("starts_ahead", F.collect_list(
        F.when(F.col("opens"), F.struct("slice", "grain", "before", "last_slice"))
    ).over(in_time.rowsBetween(1, reach)))
    needed = F.filter(
        "starts_ahead",
        lambda s: (s["grain"] - F.col("next_grain") <= CONTEXT_MS // grain_ms)
        | (s["before"] - F.col("before") - F.col("n") < context_rows))
    own = F.array(F.struct("slice", F.lit(False).alias("is_context"), "last_slice"))
    context = F.transform(needed, lambda s: F.struct(
        s["slice"].alias("slice"), F.lit(True).alias("is_context"), s["last_slice"].alias("last_slice")))
    return ahead.select("freezer_id", "grain", F.inline(F.concat(own, context)))


def ewma_before(readings: DataFrame, grain_ms: int) -> DataFrame:
    """freezer_id, grain, ewma_in: the smoothed temperature just before each grain's first reading (NULL before a unit's first).

    n readings take e to a e + b, with a = 0.6 ** n and b a weighted sum of theirs: one such map per unit and grain, composed
    over the grains before, oldest first.
    """
    keep = F.lit(1.0 - EWMA_ALPHA)
    known = F.col("ewma_in") if "ewma_in" in readings.columns else F.lit(None).cast("double")
    grained = readings.select("freezer_id", "event_ts", "event_id", "temperature_c", known.alias("known"), F.floor(F.col("event_ts") / grain_ms).alias("grain"))
    behind = F.row_number().over(Window.partitionBy("freezer_id", "grain").orderBy(F.desc("event_ts"), F.desc("event_id"))) - 1
    n = F.count("*")
    maps = grained.withColumn("_behind", behind).groupBy("freezer_id", "grain").agg(
        F.pow(keep, n).alias("a"), F.sum(EWMA_ALPHA * F.col("temperature_c") * F.pow(keep, "_behind")).alias("b"),
        F.max_by("temperature_c", "_behind").alias("first_temp"), F.max_by("known", "_behind").alias("known"))
    in_time = Window.partitionBy("freezer_id").orderBy("grain")
    earlier = F.collect_list(F.struct("a", "b", F.coalesce("known", "first_temp").alias("start"))).over(in_time.rowsBetween(-EWMA_GRAINS, -1))
    # starting from a first temperature makes that reading count in full, and is forgotten where it isn't the unit's first
    value = F.aggregate("maps", F.col("maps")[0]["start"], lambda e, m: e * m["a"] + m["b"])
    return maps.withColumn("maps", earlier).select("freezer_id", "grain", F.when(F.size("maps") > 0, value).alias("ewma_in"))


def whole(readings: DataFrame) -> DataFrame:
    """Readings as one slice per unit. ``ewma_in``, where readings have it, is what the smoothed temperature was before them."""
    known = F.col("ewma_in") if "ewma_in" in readings.columns else F.lit(None).cast("double")
    return readings.withColumns({"slice": F.lit(0).cast("bigint"), "is_context": F.lit(False), "last_slice": F.lit(True), "ewma_in": known})


def plan_slices(readings: DataFrame, max_rows: int = MAX_ROWS, context_rows: int = CONTEXT_ROWS,
                per_unit: DataFrame | None = None) -> tuple[tuple[DataFrame, int] | None, int | None]:
    """The slice plan and its grain (None if no unit is hot), and the newest reading's time.

    One count per unit over two columns decides (``per_unit``, where it has been taken). The plan is written once, a row per hot
    unit, grain and slice, so that joins know its size.
    """
    per_unit = counts(readings) if per_unit is None else per_unit
    newest, most = per_unit.agg(F.max("last_ts"), F.max("rows")).first()
    if most is None or most <= max_rows:
        return None, newest
    hot = freeze(hot_units(per_unit, max_rows), "hot-units")
    fastest = hot.agg(F.max(F.col("rows_per_ms") / F.col("slice_rows"))).first()[0]
    coarse, fine = GRAINS_MS
    grain_ms = coarse if fastest * coarse <= 0.25 else fine
    plan = slice_plan(readings, hot, grain_ms, context_rows)
    starts = plan.groupBy("freezer_id", "slice").agg(F.min("grain").alias("grain")).join(
        ewma_before(readings.join(hot.select("freezer_id"), "freezer_id", "left_semi"), grain_ms), ["freezer_id", "grain"]).drop("grain")
    return (freeze(plan.join(starts, ["freezer_id", "slice"]), "slice-plan"), grain_ms), newest


def sliced_by(readings: DataFrame, plan: tuple[DataFrame, int] | None) -> DataFrame:
    """Readings with ``slice``, ``is_context`` and ``last_slice``: once per slice that they belong to; units that the
    plan doesn't name stay whole. One join, no matter how many units are hot."""
    if plan is None:
        return whole(readings)
    rows, grain_ms = plan
    known = F.col("ewma_in") if "ewma_in" in readings.columns else F.lit(None).cast("double")
    grained = readings.withColumn("_known", known).drop("ewma_in").withColumn("grain", F.floor(F.col("event_ts") / grain_ms))
    return grained.join(rows, ["freezer_id", "grain"], "left").withColumn("ewma_in", F.coalesce("ewma_in", "_known")).drop("grain", "_known").withColumns({
        "slice": F.coalesce("slice", F.lit(0).cast("bigint")), "is_context": F.coalesce("is_context", F.lit(False)),
        "last_slice": F.coalesce("last_slice", F.lit(True))})


def cold_and_hot(readings: DataFrame, max_rows: int = MAX_ROWS,
                 context_rows: int = CONTEXT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Readings of ordinary units as they are, and those of hot units in slices (None if no unit is hot).

    Without a hot unit the readings pass through with constants and nothing is joined or copied.
    """
    plan, _ = plan_slices(readings, max_rows, context_rows)
    if plan is None:
        return whole(readings), None
    rows, grain_ms = plan
    cold = readings.join(rows.select("freezer_id").distinct(), "freezer_id", "left_anti")
    sliced = readings.withColumn("grain", F.floor(F.col("event_ts") / grain_ms)).join(rows, ["freezer_id", "grain"]).drop("grain")
    return whole(cold), sliced


def assign_slices(readings: DataFrame, max_rows: int = MAX_ROWS,
                  context_rows: int = CONTEXT_ROWS) -> tuple[DataFrame, bool]:
    """Readings with ``slice``, ``is_context`` and ``last_slice``; and whether any unit is hot."""
    plan, _ = plan_slices(readings, max_rows, context_rows)
    return sliced_by(readings, plan), plan is not None
