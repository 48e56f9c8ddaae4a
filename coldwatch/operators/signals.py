"""Per-unit signals over time as window expressions: smoothing, slope, runs, defrost.

``part`` names the columns that bound the history (the unit, or the unit and its slice), so
one shuffle on ``part`` serves every signal. Window functions that do not build on each other
are asked for together: Spark then computes them in one pass over the sorted rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldwatch import schemas as S
from coldwatch.functions import rules

ORDER = ["event_ts", "event_id"]
UNIT = ["freezer_id"]
BLOCK = "ewma_block"
_BLOCK_ROWS = 512  # 0.6 ** -512 is about 1e113: well inside a double


def time_order(df: DataFrame) -> list[str]:
    """Time order of a unit's rows. Blocks follow time, so putting them first changes nothing
    but lets the sort for the block sums serve the later windows too."""
    return [BLOCK, *ORDER] if BLOCK in df.columns else ORDER


def _in_time(df: DataFrame, part: list[str]):
    return Window.partitionBy(*part).orderBy(*time_order(df))


def _so_far(df: DataFrame, part: list[str]):
    return _in_time(df, part).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(df: DataFrame, part: list[str]):
    return _in_time(df, part).rowsBetween(Window.unboundedPreceding, -1)


# --- smoothing -----------------------------------------------------------------------------

def _decay(exponent: Column) -> Column:
    return F.pow(F.lit(1.0 - S.EWMA_ALPHA), exponent)


def _with_block_sums(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """Row number ``_n``, its block and the mean as far as its own block determines it.

    e1 = x1, en = 0.4 xn + 0.6 e(n-1). Unrolled, en is a sum of 0.6**(n-k) terms, i.e. a
    running sum of values scaled by 0.6**-k, scaled back by 0.6**n: one pass, no recursion
    and no array per row. The sum restarts every 512 readings to keep the scale in range.
    """
    weight = F.when((F.col("_n") == 0) & _ewma_in(df).isNull(), F.lit(1.0)).otherwise(F.lit(S.EWMA_ALPHA))
    pos = F.col("_n") % _BLOCK_ROWS
    numbered = (
        df.withColumn("_n", F.row_number().over(_in_time(df, part)) - 1)
        .withColumn(BLOCK, F.floor(F.col("_n") / _BLOCK_ROWS))
    )
    in_block = (Window.partitionBy(*part, BLOCK).orderBy(*ORDER)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.withColumn(
        "_local", F.sum(weight * F.col(value) * _decay(-pos)).over(in_block) * _decay(pos))


def _block_carry(df: DataFrame, part: list[str]) -> Column:
    """The mean at the end of the block before; older blocks no longer weigh anything."""
    ends = F.when(F.col("_n") % _BLOCK_ROWS == _BLOCK_ROWS - 1, F.col("_local"))
    return F.coalesce(F.last(ends, ignorenulls=True).over(_before(df, part)), F.first(_ewma_in(df)).over(_so_far(df, part)))


def _ewma_in(df: DataFrame) -> Column:
    """The mean before a slice's first row, where that row brings it along."""
    return F.col("ewma_in") if "ewma_in" in df.columns else F.lit(None).cast("double")


def _ewma() -> Column:
    added = F.col("_carried") * _decay(F.col("_n") % _BLOCK_ROWS + 1)
    return F.col("_local") + F.coalesce(added, F.lit(0.0))


def with_ewma(df: DataFrame, part: list[str] = UNIT, value: str = "temperature_c") -> DataFrame:
    """``temp_ewma`` and, from the reading before, ``prev_ewma`` and ``prev_ts``."""
    sums = _with_block_sums(df, part, value)
    smoothed = sums.withColumns({
        "_carried": _block_carry(sums, part), "prev_ts": F.lag("event_ts").over(_in_time(sums, part)),
    }).withColumn("temp_ewma", _ewma())
    return smoothed.withColumn("prev_ewma", F.lag("temp_ewma").over(_in_time(smoothed, part))).drop(
        "_n", "_local", "_carried")


def _slope() -> Column:
    """Change of the smoothed temperature per minute, over at least one second; 0 at first."""
    minutes = F.greatest((F.col("event_ts") - F.col("prev_ts")) / F.lit(60_000.0), F.lit(1 / 60.0))
    return F.coalesce((F.col("temp_ewma") - F.col("prev_ewma")) / minutes, F.lit(0.0))


def with_slope(df: DataFrame, part: list[str] = UNIT) -> DataFrame:
    return with_ewma(df, part).withColumn("slope_c_per_min", _slope())


# --- defrost, runs, trend ----------------------------------------------------------------------

def _defrost_until(df: DataFrame, part: list[str]) -> Column:
    defrosting = rules.told_flags()["defrosting"] if rules.BITS in df.columns else F.col("defrost_cycle_active")
    active = F.when(defrosting, F.col("event_ts"))
    return F.last(active, ignorenulls=True).over(_so_far(df, part)) + S.DEFROST_GRACE_MS


def _in_defrost() -> Column:
    return F.coalesce(F.col("event_ts") < F.col("defrost_until_ts"), F.lit(False))


def with_defrost(df: DataFrame, part: list[str] = UNIT) -> DataFrame:
    """``defrost_until_ts`` of the latest defrosting reading, and ``in_defrost``."""
    return df.withColumn("defrost_until_ts", _defrost_until(df, part)).withColumn("in_defrost", _in_defrost())


def _exceeds(ewma: str) -> Column:
    over = F.col(ewma) - F.col("temperature_upper_limit") > F.lit(S.TIE_C)
    return F.coalesce(over, F.lit(False))


def _compressor_bad(df: DataFrame) -> Column:
    flags = rules.told_flags() if rules.BITS in df.columns else rules.base_flags()
    return F.coalesce(flags["compressor_risk"], F.lit(False))


def _run_since(df: DataFrame, part: list[str], flag: str) -> Column:
    """When the current run of ``flag`` began: at the reading after the last one outside it
    (``next_ts`` there), or at the first reading of all. Only meaningful inside a run."""
    after_break = F.last(F.when(~F.col(flag), F.col("next_ts")), ignorenulls=True).over(_before(df, part))
    return F.coalesce(after_break, F.first("event_ts").over(_so_far(df, part)))


def _next_ts(df: DataFrame, part: list[str]) -> Column:
    return F.lead("event_ts").over(_in_time(df, part))


def with_over_run(df: DataFrame, part: list[str] = UNIT) -> DataFrame:
    """On top of the smoothed temperature: ``is_over``, ``over_since`` and ``consecutive_over``."""
    flagged = df.withColumn("is_over", _exceeds("temp_ewma")).withColumns({
        "next_ts": _next_ts(df, part), "_row": F.row_number().over(_in_time(df, part))})
    return _over_run(flagged, part).drop("_row")


def _over_run(df: DataFrame, part: list[str]) -> DataFrame:
    last_outside = F.last(F.when(~F.col("is_over"), F.col("_row")), ignorenulls=True).over(_before(df, part))
    first_row = F.first("_row").over(_so_far(df, part)) - 1
    return df.withColumns({
        "over_since": F.when(F.col("is_over"), _run_since(df, part, "is_over")),
        "consecutive_over": F.when(
            F.col("is_over"), F.col("_row") - F.coalesce(last_outside, first_row)).otherwise(0),
    })


def _over_held() -> Column:
    return F.coalesce((F.col("event_ts") - F.col("over_since") >= S.TEMP_HOLD_MS)
                      | (F.col("consecutive_over") >= S.TEMP_HOLD_READINGS), F.lit(False))


def with_compressor_run(df: DataFrame, part: list[str] = UNIT) -> DataFrame:
    """``compressor_bad`` and ``health_bad_since``."""
    flagged = df.withColumn("compressor_bad", _compressor_bad(df)).withColumn("next_ts", _next_ts(df, part))
    return flagged.withColumn("health_bad_since", F.when(
        F.col("compressor_bad"), _run_since(flagged, part, "compressor_bad")))


def with_trend(df: DataFrame, part: list[str] = UNIT) -> DataFrame:
    """``temp_trend``: the last 16 (ts, temp) points, oldest first."""
    ring = _in_time(df, part).rowsBetween(-(S.TREND_POINTS - 1), Window.currentRow)
    point = F.struct(F.col("event_ts").alias("ts"), F.col("temperature_c").alias("temp"))
    return df.withColumn("temp_trend", F.collect_list(point).over(ring))


# --- verdict --------------------------------------------------------------------------------------

def classify(enriched: DataFrame, part: list[str] = UNIT) -> DataFrame:
    """Add all signals and the sustained rule set's ``alert_type`` and ``alert_severity`` (NULL
    when quiet). Five windows: row number, block sums, and three layers that build on each other.

    Readings that bring the bits of ``rules.with_flags`` need not bring the columns that these stand for."""
    df = _with_block_sums(enriched.withColumn("compressor_bad", _compressor_bad(enriched)), part, "temperature_c")
    df = df.withColumns({
        "_carried": _block_carry(df, part),
        "prev_ts": F.lag("event_ts").over(_in_time(df, part)),
        "next_ts": _next_ts(df, part),
        "defrost_until_ts": _defrost_until(df, part),
    }).withColumns({"temp_ewma": _ewma(), "in_defrost": _in_defrost()})
    df = df.withColumn("is_over", _exceeds("temp_ewma")).withColumns({
        "prev_ewma": F.lag("temp_ewma").over(_in_time(df, part)),
        "health_bad_since": F.when(F.col("compressor_bad"), _run_since(df, part, "compressor_bad")),
    })
    df = _over_run(df.withColumn("_row", F.col("_n")), part)
    rising = F.coalesce(F.col("temp_ewma") - F.col("prev_ewma") > F.lit(S.TIE_C), F.lit(False))
    compressor_held = F.coalesce(
        F.col("event_ts") - F.col("health_bad_since") >= S.COMPRESSOR_HOLD_MS, F.lit(False))
    told = rules.told_flags() if rules.BITS in df.columns else None
    flags = rules.sustained_flags(F.col("is_over"), rising, _over_held(), compressor_held, F.col("in_defrost"), told)
    return df.withColumns({"slope_c_per_min": _slope(), "_verdict": rules.verdict(flags)}).select(
        "*", "_verdict.*").drop("_verdict", "_n", "_row", "_local", "_carried")


def with_quiet_run(classified: DataFrame, part: list[str] = UNIT) -> DataFrame:
    """``quiet_since``: first reading of the current unbroken run without an alert."""
    df = classified.withColumn("_quiet", F.col("alert_type").isNull())
    return df.withColumn(
        "quiet_since", F.when(F.col("_quiet"), _run_since(df, part, "_quiet"))).drop("_quiet")


RUNS = {  # flag of a run: its start column, and its length column if it has one
    "is_over": ("over_since", "consecutive_over"),
    "compressor_bad": ("health_bad_since", None),
    "_quiet": ("quiet_since", None),
}


def with_carried_runs(judged: DataFrame) -> DataFrame:
    """The own rows of sliced readings, with runs and defrosting as the unit's whole past gives them.

    Context settles every verdict but not when a long run began. A row whose run has no break in its
    slice takes start and length from a summary, one row per slice: the run open at the end of
    the slice before, carried over slices that it fills.
    """
    part = ["freezer_id", "slice"]
    own = judged.where(~F.col("is_context")).withColumn("_quiet", F.col("alert_type").isNull())
    so_far = _so_far(own, part)
    own = own.withColumn("_own", F.row_number().over(_in_time(own, part)))
    own = own.withColumns({f"_last_{f}": F.max(F.when(~F.col(f), F.col("_own"))).over(so_far) for f in RUNS})
    # rows behind the same break are one run
    own = own.withColumns({f"_since_{f}": F.min(F.when(F.col(f), F.col("event_ts"))).over(
        Window.partitionBy(*part, f"_last_{f}")) for f in RUNS})
    tails = [F.max_by(F.struct(F.col(f"_last_{f}").alias("last"), F.col(f"_since_{f}").alias("since")), "_own").alias(f) for f in RUNS]
    slices = own.groupBy(*part).agg(F.count("*").alias("n"), F.min("event_ts").alias("first_ts"),
                                    F.max("defrost_until_ts").alias("defrost"), *tails)
    in_order = Window.partitionBy("freezer_id").orderBy("slice")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumns({
        "upto": F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "next_first": F.lead("first_ts").over(in_order), "unit_first": F.first("first_ts").over(in_order),
        "_defrost": F.max("defrost").over(earlier)})
    carried = ["freezer_id", "slice", "_defrost"]
    for f in RUNS:
        broken = F.last(F.when(F.col(f)["last"].isNotNull(), F.struct(
            "upto", "next_first", (F.col("n") - F.col(f)["last"]).alias("open"), F.col(f)["since"].alias("since")
        )), ignorenulls=True).over(earlier)
        before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
        slices = slices.withColumns({f"_b_{f}": broken, "_before": before}).withColumns({
            f"_count_{f}": F.when(F.col(f"_b_{f}").isNull(), F.col("_before")).otherwise(
                F.col("_before") - F.col(f"_b_{f}.upto") + F.col(f"_b_{f}.open")),
            f"_start_{f}": F.when(F.col(f"_b_{f}").isNull(), F.col("unit_first")).when(
                F.col(f"_b_{f}.open") > 0, F.col(f"_b_{f}.since")).otherwise(F.col(f"_b_{f}.next_first"))})
        carried += [f"_count_{f}", f"_start_{f}"]
    out = own.join(slices.select(*carried), part).withColumn(
        "defrost_until_ts", F.greatest("defrost_until_ts", "_defrost"))
    for f, (since, length) in RUNS.items():
        leading = F.col(f"_last_{f}").isNull() & (F.col(f"_count_{f}") > 0)
        start = F.when(leading, F.col(f"_start_{f}")).otherwise(F.col(f"_since_{f}"))
        out = out.withColumn(since, F.when(F.col(f), start))
        if length:
            rows = F.col("_own") - F.coalesce(f"_last_{f}", F.lit(0)) + F.when(leading, F.col(f"_count_{f}")).otherwise(0)
            out = out.withColumn(length, F.when(F.col(f), rows).otherwise(0))
    return out.select(*judged.columns)


def runs(flagged: DataFrame, flag: str) -> DataFrame:
    """One row per unbroken run of ``flag``: its unit, ``since``, ``until`` and ``readings``.

    Takes sliced rows (``slice``, ``is_context``). Runs are first built inside each slice;
    only those touching a slice edge (two per slice at most) meet again to be joined up.
    """
    part = ["freezer_id", "slice"]
    own = flagged.where(~F.col("is_context"))
    breaks = F.sum(F.when(F.col(flag), 0).otherwise(1))
    pieces = (
        own.withColumn("_island", breaks.over(_so_far(own, part)))
        .withColumn("_islands", breaks.over(Window.partitionBy(*part)))
        .where(F.col(flag))
        .groupBy(*part, "_island", "_islands")
        .agg(F.min("event_ts").alias("since"), F.max("event_ts").alias("until"),
             F.count("*").alias("readings"))
        .withColumn("_at_start", F.col("_island") == 0)
        .withColumn("_at_end", F.col("_island") == F.col("_islands"))
    )
    out = ["freezer_id", "since", "until", "readings"]
    inner = pieces.where(~F.col("_at_start") & ~F.col("_at_end")).select(*out)
    by_slice = Window.partitionBy("freezer_id").orderBy("slice", "_island")
    edge = pieces.where(F.col("_at_start") | F.col("_at_end"))
    joined = F.col("_at_start") & F.coalesce(F.lag("_at_end").over(by_slice), F.lit(False))
    # a run may only continue into the very next slice that has readings
    neighbours = own.select(*part).distinct().withColumn(
        "_prev", F.lag("slice").over(Window.partitionBy("freezer_id").orderBy("slice")))
    chained = (
        edge.join(neighbours, part)
        .withColumn("_new", ~(joined & (F.lag("slice").over(by_slice) == F.col("_prev"))))
        .withColumn("_new", F.coalesce("_new", F.lit(True)))
        .withColumn("_run", F.sum(F.col("_new").cast("int")).over(
            by_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("freezer_id", "_run")
        .agg(F.min("since").alias("since"), F.max("until").alias("until"),
             F.sum("readings").alias("readings"))
        .select(*out)
    )
    return inner.unionByName(chained)
