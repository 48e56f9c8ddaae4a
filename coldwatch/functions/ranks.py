"""Nearest-rank percentiles over whole-millisecond values, by counting.

The values of interest are whole numbers in a bounded range, so they are counted first
(partial counts before the shuffle) and ranked afterwards: the ranking sees one row per
distinct value, never one row per sample, however large a group is.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50, 95, 99)


def nearest_rank(samples: DataFrame, keys: list[str], value: str, percents=PERCENTS,
                 weight: str | None = None, histogram: dict[str, Column] | None = None) -> DataFrame:
    """Per group: ``p<N>`` = the value at 0-based rank min(n-1, N*n/100), ``max`` and ``n``.

    ``weight`` names a column that says how many samples a row stands for. ``histogram`` adds
    the number of samples whose value meets each named condition.
    """
    hits = F.sum(weight) if weight else F.count("*")
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(hits.alias("_hits"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_hits").over(upto)).withColumn("_n", F.sum("_hits").over(group))

    def at(percent: int):
        rank = F.least(F.col("_n") - 1, F.expr(f"{percent} * _n div 100"))
        return F.min(F.when(F.col("_upto") > rank, F.col(value))).alias(f"p{percent}")

    return ranked.groupBy(*keys).agg(
        *map(at, percents), F.max(value).alias("max"), F.max("_n").alias("n"),
        *[F.sum(F.when(cond, F.col("_hits")).otherwise(0)).alias(name) for name, cond in (histogram or {}).items()])
