"""The scenario control folder: small append-only JSON records, the newest one counts."""
from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import PySparkException

from coldwatch.schemas import SCENARIOS

CONTROL_SCHEMA = "scenario string, ts bigint"


def append_scenario(spark: SparkSession, folder: str, scenario: str, ts_ms: int | None = None) -> None:
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}; known: {', '.join(SCENARIOS)}")
    ts_ms = int(time.time() * 1000) if ts_ms is None else ts_ms
    append_records(spark.createDataFrame([(scenario, ts_ms)], CONTROL_SCHEMA), folder)


def append_records(records: DataFrame, folder: str) -> None:
    """Many records (scenario, ts) at once; those that name no known scenario are written too, readers pass over them."""
    records.write.mode("append").json(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CONTROL_SCHEMA).json(folder)


def newest(records: DataFrame) -> DataFrame:
    """One row: the newest record that names a known scenario (NULLs when there is none)."""
    return records.where(F.col("scenario").isin(SCENARIOS)).agg(
        F.max_by("scenario", F.struct("ts", "scenario")).alias("scenario"), F.max("ts").alias("ts"))


def current_scenario(spark: SparkSession, folder: str | None, default: str) -> str:
    """The scenario in force now; ``default`` while the folder is missing, empty or unreadable.

    Lists the folder anew on each call, so it is meant to be called once per micro-batch.
    """
    if not folder:
        return default
    try:
        row = newest(read_records(spark, folder)).first()
    except PySparkException as problem:  # no folder yet, or one that can't be read now
        print(f"control folder not read: {type(problem).__name__}", file=sys.stderr)
        return default
    return row["scenario"] or default
