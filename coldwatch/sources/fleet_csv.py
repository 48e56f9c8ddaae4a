"""The static CSV dimensions: header rows, declared types, no inference."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coldwatch import schemas as S
from coldwatch.operators import fleet

_TYPES = {"temperature_upper_limit": "double", "door_open_limit_seconds": "int"}


def read_dimension(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    ddl = ", ".join(f"{name} {_TYPES.get(name, 'string')}" for name in columns)
    return spark.read.schema(ddl).option("header", True).csv(path)


def load_fleet(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """Join the three CSV dimensions under ``folder`` (``suffix=""`` for folders of parts)."""
    return fleet.assemble(
        read_dimension(spark, f"{folder}/freezer_metadata{suffix}", S.UNIT_COLUMNS),
        read_dimension(spark, f"{folder}/device_thresholds{suffix}", S.THRESHOLD_SCHEMA.names),
        read_dimension(spark, f"{folder}/site_metadata{suffix}", S.SITE_COLUMNS),
    )
