"""Small column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def app_mode(source_mode: Column) -> Column:
    """View name of an engine: ``mb`` for the micro-batch engine, ``rtm`` for all else."""
    return F.when(source_mode == "microbatch", F.lit("mb")).otherwise(F.lit("rtm"))


def store_label(site_id: Column, site_name: Column) -> Column:
    """Digits of the site id, else the site's name, else ``?``."""
    digits = F.regexp_replace(site_id, "[^0-9]", "")
    return F.coalesce(F.nullif(digits, F.lit("")), F.nullif(site_name, F.lit("")), F.lit("?"))
