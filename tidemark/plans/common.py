"""Tables of a scale folder, and small helpers that queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """A timestamp without zone as seconds since 1970."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)
