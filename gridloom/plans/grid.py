"""Grids of indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(px, py) of all pixels: one distributed range, no row is made twice."""
    i = F.col("id")
    return spark.range(width * height).select((i % width).cast("int").alias("px"), F.floor(i / width).cast("int").alias("py"))
