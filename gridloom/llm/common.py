"""What the operators of this folder share."""

from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import components, cut, drop_cut, ranked

__all__ = ["components", "cut", "drop_cut", "ranked", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
