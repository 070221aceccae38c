"""Table sinks: write model tables and the optimisation-ready dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from haulage.config import CostConfig


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite") -> DataFrame:
    """Write ``df`` as parquet (optionally partitioned) and return the written table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def create_namespace(spark: SparkSession, name: str, location: str | None = None) -> None:
    at = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`{at}")


def write_optimization_dataset(star, path: str, cfg: CostConfig = CostConfig()) -> DataFrame:
    """Every priced carrier option, partitioned by service level, for downstream solvers."""
    from haulage.operators.costmodel import carrier_options
    opts = carrier_options(star.shipments, star.fact_freight_rates, star.dim_plant, cfg)
    return write_table(opts, path, partition_by=["service_level"])
