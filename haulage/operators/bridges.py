"""Bridge tables: feasibility constraints as distinct key pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from haulage.sources.staging import Staging


def _bridge(mapping: DataFrame, left_code: str, left_dim: DataFrame, left_key: str,
            right_code: str, right_dim: DataFrame, right_dim_code: str, right_key: str) -> DataFrame:
    j = (mapping
         .join(left_dim, mapping[left_code] == left_dim["plant_code"], "inner")
         .join(right_dim, mapping[right_code] == right_dim[right_dim_code], "inner"))
    return j.select(left_dim[left_key], right_dim[right_key]).distinct()


def bridge_plant_customer(c: Staging, dim_plant: DataFrame, dim_customer: DataFrame) -> DataFrame:
    return _bridge(c.vmi_customers, "plant_code", dim_plant, "plant_key",
                   "customer_id", dim_customer, "customer_id", "customer_key")


def bridge_plant_port(c: Staging, dim_plant: DataFrame, dim_port: DataFrame) -> DataFrame:
    return _bridge(c.plant_port, "plant_code", dim_plant, "plant_key",
                   "port", dim_port, "port", "port_key")


def bridge_plant_product(c: Staging, dim_plant: DataFrame, dim_product: DataFrame) -> DataFrame:
    return _bridge(c.products_per_plant, "plant_code", dim_plant, "plant_key",
                   "product_id", dim_product, "product_id", "product_key")
