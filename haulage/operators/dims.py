"""The six dimensions of the star schema.

Keys are dense 1..n in the natural code order (ascending, NULLs last).
All are numbered by the partition-parallel ``scalable_key``: none is small for
certain (a feed with dirty codes grows any of them).  With the ``number`` of a
``KeyRegistry`` in place of ``dense`` a code keeps its key from load to load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.key_registry import dense
from haulage.functions.keys import nulls_last
from haulage.sources.staging import Staging


def dim_plant(c: Staging, number=dense) -> DataFrame:
    cap = c.wh_capacities
    cost = c.wh_costs
    j = cap.join(cost, cap.plant_id == cost.plant_code, "inner").select(
        cap.plant_id.alias("plant_code"), cap.daily_capacity, cost.cost_per_unit)
    return number(j, "plant_key", nulls_last("plant_code", "daily_capacity", "cost_per_unit"), ["plant_code"])


def dim_port(c: Staging, number=dense) -> DataFrame:
    ol, fr = c.order_list, c.freight_rates
    ports = (c.plant_port.select(F.col("port"))
             .union(ol.select(F.col("origin_port").alias("port")))
             .union(ol.select(F.col("destination_port").alias("port")))
             .union(fr.select(F.col("origin_port_code").alias("port")))
             .union(fr.select(F.col("destination_port_code").alias("port")))
             .distinct())
    return number(ports, "port_key", nulls_last("port"), ["port"])


def dim_carrier(c: Staging, number=dense) -> DataFrame:
    fr = c.freight_rates
    carriers = (fr.select("carrier_id")
                .union(c.order_list.select(F.col("carrier").alias("carrier_id")))
                .distinct())
    # one row per tariff carrier before the join: same answer as joining every
    # tariff row and grouping afterwards, with a far smaller join input
    tariffed = fr.groupBy("carrier_id").agg(F.max("carrier_type").alias("carrier_type"),
                                            F.lit(True).alias("is_active"))
    j = carriers.join(tariffed, "carrier_id", "left").select(
        "carrier_id", "carrier_type", F.coalesce("is_active", F.lit(False)).alias("is_active"))
    return number(j, "carrier_key", nulls_last("carrier_id"), ["carrier_id"])


def dim_customer(c: Staging, number=dense) -> DataFrame:
    vmi = c.vmi_customers
    customers = (vmi.select("customer_id")
                 .union(c.order_list.select(F.col("customer").alias("customer_id")))
                 .distinct())
    vmi_ids = (vmi.where(F.col("customer_id").isNotNull()).select("customer_id").distinct()
               .select("customer_id", F.lit(True).alias("_vmi")))
    j = customers.join(vmi_ids, "customer_id", "left").select(
        "customer_id", F.coalesce("_vmi", F.lit(False)).alias("is_vmi_customer"))
    return number(j, "customer_key", nulls_last("customer_id"), ["customer_id"])


def dim_product(c: Staging, distinct: bool = False, number=dense) -> DataFrame:
    """One key per (plant, product) row as written; ``distinct=True`` one per product."""
    if distinct:
        prods = c.products_per_plant.select("product_id").distinct()
        return number(prods, "product_key", nulls_last("product_id"), ["product_id"])
    prods = c.products_per_plant.select("product_id", "plant_code")
    return number(prods, "product_key", nulls_last("product_id", "plant_code"), ["product_id", "plant_code"]).select(
        "product_key", "product_id")


def month_name(d):
    """Lower-case month name blank-padded to 9 characters ('may      ')."""
    return F.rpad(F.lower(F.date_format(d, "MMMM")), 9, " ")


def dim_date(c: Staging, number=dense) -> DataFrame:
    dates = c.order_list.select(F.col("order_date").alias("full_date")).distinct()
    d = F.col("full_date")
    keyed = number(dates, "date_key", nulls_last("full_date"), ["full_date"])
    return keyed.select(
        "date_key", "full_date",
        F.dayofmonth(d).cast("int").alias("day"),
        F.month(d).cast("int").alias("month"),
        month_name(d).alias("month_name"),
        F.quarter(d).cast("int").alias("quarter"),
        F.year(d).cast("int").alias("year"))
