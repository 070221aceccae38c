"""Ingest: an order list with bad records, and the keys of a model over two loads."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.key_registry import KeyRegistry
from haulage.operators import dims
from haulage.operators.clean import clean_table
from haulage.plans.loads import LoadedModel
from haulage.plans.star import Star, clean_for
from haulage.session import scratch_path
from haulage.sources.quarantine import Ingested, ingest

#: Order numbers are told apart by their remainder; these lines are damaged.
MODULUS = 50
QUANTITY, DATE, WEIGHT, SHORT, LONG, TWO = 7, 13, 21, 29, 37, 43


def _damaged_orders(spark: SparkSession, sf_dir: str) -> Ingested:
    """The order list written as CSV lines, some with a unit behind the quantity, a date in another pattern,
    a weight in words, a field too few or too many, and ingested again."""
    orders = clean_for(spark, sf_dir).order_list
    left = F.pmod("order_id", F.lit(MODULUS))
    written = {c: F.col(c).cast("string") for c in orders.columns}
    written["unit_quantity"] = F.when(left.isin(QUANTITY, TWO), F.concat(written["unit_quantity"], F.lit(" pcs"))).otherwise(written["unit_quantity"])
    written["order_date"] = F.when(left == DATE, F.date_format("order_date", "dd/MM/yyyy")).otherwise(written["order_date"])
    written["weight"] = F.when(left.isin(WEIGHT, TWO), F.lit("n/a")).otherwise(written["weight"])
    line = F.to_csv(F.struct(*[c.alias(n) for n, c in written.items()]))
    line = (F.when(left == SHORT, F.regexp_replace(line, ",[^,]*$", "")).when(left == LONG, F.concat(line, F.lit(",?")))
            .otherwise(line))
    path = scratch_path(spark, "csv-damaged")
    orders.select(line.alias("value")).write.text(path)
    return ingest(spark, path, "order_list", header=False)


def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines that are readable, cleaned."""
    return clean_table("order_list", _damaged_orders(spark, sf_dir).accepted)


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fault: rule, column, the text found there, and the order it belongs to."""
    return _damaged_orders(spark, sf_dir).rejects.select(
        "table_name", "rule", "column_name", "value", F.split("record", ",")[0].cast("long").alias("order_id"))


def lasting_customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer dimension after two loads: first the orders of half of the dates, then all of them.  The
    customers of the first load keep its keys, those that the second one adds come behind."""
    c, keys = clean_for(spark, sf_dir), KeyRegistry(spark, scratch_path(spark, "keys"))
    first = replace(c, order_list=c.order_list.where("day(order_date) <= 2"))
    dims.dim_customer(first, keys.number)
    return dims.dim_customer(c, keys.number)


def _two_loads(spark: SparkSession, sf_dir: str) -> Star:
    """The model after a load of the lines with an even quantity and one of all others, so that shipments
    and cells have lines of both."""
    c, model = clean_for(spark, sf_dir), LoadedModel(spark, scratch_path(spark, "loaded"))
    even = F.coalesce(F.col("unit_quantity") % 2 == 0, F.lit(False))
    for part in (even, ~even):
        model.load(replace(c, order_list=c.order_list.where(part)))
    return model.star()


def two_loads_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipments of a model after two loads, by their codes."""
    star = _two_loads(spark, sf_dir)
    ports = star.dim_port.selectExpr("port_key", "port")
    return (star.shipments.join(star.dim_plant.selectExpr("plant_key AS plant_id", "plant_code"), "plant_id")
            .join(star.dim_carrier.selectExpr("carrier_key", "carrier_id AS carrier"), F.expr("carrier_id = carrier_key"))
            .join(ports.selectExpr("port_key AS origin_port_id", "port AS origin_port"), "origin_port_id")
            .join(ports.selectExpr("port_key AS destination_port_id", "port AS destination_port"), "destination_port_id")
            .select("order_id", "plant_code", "carrier", "origin_port", "destination_port", "service_level", "unit_quantity",
                    F.col("total_weight").cast("double").alias("total_weight")))


def two_loads_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plants' order lines after two loads against their capacity, with the number of their order keys.

    Distinct keys are bits, in one bitmap for a plant and a stretch of 32,768 keys: no line is shuffled for them.
    """
    star = _two_loads(spark, sf_dir)
    found = star.fact_orders.groupBy(F.col("plant_id").alias("plant_key"), F.expr("bitmap_bucket_number(order_key) AS _stretch")).agg(
        F.count(F.lit(1)).alias("order_lines"), F.expr("bitmap_count(bitmap_construct_agg(bitmap_bit_position(order_key))) AS order_keys"))
    lines = found.groupBy("plant_key").agg(F.sum("order_lines").alias("order_lines"), F.sum("order_keys").alias("order_keys"))
    return star.dim_plant.join(lines, "plant_key").select("plant_code", "daily_capacity", "order_lines", "order_keys")
