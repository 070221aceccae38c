"""The two fact tables.

``fact_freight_rates``: one row per tariff (carrier, lane, service, weight band).
``fact_orders``: one row per order line and product key (inner joins to every
dimension, so lines with an unknown code drop out; see ``quality.dq_orphans``).
Both get dense ids over a total natural order, so ids are reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.functions.keys import nulls_last, scalable_key
from haulage.sources.staging import Staging

FREIGHT_ORDER = ["carrier_key", "origin_port_key", "destination_port_key", "service_level",
                 "min_weight", "max_weight", "rate", "minimum_cost", "transport_mode",
                 "transport_days", "carrier_type"]

ORDER_COLUMNS = ["order_id", "date_id", "plant_id", "product_id", "customer_id", "carrier_id",
                 "origin_port_id", "destination_port_id", "transport_mode", "service_level",
                 "unit_quantity", "weight", "ship_ahead_days", "ship_late_days"]


def freight_rates_keyed(c: Staging, dim_carrier: DataFrame, dim_port: DataFrame) -> DataFrame:
    """Tariffs on surrogate keys, without the id (cheap, lazy)."""
    f = c.freight_rates
    op = dim_port.select(F.col("port").alias("_op"), F.col("port_key").alias("origin_port_key"))
    dp = dim_port.select(F.col("port").alias("_dp"),
                         F.col("port_key").alias("destination_port_key"))
    cr = dim_carrier.select(F.col("carrier_id").alias("_cr"), "carrier_key")
    j = (f.join(cr, f.carrier_id == cr._cr)
          .join(op, f.origin_port_code == op._op)
          .join(dp, f.destination_port_code == dp._dp))
    return j.select(
        "carrier_key", "origin_port_key", "destination_port_key",
        F.col("service_code").alias("service_level"),
        F.col("mode_description").alias("transport_mode"),
        F.col("min_weight_quantity").alias("min_weight"),
        F.col("max_weight_quantity").alias("max_weight"),
        "rate", "minimum_cost",
        F.col("transportation_day_count").alias("transport_days"),
        "carrier_type")


def fact_freight_rates(c: Staging, dim_carrier: DataFrame, dim_port: DataFrame) -> DataFrame:
    keyed = freight_rates_keyed(c, dim_carrier, dim_port)
    return scalable_key(keyed, "freight_rate_id", nulls_last(*FREIGHT_ORDER))


def order_lines_keyed(o: DataFrame, dim_date: DataFrame, dim_plant: DataFrame,
                      dim_product: DataFrame, dim_customer: DataFrame, dim_carrier: DataFrame,
                      dim_port: DataFrame) -> DataFrame:
    """Order lines ``o`` (clean order list rows) on surrogate keys, without ``order_key``."""
    d = dim_date.select(F.col("full_date").alias("_d"), F.col("date_key").alias("date_id"))
    pl = dim_plant.select(F.col("plant_code").alias("_pl"), F.col("plant_key").alias("plant_id"))
    pr = dim_product.select(F.col("product_id").alias("_pr"),
                            F.col("product_key").alias("product_key_"))
    cu = dim_customer.select(F.col("customer_id").alias("_cu"),
                             F.col("customer_key").alias("customer_id_"))
    cr = dim_carrier.select(F.col("carrier_id").alias("_cr"), F.col("carrier_key").alias("carrier_id_"))
    po = dim_port.select(F.col("port").alias("_po"), F.col("port_key").alias("origin_port_id"))
    pd_ = dim_port.select(F.col("port").alias("_pd"), F.col("port_key").alias("destination_port_id"))
    # customers and products last: where they are too many for a broadcast, the lines are shuffled with keys
    # instead of codes, and not yet once per product key
    j = (o.join(d, o.order_date == d._d)
          .join(pl, o.plant_code == pl._pl)
          .join(cr, o.carrier == cr._cr)
          .join(po, o.origin_port == po._po)
          .join(pd_, o.destination_port == pd_._pd)
          .join(cu, o.customer == cu._cu)
          .join(pr, o.product_id == pr._pr))
    return j.select(
        "order_id", "date_id", "plant_id",
        F.col("product_key_").alias("product_id"),
        F.col("customer_id_").alias("customer_id"),
        F.col("carrier_id_").alias("carrier_id"),
        "origin_port_id", "destination_port_id",
        F.col("transportation_day_count").alias("transport_mode"),
        "service_level", "unit_quantity", "weight",
        F.col("ship_ahead_day_count").alias("ship_ahead_days"),
        F.col("ship_late_day_count").alias("ship_late_days"))


def product_keys(dim_product: DataFrame) -> DataFrame:
    """The number of keys of every product."""
    return dim_product.groupBy("product_id").agg(F.count(F.lit(1)).cast("int").alias("product_keys"))


def shipment_lines(o: DataFrame, dim_plant: DataFrame, products: DataFrame, dim_carrier: DataFrame,
                   dim_port: DataFrame) -> DataFrame:
    """Order lines ``o`` with the columns of the shipment rollup, their day and customer as they stand there,
    and the columns of ``products`` (:func:`product_keys`, and more) in place of a row for each product key.

    For dimensions made of ``o`` itself: every date and customer but NULL has exactly one key there, so that
    the lines need not be joined (and, with many customers, shuffled) to find it.
    """
    pl = dim_plant.select(F.col("plant_code").alias("_pl"), F.col("plant_key").alias("plant_id"))
    pr = products.withColumnRenamed("product_id", "_pr")
    cr = dim_carrier.select(F.col("carrier_id").alias("_cr"), F.col("carrier_key").alias("carrier_id_"))
    po = dim_port.select(F.col("port").alias("_po"), F.col("port_key").alias("origin_port_id"))
    pd_ = dim_port.select(F.col("port").alias("_pd"), F.col("port_key").alias("destination_port_id"))
    known = o.where("order_date IS NOT NULL AND customer IS NOT NULL")
    j = (known.join(pl, known.plant_code == pl._pl)
              .join(cr, known.carrier == cr._cr)
              .join(po, known.origin_port == po._po)
              .join(pd_, known.destination_port == pd_._pd)
              .join(pr, known.product_id == pr._pr))
    return j.select("order_id", "plant_id", F.col("carrier_id_").alias("carrier_id"), "origin_port_id",
                    "destination_port_id", "service_level", "unit_quantity", "weight", "order_date", "customer",
                    *[c for c in products.columns if c != "product_id"])


def lines_per_day(o: DataFrame, dim_plant: DataFrame, dim_product: DataFrame) -> DataFrame:
    """(plant_id, full_date, lines) of the order lines ``o``, a line counted once per product key.

    As in :func:`shipment_lines`, dates, customers, carriers and ports need no join: they have one key.
    """
    known = o.where(" AND ".join(f"{c} IS NOT NULL" for c in ("order_date", "customer", "carrier", "origin_port", "destination_port")))
    plants = dim_plant.select(F.col("plant_code").alias("_pl"), F.col("plant_key").alias("plant_id"))
    return (known.join(plants, F.col("plant_code") == F.col("_pl")).join(product_keys(dim_product), "product_id")
            .groupBy("plant_id", F.col("order_date").alias("full_date")).agg(F.sum("product_keys").alias("lines")))


def fact_orders(c: Staging, dim_date, dim_plant, dim_product, dim_customer, dim_carrier,
                dim_port) -> DataFrame:
    lines = order_lines_keyed(c.order_list, dim_date, dim_plant, dim_product, dim_customer,
                              dim_carrier, dim_port)
    return scalable_key(lines, "order_key", nulls_last(*ORDER_COLUMNS))
