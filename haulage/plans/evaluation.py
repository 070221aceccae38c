"""Network evaluation: what the historical network cost and how plants were loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.config import CostConfig
from haulage.operators.costmodel import order_costs, orders_together
from haulage.plans.labels import CAPACITY_DOES_NOT_FIT, CAPACITY_FITS
from haulage.plans.star import Star


# the three totals of every cost question, summed exactly and returned as double
COST_SUMS = ["CAST(sum(transport_cost) AS DOUBLE) AS total_transport_cost",
             "CAST(sum(warehouse_cost) AS DOUBLE) AS total_warehouse_cost",
             "CAST(sum(total_order_cost) AS DOUBLE) AS total_logistics_cost"]


def historical_costs(star: Star, cfg: CostConfig) -> DataFrame:
    return order_costs(star.shipments, star.fact_freight_rates, star.dim_plant, cfg)


def total_historical_cost(star: Star, cfg: CostConfig) -> DataFrame:
    """Total transport, warehouse and logistics cost (one row)."""
    return star.cost_cube(cfg).selectExpr(*COST_SUMS)


def priced_historical_cost(star: Star, cfg: CostConfig) -> DataFrame:
    """The same row priced in one pass, for the question asked alone: no cube is written for it."""
    return historical_costs(star, cfg).selectExpr(*COST_SUMS)


def avg_cost_per_order_unit(star: Star, cfg: CostConfig) -> DataFrame:
    """Average logistics cost per order and per unit, rounded to cents.  Orders of several shipments
    would count once per cell of the cube, so the shipment grain counts them from the orders' rows."""
    total = "CAST(sum(total_order_cost) AS DOUBLE)"
    source, orders = ((star.cost_cube(cfg), "sum(orders)") if cfg.grain == "order"
                      else (order_costs(orders_together(star.shipments), star.fact_freight_rates, star.dim_plant, cfg),
                            "count(DISTINCT order_id)"))
    return source.selectExpr(
        f"round({total} / CAST(nullif({orders}, 0) AS DOUBLE), 2)"
        " AS avg_cost_per_order",
        f"round({total} / CAST(nullif(sum(unit_quantity), 0) AS DOUBLE), 2) AS avg_cost_per_unit")


def _route_costs(star: Star, cfg: CostConfig) -> DataFrame:
    return star.cost_cube(cfg).groupBy("plant_id", "origin_port_id", "destination_port_id").agg(
        *[F.expr(e) for e in COST_SUMS])


def cost_by_plant_route(star: Star, cfg: CostConfig) -> DataFrame:
    """Cost per (plant, origin, destination), costliest first."""
    return _route_costs(star, cfg).orderBy(F.col("total_logistics_cost").desc_nulls_first())


def cost_by_carrier(star: Star, cfg: CostConfig) -> DataFrame:
    """Cost per carrier, costliest first."""
    return (star.cost_cube(cfg).groupBy("carrier_id").agg(*[F.expr(e) for e in COST_SUMS])
            .orderBy(F.col("total_logistics_cost").desc_nulls_first()))


def plant_line_counts(star: Star) -> DataFrame:
    """Order lines per plant joined to its capacity (all dates together, as written)."""
    counts = star.fact_orders.groupBy("plant_id").agg(F.count(F.lit(1)).alias("daily_orders"))
    plants = star.dim_plant.select("plant_key", "plant_code", "daily_capacity")
    return plants.join(counts, plants.plant_key == counts.plant_id).select(
        "plant_code", "daily_capacity", "daily_orders")


def capacity_fit(star: Star, cfg: CostConfig) -> DataFrame:
    """Whether each plant's capacity exceeds its order lines (equality does not fit)."""
    pc = plant_line_counts(star)
    return pc.select("plant_code", "daily_capacity", "daily_orders",
                     F.when(F.col("daily_capacity") > F.col("daily_orders"), F.lit(CAPACITY_FITS))
                     .otherwise(F.lit(CAPACITY_DOES_NOT_FIT))
                     .alias("efficiently"))
