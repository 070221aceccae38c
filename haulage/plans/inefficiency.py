"""Inefficiency detection: costly routes and carriers, loaded plants, unused cheaper carriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulage.config import CostConfig
from haulage.operators.costmodel import OPTION_SHIPMENT_KEYS, historical_options
from haulage.plans.evaluation import _route_costs, plant_line_counts
from haulage.plans.optimization import optimal_choices
from haulage.plans.star import Star

from haulage.plans.labels import NEAR_CAPACITY, NEAR_CAPACITY_SHARE, OVER_CAPACITY, UNDER_CAPACITY


def highest_cost_routes(star: Star, cfg: CostConfig) -> DataFrame:
    """Route costs grouped per plant too, but the plant is not shown (as written)."""
    return (_route_costs(star, cfg)
            .select("origin_port_id", "destination_port_id", "total_transport_cost",
                    "total_warehouse_cost", "total_logistics_cost")
            .orderBy(F.col("total_logistics_cost").desc_nulls_first()))


def carrier_cost_by_route(star: Star, cfg: CostConfig) -> DataFrame:
    return (star.cost_cube(cfg).groupBy("carrier_id", "origin_port_id", "destination_port_id")
            .agg(F.expr("CAST(sum(total_order_cost) AS DOUBLE) AS total_logistics_cost"))
            .orderBy(F.col("origin_port_id").asc_nulls_last(),
                     F.col("destination_port_id").asc_nulls_last(),
                     F.col("total_logistics_cost").desc_nulls_first()))


def utilization_label(lines: Column, capacity: Column) -> Column:
    """lines / capacity > 1 over, >= 0.9 near, else under; compared exactly in integers."""
    num, den = NEAR_CAPACITY_SHARE
    return (F.when(lines > capacity, F.lit(OVER_CAPACITY))
            .when(lines * den >= capacity * num, F.lit(NEAR_CAPACITY))
            .otherwise(F.lit(UNDER_CAPACITY)))


def capacity_utilization(star: Star, cfg: CostConfig) -> DataFrame:
    pc = plant_line_counts(star)
    return pc.select("plant_code", "daily_capacity", "daily_orders",
                     utilization_label(F.col("daily_orders"), F.col("daily_capacity"))
                     .alias("Interpretation"))


def lower_cost_routes(star: Star, cfg: CostConfig) -> DataFrame:
    """Orders whose historical carrier cost more than the cheapest carrier on the lane.

    Order grain (as written): each historical option row of the order is compared
    with the order's single cheapest option.  Shipment grain: per shipment.
    """
    keys = ["order_id"] if cfg.grain == "order" else OPTION_SHIPMENT_KEYS
    hist = historical_options(star.shipments, star.fact_freight_rates, star.dim_plant, cfg)
    best = optimal_choices(star, cfg, guarded=True).selectExpr(
        *keys, "carrier_id AS cheaper_carrier", "total_order_cost AS cheapest_possible_cost")
    j = hist.join(best, keys).where("historical_total_cost > cheapest_possible_cost")
    return (j.selectExpr("order_id", "origin_port_id", "destination_port_id", "service_level",
                         "historical_carrier", "cheaper_carrier",
                         "CAST(historical_total_cost AS DOUBLE) AS historical_total_cost",
                         "CAST(cheapest_possible_cost AS DOUBLE) AS cheapest_possible_cost",
                         "CAST(historical_total_cost - cheapest_possible_cost AS DOUBLE)"
                         " AS potential_savings")
            .orderBy(F.expr("potential_savings").desc_nulls_first()))
