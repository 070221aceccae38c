"""Network optimisation: cheapest carrier per order, the saving, the shift in route use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.config import CostConfig
from haulage.operators.costmodel import carrier_options, cheapest_option, cheapest_options
from haulage.plans.evaluation import historical_costs
from haulage.plans.star import Star


def optimal_choices(star: Star, cfg: CostConfig, guarded: bool | None = None) -> DataFrame:
    """The cheapest option per order (or shipment)."""
    if not star.plants_priced():
        options = carrier_options(star.shipments, star.fact_freight_rates, star.dim_plant, cfg, guarded=guarded)
        return cheapest_option(options, cfg)
    envelopes, levels = star.envelopes(cfg, cfg.guarded if guarded is None else guarded)
    options = cheapest_options(star.shipments, envelopes, levels, star.dim_plant, cfg, guarded=guarded)
    # an envelope has one piece at a weight: one option per shipment already
    return options if cfg.grain == "shipment" else cheapest_option(options, cfg)


def optimal_assignment(star: Star, cfg: CostConfig) -> DataFrame:
    """Cheapest carrier per order.  As written this prices options without the
    zero-freight / missing-rate guard (a NULL rate falls back to the minimum cost)."""
    best = optimal_choices(star, cfg, guarded=False)
    extra = [] if cfg.grain == "order" else ["plant_id", "origin_port_id", "destination_port_id",
                                             "service_level"]
    return best.selectExpr("order_id", *extra, "historical_carrier",
                           "carrier_id AS optimal_carrier",
                           "CAST(transport_cost AS DOUBLE) AS transport_cost",
                           "CAST(warehouse_cost AS DOUBLE) AS warehouse_cost",
                           "CAST(total_order_cost AS DOUBLE) AS total_order_cost")


def _two_totals(hist: DataFrame, opt: DataFrame) -> DataFrame:
    """Both scalar totals from one aggregation over a tagged union (no cross join)."""
    h = hist.selectExpr("total_order_cost AS _h", "CAST(NULL AS DECIMAL(38,8)) AS _o")
    o = opt.selectExpr("CAST(NULL AS DECIMAL(38,8)) AS _h", "total_order_cost AS _o")
    return h.unionByName(o).selectExpr("sum(_h) AS h", "sum(_o) AS o")


def cost_reduction(star: Star, cfg: CostConfig, comparable: bool = False) -> DataFrame:
    """Historical vs optimised total.  As written the historical side also counts
    orders that have no tariff at all; ``comparable=True`` restricts it to the
    orders (or shipments) that received an optimised carrier."""
    hist = historical_costs(star, cfg)
    opt = optimal_choices(star, cfg, guarded=True)
    if comparable:
        keys = ["order_id"] if cfg.grain == "order" else [
            "order_id", "plant_id", "carrier_id", "origin_port_id", "destination_port_id",
            "service_level"]
        opt_keys = opt.selectExpr(*["historical_carrier AS carrier_id" if k == "carrier_id"
                                    else k for k in keys])
        hist = hist.join(opt_keys, keys, "left_semi")
    return _two_totals(hist, opt).selectExpr(
        "CAST(h AS DOUBLE) AS historical_total_cost",
        "CAST(o AS DOUBLE) AS optimal_total_cost",
        "CAST(h - o AS DOUBLE) AS potential_savings",
        "round(CAST(h - o AS DOUBLE) / nullif(CAST(h AS DOUBLE), 0.0) * 100, 2)"
        " AS savings_percentage")


def route_rebalance(star: Star, cfg: CostConfig) -> DataFrame:
    """Shipments per (plant, origin, destination) historically vs optimised rows."""
    route = ["plant_id", "origin_port_id", "destination_port_id"]
    historical = star.shipments.groupBy(*route).agg(F.expr("count(1) AS historical_orders"))
    optimal = (optimal_choices(star, cfg, guarded=True)
               .groupBy(*route).agg(F.expr("count(1) AS optimal_orders")))
    j = historical.join(optimal, route, "full")
    h, o = "coalesce(historical_orders, 0)", "coalesce(optimal_orders, 0)"
    return (j.selectExpr(*route, f"{h} AS historical_orders", f"{o} AS optimal_orders",
                         f"{o} - {h} AS change_in_orders")
            .orderBy(F.expr("change_in_orders").desc_nulls_first()))
