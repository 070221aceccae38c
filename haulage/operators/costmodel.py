"""Cost model: shipment rollup, tariff lookup, pricing, cheapest option.

Shuffle plan (tariffs and plants are joined by broadcast when Spark's size
check allows, otherwise by a shuffle join on the lane keys):

1. ``shipments``    - aggregate order lines on the 6 shipment keys (partial
                      aggregation map-side).  The star makes the result of the clean
                      order list, without the numbered fact table, writes it once and
                      every question starts there.
2. tariff lookup    - equi keys on the lane and on the cell of the weight (bands are listed
                      under the dyadic cells they meet), exact band as a residual.  Where only
                      the cheapest tariff is wanted, the lane's lower envelope is looked up
                      instead: one row per shipment, no fan-out over carriers.
3. ``first_by``     - one surviving row per order (or per shipment) through a
                      group limit, whose map-side part reduces a hot order before
                      it is shuffled.
4. ``cost_cube``    - shuffles the rollup once by order; tariff, top-1, charge and the
                      count of orders follow inside the partitions.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.config import CostConfig
from haulage.functions.intervals import levels_for, lookup
from haulage.functions.ordering import asc, desc, first_by
from haulage.functions.pricing import WEIGHT_TYPE, freight_charge_sql

SHIPMENT_KEYS = ["order_id", "plant_id", "carrier_id", "origin_port_id", "destination_port_id",
                 "service_level"]
ROUTE_KEYS = ["plant_id", "origin_port_id", "destination_port_id"]


def shipments(fact_orders: DataFrame) -> DataFrame:
    return fact_orders.groupBy(*SHIPMENT_KEYS).agg(
        F.sum("unit_quantity").alias("unit_quantity"),
        F.sum(F.col("unit_quantity") * F.col("weight")).cast(WEIGHT_TYPE).alias("total_weight"))


def shipments_of_lines(lines: DataFrame) -> DataFrame:
    """The same rollup from ``facts.shipment_lines``: a line counts once per product key."""
    return lines.groupBy(*SHIPMENT_KEYS).agg(
        F.sum(F.col("unit_quantity").cast("long") * F.col("product_keys")).alias("unit_quantity"),
        F.sum(F.col("unit_quantity") * F.col("weight") * F.col("product_keys")).cast(WEIGHT_TYPE).alias("total_weight"))


def _tariffs(fact_freight_rates: DataFrame) -> DataFrame:
    return fact_freight_rates.selectExpr(
        "freight_rate_id", "carrier_key", "origin_port_key", "destination_port_key",
        "service_level AS _service", "min_weight", "max_weight", "rate", "minimum_cost")


LANE = [("origin_port_id", "origin_port_key"), ("destination_port_id", "destination_port_key"),
        ("service_level", "_service")]
BAND = ("min_weight", "max_weight")
# the levels of a tariff table's bands, found once per table
_LEVELS: WeakKeyDictionary = WeakKeyDictionary()


def tariff_levels(rates: DataFrame) -> list[tuple[int, int]]:
    if rates not in _LEVELS:
        _LEVELS[rates] = levels_for(rates, ["origin_port_key", "destination_port_key", "service_level"], *BAND)
    return _LEVELS[rates]


def rated_shipments(ships: DataFrame, fact_freight_rates: DataFrame) -> DataFrame:
    """Every shipment with every tariff band of its own carrier (LEFT: unmatched kept)."""
    j = lookup(ships, _tariffs(fact_freight_rates), tariff_levels(fact_freight_rates),
               [*LANE, ("carrier_id", "carrier_key")], "total_weight", *BAND, row_keys=SHIPMENT_KEYS)
    return j.selectExpr(*SHIPMENT_KEYS, "unit_quantity", "total_weight", "freight_rate_id",
                        "min_weight", "rate", "minimum_cost")


def grain_keys(cfg: CostConfig) -> list[str]:
    return ["order_id"] if cfg.grain == "order" else list(SHIPMENT_KEYS)


# highest matching band first; an unmatched shipment (NULL band) sorts before any
# match, as a descending sort does in the original database (NULLS FIRST)
HISTORICAL_ORDER = [desc("min_weight", "first"), asc("freight_rate_id")] + [
    asc(k) for k in SHIPMENT_KEYS[1:]]


def historical_tariff(rated: DataFrame, cfg: CostConfig) -> DataFrame:
    return first_by(rated, grain_keys(cfg), HISTORICAL_ORDER)


def _plant_costs(dim_plant: DataFrame) -> DataFrame:
    return dim_plant.selectExpr("plant_key AS _plant", "cost_per_unit")


def order_costs(ships: DataFrame, fact_freight_rates: DataFrame, dim_plant: DataFrame,
                cfg: CostConfig) -> DataFrame:
    """Historical cost per order (or shipment) from the shipment rollup ``ships``."""
    picked = historical_tariff(rated_shipments(ships, fact_freight_rates), cfg)
    return _history_priced(picked, _plant_costs(dim_plant), cfg)


def _history_priced(picked: DataFrame, plant_costs: DataFrame, cfg: CostConfig, *more: str) -> DataFrame:
    transport = freight_charge_sql("total_weight", "rate", "minimum_cost", "carrier_id",
                                   cfg.zero_freight_carrier_key, guarded=True)
    return (picked.join(plant_costs, F.expr("plant_id = _plant"))
            .selectExpr(*SHIPMENT_KEYS, "unit_quantity", "total_weight", "freight_rate_id", "rate",
                        "minimum_cost", f"{transport} AS transport_cost",
                        "unit_quantity * cost_per_unit AS warehouse_cost", *more)
            .selectExpr("*", "coalesce(transport_cost, 0) + warehouse_cost AS total_order_cost"))


def orders_together(ships: DataFrame) -> DataFrame:
    """The rollup with an order's shipments in one partition, for steps by order and by shipment alike:
    they share this one shuffle.  A hot order is not one task's rows, for the rollup has a row per plant,
    carrier, route and service of an order, however many lines it has."""
    return ships.repartition("order_id")


CUBE_KEYS = ["plant_id", "carrier_id", "origin_port_id", "destination_port_id"]


def cost_cube(ships: DataFrame, fact_freight_rates: DataFrame, dim_plant: DataFrame, cfg: CostConfig) -> DataFrame:
    """Exact historical costs, units and orders per plant, carrier and route.  An order has one row of
    ``order_costs`` in the order grain, so there its orders add up over the cells.

    The distinct orders of a cell are counted without a shuffle of their own: an order counts at its first
    service there (the order grain has one), and at the first of the rows that a plant key may have.
    """
    picked = historical_tariff(rated_shipments(orders_together(ships), fact_freight_rates), cfg)
    # the ranking is in the order that the rows have from the top-1 by shipment: no further sort
    first = ("true" if cfg.grain == "order" else
             f"row_number() OVER (PARTITION BY order_id, {', '.join(CUBE_KEYS)} ORDER BY service_level NULLS FIRST) = 1")
    plants = _plant_costs(dim_plant).selectExpr(
        "*", "row_number() OVER (PARTITION BY _plant ORDER BY cost_per_unit) = 1 AS _once")
    priced = _history_priced(picked.selectExpr("*", f"{first} AS _first"), plants, cfg, "_first AND _once AS _counts")
    return priced.groupBy(*CUBE_KEYS).agg(
        F.sum("transport_cost").alias("transport_cost"), F.sum("warehouse_cost").alias("warehouse_cost"),
        F.sum("total_order_cost").alias("total_order_cost"), F.sum("unit_quantity").alias("unit_quantity"),
        F.expr("count(order_id) FILTER (WHERE _counts) AS orders"))


def carrier_options(ships: DataFrame, fact_freight_rates: DataFrame, dim_plant: DataFrame,
                    cfg: CostConfig, guarded: bool | None = None) -> DataFrame:
    """Every shipment priced with every carrier that has a tariff on its lane and band.

    The warehouse charge depends on the shipment only, so it is computed once per
    shipment before the tariff join multiplies the rows.
    """
    return _priced(ships, _tariffs(fact_freight_rates), tariff_levels(fact_freight_rates), BAND, dim_plant, cfg, guarded)


def cheapest_options(ships: DataFrame, envelopes: DataFrame, levels: list[tuple[int, int]],
                     dim_plant: DataFrame, cfg: CostConfig, guarded: bool | None = None) -> DataFrame:
    """Every shipment with the cheapest of its options alone, read off the lanes' lower envelopes
    (see :mod:`haulage.operators.envelope`; ``levels`` are those of their pieces).  Plants must
    have a cost per unit: where the total is NULL, options rank by carrier and not by charge."""
    pieces = envelopes.withColumnRenamed("service_level", "_service")
    return _priced(ships, pieces, levels, ("from_weight", "to_weight"), dim_plant, cfg, guarded)


def _priced(ships: DataFrame, tariffs: DataFrame, levels: list[tuple[int, int]], band: tuple[str, str],
            dim_plant: DataFrame, cfg: CostConfig, guarded: bool | None) -> DataFrame:
    guarded = cfg.guarded if guarded is None else guarded
    s = (ships.join(_plant_costs(dim_plant), F.expr("plant_id = _plant"))
         .selectExpr(*SHIPMENT_KEYS, "unit_quantity", "total_weight",
                     "unit_quantity * cost_per_unit AS warehouse_cost"))
    j = lookup(s, tariffs, levels, LANE, "total_weight", *band)
    transport = freight_charge_sql("total_weight", "rate", "minimum_cost", "carrier_key",
                                   cfg.zero_freight_carrier_key, guarded=guarded)
    return (j.selectExpr("order_id", "plant_id", "origin_port_id", "destination_port_id",
                         "service_level", "carrier_id AS historical_carrier",
                         "carrier_key AS carrier_id", "freight_rate_id", "unit_quantity",
                         "total_weight", "rate", "minimum_cost", f"{transport} AS transport_cost",
                         "warehouse_cost")
            .selectExpr("*", "transport_cost + warehouse_cost AS total_order_cost"))


def historical_options(ships: DataFrame, fact_freight_rates: DataFrame, dim_plant: DataFrame,
                       cfg: CostConfig) -> DataFrame:
    """The options of each shipment's own carrier, priced (guarded): the carrier is part of the
    lookup, so that no other carrier's options are made first."""
    transport = freight_charge_sql("total_weight", "rate", "minimum_cost", "carrier_id",
                                   cfg.zero_freight_carrier_key, guarded=True)
    return (rated_shipments(ships, fact_freight_rates).where("freight_rate_id IS NOT NULL")
            .join(_plant_costs(dim_plant), F.expr("plant_id = _plant"))
            .selectExpr("order_id", "plant_id", "carrier_id AS historical_carrier", "origin_port_id",
                        "destination_port_id", "service_level",
                        f"{transport} + unit_quantity * cost_per_unit AS historical_total_cost"))


OPTION_SHIPMENT_KEYS = ["order_id", "plant_id", "historical_carrier", "origin_port_id",
                        "destination_port_id", "service_level"]

CHEAPEST_ORDER = [asc("total_order_cost"), asc("carrier_id"), asc("freight_rate_id")] + [
    asc(k) for k in OPTION_SHIPMENT_KEYS[1:]]


def cheapest_option(options: DataFrame, cfg: CostConfig) -> DataFrame:
    keys = ["order_id"] if cfg.grain == "order" else list(OPTION_SHIPMENT_KEYS)
    return first_by(options, keys, CHEAPEST_ORDER)
