"""Named queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the parquet inputs of ``sf_dir`` through the materialised
clean layer and star schema of that input (built once per application).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.config import CostConfig
from haulage.operators import costmodel
from haulage.operators import quality
from haulage.plans import evaluation, extensions, inefficiency, ingest, optimization
from haulage.operators.clean import clean_table
from haulage.plans.star import Star, clean_for, open_star, save_star, star_for
from haulage.session import scratch_path
from haulage.sources.csv import read_staging_csv, write_staging_csv, write_untidy_vmi

Query = Callable[[SparkSession, str], DataFrame]


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Final projection: exact decimals leave as double, everything else unchanged."""
    fields = df.schema.fields
    if not any(isinstance(f.dataType, T.DecimalType) for f in fields):
        return df
    return df.selectExpr(*[f"CAST(`{f.name}` AS DOUBLE) AS `{f.name}`"
                           if isinstance(f.dataType, T.DecimalType) else f"`{f.name}`"
                           for f in fields])


def _clean_table(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_as_double(getattr(clean_for(spark, sf_dir), name))


def _star_table(name: str, dedup: bool, spark: SparkSession, sf_dir: str) -> DataFrame:
    return decimals_as_double(getattr(star_for(spark, sf_dir, dedup), name))


def on_star(fn: Callable[[Star, CostConfig], DataFrame], cfg: CostConfig = CostConfig(),
            **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(star_for(spark, sf_dir, cfg.dedup_product), cfg, **kw)
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _shipments(star: Star, cfg: CostConfig) -> DataFrame:
    return decimals_as_double(star.shipments)


def _rated_shipments(star: Star, cfg: CostConfig) -> DataFrame:
    return decimals_as_double(costmodel.rated_shipments(star.shipments, star.fact_freight_rates))


def _order_costs(star: Star, cfg: CostConfig) -> DataFrame:
    return decimals_as_double(evaluation.historical_costs(star, cfg))


def _carrier_options(star: Star, cfg: CostConfig) -> DataFrame:
    return decimals_as_double(costmodel.carrier_options(
        star.shipments, star.fact_freight_rates, star.dim_plant, cfg))


CLEAN_TABLES = ("order_list", "freight_rates", "plant_port", "vmi_customers",
                "products_per_plant", "wh_capacities", "wh_costs")
STAR_TABLES = ("dim_plant", "dim_port", "dim_carrier", "dim_customer", "dim_product", "dim_date",
               "bridge_plant_customer", "bridge_plant_port", "bridge_plant_product",
               "fact_freight_rates", "fact_orders")


def core_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for t in CLEAN_TABLES:
        q[f"clean_{t}"] = partial(_clean_table, t)
    for t in STAR_TABLES:
        q[t] = partial(_star_table, t, False)
    q["dim_product_distinct"] = partial(_star_table, "dim_product", True)
    q["shipments"] = on_star(_shipments)
    q["rated_shipments"] = on_star(_rated_shipments)
    q["order_costs"] = on_star(_order_costs)
    q["carrier_options"] = on_star(_carrier_options)
    q["total_historical_cost"] = on_star(evaluation.priced_historical_cost)
    q["avg_cost_per_order_unit"] = on_star(evaluation.avg_cost_per_order_unit)
    q["cost_by_plant_route"] = on_star(evaluation.cost_by_plant_route)
    q["capacity_fit"] = on_star(evaluation.capacity_fit)
    q["highest_cost_routes"] = on_star(inefficiency.highest_cost_routes)
    q["carrier_cost_by_route"] = on_star(inefficiency.carrier_cost_by_route)
    q["capacity_utilization"] = on_star(inefficiency.capacity_utilization)
    q["lower_cost_routes"] = on_star(inefficiency.lower_cost_routes)
    q["optimal_assignment"] = on_star(optimization.optimal_assignment)
    q["cost_reduction"] = on_star(optimization.cost_reduction)
    q["route_rebalance"] = on_star(optimization.route_rebalance)

    ship = CostConfig(grain="shipment")
    q["total_historical_cost_by_shipment"] = on_star(evaluation.total_historical_cost, ship)
    q["avg_cost_per_order_unit_by_shipment"] = on_star(evaluation.avg_cost_per_order_unit, ship)
    q["cost_by_plant_route_by_shipment"] = on_star(evaluation.cost_by_plant_route, ship)
    q["lower_cost_routes_by_shipment"] = on_star(inefficiency.lower_cost_routes, ship)
    q["optimal_assignment_by_shipment"] = on_star(optimization.optimal_assignment, ship)
    q["cost_reduction_by_shipment"] = on_star(optimization.cost_reduction, ship)
    q["route_rebalance_by_shipment"] = on_star(optimization.route_rebalance, ship)
    q["highest_cost_routes_by_shipment"] = on_star(inefficiency.highest_cost_routes, ship)
    q["carrier_cost_by_route_by_shipment"] = on_star(inefficiency.carrier_cost_by_route, ship)
    q["cost_reduction_comparable"] = on_star(optimization.cost_reduction, comparable=True)
    q["cost_reduction_comparable_by_shipment"] = on_star(optimization.cost_reduction, ship,
                                                         comparable=True)
    dedup = CostConfig(dedup_product=True)
    q["total_historical_cost_dedup"] = on_star(evaluation.total_historical_cost, dedup)
    q["cost_reduction_dedup"] = on_star(optimization.cost_reduction, dedup)
    q["capacity_utilization_dedup"] = on_star(inefficiency.capacity_utilization, dedup)
    q["capacity_fit_dedup"] = on_star(evaluation.capacity_fit, dedup)
    q["cost_by_carrier"] = on_star(evaluation.cost_by_carrier)
    # the business reading: every shipment, and one key per product
    both = CostConfig(grain="shipment", dedup_product=True)
    for fn in (evaluation.avg_cost_per_order_unit, evaluation.cost_by_plant_route, inefficiency.highest_cost_routes,
               inefficiency.carrier_cost_by_route, inefficiency.lower_cost_routes, optimization.optimal_assignment,
               optimization.route_rebalance):
        q[f"{fn.__name__}_dedup"] = on_star(fn, dedup)
        q[f"{fn.__name__}_by_shipment_dedup"] = on_star(fn, both)
    q["total_historical_cost_by_shipment_dedup"] = on_star(evaluation.total_historical_cost, both)
    q["cost_reduction_by_shipment_dedup"] = on_star(optimization.cost_reduction, both)
    return q


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order list exported as source-style CSV, then ingested by position and cleaned."""
    path = scratch_path(spark, "csv-order_list")
    write_staging_csv(clean_for(spark, sf_dir).order_list, path, "order_list")
    return decimals_as_double(clean_table("order_list", read_staging_csv(spark, path, "order_list")))


def _untidy_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The VMI list written as untidy CSV files (see ``write_untidy_vmi``), ingested and cleaned."""
    path = scratch_path(spark, "csv-untidy")
    write_untidy_vmi(clean_for(spark, sf_dir).vmi_customers, path)
    return clean_table("vmi_customers", read_staging_csv(spark, path, "vmi_customers"))


def _model_tables(star: Star, cfg: CostConfig) -> DataFrame:
    """Name and row count of every table of the model."""
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
              for name, df in star.tables().items()]
    return reduce(DataFrame.unionAll, counts)


def _saved_model_tables(star: Star, cfg: CostConfig) -> DataFrame:
    """Name and row count of every table of the model, saved in a database and opened by its name."""
    spark = star.fact_orders.sparkSession
    folder = scratch_path(spark, "saved")
    database = folder.rsplit("/", 1)[-1].replace("-", "_")
    save_star(star, database, folder)
    return _model_tables(star_for(spark, open_star(spark, database)), cfg)


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile_tables(clean_for(spark, sf_dir))


def _dq(which: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clean_for(spark, sf_dir)
    if which == "orphans":
        return quality.dq_orphans(c, star_for(spark, sf_dir).dim_plant)
    return quality.dq_duplicates(c) if which == "duplicates" else quality.dq_bounds(c)


def extension_queries() -> dict[str, Query]:
    dedup = CostConfig(dedup_product=True)
    q: dict[str, Query] = {
        "stg_csv": _csv_round_trip,
        "clean_untidy_csv": _untidy_csv,
        "ingest_accepted": lambda spark, sf_dir: decimals_as_double(ingest.ingest_accepted(spark, sf_dir)),
        "ingest_rejects": ingest.ingest_rejects,
        "lasting_customer_keys": ingest.lasting_customer_keys,
        "two_loads_shipments": ingest.two_loads_shipments,
        "two_loads_capacity": ingest.two_loads_capacity,
        "saved_model_tables": on_star(_saved_model_tables),
        "model_tables": on_star(_model_tables),
        "profile_tables": _profile,
        "dq_orphans": partial(_dq, "orphans"),
        "dq_duplicates": partial(_dq, "duplicates"),
        "dq_bounds": partial(_dq, "bounds"),
        "usage_frequency": on_star(extensions.usage_frequency),
        "avg_transport_days": on_star(extensions.avg_transport_days),
        "capacity_by_day": on_star(extensions.capacity_by_day),
        "delivery_performance": on_star(extensions.delivery_performance),
        "feasible_options": on_star(lambda s, c: decimals_as_double(
            extensions.feasible_options(s, c)), dedup),
        "feasible_assignment": on_star(lambda s, c: decimals_as_double(
            extensions.feasible_assignment(s, c)), dedup),
        "utilization_shift": on_star(extensions.utilization_shift, dedup),
        "capacity_assignment": on_star(extensions.capacity_assignment, dedup),
        "capacity_assignment_by_day": on_star(extensions.capacity_assignment, dedup,
                                              per_day=True),
    }
    return q


def all_queries() -> dict[str, Query]:
    return {**core_queries(), **extension_queries()}
