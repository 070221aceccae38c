"""Data profiling and data-quality rules over the clean layer.

The source declares no keys or constraints, so uniqueness and referential
integrity are checked here instead of assumed.  Every check is one aggregate
pass or one anti-join; results are small ``(rule, n_bad)`` tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.sources.staging import Staging


def profile_table(name: str, df: DataFrame) -> DataFrame:
    """One row per column: rows, non-null values, distinct values, min, max (as text).

    Each column is read alone and counted by value, so that map-side partials shrink it to
    its distinct values before it is shuffled; only a near-unique column is shuffled in full.
    """
    def column(c: str) -> DataFrame:
        by_value = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        present = F.when(F.col("value").isNotNull(), F.col("n"))
        return by_value.agg(
            F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(present), F.lit(0)).alias("non_null"),
            F.count("value").alias("distinct_values"), F.min("value").cast("string").alias("min_value"),
            F.max("value").cast("string").alias("max_value"))

    return reduce(DataFrame.unionByName, [column(c) for c in df.columns])


def profile_tables(c: Staging) -> DataFrame:
    return reduce(DataFrame.unionByName,
                  [profile_table(n, df) for n, df in c.tables().items()])


def _rule_counts(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Count rows matching each predicate in a single pass; one output row per rule."""
    one = df.agg(*[F.count(F.when(pred, F.lit(1))).alias(f"_r{i}")
                   for i, pred in enumerate(rules.values())])
    return one.select(F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"_r{i}").alias("n_bad"))
        for i, r in enumerate(rules)])).alias("x")).select("x.rule", "x.n_bad")


def _orphans(rule: str, rows: DataFrame, col: str, ref: DataFrame, ref_col: str) -> DataFrame:
    keys = ref.select(F.col(ref_col).alias("_k")).distinct()
    missing = rows.join(keys, rows[col] == keys["_k"], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")


def dq_orphans(c: Staging, dim_plant: DataFrame) -> DataFrame:
    """Rows whose code has no match where an inner join will look for it (and drop them)."""
    ol = c.order_list
    checks = [
        _orphans("order_plant_without_capacity_or_cost", ol, "plant_code", dim_plant, "plant_code"),
        _orphans("order_product_without_plant", ol, "product_id", c.products_per_plant,
                 "product_id"),
        _orphans("capacity_plant_without_cost", c.wh_capacities, "plant_id", c.wh_costs,
                 "plant_code"),
        _orphans("cost_plant_without_capacity", c.wh_costs, "plant_code", c.wh_capacities,
                 "plant_id"),
        _orphans("plant_port_unknown_plant", c.plant_port, "plant_code", dim_plant, "plant_code"),
        _orphans("vmi_unknown_plant", c.vmi_customers, "plant_code", dim_plant, "plant_code"),
        _orphans("product_unknown_plant", c.products_per_plant, "plant_code", dim_plant,
                 "plant_code"),
        _rule_counts(ol, {
            "order_missing_date": F.col("order_date").isNull(),
            "order_missing_carrier": F.col("carrier").isNull(),
            "order_missing_customer": F.col("customer").isNull(),
            "order_missing_port": F.col("origin_port").isNull() | F.col("destination_port").isNull(),
        }),
    ]
    return reduce(DataFrame.unionByName, checks)


def _duplicate_keys(rule: str, df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of key values that occur on more than one row."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")


def dq_duplicates(c: Staging) -> DataFrame:
    checks = [
        _duplicate_keys("wh_costs_duplicate_plant", c.wh_costs, ["plant_code"]),
        _duplicate_keys("wh_capacities_duplicate_plant", c.wh_capacities, ["plant_id"]),
        _duplicate_keys("plant_port_duplicate_pair", c.plant_port, ["plant_code", "port"]),
        _duplicate_keys("vmi_duplicate_pair", c.vmi_customers, ["plant_code", "customer_id"]),
        _duplicate_keys("products_per_plant_duplicate_pair", c.products_per_plant,
                        ["plant_code", "product_id"]),
        _duplicate_keys("product_in_several_plants", c.products_per_plant, ["product_id"]),
        _duplicate_keys("freight_rates_duplicate_band", c.freight_rates,
                        ["carrier_id", "origin_port_code", "destination_port_code", "service_code",
                         "min_weight_quantity", "max_weight_quantity"]),
        _duplicate_keys("order_list_identical_lines", c.order_list, c.order_list.columns),
    ]
    return reduce(DataFrame.unionByName, checks)


def dq_bounds(c: Staging) -> DataFrame:
    fr, ol = c.freight_rates, c.order_list
    return reduce(DataFrame.unionByName, [
        _rule_counts(fr, {
            "tariff_min_above_max": F.col("min_weight_quantity") > F.col("max_weight_quantity"),
            "tariff_negative_rate": F.col("rate") < 0,
            "tariff_missing_rate": F.col("rate").isNull(),
            "tariff_missing_minimum_cost": F.col("minimum_cost").isNull(),
            "tariff_missing_rate_and_minimum": F.col("rate").isNull()
                                              & F.col("minimum_cost").isNull(),
        }),
        _rule_counts(c.wh_capacities, {
            "capacity_not_positive": F.coalesce(F.col("daily_capacity") <= 0, F.lit(True)),
        }),
        _rule_counts(c.wh_costs, {
            "cost_per_unit_negative_or_missing": F.coalesce(F.col("cost_per_unit") < 0,
                                                            F.lit(True)),
        }),
        _rule_counts(ol, {
            "order_quantity_not_positive": F.coalesce(F.col("unit_quantity") <= 0, F.lit(True)),
            "order_weight_missing": F.col("weight").isNull(),
            "order_late_and_early": (F.col("ship_late_day_count") > 0)
                                    & (F.col("ship_ahead_day_count") > 0),
        }),
    ])
