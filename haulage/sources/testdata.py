"""Adapter: the driver's TPC-H-shaped parquet tables -> the seven staging tables.

The mapping is a fixed, deterministic recipe (integer and decimal arithmetic
only), so the same rows can be produced by any SQL engine.  Every table is
derived from the parquet inputs with joins, aggregates and generators, so its
size follows the input scale factor.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.sources.staging import Staging, conform

# ---- fixed values of the fixture recipe (must stay exactly as listed) ----
NATION_COUNT = 25                      # TPC-H nation keys 0..24
CARRIERS = (1, 2, 3, 4, 5)             # tariff carriers C01..C05; orders also use C06
ORDER_CARRIER_MOD = 6                  # order carrier = C0(l_suppkey % 6 + 1)
SERVICE_CODES = ("A", "N", "R")        # service s = 0, 1, 2 -> SL_A, SL_N, SL_R
WEIGHT_BANDS = ((0, 50), (50, 120), (120, 200))   # band b = 0, 1, 2, bounds inclusive
TARIFF_KEEP_MOD = 4                    # keep (o*7 + d*3 + c*5 + s) % 4 <> 0
MIN_COST_NULL_MOD = 11                 # minimum_cost NULL when (o + d + c) % 11 = 0
RATE_NULL_MOD = 23                     # rate NULL when (o*3 + d + c) % 23 = 0
PLANT_PORT_EXTRA_SHIFT = 7             # extra port (n + 7) % 25 for n % 3 = 0
VMI_CUSTOMER_MOD = 20                  # VMI customers: c_custkey % 20 = 0
VMI_PLANT_MOD = 5                      # their plant: c_nationkey % 5 + 1
PRODUCT_SECOND_PLANT_SHIFT = 11        # second plant (p_partkey + 11) % 25 + 1 for p % 5 = 0
PRODUCT_ORPHAN = (50, 7)               # parts with p_partkey % 50 = 7 have no plant
CAPACITY_ORPHAN_NATION = 24            # nation 24's plant has no capacity row


def _pad2(c):
    """Two digits at least; larger numbers are not cut."""
    return F.concat(F.when(c < 10, F.lit("0")).otherwise(F.lit("")), c.cast("string"))


def plant_code(idx0):
    """Plant code for a 0-based index: PLANT01, PLANT02, ..."""
    return F.concat(F.lit("PLANT"), _pad2(idx0 + 1))


def port_code(idx0):
    return F.concat(F.lit("PORT"), _pad2(idx0 + 1))


def _dec(x: str):
    return F.lit(Decimal(x))


class ParquetTables:
    """Reads ``{sf_dir}/{name}.parquet`` with only the needed columns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __call__(self, name: str, *cols: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df.select(*cols) if cols else df


def order_list(t: ParquetTables) -> DataFrame:
    l = t("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
          "l_returnflag", "l_shipdate")
    o = t("orders", "o_orderkey", "o_custkey", "o_orderdate")
    c = t("customer", "c_custkey", "c_nationkey")
    s = t("supplier", "s_suppkey", "s_nationkey")
    p = t("part", "p_partkey", "p_size")
    # customers meet the orders, not the lines: where they are too many for a broadcast, orders are shuffled;
    # parts come before the orders, so that lines shuffled by part do not carry the columns of their orders yet
    j = (l.join(s, F.col("l_suppkey") == s.s_suppkey)
          .join(p, F.col("l_partkey") == p.p_partkey)
          .join(o.join(c, o.o_custkey == c.c_custkey), F.col("l_orderkey") == F.col("o_orderkey")))
    order_date = F.to_date("o_orderdate")
    days = F.datediff(F.to_date("l_shipdate"), order_date)
    return conform("order_list", j.select(
        F.col("l_orderkey").alias("order_id"),
        order_date.alias("order_date"),
        port_code(F.col("s_nationkey")).alias("origin_port"),
        F.concat(F.lit("C0"), (F.col("l_suppkey") % ORDER_CARRIER_MOD + 1).cast("string")).alias("carrier"),
        F.col("l_linenumber").alias("transportation_day_count"),
        F.concat(F.lit("SL_"), F.col("l_returnflag")).alias("service_level"),
        F.greatest(F.lit(0), -days).alias("ship_ahead_day_count"),
        F.greatest(F.lit(0), days).alias("ship_late_day_count"),
        F.concat(F.lit("CUST_"), F.col("o_custkey").cast("string")).alias("customer"),
        F.col("l_partkey").alias("product_id"),
        plant_code(F.col("s_nationkey")).alias("plant_code"),
        port_code(F.col("c_nationkey")).alias("destination_port"),
        F.col("l_quantity").cast("int").alias("unit_quantity"),
        (F.col("p_size") * _dec("0.1")).cast("decimal(12,4)").alias("weight"),
    ))


def freight_rates(t: ParquetTables) -> DataFrame:
    """Tariff catalogue: lanes (origin nation x destination nation) x carrier x service x band."""
    nation = t("nation", "n_nationkey")
    last = nation.agg(F.coalesce(F.max("n_nationkey"), F.lit(0)).alias("n")).first()["n"]
    lanes = (nation.select(F.col("n_nationkey").alias("o"))
             .withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(last))))
             .join(nation.select(F.col("n_nationkey").alias("d")), "d", "left_semi"))
    grid = (lanes
            .withColumn("c", F.explode(F.array(*[F.lit(c) for c in CARRIERS])))
            .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(len(SERVICE_CODES) - 1))))
            .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(WEIGHT_BANDS) - 1))))
            .where((F.col("o") * 7 + F.col("d") * 3 + F.col("c") * 5 + F.col("s"))
                   % TARIFF_KEEP_MOD != 0))
    o, d, c, s, b = (F.col(x) for x in "odcsb")

    def pick(idx, values):
        expr = F.when(idx == 0, F.lit(values[0]))
        for i, v in enumerate(values[1:], start=1):
            expr = expr.when(idx == i, F.lit(v))
        return expr

    min_cost = F.when((o + d + c) % MIN_COST_NULL_MOD == 0, F.lit(None)).otherwise(
        _dec("1") + ((o + d * 5 + c) % 20) * _dec("0.5"))
    rate = F.when((o * 3 + d + c) % RATE_NULL_MOD == 0, F.lit(None)).otherwise(
        _dec("0.05") + ((o * 31 + d * 17 + c * 13 + s * 7 + b * 3) % 97) * _dec("0.01"))
    return conform("freight_rates", grid.select(
        F.concat(F.lit("C0"), c.cast("string")).alias("carrier_id"),
        port_code(o).alias("origin_port_code"),
        port_code(d).alias("destination_port_code"),
        pick(b, [lo for lo, _ in WEIGHT_BANDS]).alias("min_weight_quantity"),
        pick(b, [hi for _, hi in WEIGHT_BANDS]).alias("max_weight_quantity"),
        F.concat(F.lit("SL_"), pick(s, list(SERVICE_CODES))).alias("service_code"),
        min_cost.alias("minimum_cost"),
        rate.alias("rate"),
        F.when(c % 2 == 0, F.lit("AIR")).otherwise(F.lit("GROUND")).alias("mode_description"),
        (1 + (o + d + c) % 14).alias("transportation_day_count"),
        F.concat(F.lit("TYPE_"), (c % 3).cast("string")).alias("carrier_type"),
    ))


def plant_port(t: ParquetTables) -> DataFrame:
    n = F.col("n_nationkey")
    nation = t("nation", "n_nationkey")
    own = nation.select(plant_code(n).alias("plant_code"), port_code(n).alias("port"))
    extra = nation.where(n % 3 == 0).select(
        plant_code(n).alias("plant_code"),
        port_code((n + PLANT_PORT_EXTRA_SHIFT) % NATION_COUNT).alias("port"))
    return conform("plant_port", own.unionByName(extra))


def vmi_customers(t: ParquetTables) -> DataFrame:
    c = t("customer", "c_custkey", "c_nationkey")
    return conform("vmi_customers", c.where(F.col("c_custkey") % VMI_CUSTOMER_MOD == 0).select(
        plant_code(F.col("c_nationkey") % VMI_PLANT_MOD).alias("plant_code"),
        F.concat(F.lit("CUST_"), F.col("c_custkey").cast("string")).alias("customer_id")))


def products_per_plant(t: ParquetTables) -> DataFrame:
    p = t("part", "p_partkey")
    k = F.col("p_partkey")
    mod, orphan = PRODUCT_ORPHAN
    first = p.where(k % mod != orphan).select(
        plant_code(k % NATION_COUNT).alias("plant_code"), k.alias("product_id"))
    second = p.where(k % 5 == 0).select(
        plant_code((k + PRODUCT_SECOND_PLANT_SHIFT) % NATION_COUNT).alias("plant_code"),
        k.alias("product_id"))
    return conform("products_per_plant", first.unionByName(second))


def wh_capacities(t: ParquetTables, orders: DataFrame) -> DataFrame:
    """Capacity = max(1, floor(lines * (11 + n % 6) / 10)) per plant; one plant left out."""
    n = F.col("n_nationkey")
    lines = orders.groupBy("plant_code").agg(F.count(F.lit(1)).alias("lines"))
    plants = (t("nation", "n_nationkey").where(n != CAPACITY_ORPHAN_NATION)
              .select(n, plant_code(n).alias("plant_code")))
    j = plants.join(lines, "plant_code", "left")
    cap = F.greatest(F.lit(1), F.expr("(coalesce(lines, 0) * (11 + n_nationkey % 6)) div 10"))
    return conform("wh_capacities", j.select(F.col("plant_code").alias("plant_id"),
                                             cap.alias("daily_capacity")))


def wh_costs(t: ParquetTables) -> DataFrame:
    n = F.col("n_nationkey")
    return conform("wh_costs", t("nation", "n_nationkey").select(
        plant_code(n).alias("plant_code"),
        (_dec("0.37") + (n * 13 % 17) * _dec("0.1")).alias("cost_per_unit")))


def load_staging(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> Staging:
    """The seven staging tables; pass ``orders`` to reuse an already written order list."""
    t = ParquetTables(spark, sf_dir)
    orders = order_list(t) if orders is None else orders
    return Staging(
        plant_port=plant_port(t),
        vmi_customers=vmi_customers(t),
        products_per_plant=products_per_plant(t),
        wh_capacities=wh_capacities(t, orders),
        wh_costs=wh_costs(t),
        freight_rates=freight_rates(t),
        order_list=orders,
    )
