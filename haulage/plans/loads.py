"""A model that takes new order lines without being built anew.

A folder (shared storage) holds, per load, the small tables as of that load, the load's own order lines and
the shipment rollup of the ranges of order numbers ("cells") that the load touches; a registry keeps the
dimension keys.  A load reads its own lines and the rollup of the touched cells only: the shipments of both
are merged and the cell is written anew, next to the old one.  What counts is said by the commit table alone,
one row per touched cell, appended as a single file when all else is written: until then every reader sees
the model as it was, and a load that fails anywhere is simply run again.

The other staging tables (tariffs, plants, bridges' lists) are taken whole from every load and replace the
earlier ones.  Codes met in earlier orders stay in the dimensions.  A line whose code is unknown at its load
drops out, as in a full build, and does not come back when a later load brings the code.  The same line
loaded twice counts twice.  One load at a time may write to a folder.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.functions.key_registry import KeyRegistry
from haulage.functions.keys import nulls_last, scalable_key
from haulage.functions.pricing import WEIGHT_TYPE
from haulage.operators import bridges, costmodel, dims, facts
from haulage.plans.star import Star, _write_all, register_star
from haulage.sources.staging import Staging

#: A cell has 2^20 order numbers; lines without a number have a cell of their own.
CELL_BITS, NO_ORDER = 20, -(1 << 62)
SMALL = ("dim_plant", "dim_port", "dim_carrier", "dim_customer", "dim_product", "dim_date", "bridge_plant_customer",
         "bridge_plant_port", "bridge_plant_product", "fact_freight_rates")


def _in_cells(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.coalesce(F.shiftright("order_id", CELL_BITS), F.lit(NO_ORDER)))


def _with_codes(c: Staging, known: DataFrame, *names: str) -> Staging:
    """``c`` with an order list of the columns ``names`` alone, which has the codes of ``known`` in each as well."""
    [code] = known.columns
    return replace(c, order_list=c.order_list.select(*names).union(known.select(*[F.col(code).alias(n) for n in names])))


class LoadedModel:
    """The model in ``folder``: :meth:`load` adds order lines, :meth:`star` is the model after the last load."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.keys = KeyRegistry(spark, f"{self.folder}/keys")

    def commits(self) -> DataFrame | None:
        """(load, cell, order_key): the touched cells of every load and its highest order key; None at first."""
        try:
            return self.spark.read.parquet(f"{self.folder}/commits")
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _last(self) -> tuple[int, int]:
        """The last load and the highest order key, 0 at first."""
        done = self.commits()
        return (0, 0) if done is None else tuple(done.agg(F.max("load"), F.max("order_key")).first())

    def _rollup(self, schema: T.StructType) -> DataFrame:
        """Shipments of the last load of every cell, with the cell."""
        newest = self.commits().where("cell IS NOT NULL").groupBy("cell").agg(F.max("load").alias("load"))
        kept = T.StructType([*schema.fields, T.StructField("load", T.IntegerType()), T.StructField("cell", T.LongType())])
        table = self.spark.read.schema(kept).parquet(f"{self.folder}/shipments")
        return table.join(newest, ["load", "cell"], "left_semi").drop("load")

    def _lines(self, last: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/fact_orders").where(F.col("load") <= last).drop("load")

    def star(self) -> Star:
        """The model after the last load that ended."""
        last, _ = self._last()
        if not last:
            raise ValueError(f"no load has ended in {self.folder}")
        lines = self._lines(last)
        small = {n: self.spark.read.parquet(f"{self.folder}/tables/load={last}/{n}") for n in SMALL}
        return Star(clean=None, **small, fact_orders=lines, shipments=self._rollup(costmodel.shipments(lines).schema).drop("cell"))

    def open(self) -> str:
        """The name under which the questions find the model as it is now."""
        return register_star(self.spark, f"loaded:{self.folder}:{self._last()[0]}", self.star())

    def load(self, c: Staging) -> int:
        """Adds the order lines of ``c`` (clean tables) and returns the number of the load."""
        last, top = self._last()
        load = last + 1
        old = self.star() if last else None
        number = self.keys.number

        def seen(dimension: str, code: str, *names: str) -> Staging:
            return _with_codes(c, getattr(old, dimension).select(code), *names) if old else c

        root = f"{self.folder}/tables/load={load}"
        d = _write_all({
            "dim_plant": lambda: dims.dim_plant(c, number),
            "dim_port": lambda: dims.dim_port(seen("dim_port", "port", "origin_port", "destination_port"), number),
            "dim_carrier": lambda: dims.dim_carrier(seen("dim_carrier", "carrier_id", "carrier"), number),
            "dim_customer": lambda: dims.dim_customer(seen("dim_customer", "customer_id", "customer"), number),
            "dim_product": lambda: dims.dim_product(c, number=number),
            "dim_date": lambda: dims.dim_date(seen("dim_date", "full_date", "order_date"), number),
        }, root)

        def numbered_lines() -> DataFrame:
            lines = facts.order_lines_keyed(c.order_list, d["dim_date"], d["dim_plant"], d["dim_product"], d["dim_customer"],
                                            d["dim_carrier"], d["dim_port"])
            return (scalable_key(lines, "order_key", nulls_last(*facts.ORDER_COLUMNS))
                    .withColumn("order_key", F.col("order_key") + F.lit(top)))

        _write_all({
            "bridge_plant_customer": lambda: bridges.bridge_plant_customer(c, d["dim_plant"], d["dim_customer"]),
            "bridge_plant_port": lambda: bridges.bridge_plant_port(c, d["dim_plant"], d["dim_port"]),
            "bridge_plant_product": lambda: bridges.bridge_plant_product(c, d["dim_plant"], d["dim_product"]),
            "fact_freight_rates": lambda: facts.fact_freight_rates(c, d["dim_carrier"], d["dim_port"]),
        }, root)
        lines = _write_all({f"load={load}": numbered_lines}, f"{self.folder}/fact_orders")[f"load={load}"]
        cells = _in_cells(lines).select("cell").distinct()
        rollup = _in_cells(costmodel.shipments(lines))
        if old:
            # the sums of the earlier loads and this one's lines, by shipment at once
            before = self._rollup(rollup.drop("cell").schema).join(cells, "cell", "left_semi")
            added = _in_cells(lines).selectExpr("cell", *costmodel.SHIPMENT_KEYS, "CAST(unit_quantity AS BIGINT) AS unit_quantity",
                                                "unit_quantity * weight AS total_weight")
            rollup = (before.unionByName(added).groupBy("cell", *costmodel.SHIPMENT_KEYS).agg(
                F.sum("unit_quantity").alias("unit_quantity"), F.sum("total_weight").cast(WEIGHT_TYPE).alias("total_weight")))
        # few files per cell; a large cell is dealt to several tasks
        rollup.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/shipments/load={load}")
        highest = lines.agg(F.coalesce(F.max("order_key"), F.lit(top)).alias("order_key"))
        done = cells.select("cell", F.lit(None).cast("long").alias("order_key")).union(
            highest.select(F.lit(None).cast("long"), "order_key"))
        # one file: the load counts as a whole or not at all
        done.select(F.lit(load).alias("load"), "cell", "order_key").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return load
