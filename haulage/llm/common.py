"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulage.session import scratch_path

#: White space of the word and line rules (fixed values): space and \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage cut, real sizes for the planner."""
    path = scratch_path(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column of ``taken`` has it."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column called exactly ``name``, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, mod ``modulus``; a null key counts as empty text (0)."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(modulus)).cast("int")


def running_before(df: DataFrame, key: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """Sum of ``value`` over the rows with smaller ``key`` (a unique long from 0).

    Two levels: inside runs of ``group`` keys, and over the totals of the runs, so no
    task sees all rows.
    """
    run, base = fresh(df.columns, "run", "base")
    tagged = df.withColumn(run, F.floor(col(key) / group).cast("long"))
    totals = tagged.groupBy(run).agg(F.sum(value).alias(base))
    bases = totals.select(run, F.coalesce(F.sum(base).over(
        Window.orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    within = F.coalesce(F.sum(value).over(Window.partitionBy(run).orderBy(key)
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (tagged.withColumn(out, within).join(bases, run)
            .withColumn(out, (col(out) + col(base)).cast("long")).drop(run, base))
