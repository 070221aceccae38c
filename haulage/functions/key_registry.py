"""Surrogate keys that stay put between loads.

A registry is a folder with one table per key: (code columns, key).  A load looks its codes up, and only the
codes it meets for the first time are numbered, behind the highest key so far, in their own order.  Their
rows are appended; nothing written before is touched, so no old key moves, and keys are dense.  A code's
key belongs to the code alone: rows that share a code share its key.  NULL is a code like any other.

A load that fails while it appends has added all of a key's new codes or none; the next load finds them.
One load at a time may write to a registry.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.functions.keys import nulls_last, scalable_key
from haulage.session import stored


class KeyRegistry:
    """Saved keys under ``folder`` (shared storage); ``number`` takes the place of ``scalable_key``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def known(self, name: str) -> DataFrame | None:
        """The codes and keys of ``name``, None before its first load."""
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def number(self, df: DataFrame, name: str, order: list[Column], code: list[str]) -> DataFrame:
        """``df`` with its lasting key ``name`` in front, by the columns ``code``; ``order`` ranks rows
        within a code and is not needed: a code has one key."""
        # read three times below: written, so that a dimension's distinct codes are found once
        df = stored(df, name)
        codes, known = df.select(*code).distinct(), self.known(name)
        if known is None:
            added = scalable_key(codes, name, nulls_last(*code))
        else:
            top = known.agg(F.coalesce(F.max(name), F.lit(0)).alias("top")).first()["top"]
            added = scalable_key(codes.join(known, _same(codes, known, code), "left_anti"), name, nulls_last(*code))
            added = added.withColumn(name, F.col(name) + F.lit(top))
        added.select(*code, name).write.mode("append").parquet(f"{self.folder}/{name}")
        keys = self.known(name).select(*[F.col(c).alias(f"_{c}") for c in code], name)
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in code])
        return df.join(keys, same).select(name, *df.columns)


def _same(left: DataFrame, right: DataFrame, code: list[str]) -> Column:
    return reduce(Column.__and__, [left[c].eqNullSafe(right[c]) for c in code])


def dense(df: DataFrame, name: str, order: list[Column], code: list[str]) -> DataFrame:
    """Keys of this load alone, 1 to n in ``order``."""
    return scalable_key(df, name, order)
