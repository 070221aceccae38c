"""Dense surrogate keys 1..n, ranks and running sums in a total order, partition-parallel.

Rows are range-partitioned on the full sort key (a single hot value of the leading column is
still split on the trailing columns), sorted inside each partition and written with their partition
and position, so that every later pass sees the same ones; then each partition's offset is added.
The offsets are one number per partition, so keeping them in the plan is bounded.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulage.session import stored


def nulls_last(*cols: str | Column) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in cols]


def scalable_key(df: DataFrame, name: str, order: list[Column],
                 num_partitions: int | None = None) -> DataFrame:
    # without an explicit count AQE may merge small neighbouring ranges; merged
    # partitions stay contiguous, so partition order is still key order
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    ordered = stored(ranged.sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("_part"),
        # monotonically_increasing_id = (partition << 33) + position in partition
        (F.monotonically_increasing_id()
         - F.shiftleft(F.spark_partition_id().cast("long"), 33)).alias("_pos")), "ordered")
    sizes = dict(ordered.groupBy("_part").count().collect())
    offsets = accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=0)
    before = f"array({', '.join(f'{n}L' for n in offsets)})"
    return ordered.select((F.expr(f"{before}[_part]") + F.col("_pos") + 1).cast("long").alias(name),
                          *[F.col(c) for c in df.columns])


def scalable_rank_within(df: DataFrame, name: str, group: list[str], order: list[Column],
                         num_partitions: int | None = None) -> DataFrame:
    """1..n inside each group in ``order``, without putting a group in one task.

    Numbers all rows globally in (group, order) with ``scalable_key`` (a large
    group spans several range partitions), then subtracts the group's first
    position.  The per-group start table has one row per group.
    """
    keyed = scalable_key(df, "_pos", nulls_last(*group) + list(order), num_partitions)
    starts = keyed.groupBy(*group).agg(F.min("_pos").alias("_start"))
    return (keyed.join(starts, group)
            .withColumn(name, (F.col("_pos") - F.col("_start") + 1).cast("long"))
            .drop("_pos", "_start"))


def scalable_running_sum(df: DataFrame, name: str, value: str, group: list[str], order: list[Column],
                         num_partitions: int | None = None) -> DataFrame:
    """Sum of ``value`` up to and including each row, inside its group in ``order`` (total), without
    putting a group in one task: rows are range-partitioned on (group, order), summed inside each
    partition, and the totals of a group's earlier partitions added (a row per partition and group
    that meet, and ranges are contiguous, so few)."""
    full = nulls_last(*group) + list(order)
    ranged = df.repartitionByRange(num_partitions, *full) if num_partitions else df.repartitionByRange(*full)
    parts = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part", *group).agg(F.sum(value).alias("_total"))
    before = totals.select("_part", *group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return (parts.withColumn(name, F.sum(value).over(within)).join(before, ["_part", *group])
            .withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before"))
