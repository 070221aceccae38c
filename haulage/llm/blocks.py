"""Comparing the rows of a bucket with each other in blocks of bounded size.

A bucket of more than BLOCK rows is cut into blocks by a hash of the row; every two blocks meet
in a task group of their own, so no group holds more than two blocks however large the bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import written

BLOCK = 1024


def in_blocks(rows: DataFrame, bucket: list[str], key: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``left_block``, ``right_block`` and ``own_block``; a row appears once for each block
    of its bucket.  Buckets of one row go."""
    sizes = written(rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                    .select(*bucket, F.ceil(F.col("n") / block).cast("int").alias("n_blocks")), "bucket-sizes")
    own = F.pmod(F.xxhash64(key), F.col("n_blocks")).cast("int")
    return (rows.join(sizes, bucket).withColumn("own_block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            .withColumns({"left_block": F.least("own_block", "other"), "right_block": F.greatest("own_block", "other")})
            .drop("other", "n_blocks"))
