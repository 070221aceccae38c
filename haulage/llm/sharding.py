"""Sharding by a two-pass external shuffle (native).

Pass 1 scatters the records uniformly over memory-sized buckets by a seeded hash of the
whole record, puts each bucket in a fixed start order, shuffles it with Spark's
``shuffle`` (a Fisher-Yates shuffle, seeded per bucket) and writes the buckets to the
shared folder.  Pass 2 reads them back in bucket order: a record's global position is its
bucket's offset plus its place in the bucket, and the positions are cut into shards whose
row counts differ by one at most (law ``rows``).

The written buckets fix every later pass, so a lost executor cannot change an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import col, fresh, read_table, running_before, written

#: Text bytes aimed at in one bucket; a task holds one bucket in memory.
BUCKET_BYTES = 32 << 20
#: Buckets made at least, so that small inputs still spread over the cluster.
MIN_BUCKETS = 64
#: Buckets made at most, which bounds the broadcast table of their offsets (16 bytes each).
#: Above BUCKET_BYTES * MAX_BUCKETS of text the buckets grow instead: 100 MB at 100 TB.
MAX_BUCKETS = 1 << 20
SEED = 20_240


def size_of(text):
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shuffled_buckets(docs: DataFrame, text: str = "text", seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """Pass 1: one written row per bucket: bucket, n, records (an array in shuffled order).

    Identical rows are told apart by a copy number before they are hashed, so a row that
    repeats any number of times is spread like distinct ones.
    """
    cols = docs.columns
    copy, key = fresh(cols, "copy", "key")
    row_hash = F.xxhash64(*[col(c) for c in cols])
    stats = (docs.groupBy(row_hash.alias(key))
             .agg(F.count(F.lit(1)).alias("n"), F.sum(size_of(col(text))).alias("bytes"))
             .agg(F.max("n").alias("most"), F.sum("bytes").alias("bytes")).first())
    if (stats["most"] or 0) > 1:
        numbered = (docs.groupBy(*[col(c) for c in cols]).agg(F.count(F.lit(1)).alias(key))
                    .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), col(key)))).drop(key))
    else:
        numbered = docs.withColumn(copy, F.lit(1).cast("long"))
    buckets = min(MAX_BUCKETS, max(min_buckets, -(-(stats["bytes"] or 0) // bucket_bytes)))
    every = [col(c) for c in [*cols, copy]]
    scattered = numbered.select(
        F.pmod(F.xxhash64(F.lit(seed), *every), F.lit(buckets)).cast("int").alias("bucket"),
        F.struct(F.xxhash64(F.lit(seed + 1), *every).alias("rank"),
                 F.struct(*[col(c) for c in cols]).alias("row")).alias("record"))
    # one bucket per partition: memory holds one at a time, and its seed is its own
    packed = (scattered.repartitionById(buckets, F.col("bucket"))
              .groupBy("bucket").agg(F.sort_array(F.collect_list("record")).alias("records")))
    return written(packed.select(
        F.col("bucket").cast("long").alias("bucket"), F.size("records").cast("long").alias("n"),
        F.shuffle(F.transform("records", lambda r: r["row"]), seed).alias("records")), "buckets")


def shard(docs: DataFrame, shards: int = 8, text: str = "text", seed: int = SEED,
          bucket_bytes: int = BUCKET_BYTES, min_buckets: int = MIN_BUCKETS,
          shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """All rows and columns of ``docs`` plus ``shard`` (int, from 0) and ``slot`` (long, gapless
    from 0 in each shard).

    Law ``rows``: shard sizes differ by one row at most.  Nulls, empty and very long texts are
    rows like others; an empty table gives an empty result; ties cannot occur, since identical
    rows are interchangeable; input columns called like the two new ones are replaced.
    """
    docs = docs.drop(shard_col, slot_col)
    packed = shuffled_buckets(docs, text, seed, bucket_bytes, min_buckets)
    offsets = running_before(packed.select("bucket", "n"), "bucket", "n", "start")
    total = packed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    [at] = fresh([*docs.columns, shard_col, slot_col], "at")
    placed = (packed.join(F.broadcast(offsets.select("bucket", "start")), "bucket")
              .select("start", F.posexplode("records").alias("place", "row"))
              .select("row.*", (F.col("start") + F.col("place")).cast("long").alias(at)))
    # shard s holds the places from ceil(s * total / shards) on
    number = F.expr(f"CAST(({at} * {shards}L) div {max(total, 1)}L AS INT)")
    first = F.expr(f"(`{shard_col}` * {total}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn(shard_col, number)
            .withColumn(slot_col, (F.col(at) - first).cast("long")).drop(at))


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """One folder of Parquet files per shard, rows by slot inside each file."""
    (sharded.sortWithinPartitions(shard_col, slot_col)
     .write.partitionBy(shard_col).parquet(path))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`shard` over all of ``documents``, 8 shards."""
    out = shard(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", size_of(F.col("text")).alias("size"),
                      F.crc32(F.coalesce("text", F.lit(""))).cast("long").alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
