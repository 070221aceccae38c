"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosine, components.

Equal vectors are one class from the start.  Every class gets, in each of several tables, the
signs of its products with random hyperplanes as a bucket number; the classes of a bucket are
compared by exact cosine, block by block, in numpy.  A pair counts in the first table in which
it shares a bucket, and only counts and a spanning forest leave a block, never all pairs.

The planes per table grow with the logarithm of the number of classes (about ``BUCKET`` classes
in a bucket of spread vectors), and the tables with them, so that a pair at the threshold is
missed with a probability below ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.blocks import in_blocks
from haulage.llm.common import col, fresh, read_table, written
from haulage.llm.components import components

THRESHOLD, BUCKET, MISS, SEED = 0.95, 128, 1e-6, 3


def tables_for(classes: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> tuple[int, int]:
    """(planes per table, tables)."""
    planes = max(4, math.ceil(math.log2(max(classes, 1) / bucket)) if classes > bucket else 4)
    same = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(miss) / math.log(1 - same))


def forest(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component in a symmetric boolean matrix."""
    label = np.arange(len(linked))
    while True:
        around = np.where(linked, label[None, :], len(linked)).min(axis=1, initial=len(linked))
        low = np.minimum(label, around)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(threshold: float):
    """Links inside a block pair: rows (a, b, 0) are forest edges, rows (a, null, n) link counts."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        at, left, right = key[0].as_py(), key[3].as_py(), key[4].as_py()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], table.column("own_block").to_numpy()[order]
        copies = table.column("copies").to_numpy()[order]
        vectors = np.array(table.column("vector").to_pylist(), np.float64)[order]
        codes = np.array(table.column("codes").to_pylist(), np.int64)[order]
        length = np.sqrt((vectors * vectors).sum(axis=1))
        linked = vectors @ vectors.T / (length[:, None] * length[None, :]) >= threshold
        np.fill_diagonal(linked, False)
        if left != right:
            linked &= own[:, None] != own[None, :]
        for earlier in range(at):  # a pair that met in an earlier table counted there
            linked &= codes[:, earlier][:, None] != codes[:, earlier][None, :]
        edges = forest(linked)
        links = linked @ copies
        moved, counted = edges != np.arange(len(ids)), links > 0
        return pa.table({"a": np.concatenate([ids[moved], ids[counted]]),
                         "b": pa.array(np.concatenate([ids[edges[moved]], ids[counted]]),
                                       mask=np.concatenate([np.zeros(moved.sum(), bool), np.ones(counted.sum(), bool)])),
                         "n": np.concatenate([np.zeros(moved.sum(), np.int64), links[counted].astype(np.int64)])})

    return compare


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                    seed: int = SEED) -> DataFrame:
    """All rows and columns of ``vectors`` plus n_links, component_id and kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null
    key link with nothing: n_links 0, their key as component, kept.  Vectors of another length
    link among themselves alone.
    Rows that repeat a vector are linked vectors like others.  Columns called like the new ones
    are replaced.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = vectors.drop("n_links", "component_id", "kept")
    [unit] = fresh(vectors.columns, "unit")
    value = F.col("`" + embedding + "`").cast("array<double>")
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(value, lambda x: x != 0)
    good = col(key).isNotNull() & value.isNotNull() & fine & some
    keyed = vectors.withColumn(unit, F.when(good, value))
    classes = written(keyed.filter(col(unit).isNotNull()).groupBy(col(unit).alias("vector"))
                      .agg(F.min(col(key)).alias("least"), F.count(F.lit(1)).alias("copies"))
                      .withColumn("id", F.monotonically_increasing_id()), "vectors")
    planes, tables = tables_for(classes.count(), threshold)

    def signed(batches):
        normals = {}
        for batch in batches:
            codes = np.zeros((batch.num_rows, tables), np.int64)
            values = batch.column("vector").to_pylist()
            lengths = np.array([len(v) for v in values])
            for dim in np.unique(lengths):
                mine = np.nonzero(lengths == dim)[0]
                if dim not in normals:
                    normals[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * planes))
                signs = np.array([values[i] for i in mine]) @ normals[dim] > 0
                codes[mine] = signs.reshape(len(mine), tables, planes) @ (1 << np.arange(planes))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), batch.column("vector"),
                 pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["id", "copies", "vector", "codes"])

    coded = classes.select("id", "copies", "vector").mapInArrow(
        signed, "id bigint, copies bigint, vector array<double>, codes array<bigint>")
    rows = (coded.select("*", F.size("vector").alias("dim"), F.posexplode("codes").alias("table", "code")))
    blocked = in_blocks(rows, ["table", "code", "dim"], "id")
    found = written(blocked.groupBy("table", "code", "dim", "left_block", "right_block")
                    .applyInArrow(_compare(threshold), "a bigint, b bigint, n bigint"), "vector-links")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    parts = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("id"), "component")
    info = (classes.select("id", "least", "copies").join(links, "id", "left").join(parts, "id", "left")
            .withColumn("component", F.coalesce("component", "id")))
    smallest = info.groupBy("component").agg(F.min("least").alias("component_id"))
    info = (info.join(smallest, "component")
            .select("id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    labelled = written(classes.select("id", F.col("vector").alias(unit)).join(info, "id").drop("id"), "vector-classes")
    return (keyed.join(labelled, unit, "left").drop(unit)
            .withColumns({"n_links": F.coalesce("n_links", F.lit(0)).cast("long"),
                          "component_id": F.coalesce(F.col("component_id"), col(key))})
            .withColumn("kept", col(key).eqNullSafe(F.col("component_id")))
            .select(*[col(c) for c in vectors.columns], "n_links", "component_id", "kept"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all ``embeddings``."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


#: Brute force over all pairs; the driver's DuckDB compares them in doubles.
OP4_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
    WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(e, e) > 0),
  links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= {THRESHOLD}),
  reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
  least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
  counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
  SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
  FROM v JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""
