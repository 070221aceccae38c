"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct word shingles.  Under each of PERMUTATIONS permutations of
the 64-bit shingle hashes both the smallest and the largest value are kept, so the signature has
two values per hash evaluation.  Signatures are cut into bands; documents that share a band are
candidates, and a candidate pair is a link if its full sets have the similarity asked for.

Documents with equal sets are one class from the start.  The classes that share a band with
another one get their full sets, once; then two rounds compare them:

1. In every bucket (classes that share a band) each class meets the bucket's centre, the class of
   the lowest rank; all buckets rank alike, so a large group has few centres.  The links found are
   closed to components.
2. Two classes of a bucket that have both met its centre, but not each other, and are not in one
   component yet, may still be linked.  Every such pair is among the classes that met one centre,
   so those are compared with each other by exact matrix products of their sets, block by block.
   Only a spanning forest of the links leaves a block.

So a group of thousands of copies costs little per copy, no pair that could join two components is
left out, and nothing is capped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.blocks import in_blocks
from haulage.llm.common import col, fresh, read_table, written
from haulage.llm.components import components
from haulage.llm.embeddings import forest

PERMUTATIONS, BAND_ROWS, SEED = 64, 4, 1
#: Similarity as a ratio of integers: 100 * intersection >= 80 * union.
THRESHOLD = (80, 100)
#: Classes in a block of the second round, and columns of one matrix product.
BLOCK, COLUMNS = 512, 8192
#: Shingles hashed at once.
CHUNK = 4096
#: Word hashes kept by a task before it starts afresh.
CACHE = 1 << 20


class WordHashes(dict):
    """Hash by word (bytes), computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(values: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads 64-bit values."""
    values = (values ^ values >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def shingle_set(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words; of all words as one shingle if
    there are fewer; none without words."""
    # bytes.lower changes A-Z alone, bytes.split cuts at the ASCII white space
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(ids))
    total = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        total = mixed(total + ids[k:len(ids) - size + 1 + k])
    return np.unique(total)


def digest(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def permutations(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and offsets of ``count`` permutations x -> factor * x + offset mod 2^64."""
    rng = np.random.default_rng(seed)
    draw = lambda: rng.integers(0, 1 << 64, count, np.uint64, endpoint=False)
    return draw() | np.uint64(1), draw()


def min_max(shingles: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side, as the upper 32 bits (int32)."""
    low = np.full(len(factors), ~np.uint64(0))
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(shingles), CHUNK):
        seen = shingles[at:at + CHUNK, None] * factors + offsets
        np.minimum(low, seen.min(axis=0), out=low)
        np.maximum(high, seen.max(axis=0), out=high)
    return (np.column_stack([low, high]).ravel() >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, words: int, text: str, seed: int) -> DataFrame:
    """``docs`` without the text, plus n_shingles, digest (null: empty set) and signature."""
    schema = docs.drop(text).withColumns({"n_shingles": F.lit(0).cast("long"), "digest": F.lit(None).cast("binary"),
                                          "signature": F.lit(None).cast("array<int>")}).schema

    def sign(batches):
        factors, offsets = permutations(seed, PERMUTATIONS)
        hashes = WordHashes()
        for batch in batches:
            sizes, digests, found = [], [], []
            for value in batch.column(text).to_pylist():
                shingles = shingle_set(value, words, hashes)
                sizes.append(len(shingles))
                digests.append(digest(shingles))
                found.append(min_max(shingles, factors, offsets) if len(shingles) else np.zeros(0, np.int32))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            values = pa.array(np.concatenate([*found, np.zeros(0, np.int32)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in batch.schema.names if c != text], pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)],
                names=[f.name for f in schema])

    return docs.mapInArrow(sign, schema)


def full_sets(classes: DataFrame, ids: DataFrame, docs: DataFrame, words: int, text: str) -> DataFrame:
    """Written (id, shingles): the full sets of the classes in ``ids``, computed anew from their texts."""
    wanted = written(classes.select("id", "key", "digest").join(ids, "id", "left_semi"), "minhash-wanted")

    def sets(batches):
        hashes = WordHashes()
        for batch in batches:
            numbers, found = [], []
            for number, mark, value in zip(*(batch.column(c).to_pylist() for c in ("id", "digest", text))):
                shingles = shingle_set(value, words, hashes)
                if digest(shingles) == mark:
                    numbers.append(number)
                    found.append(shingles.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(found, pa.binary())], names=["id", "shingles"])

    # a merge join leaves the rows sorted by key, so that rows repeated word for word go at no further cost
    texts = docs.select("key", text).join(wanted.hint("merge"), "key").dropDuplicates(["key"])
    return written(texts.select("id", "digest", text).mapInArrow(sets, "id bigint, shingles binary"), "minhash-sets")


def verified(pairs: DataFrame, full: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """The links among ``pairs`` (a, b), by intersection and union of the full sets."""
    share, whole = threshold

    def compare(batches):
        for batch in batches:
            links = []
            for one, two in zip(batch.column("one"), batch.column("two")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (one, two))
                common = len(np.intersect1d(x, y, assume_unique=True))
                links.append(whole * common >= share * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    both = (pairs.join(full.select(F.col("id").alias("a"), F.col("shingles").alias("one")), "a")
            .join(full.select(F.col("id").alias("b"), F.col("shingles").alias("two")), "b"))
    return written(both.select("a", "b", "one", "two").mapInArrow(compare, "a bigint, b bigint"), "minhash-links")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all intersections."""
    lengths = np.array([len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    # shingles of one set alone meet nothing
    shared = times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        first, stop = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[first:stop], column[first:stop] - at] = 1
        out += part @ part.T
    np.fill_diagonal(out, lengths)
    return out


def _linked_in_block(threshold: tuple[int, int]):
    share, whole = threshold

    def link(key: tuple, table: pa.Table) -> pa.Table:
        ids, part = table.column("id").to_numpy(), table.column("part").to_numpy()
        order = np.argsort(ids)
        ids, part = ids[order], part[order]
        if (part == part[0]).all():
            return pa.table({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        raw = table.column("shingles").combine_chunks().take(pa.array(order))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        size = np.array([len(x) for x in sets], np.float64)
        common = common_counts(sets)
        low = forest(whole * common >= share * (size[:, None] + size[None, :] - common))
        moved = low != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[low[moved]]})

    return link


def similar_classes(classes: DataFrame, docs: DataFrame, words: int, text: str, threshold: tuple[int, int], seed: int) -> DataFrame:
    """(node, component) of the classes (id, key, n_shingles, digest, signature) that have a link."""
    share, whole = threshold
    bands = 2 * PERMUTATIONS // BAND_ROWS
    hashed = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)),
                         lambda b: F.xxhash64(b, F.slice("signature", b * BAND_ROWS + 1, BAND_ROWS)))
    banded = classes.select("id", "n_shingles", F.explode(hashed).alias("band"))
    rank = F.struct(F.xxhash64(F.lit(seed), "id").alias("rank"), F.col("id").alias("centre"), F.col("n_shingles").alias("centre_n"))
    shared = written(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("least")).filter("n > 1")
                     .select("band", "least.centre", "least.centre_n"), "minhash-buckets")
    members = written(banded.join(shared, "band"), "minhash-members")
    full = full_sets(classes, members.select("id").distinct(), docs, words, text)
    # sets of very different size cannot be similar enough
    met = written(members.filter((F.col("id") != F.col("centre")) & (F.least("n_shingles", "centre_n") * whole >= F.greatest("n_shingles", "centre_n") * share))
                  .select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), "minhash-pairs")
    links = verified(met, full, threshold)
    parts = components(links).withColumnRenamed("node", "id")
    placed = written(members.filter("id <> centre").select("band", "id", "centre").join(parts, "id", "left")
                     .select("band", "id", "centre", F.coalesce("component", "id").alias("part")), "minhash-placed")
    open_ = written(placed.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high"))
                    .filter("low < high").select("band"), "minhash-open")
    rest = written(placed.join(open_, "band", "left_semi").select("centre", "id", "part").distinct(), "minhash-rest")
    more = (in_blocks(rest, ["centre"], "id", BLOCK).join(full, "id").groupBy("centre", "left_block", "right_block")
            .applyInArrow(_linked_in_block(threshold), "a bigint, b bigint"))
    return components(links.unionByName(written(more, "minhash-more")))


def _labelled(docs: DataFrame, words: int, threshold: tuple[int, int], key: str, text: str, seed: int) -> DataFrame:
    """(doc, key, n_shingles, component_id, kept) per row; ``key`` is a hash of document key and text."""
    # by that hash a class's text is found again, whatever order the rows come in
    keyed = docs.select(col(key).alias("doc"), col(text).alias("body"), F.xxhash64(col(key), col(text)).alias("key"))
    rows = written(signatures(keyed, words, "body", seed).withColumn("row", F.monotonically_increasing_id()), "minhash-rows")
    grouped = written(rows.filter("digest IS NOT NULL").groupBy("digest").agg(
        F.min("row").alias("id"), F.min("doc").alias("least")), "minhash-classes")
    classes = written(rows.drop("digest", "doc").join(grouped, rows["row"] == grouped["id"])
                      .select("id", "key", "digest", "least", "n_shingles", "signature"), "minhash-signed")
    parts = similar_classes(classes, keyed, words, "body", threshold, seed)
    info = (grouped.join(parts.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id")))
    least = written(info.groupBy("component").agg(F.min("least").alias("component_id")), "minhash-least")
    info = written(info.join(least, "component").select("digest", "component_id", F.lit(True).alias("found")), "minhash-components")
    out = rows.select("doc", "key", "n_shingles", "digest").join(info, "digest", "left")
    return out.select("doc", "key", "n_shingles",
                      F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
                      F.when(F.col("found"), F.col("doc").eqNullSafe(F.col("component_id"))).otherwise(F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = THRESHOLD, key: str = "doc_id",
                    text: str = "text", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: the key, n_shingles, component_id (smallest key reachable over
    links, its own included) and kept.

    Null and empty texts and texts without words have no shingles and link with nothing; texts of
    fewer words are one shingle; very long texts are read whole.  Equal sets are linked, repeated
    rows too: of rows with the smallest key all are kept.  A row with a null key is in its
    component but never its smallest; a component of such rows alone has a null id and keeps them.
    An empty table gives an empty result; extra columns are left out.
    """
    return _labelled(docs, words, threshold, key, text, seed).select(F.col("doc").alias(key), "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, words: int = 5, threshold: tuple[int, int] = THRESHOLD, key: str = "doc_id",
                         text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps."""
    [mark] = fresh(docs.columns, "mark")
    kept = written(_labelled(docs, words, threshold, key, text, seed).filter("kept")
                   .select(F.col("key").alias(mark)).distinct(), "minhash-kept")
    return docs.withColumn(mark, F.xxhash64(col(key), col(text))).join(kept, mark, "left_semi").drop(mark)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all ``documents`` on shingles of four words, as its contract has it."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4)
