"""Line dedup with a sharded minimal perfect hash.

A line's key is hashed to 96 bits; the first 64 choose a shard and are placed by the shard's
minimal perfect hash, the other 32 are its fingerprint.  A shard is one binary row of compact
arrays by that index: fingerprints, document counts (up to 255) and, for keys in two documents
or more, the smallest document.  Documents send their line hashes to the shards and probe the
arrays; no line is joined with another.

Key hashes are combined inside every map task, so a line that very many documents hold reaches
its shard once per task.  Keys with over 1/HOT of all (document, key) pairs, HOT of them at most,
are not probed: their smallest documents are sent to the tasks instead.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import perfect_hash
from haulage.llm.common import col, fresh, read_table, written

#: Text bytes for one shard (of the order of a million lines), and shards at least.
SHARD_BYTES, MIN_SHARDS = 64 << 20, 64
HOT = 4096
#: (document, key) pairs that a map task combines at once.
COMBINE = 1 << 20
#: Shortest key in code points.
LEAST = 10
#: Stands for a null document id: above all others.
LAST = (1 << 63) - 1


def line_keys(text: str | None, least: int = LEAST) -> list[bytes]:
    """Per line of the text (none: one empty line) its key, or b'' where that is too short."""
    # on bytes, lower changes A-Z alone and strip takes the ASCII white space
    keys = [line.strip() for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n")]
    return [k if len(k) >= least and (k.isascii() or len(k.decode("utf-8", "surrogatepass")) >= least) else b"" for k in keys]


def hashes(keys: list[bytes]) -> np.ndarray:
    """96-bit hashes of the keys as rows (uint64, uint64 below 2^32)."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.uint64).reshape(-1, 2)
    return np.column_stack([raw[:, 0], raw[:, 1] >> np.uint64(32)])


def distinct_hashes(text: str | None) -> np.ndarray:
    return hashes(list({k: None for k in line_keys(text) if k}))


def _combine(pairs: np.ndarray, docs: np.ndarray, last: np.ndarray, counts: np.ndarray) -> tuple:
    """Sums up rows of one key: (key rows, smallest document, largest, count)."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs, docs, last, counts = pairs[order], docs[order], last[order], counts[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    starts = np.nonzero(new)[0]
    if not len(starts):
        return pairs, docs, last, counts
    return pairs[starts], np.minimum.reduceat(docs, starts), np.maximum.reduceat(last, starts), np.add.reduceat(counts, starts)


def index(docs: DataFrame, shards: int) -> DataFrame:
    """The written index: one row per shard with ``tables`` (binary), ``pairs`` and its hottest keys."""

    def gather(batches):
        held, size = [], 0

        def flush():
            pairs, low, high, counts = _combine(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays(
                [pa.array((pairs[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(pairs[:, 0].view(np.int64)),
                 pa.array(pairs[:, 1].astype(np.int64)), pa.array(low), pa.array(high), pa.array(counts)],
                names=["shard", "key", "mark", "low", "high", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist()):
                found = distinct_hashes(text)
                if len(found):
                    own = np.full(len(found), doc, np.int64)
                    held.append((found, own, own, np.ones(len(found), np.int64)))
                    size += len(found)
                if size >= COMBINE:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        number = lambda c: table.column(c).to_numpy()
        pairs, low, high, counts = _combine(np.column_stack([number("key").view(np.uint64), number("mark").astype(np.uint64)]),
                                            number("low"), number("high"), number("n"))
        # keys that share their first 64 bits (hardly ever) are kept apart by their marks
        twin = np.zeros(len(pairs), bool)
        twin[1:] = pairs[1:, 0] == pairs[:-1, 0]
        tables = perfect_hash.build(pairs[~twin, 0])
        at = perfect_hash.lookup(tables, pairs[~twin, 0])
        several = low != high
        marks, held = np.zeros(len(at), np.uint32), np.ones(len(at), np.uint8)
        owners = np.zeros(len(at), np.int64)
        marks[at] = pairs[~twin, 1]
        held[at] = np.where(several, np.minimum(np.maximum(counts, 2), 255), 1)[~twin]
        owners[at] = low[~twin]
        blob = pickle.dumps({"hash": tables, "marks": marks, "counts": held, "owners": owners[held > 1],
                             "twins": {(int(k), int(m)): int(o) for (k, m), o, s in zip(pairs[twin], low[twin], several[twin]) if s}})
        total = int(counts.sum())
        hot = np.nonzero(several & (counts * 64 >= total))[0]
        hottest = [{"key": int(pairs[i, 0].view(np.int64)), "mark": int(pairs[i, 1]), "owner": int(low[i]), "n": int(counts[i])} for i in hot]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "tables": pa.array([blob], pa.binary()), "pairs": [total],
                         "hot": pa.array([hottest], pa.list_(pa.struct([(c, pa.int64()) for c in ("key", "mark", "owner", "n")])))})

    rows = docs.mapInArrow(gather, "shard int, key bigint, mark bigint, low bigint, high bigint, n bigint")
    return written(rows.groupBy("shard").applyInArrow(
        pack, "shard int, tables binary, pairs bigint, hot array<struct<key:bigint,mark:bigint,owner:bigint,n:bigint>>"), "line-index")


def probed(docs: DataFrame, index_: DataFrame, hot: dict, shards: int) -> DataFrame:
    """(doc, key) of the lines to drop, hot keys left out: probes stream past their shard's arrays."""

    def ask(batches):
        for batch in batches:
            found, owners = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("body").to_pylist()):
                mine = distinct_hashes(text)
                if hot and len(mine):
                    mine = mine[[(k, m) not in hot for k, m in mine.tolist()]]
                found.append(mine)
                owners.append(np.full(len(mine), doc, np.int64))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array((pairs[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(pairs[:, 0].view(np.int64)),
                 pa.array(pairs[:, 1].astype(np.int64)), pa.array(np.concatenate(owners))], names=["shard", "key", "mark", "doc"])

    def answer(batches):
        arrays = None
        for batch in batches:
            # a shard's arrays stand before its probes; a batch may hold several shards
            at = 0
            blobs = [i for i, valid in enumerate(batch.column("tables").is_valid().to_pylist()) if valid]
            for stop in [*blobs, batch.num_rows]:
                if stop > at and arrays is not None:
                    yield check(batch.slice(at, stop - at), arrays)
                if stop < batch.num_rows:
                    arrays = pickle.loads(batch.column("tables")[stop].as_py())
                    arrays["rank"] = np.cumsum(arrays["counts"] > 1) - 1
                at = stop + 1

    def check(part, arrays):
        keys, marks, docs_ = (part.column(c).to_numpy() for c in ("key", "mark", "doc"))
        place = perfect_hash.lookup(arrays["hash"], keys.view(np.uint64))
        known = place >= 0
        known[known] = arrays["marks"][place[known]] == marks[known]
        several = known.copy()
        several[known] = arrays["counts"][place[known]] > 1
        drop = several.copy()
        drop[several] = arrays["owners"][arrays["rank"][place[several]]] != docs_[several]
        if arrays["twins"]:
            for i in np.nonzero(~known)[0]:
                owner = arrays["twins"].get((int(keys[i].view(np.uint64)), int(marks[i])))
                drop[i] = owner is not None and owner != docs_[i]
        return pa.RecordBatch.from_arrays([part.column("doc"), part.column("key")], names=["doc", "key"]).filter(pa.array(drop))

    asks = docs.mapInArrow(ask, "shard int, key bigint, mark bigint, doc bigint")
    both = index_.select("shard", "tables", F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("bigint").alias("mark"),
                         F.lit(None).cast("bigint").alias("doc")).unionByName(asks.withColumn("tables", F.lit(None).cast("binary")))
    return (both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("tables").isNull())
            .mapInArrow(answer, "doc bigint, key bigint"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", kept_col: str = "kept_text") -> DataFrame:
    """All rows and columns of ``docs`` plus n_lines, n_dropped and ``kept_text``, the lines that stay.

    A null or empty text is one empty line.  A document is known by its (integer) key: rows that
    repeat a key are one document, rows with a null key one that comes after all others.  A line
    stays in the document with the smallest key, as often as it stands there; short lines stay.
    Very long texts are read whole; an empty table gives an empty result; columns called like the
    new ones are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", kept_col)
    doc, dropped = fresh(docs.columns, "doc", "dropped")
    slim = docs.select(F.coalesce(col(key).cast("long"), F.lit(LAST)).alias("doc"), col(text).alias("body"))
    size = docs.agg(F.sum(F.octet_length(col(text))).alias("n")).first()["n"] or 0
    shards = max(MIN_SHARDS, -(-size // SHARD_BYTES))
    index_ = index(slim, shards)
    pairs = index_.agg(F.sum("pairs").alias("n")).first()["n"] or 0
    hot = {(r["key"] & (1 << 64) - 1, r["mark"]): r["owner"] for r in
           index_.select(F.inline("hot")).filter(F.col("n") * HOT > pairs).collect()}
    lists = written(probed(slim, index_, hot, shards).groupBy(F.col("doc").alias(doc))
                    .agg(F.collect_set("key").alias(dropped)), "line-drops")

    def apply(batches):
        for batch in batches:
            counts, gone, kept = [], [], []
            for owner, value, drops in zip(*(batch.column(c).to_pylist() for c in (doc, text, dropped))):
                lines, keys = (value or "").split("\n"), line_keys(value)
                marked = {x & (1 << 64) - 1 for x in drops or ()}
                stay = [True] * len(lines)
                if marked or hot:
                    long = [i for i, k in enumerate(keys) if k]
                    for i, (k, m) in zip(long, hashes([keys[i] for i in long]).tolist()):
                        stay[i] = k not in marked and hot.get((k, m), owner) == owner
                counts.append(len(lines))
                gone.append(len(lines) - sum(stay))
                kept.append(value or "" if all(stay) else "\n".join(x for x, s in zip(lines, stay) if s))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in docs_columns], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[*docs_columns, "n_lines", "n_dropped", kept_col])

    docs_columns = docs.columns
    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_dropped": F.lit(0).cast("long"), kept_col: F.lit("")}).schema
    return (docs.withColumn(doc, F.coalesce(col(key).cast("long"), F.lit(LAST))).join(lists, doc, "left").mapInArrow(apply, schema))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all ``documents`` without those that a document with a smaller id holds."""
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP2_SQL = f"""WITH lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
  keyed AS (SELECT *, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
  several AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= {LEAST} GROUP BY k HAVING count(DISTINCT doc_id) > 1),
  marked AS (SELECT keyed.*, coalesce(owner <> doc_id, false) AS gone FROM keyed LEFT JOIN several USING (k))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id"""
