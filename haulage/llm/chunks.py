"""Texts in chunks of bounded size, and questions of chunks to shards of the corpus.

A chunk is one row of a written table: some megabytes of texts, compressed, with the other columns of
their rows.  What belongs to a chunk is fixed by the table, so a lost task repeats with the same chunk.

Where a text needs to know something about all texts (does this key stand elsewhere?), its chunk asks:
it sends the distinct keys of all its texts, sorted, to the shards (ranges of keys), one message per
shard that has any.  The task of a shard answers every message in the order of its keys, and the
chunk, which derives the same keys again from its texts, reads the answers off.  A key that a third of
all rows hold reaches its shard once per chunk.  Messages never outnumber the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import col
from haulage.session import scratch_path

#: Bytes of text in a chunk (a longer text is a chunk alone).
CHUNK_BYTES = 8 << 20
#: Chunks in a file, so that a reader's batch stays small.
FILE_CHUNKS = 16
#: Bytes of text for one shard.
SHARD_BYTES = 32 << 20


def pack(texts: list[bytes | None]) -> bytes:
    lengths = np.array([len(texts), *[-1 if t is None else len(t) for t in texts]], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(lengths.tobytes() + b"".join(t or b"" for t in texts))


def texts_of(packed: bytes) -> list[bytes | None]:
    """The texts of a chunk as UTF-8, None where the text is null."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    out, at = [], 8 * (count + 1)
    for n in np.frombuffer(raw, np.int64, count, 8).tolist():
        out.append(None if n < 0 else raw[at:at + n])
        at += max(n, 0)
    return out


def chunked(docs: DataFrame, text: str, label: str, pack: Callable = pack, chunk_bytes: int | None = None) -> DataFrame:
    """Written (chunk, texts, rows): ``rows`` has the columns of ``docs`` other than ``text``, in the order
    of the texts, and ``texts`` what ``pack`` makes of those (UTF-8, None where null).  An empty table has
    no chunks.  A chunk has about ``chunk_bytes`` of text."""
    others, most = [c for c in docs.columns if c != text], chunk_bytes or CHUNK_BYTES

    def cut(batches):
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, start, size = batch.column("body").to_pylist(), 0, 0
            for i, value in enumerate(texts):
                size += len(value or b"")
                if size >= most or i + 1 == len(texts):
                    rows = batch.column("rest").slice(start, i + 1 - start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk], pa.int64()), pa.array([pack(texts[start:i + 1])], pa.binary()),
                         pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)], names=["chunk", "texts", "rows"])
                    chunk, start, size = chunk + 1, i + 1, 0

    # a struct needs a field: the flag stands there when the text is the only column
    rest = F.struct(*[col(c) for c in others]) if others else F.struct(F.lit(True).alias("row"))
    slim = docs.select(col(text).cast("binary").alias("body"), rest.alias("rest"))
    schema = slim.select(F.lit(0).cast("long").alias("chunk"), F.col("body").alias("texts"), F.array("rest").alias("rows")).schema
    path = scratch_path(docs.sparkSession, label)
    slim.mapInArrow(cut, schema).write.option("maxRecordsPerFile", FILE_CHUNKS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def shards_for(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(col(text))).alias("n")).first()["n"] or 0
    return max(1, -(-size // SHARD_BYTES))


def messages(keys: np.ndarray, shards: int, bits: int = 64) -> Iterable[tuple[int, slice]]:
    """(shard, where its keys stand) of sorted distinct ``keys`` below 2^bits; a shard is a range of keys."""
    width = min(((1 << bits) - 1) // shards + 1, (1 << 64) - 1)
    shard = (keys // np.uint64(width)).astype(np.int64)
    cuts = [0, *(np.nonzero(np.diff(shard))[0] + 1).tolist(), len(keys)]
    return [(int(shard[a]), slice(a, b)) for a, b in zip(cuts, cuts[1:]) if b > a]


def answered(chunks: DataFrame, replies: DataFrame | None, ask: Callable, reply: Callable, read: Callable = texts_of) -> DataFrame:
    """(chunk, shard, reply): ``ask(texts, earlier)`` yields (shard, message) of a chunk, given its earlier
    ``replies``; ``reply(messages)`` gives a shard's answers, one per message.  ``read`` undoes ``pack``."""
    names = ["chunk", "shard", "ask"]

    def rows_of(chunk, texts, earlier):
        found = list(ask(read(texts), earlier))
        return [pa.array([chunk] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()),
                pa.array([m for _, m in found], pa.binary())]

    def first(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays(rows_of(batch.column("chunk")[i].as_py(), batch.column("texts")[i].as_py(), []), names=names)

    def later(left, right):
        # replies go to chunks that asked: there is always one chunk here
        return pa.Table.from_arrays(rows_of(left.column("chunk")[0].as_py(), left.column("texts")[0].as_py(), in_order(right)), names=names)

    def answer(table):
        out = reply([x.as_py() for x in table.column("ask")])
        return pa.Table.from_arrays([table.column("chunk"), table.column("shard"), pa.array(out, pa.binary())], names=["chunk", "shard", "reply"])

    slim, schema = chunks.select("chunk", "texts"), "chunk bigint, shard int, ask binary"
    asked = slim.mapInArrow(first, schema) if replies is None else \
        slim.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(later, schema)
    return asked.groupBy("shard").applyInArrow(answer, "chunk bigint, shard int, reply binary")


def in_order(table: pa.Table) -> list[tuple[int, bytes]]:
    """(round, reply) of a chunk's replies, by round and shard."""
    rounds = table.column("round").to_pylist()
    rows = sorted(zip(rounds, table.column("shard").to_pylist(), table.column("reply").to_pylist()), key=lambda r: r[:2])
    return [(r, b) for r, _, b in rows]


def finished(chunks: DataFrame, replies: DataFrame, texts_to_columns: Callable, added: list[tuple[str, str]],
             read: Callable = texts_of) -> DataFrame:
    """The rows of all chunks without their texts, with the columns ``added`` (name, type) that
    ``texts_to_columns(texts, replies)`` gives as arrays."""
    kept = [f.name for f in chunks.schema["rows"].dataType.elementType.fields]
    sample = chunks.select(F.inline("rows")).select(*[col(c) for c in kept], *[F.lit(None).cast(t).alias(n) for n, t in added])
    schema = sample.schema

    def finish(left, right):
        rows = left.column("rows").combine_chunks()[0].values
        new = texts_to_columns(read(left.column("texts")[0].as_py()), in_order(right))
        return pa.Table.from_arrays([*rows.flatten(), *new], names=[*kept, *[n for n, _ in added]])

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)
