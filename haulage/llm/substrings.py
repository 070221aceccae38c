"""Exact substring dedup by words, with difference-cover anchors.

A difference cover D of a period v holds, for any two places i and j, a shift s < v with i + s and
j + s both in D modulo v.  Windows of w words stand at cover places only (with v = 21 five places in
21); any two equal runs of ``window`` = w + v - 1 words or more therefore share an anchor at the same
distance from their starts.

1.  Every chunk of texts asks which of its anchors stand anywhere else.
2.  A repeated anchor is extended to all windows of ``window`` words that hold it; the chunk asks which
    of these stand anywhere else, by 96 bits.  Windows without a repeated anchor cannot repeat.
3.  Words of repeated windows go.

No two places are ever paired: a passage of m copies sends m times its windows at most.
"""

from __future__ import annotations

from itertools import combinations, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import chunks
from haulage.llm.common import fresh, read_table, written

WINDOW = 35
#: Word hashes kept by a task.
CACHE = 1 << 19
#: Odd multipliers of the two rolling hashes (any will do), and the bits of an anchor's key.
BASES, KEY_BITS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), 48


def cover(period: int) -> list[int]:
    """A smallest difference cover of ``period`` that holds 0 (by search: for small periods)."""
    for size in range(1, period + 1):
        if size * (size - 1) + 1 < period:
            continue
        for rest in combinations(range(1, period), size - 1):
            places = (0, *rest)
            if len({(a - b) % period for a in places for b in places}) == period:
                return list(places)
    return [0]


def period_for(window: int) -> int:
    """The longest period with a perfect cover (k places for k^2 - k + 1) that leaves anchors of two fifths
    of the window."""
    return max(v for v in (1, 3, 7, 13, 21, 31) if v == 1 or 5 * v <= 3 * window)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class Rolled:
    """Words of some texts one after another, with the hashes of all windows."""

    def __init__(self, texts: list[bytes | None], hashes: Hashes):
        # bytes.split cuts at the ASCII white space
        self.words = [(t or b"").split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.n = int(self.lengths.sum())
        self.values = np.fromiter((hashes[w] for words in self.words for w in words), np.uint64, self.n)
        self.place = np.arange(self.n) - np.repeat(self.starts, self.lengths)
        self.left = np.repeat(self.lengths, self.lengths) - self.place
        self.sums = {}

    def windows(self, at: np.ndarray, width: int, which: int = 0) -> np.ndarray:
        """Hash of the ``width`` words from each place of ``at``."""
        if which not in self.sums:
            base = BASES[which]
            up, down = (np.full(self.n + 1, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            up[:1] = down[:1] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            mixed = self.values ^ self.values >> np.uint64(29) if which else self.values
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * up[:-1], dtype=np.uint64)]), down
        sums, down = self.sums[which]
        value = (sums[at + width] - sums[at]) * down[at]
        value = (value ^ value >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
        return value ^ value >> np.uint64(33)


def distinct(keys: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the first of each distinct key in order, place of every key among them, counts)."""
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    if marks is not None and (~new[1:] & (marks[order[1:]] != marks[order[:-1]])).any():
        order = np.lexsort((marks, keys))
        new[1:] = (keys[order[1:]] != keys[order[:-1]]) | (marks[order[1:]] != marks[order[:-1]])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    return first, place, np.bincount(place, minlength=len(first))


def _bytes(values: np.ndarray, width: int) -> bytes:
    """The low bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64)


def _asked(keys: np.ndarray, marks: np.ndarray | None, shards: int, bits: int):
    """(shard, message) of the distinct keys: their number, keys, marks, and which stand here twice."""
    first, _, counts = distinct(keys, marks)
    for shard, part in chunks.messages(keys[first], shards, bits):
        mine = first[part]
        yield shard, (len(mine).to_bytes(8, "little") + _bytes(keys[mine], bits // 8)
                      + (b"" if marks is None else _bytes(marks[mine], 4)) + np.packbits(counts[part] > 1).tobytes())


def _reply(messages: list[bytes], width: int, marked: bool) -> list[bytes]:
    """Per message, which of its keys stand in another one or twice in their own."""
    keys, marks, twice, sizes = [], [], [], []
    for raw in messages:
        n, at = int.from_bytes(raw[:8], "little"), 8
        keys.append(_values(raw[at:at + width * n], width))
        at += width * n
        if marked:
            marks.append(_values(raw[at:at + 4 * n], 4))
            at += 4 * n
        twice.append(np.unpackbits(np.frombuffer(raw, np.uint8, offset=at), count=n).astype(bool))
        sizes.append(n)
    _, place, counts = distinct(np.concatenate(keys), np.concatenate(marks) if marked else None)
    several = counts > 1
    several[place[np.concatenate(twice)]] = True
    return [np.packbits(x).tobytes() for x in np.split(several[place], np.cumsum(sizes)[:-1])]


def _read_off(keys: np.ndarray, marks: np.ndarray | None, shards: int, bits: int, replies: list[bytes]) -> np.ndarray:
    """For every key whether the shards said that it repeats."""
    first, place, _ = distinct(keys, marks)
    known = [np.unpackbits(np.frombuffer(raw, np.uint8), count=part.stop - part.start)
             for (_, part), raw in zip(chunks.messages(keys[first], shards, bits), replies, strict=True)]
    return np.concatenate([*known, np.zeros(0, np.uint8)]).astype(bool)[place]


def drop_repeated(docs: DataFrame, text: str = "text", window: int = WINDOW, kept_col: str = "kept_text") -> DataFrame:
    """All rows of ``docs`` and all columns but ``text``, with n_words, n_removed and ``kept_text``: the words
    that no repeated window of ``window`` words covers, joined by single spaces.

    Words are runs without ASCII white space and are compared unchanged.  Every row is a document of its
    own, whatever its columns hold, so rows that repeat lose each other's windows.  A null or empty text
    has no words and keeps the empty text; texts shorter than a window lose nothing.  Very long texts are
    read whole, each in one task.  An empty table gives an empty result; columns called like the new ones
    are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", kept_col)
    shards = chunks.shards_for(docs, text)
    table = chunks.chunked(docs, text, "substring-chunks")
    period = period_for(window)
    places, width = np.isin(np.arange(period), cover(period)), window - period + 1
    hashes = Hashes()

    def anchors(texts):
        rolled = Rolled(texts, hashes)
        at = np.nonzero(places[rolled.place % period] & (rolled.left >= width))[0]
        return rolled, at, rolled.windows(at, width) >> np.uint64(64 - KEY_BITS)

    def ask_anchors(texts, _):
        _, _, keys = anchors(texts)
        return _asked(keys, None, shards, KEY_BITS)

    def candidates(texts, replies):
        """Windows that hold a repeated anchor, with their hashes."""
        rolled, at, keys = anchors(texts)
        repeated = np.zeros(rolled.n + 1, np.int64)
        repeated[at[_read_off(keys, None, shards, KEY_BITS, [b for r, b in replies if r == 1])] + 1] = 1
        before = np.cumsum(repeated)
        starts = np.nonzero(rolled.left >= window)[0]
        starts = starts[before[starts + period] > before[starts]]
        return rolled, starts, rolled.windows(starts, window), rolled.windows(starts, window, 1) >> np.uint64(32)

    def ask_windows(texts, replies):
        _, _, keys, marks = candidates(texts, replies)
        return _asked(keys, marks, shards, 64)

    def apply(texts, replies):
        rolled, starts, keys, marks = candidates(texts, replies)
        hit = starts[_read_off(keys, marks, shards, 64, [b for r, b in replies if r == 2])]
        edge = np.zeros(rolled.n + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        stay = np.cumsum(edge)[:-1] == 0
        total = np.concatenate([[0], np.cumsum(~stay)])
        removed = total[rolled.starts + rolled.lengths] - total[rolled.starts]
        kept = [b" ".join(words if not gone else compress(words, stay[start:start + len(words)].tolist()))
                for words, start, gone in zip(rolled.words, rolled.starts.tolist(), removed.tolist())]
        return [pa.array(rolled.lengths), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]

    said = lambda df, n: df.withColumn("round", F.lit(n))
    one = said(written(chunks.answered(table, None, ask_anchors, lambda m: _reply(m, KEY_BITS // 8, False)), "substring-anchors"), 1)
    two = said(written(chunks.answered(table, one, ask_windows, lambda m: _reply(m, 8, True)), "substring-windows"), 2)
    [body] = fresh(docs.columns, "kept_bytes")
    out = chunks.finished(table, one.unionByName(two), apply, [("n_words", "bigint"), ("n_removed", "bigint"), (body, "binary")])
    return out.withColumn(body, F.col(body).cast("string")).withColumnRenamed(body, kept_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by repeated windows of 35 words, over all ``documents``."""
    out = drop_repeated(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = f"""WITH texts AS (SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
  windows AS (SELECT r, i, array_to_string(l[i:i + {WINDOW - 1}], ' ') AS k
    FROM (SELECT r, l, unnest(range(1, len(l) - {WINDOW - 2})) AS i FROM texts)),
  repeated AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
  covered AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS i FROM windows SEMI JOIN repeated USING (k)),
  words AS (SELECT r, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM texts),
  kept AS (SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN covered USING (r, i) GROUP BY r)
  SELECT doc_id, len(l) AS n_words, len(l) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
  FROM texts LEFT JOIN kept USING (r)"""
