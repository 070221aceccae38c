"""Scoring texts with a trigram model held in Elias-Fano tries.

Training counts every word (by a 63-bit hash) and every trigram of all training documents.  The most
frequent words (at most COUNTED) go to every task, which makes their codes small; any other word is
coded by its hash.  Nothing is left out for being rare.

The model is cut into shards by the *middle* word of a trigram (a, b, c); a middle word with more than
HOT occurrences is cut further by its successor c.  So a shard has all trigrams of its pairs (b, c), and
one message per distinct trigram of a chunk of texts is all that is sent: it carries the trigram's count
in training texts, and is answered with what the chunk needs for its probability.

A shard's trie has three levels of Elias-Fano sequences with monotone pointers: the words c after a
middle word b, the words a before it, and for every context (a, b) its successors, each written as its
rank among the successors of b alone (context-relative, so the numbers are small).  A trigram is found by
successor search of c and a below b, then of c's rank below (a, b).  The levels carry the smoothed masses,
quantised to 16 bits, and are read through one memory map.  Texts that were held out ask as well:
their trigrams need not be there.

Every order is a Dirichlet mixture with the next lower one, down to (c + 0.1) / (N + 0.1 (V + 1)):

    P(c | b)    = (n(b, c) + KAPPA sqrt(n(b)) P(c)) / (n(b) + KAPPA sqrt(n(b)))
    P(c | a, b) = (n(a, b, c) + MU P(c | b)) / (n(a, b) + MU)

It needs counts alone, no numbers of distinct successors, and n(a, b) comes with the answer to the
trigram one word before; that is why a hot middle word can be cut.  Probabilities are rounded down.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import col, crc_mod, read_table, written
from haulage.llm.elias_fano import Sequence, encode
from haulage.session import scratch_path

#: So many words at most, the most frequent, go to every task (hash and count, 16 bytes each).
COUNTED = 1_000_000
#: Training tokens per shard of the model.
SHARD = 1 << 20
#: Occurrences of a middle word per part of its trigrams.
HOT = 1 << 17
#: MU's logarithm is a whole number of steps, so that an unseen context leaves the lower order as it is.
ADDED, KAPPA, MU = 0.1, 4.0, 10 ** 0.6
#: A quantised logarithm: steps of a decimal digit, and the logarithm of code 1 (code 0 is nothing).
STEPS, LOWEST = 1800, -22.0
#: Tokens handled at once.
CHUNK = 1 << 20
CACHE = 1 << 19
END = b""


def hash_of(word: bytes) -> int:
    """63-bit hash of a token; the end has the hash of the empty word."""
    return xxhash.xxh3_64_intdigest(word) >> 1


class Numbers(dict):
    """Value by token, computed once by ``of``; starts afresh when it is large."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: bytes):
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = self.of(word)
        return value


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, then one end."""
    # bytes.lower changes A-Z alone, bytes.split cuts at the ASCII white space
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def numbered(texts: list[str | None], numbers: Numbers, size: int | None = None):
    """(first text, texts, numbers of their tokens, token counts): groups of about ``size`` tokens."""
    start, values, lengths, held = 0, [], [], 0
    for i, text in enumerate(texts):
        words = tokens(text)
        values.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        lengths.append(len(words))
        held += len(words)
        if held >= (size or CHUNK) or i + 1 == len(texts):
            yield start, i + 1 - start, np.concatenate(values), np.array(lengths)
            start, values, lengths, held = i + 1, [], [], 0


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, places = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(places, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def _counted(parts, name: str = "key"):
    """Record batches (key, n) of (key, count) arrays, combined until they are CHUNK long."""
    held, size = [], 0
    for keys, counts in parts:
        held.append((keys, counts))
        size += len(keys)
        if size >= CHUNK:
            held = [_summed(held)]
            size = len(held[0][0])
            if size >= CHUNK // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=[name, "n"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _summed(held)], names=[name, "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """Written (word, n): the hash and count of every token of the texts in ``body``."""

    def count(batches):
        def parts():
            numbers = Numbers(hash_of)
            for batch in batches:
                for _, _, words, _ in numbered(batch.column("body").to_pylist(), numbers):
                    yield np.unique(words, return_counts=True)
        yield from _counted(parts(), "word")

    return written(docs.mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays as one buffer: a header of names, types and places, then the arrays."""
    head, body, at = [], [], 0
    for name, values in arrays.items():
        raw = np.ascontiguousarray(values).tobytes()
        head.append(f"{name} {values.dtype.str} {len(values)} {at}")
        body.append(raw + bytes(-len(raw) % 8))
        at += len(body[-1])
    first = "\n".join(head).encode()
    first += b"\n" + b" " * (-(len(first) + 1) % 8)
    return len(first).to_bytes(8, "little") + first + b"".join(body)


def unpack(buffer: bytes) -> dict[str, np.ndarray]:
    """The arrays as views of a memory map of ``buffer`` (anonymous: no file of one machine)."""
    view = mmap.mmap(-1, len(buffer))
    view.write(buffer)
    skip = int.from_bytes(view[:8], "little")
    arrays = {}
    for line in view[8:8 + skip].decode().split("\n"):
        if line.strip():
            name, kind, count, at = line.split(" ")
            arrays[name] = np.frombuffer(view, np.dtype(kind), int(count), 8 + skip + int(at))
    return arrays


def _part(arrays: dict, prefix: str) -> dict:
    return {k[len(prefix):]: v for k, v in arrays.items() if k.startswith(prefix)}


class Words:
    """The frequent words, by count, and the totals of the training tokens."""

    def __init__(self, arrays: dict):
        self.hashes, self.counts = arrays["words"], arrays["counts"]
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.total, distinct = (int(x) for x in arrays["totals"])
        self.room = np.log10(self.total + ADDED * (distinct + 1))
        #: The word before the end that begins a text.
        self.nothing = len(self.hashes)
        self.end = int(self.codes_of(np.array([hash_of(END)]))[0])

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """Places of tokens, by their hashes, among the frequent words, or the hash coded below 0."""
        distinct, place = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.sorted, distinct), len(self.sorted) - 1)
        return np.where(self.sorted[at] == distinct, self.order[at], -1 - distinct)[place]

    def local(self, columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The distinct codes of the columns, in order, and the place of each among them."""
        below = np.unique(np.concatenate([np.unique(c[c < 0]) for c in columns]))
        there = np.zeros(self.nothing + 1, bool)
        for c in columns:
            there[c[c >= 0]] = True
        place = (np.cumsum(there) + (len(below) - 1)).astype(np.int32)
        out = []
        for c in columns:
            # a code below 0 reads a wrong place first
            at = place[np.maximum(c, 0)]
            rare = np.flatnonzero(c < 0)
            at[rare] = np.searchsorted(below, c[rare])
            out.append(at)
        return np.concatenate([below, np.flatnonzero(there)]), out

    def count_of(self, codes: np.ndarray) -> np.ndarray:
        """Counts of the frequent words among ``codes``, 0 of all others."""
        some = (codes >= 0) & (codes < len(self.counts))
        return np.where(some, self.counts[np.where(some, codes, 0)], 0)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts + ADDED) - self.room


def _code(values: np.ndarray, up: bool = False) -> np.ndarray:
    """Quantised logarithms of masses, rounded down (or up); 0 for no mass."""
    with np.errstate(divide="ignore"):
        scaled = (np.log10(values) - LOWEST) * STEPS
    whole = np.ceil(scaled - 1e-9) if up else np.floor(scaled + 1e-9)
    return np.where(values > 0, np.clip(whole + 1, 1, 65535), 0).astype(np.uint16)


MASSES = 10 ** (np.arange(-1, 65535) / STEPS + LOWEST)
MASSES[0] = 0


def _mass(codes: np.ndarray) -> np.ndarray:
    return MASSES[codes]


#: The mass of an unseen context: the prior's weight alone.
UNSEEN = _code(np.array([MU]), up=True)[0]


def _first_of(values: np.ndarray) -> np.ndarray:
    """Where a sorted column has a new value."""
    return np.flatnonzero(np.diff(values, prepend=values[:1] - 1))


def _pairs(middle: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a sorted row is the first of its pair, and the pair's number."""
    first = np.ones(len(middle), bool)
    first[1:] = (middle[1:] != middle[:-1]) | (after[1:] != after[:-1])
    return first, np.cumsum(first) - 1


def _level(node: np.ndarray, word: np.ndarray, above: int) -> dict:
    """Arrays of a level: numbers below the ``above`` nodes before, sorted by (node, word)."""
    starts = np.searchsorted(node, np.arange(above + 1))
    # a node's words follow the last value of the node before it
    last = np.zeros(above + 1, np.int64)
    filled = starts[1:] > starts[:-1]
    last[1:][filled] = word[starts[1:][filled] - 1] + 1
    ahead = np.cumsum(last)[:-1]
    return {**{f"p_{k}": v for k, v in encode(starts).items()}, **{f"w_{k}": v for k, v in encode(word + ahead[node]).items()}}


def grow(middle: np.ndarray, after: np.ndarray, before: np.ndarray, counts: np.ndarray, totals: np.ndarray, nothing: int) -> dict:
    """Levels of a trie: distinct trigrams as numbers of their words, sorted by (middle, after, before), with
    their counts; ``totals``: occurrences of every middle word, by number; ``nothing``: the number (or -1) of
    the word before the end that begins a text, which is no context."""
    begins = _first_of(middle)
    heads, parent = middle[begins], np.repeat(np.arange(len(begins)), np.diff(begins, append=len(middle)))
    first, pair = _pairs(middle, after)
    found, above = np.bincount(pair, counts), parent[first]
    alpha = KAPPA * np.sqrt(totals[heads])
    share = MU * found / (totals[heads] + alpha)[above]
    rank = pair - np.searchsorted(above, np.arange(len(heads)))[parent]
    real = np.nonzero(before != nothing)[0]
    size = int(before.max()) + 1
    key = parent[real] * size + before[real]
    # ranks stay in order within a context
    by = np.argsort(key, kind="stable")
    key, real = key[by], real[by]
    contexts = key[_first_of(key)]
    context = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
    levels = {"after": _level(above, after[first], len(heads)), "before": _level(contexts // size, contexts % size, len(heads)),
              "gram": _level(context, rank[real], len(contexts))}
    return {"heads": heads, "rest": _code(MU * alpha / (totals[heads] + alpha)), "pair": _code(share), "room": _code(found + MU, up=True),
            "mass": _code(counts[real] + share[pair[real]]), **{f"{n}.{k}": v for n, level in levels.items() for k, v in level.items()}}


class Trie:
    """Questions to the levels of :func:`grow`, read through a memory map."""

    def __init__(self, buffer: bytes):
        self.arrays = unpack(buffer)
        self.levels = {n: (Sequence(_part(self.arrays, f"{n}.p_")), Sequence(_part(self.arrays, f"{n}.w_"))) for n in ("after", "before", "gram")}

    def child(self, level: str, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of ``word`` below each parent node (-1: none), and its rank there; sorted by (parent, word)."""
        pointers, successors = self.levels[level]
        node, rank = np.full(len(parent), -1, np.int64), np.full(len(parent), -1, np.int64)
        some = np.flatnonzero(parent >= 0)
        begins = _first_of(parent[some])
        nodes, runs = parent[some][begins], np.diff(begins, append=len(some))
        first, stop = pointers.read(nodes), pointers.read(nodes + 1)
        # a node's words follow the last value of the node before it
        base = np.where(first > 0, successors.read(np.maximum(first - 1, 0)) + 1, 0) if successors.n else first
        beyond = np.where(stop > 0, successors.read(np.maximum(stop - 1, 0)) + 1, 0) if successors.n else first
        first, stop, base, beyond = (np.repeat(x, runs) for x in (first, stop, base, beyond))
        found = successors.seek(np.minimum(base + word[some], beyond))
        hit = (found >= first) & (found < stop)
        node[some[hit]], rank[some[hit]] = found[hit], (found - first)[hit]
        return node, rank

    def masses(self, middle: np.ndarray, after: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes per trigram, sorted by (middle, after, before): its mass without the part of P(c), the weight
        of that part, and n(b, c) + MU for the next trigram."""
        heads = self.arrays["heads"]
        at = np.minimum(np.searchsorted(heads, middle), len(heads) - 1)
        parent = np.where(heads[at] == middle, at, -1)
        first, pair = _pairs(middle, after)
        node, rank = (x[pair] for x in self.child("after", parent[first], after[first]))
        size = int(before.max()) + 1
        key = parent * size + before
        by = np.argsort(key, kind="stable")
        begins = _first_of(key[by])
        heads = by[begins]
        context = np.repeat(self.child("before", parent[heads], before[heads])[0], np.diff(begins, append=len(by)))
        # asked for only below a known context and pair
        context = np.where(rank[by] >= 0, context, -1)
        gram = np.empty(len(by), np.int64)
        gram[by] = self.child("gram", context, rank[by])[0]
        mass = np.where(node >= 0, self.arrays["pair"][np.maximum(node, 0)], 0)
        if len(self.arrays["mass"]):
            mass = np.where(gram >= 0, self.arrays["mass"][np.maximum(gram, 0)], mass)
        rest = np.where(parent >= 0, self.arrays["rest"][np.maximum(parent, 0)], _code(np.array([MU]))[0])
        room = np.where(node >= 0, self.arrays["room"][np.maximum(node, 0)], UNSEEN)
        return mass.astype(np.uint16), rest.astype(np.uint16), room.astype(np.uint16)


def _blob(*columns: np.ndarray) -> bytes:
    """Columns of one type and length packed byte by byte: the high bytes of small numbers take next to nothing."""
    rows = np.stack(columns)
    planes = rows.view(np.uint8).reshape(*rows.shape, rows.itemsize).transpose(0, 2, 1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unblob(raw: bytes, kind=np.int64, columns: int = 1) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(columns, np.dtype(kind).itemsize, -1)
    out = np.ascontiguousarray(flat.transpose(0, 2, 1)).view(kind).reshape(columns, -1)
    return out if columns > 1 else out[0]


def _distinct(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct row, in order, and the place of every row among them; numbers below ``size``."""
    key, top = columns[0].astype(np.int64), size
    for column in columns[1:]:
        if top * size >= 1 << 63:
            names, key = np.unique(key, return_inverse=True)
            top = len(names)
        key, top = key * size + column, top * size
    # any row stands for its equals, so the sort need not be stable
    by = np.argsort(key)
    new = np.ones(len(by), bool)
    np.not_equal(key[by[1:]], key[by[:-1]], out=new[1:])
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(new) - 1
    return by[new], place


def _asked(found: np.ndarray, lengths: np.ndarray, words: Words) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct trigrams that end at the tokens, as codes (middle, after, before), in order, and each
    token's place among them."""
    starts = np.cumsum(lengths) - lengths
    # a text begins with the end after nothing
    row = np.insert(found, np.repeat(starts, 2), np.tile([words.nothing, words.end], len(lengths)))
    at = np.arange(len(found)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 2
    codes, [local] = words.local([row])
    columns = [local[at - 1], local[at], local[at - 2]]
    first, spot = _distinct(columns, len(codes))
    return [codes[c[first]] for c in columns], spot


def _mixed(codes: np.ndarray) -> np.ndarray:
    mixed = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ mixed >> np.uint64(32)


def _by_shard(columns: list[np.ndarray], words: Words, shards: int):
    """(shard, indexes of its trigrams, in order): by the middle word, a hot one by its successor too."""
    middle, after = columns[:2]
    mixed, parts = _mixed(middle), words.count_of(middle) // HOT
    part = (_mixed(after) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)
    mixed = np.where(parts > 1, _mixed(mixed.view(np.int64) ^ part), mixed)
    shard = (mixed % np.uint64(shards)).astype(np.int64)
    by = np.argsort(shard, kind="stable")
    cuts = np.nonzero(np.diff(shard[by]))[0] + 1
    for rows in np.split(by, cuts) if len(by) else ():
        yield int(shard[rows[0]]), rows


def _answers(columns: list[np.ndarray], counts: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
    """Of every row (a trigram and its count in a chunk): the codes of :meth:`Trie.masses`, by the trie of the rows
    that training texts have, and the occurrences of its middle word (in training texts)."""
    codes, local = words.local(columns)
    first, place = _distinct(local, len(codes))
    n, place = np.bincount(place, counts, len(first)), place.astype(np.int32)
    middle, after, before = (c[first].astype(np.int64) for c in local)
    del local, first
    known = words.count_of(codes)
    totals = np.where(codes >= 0, known, np.bincount(middle, n, len(codes)))
    seen = n > 0
    if seen.any():
        nothing = np.searchsorted(codes, words.nothing)
        trie = Trie(pack(grow(middle[seen], after[seen], before[seen], n[seen], totals, int(nothing))))
        out = trie.masses(middle, after, before)
    else:
        out = tuple(np.full(len(n), x, np.uint16) for x in (0, _code(np.array([MU]))[0], UNSEEN))
    return *(x[place] for x in out), totals[middle][place].astype(np.int64)


def _frequent(words: DataFrame) -> dict[str, np.ndarray]:
    """The most frequent words, at most COUNTED, and the end, by count, with the totals."""
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the least count that at most COUNTED words reach
    reach, lowest = 0, 1
    for row in words.groupBy("n").count().orderBy(F.desc("n")).limit(COUNTED).toLocalIterator():
        reach += row["count"]
        if reach > COUNTED:
            lowest = row["n"] + 1
            break
    end = hash_of(END)
    found = words.filter((F.col("n") >= lowest) | (F.col("word") == end)).toArrow()
    hashes, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("word", "n"))
    if not len(hashes):  # nothing to learn from
        hashes, counts = np.array([end]), np.zeros(1, np.int64)
    by_count = np.lexsort((hashes, -counts))
    return {"words": hashes[by_count], "counts": counts[by_count], "totals": np.array([totals["n"], totals["v"]], np.int64)}


def _scored(docs: DataFrame) -> DataFrame:
    """Scores of the rows (doc, body, train, ask) with ``ask``, learned from those with ``train``."""
    table = _frequent(word_counts(docs.filter("train").select("body")))
    total = int(table["totals"][0])
    shared = docs.sparkSession.sparkContext.broadcast(pack(table))
    shards = max(1, -(-total // SHARD))
    held: list[Words] = []

    def frequent() -> Words:
        # once per task, whose groups share it
        if not held:
            held.append(Words(unpack(shared.value)))
        return held[0]

    def cut(batches):
        words, numbers = frequent(), Numbers(hash_of)
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            train, ask = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("train", "ask"))
            for start, count, found, lengths in numbered(batch.column("body").to_pylist(), numbers):
                own = batch.column("doc").slice(start, count)
                flags = train[start:start + count] | ask[start:start + count] << 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), own),
                     *[pa.array([_blob(x)], pa.binary()) for x in (words.codes_of(found), lengths.astype(np.int64), flags)]],
                    names=["chunk", "doc", "found", "lengths", "flags"])
                chunk += 1

    empty = F.lit(None).cast("binary")
    schema = docs.select(F.lit(0).cast("long").alias("chunk"), F.array("doc").alias("doc"), empty.alias("found"),
                         empty.alias("lengths"), empty.alias("flags")).schema
    chunks = docs.mapInArrow(cut, schema)
    path = scratch_path(docs.sparkSession, "lm-chunks")
    # few chunks a file, so that a reader's batch stays small
    chunks.write.option("maxRecordsPerFile", 16).parquet(path)
    chunks = docs.sparkSession.read.schema(schema).parquet(path)

    def send(batches):
        words = frequent()
        for batch in batches:
            for i in range(batch.num_rows):
                found, lengths, flags = (_unblob(batch.column(c)[i].as_py(), t) for c, t in (("found", np.int64), ("lengths", np.int64), ("flags", np.uint8)))
                columns, spot = _asked(found, lengths, words)
                n = np.bincount(spot, np.repeat(flags & 1, lengths), len(columns[0])).astype(np.int64)
                chunk, ask = batch.column("chunk")[i].as_py(), bool((flags & 2).any())
                for shard, rows in _by_shard(columns, words, shards):
                    grams = [c[rows] for c in columns]
                    # the sorted middle words go as steps
                    grams[0] = np.diff(grams[0], prepend=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int64()), pa.array([chunk], pa.int64()), pa.array([ask]), pa.array([len(rows)], pa.int64()),
                         pa.array([_blob(*grams, n[rows])], pa.binary())],
                        names=["shard", "chunk", "ask", "size", "grams"])

    def answer(asked):
        words = frequent()
        ends = np.cumsum(asked.column("size").to_numpy())
        columns = [np.empty(ends[-1], np.int64) for _ in range(4)]
        for blob, stop in zip(asked.column("grams"), ends):
            rows = _unblob(blob.as_py(), np.int64, 4)
            rows = [np.cumsum(rows[0]), *rows[1:]]
            for column, values in zip(columns, rows):
                column[stop - len(values):stop] = values
        mass, rest, room, totals = _answers(columns[:3], columns[3], words)
        chunk, ask, out = asked.column("chunk").to_pylist(), asked.column("ask").to_pylist(), []
        for i, (start, stop) in enumerate(zip([0, *ends[:-1]], ends)):
            if ask[i]:
                # weights and counts belong to the middle word
                heads = start + _first_of(columns[0][start:stop])
                out.append((chunk[i], asked.column("shard")[0].as_py(), _blob(mass[start:stop], room[start:stop]), _blob(rest[heads]), _blob(totals[heads])))
        return pa.Table.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            names=["chunk", "shard", "codes", "rest", "totals"])

    answered = (chunks.mapInArrow(send, "shard bigint, chunk bigint, ask boolean, size bigint, grams binary")
                .groupBy("shard").applyInArrow(answer, "chunk bigint, shard bigint, codes binary, rest binary, totals binary"))

    def finish(chunk, answers):
        words = frequent()
        got = {row["shard"]: row for row in answers.to_pylist()}
        parts = []
        for i in range(chunk.num_rows):
            found, lengths, flags = (_unblob(chunk.column(c)[i].as_py(), t) for c, t in (("found", np.int64), ("lengths", np.int64), ("flags", np.uint8)))
            keep = np.nonzero(flags & 2)[0]
            text = np.repeat(np.arange(len(lengths)), lengths)
            count, prob = words.count_of(found), np.ones(len(found))
            if len(keep):
                columns, spot = _asked(found, lengths, words)
                codes = np.zeros((3, len(columns[0])), np.uint16)
                rare, occurrences = [], []
                for shard, rows in _by_shard(columns, words, shards):
                    codes[:2, rows] = _unblob(got[shard]["codes"], np.uint16, 2)
                    heads = _first_of(columns[0][rows])
                    codes[2, rows] = np.repeat(_unblob(got[shard]["rest"], np.uint16), np.diff(heads, append=len(rows)))
                    known = columns[0][rows][heads]
                    rare.append(known[known < 0])
                    occurrences.append(_unblob(got[shard]["totals"])[known < 0])
                # a word that is not frequent has its count from the trigram it is the middle of
                rare, occurrences = np.concatenate(rare), np.concatenate(occurrences)
                by, who = np.argsort(rare), np.nonzero(found < 0)[0]
                count[who] = occurrences[by][np.searchsorted(rare[by], found[who])]
                mass, room, rest = codes[:, spot]
                room = np.insert(room[:-1], 0, UNSEEN)
                room[np.cumsum(lengths) - lengths] = UNSEEN
                prob = (_mass(mass) + _mass(rest) * ((count + ADDED) / 10 ** words.room)) / _mass(room)
            sums = [lengths, np.bincount(text, count > 0, len(lengths)).astype(np.int64),
                    np.bincount(text, words.base(count), len(lengths)), np.bincount(text, np.log10(prob), len(lengths))]
            parts.append(pa.Table.from_arrays(
                [chunk.column("doc").combine_chunks()[i].values.take(pa.array(keep)), *[pa.array(x[keep]) for x in sums]],
                names=["doc", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(parts)

    zero = F.lit(0).cast("long")
    schema = docs.select("doc", zero.alias("n_tokens"), zero.alias("n_known"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score")).schema
    out = chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(finish, schema)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def score(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, n_tokens, n_known, train_tokens, base_score and score (log10 of
    the text's probability by the model), learned from all rows of ``training``.

    A null or empty text is one end token; very long texts are read whole; rows that repeat are all
    answered; without training texts every token is unknown and all counts are 0.  An empty table
    gives an empty result; extra columns are left out.
    """
    doc, body = col(key).alias("doc"), col(text).alias("body")
    kind = docs.select(doc).schema["doc"].dataType
    asked = docs.select(doc, body, F.lit(False).alias("train"), F.lit(True).alias("ask"))
    learned = training.select(F.lit(None).cast(kind).alias("doc"), body, F.lit(True).alias("train"), F.lit(False).alias("ask"))
    return _scored(asked.unionByName(learned)).select(
        F.col("doc").alias(key), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; learned from those outside the held-out tenth."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 10) == 0
    # training texts are scored as well: every row is read once for both
    out = _scored(docs.select(F.col("doc_id").alias("doc"), F.col("text").alias("body"), (~held_out).alias("train"), F.lit(True).alias("ask")))
    return out.withColumnRenamed("doc", "doc_id").select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
