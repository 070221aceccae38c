"""Alignment of two tokenizers by interval coalescing.

Tokens of both tokenizers are byte intervals of the same text.  All of them are sorted by start, ends
are accumulated to a running maximum, and a group begins where a start reaches that maximum: there
both tokenizers end a token.  Inside a group every A and B token whose bytes overlap are linked.

A text is cut at single spaces between two characters that are not white space.  No token of either
tokenizer reaches over such a cut (the byte-level pre-tokenizer begins a new word there, and no piece
of the other vocabulary has a space after another character, which is checked when it is loaded), so
both end a token there; each distinct segment of a chunk is encoded and coalesced once.  Chunks hold
the ids of their distinct segments instead of texts, so no text is encoded again.

How often an id pair is linked is known to no chunk: chunks ask the shards of the pairs (see
:mod:`haulage.llm.chunks`), and the highest count of each A id, a table no larger than the
vocabulary, goes to every task.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import chunks
from haulage.llm.common import read_table, written

FOLDER = "/opt/tokenizers"
#: Byte-level BPE (A) and sentence pieces (B).
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pair keys are A id * 2^32 + B id, below 2^56.
PAIR_BITS = 56
#: Bytes of text in a chunk (its distinct segments take much more room while they are encoded).
CHUNK_BYTES = 4 << 20
#: Segments encoded at once.
BATCH = 1024
#: Characters below this are letters, digits or white space alike in all versions of Unicode in use.
PLAIN = "\u0250"
#: The words of byte-level pre-tokenizers (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\S) (?=\S)")
ODD = re.compile(r"\s | \s")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable characters of Latin-1 stand for
    themselves, the other bytes, in order, for the characters from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, with the bytes of every token."""

    def __init__(self, a_file: str, b_file: str, quick: bool | None = None):
        """``quick``: whether A's faster encoder agrees (None: find out)."""
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        # an added token's text stands for itself
        raw = [names.get(i, "") for i in range(max(names) + 1)]
        self.a_bytes = [bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t in raw]
        self.quick = self._quick(a_file, alphabet, quick) if quick is not False else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has a space after another character: texts cannot be cut at spaces")
        byte = [self.b.is_byte(i) and BYTE_PIECE.fullmatch(p) for i, p in enumerate(pieces)]
        self.b_bytes = [bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode() for m, p in zip(byte, pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def _quick(self, a_file: str, alphabet: dict[str, int], known: bool | None):
        """A's encoder by ranks of merged tokens, which is several times faster; None if it may differ.

        It merges the pair whose joined token ranks lowest, A the listed pair.  Where every token encodes
        to itself by the listed merges, the pair before a merge is always the listed one: nothing has
        been merged over the ends of the token yet, so the lower merges inside it went as they go in the
        token alone.  So both agree if that holds and tokens rank as their merges.
        """
        import tiktoken

        with open(a_file, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        whole = {t for t in model["vocab"] if all(c in alphabet for c in t)}
        merged = [a + b for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if (model["type"] != "BPE" or model.get("dropout") or spec.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex")
                or pre.get("add_prefix_space") or len(set(merged)) < len(merged) or whole - set(merged) - set(alphabet)
                or not known and any([x.value for x in self.a.model.tokenize(t)] != [t] for t in merged)):
            return None
        ranked = [*alphabet, *merged]
        self.rank_ids = np.array([model["vocab"][t] for t in ranked], np.int64)
        return tiktoken.Encoding("a", pat_str=WORDS, special_tokens={}, mergeable_ranks={bytes(alphabet[c] for c in t): i for i, t in enumerate(ranked)})

    def encode(self, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ids per segment) of space + segment by A and of the segment by B, which adds the space."""
        sides = [[], []]
        for i in range(0, len(segments), BATCH):
            part = segments[i:i + BATCH]
            # segments of plain letters that keep their space are encoded in one text, which is cut by bytes
            plain = np.array([bool(s) and (s.isascii() or max(s) < PLAIN) and not (s[0].isspace() or s[-1].isspace()) for s in part], bool)
            together = " ".join(compress(part, plain))
            bounds = np.cumsum([len(s.encode()) + 1 for s in compress(part, plain)], dtype=np.int64)
            rest = list(compress(part, ~plain))
            found = []
            for side, width in ((0, self.a_size), (1, self.b_size)):
                if not together:
                    ids = np.zeros(0, np.int64)
                elif side:
                    ids = np.array(self.b.encode(together), np.int64)
                else:
                    ids = self.rank_ids[self.quick.encode_to_numpy(" " + together)] if self.quick else np.array(
                        self.a.encode(" " + together, add_special_tokens=False).ids, np.int64)
                cuts = np.searchsorted(np.cumsum(width[ids]), bounds, "left") + 1
                others = [e.ids for e in self.a.encode_batch_fast([" " + s for s in rest], add_special_tokens=False)] if not side else \
                    self.b.encode(rest, num_threads=1) if rest else []
                found.append((ids, np.diff(cuts, prepend=0), others))
            for side, (ids, sizes, others) in zip(sides, found):
                every = np.empty(len(part), np.int64)
                every[plain], every[~plain] = sizes, list(map(len, others))
                out = np.empty(int(every.sum()), np.int64)
                mine = np.repeat(plain, every)
                out[mine], out[~mine] = ids, list(chain.from_iterable(others))
                side.append((out, every))
        none = np.zeros(0, np.int64)
        return [tuple(np.concatenate([none, *(x[k] for x in side)]) for k in (0, 1)) for side in sides]

    def pack(self, texts: list[bytes | None]) -> bytes:
        """The texts of a chunk as ids: distinct segments, and the segments of every text."""
        table = Places()
        parts = []
        for text in texts:
            found = segments_of(text.decode("utf-8", "replace")) if text else []
            parts.append(np.fromiter(map(table.__getitem__, found), np.int64, len(found)))
        (a, n_a), (b, n_b) = self.encode(list(table))
        whole = [b" " + s.encode() for s in table]
        good = np.ones(len(whole), bool)
        for ids, sizes, names, widths in ((a, n_a, self.a_bytes, self.a_size), (b, n_b, self.b_bytes, self.b_size)):
            stops = np.cumsum(widths[ids])
            total = np.concatenate([[0], stops])[np.cumsum(sizes)]
            joined = b"".join(map(names.__getitem__, ids.tolist()))
            if joined != b"".join(whole) or (total != np.cumsum(list(map(len, whole)))).any():
                cuts = np.concatenate([[0], total]).tolist()
                good &= [joined[i:j] == w for i, j, w in zip(cuts, cuts[1:], whole)]
        # a text whose bytes differ has no tokens, and bad segments none, so that the rest lies gapless
        parts = [p if good[p].all() else p[:0] for p in parts]
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a[~good] = n_b[~good] = 0
        return _pack([a, n_a, b, n_b, np.array([len(p) for p in parts]), np.concatenate([*parts, np.zeros(0, np.int64)])])


class Places(dict):
    """A place by segment, in the order of their first appearance."""

    def __missing__(self, segment: str) -> int:
        self[segment] = place = len(self)
        return place


def _pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of numbers below 2^32, byte by byte: the high bytes of small numbers take next to nothing."""
    planes = [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(x) for x in arrays], np.int64).tobytes() + b"".join(planes))


def _unpack(raw: bytes, count: int) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 8 * count
    for n in np.frombuffer(raw, np.int64, count).tolist():
        planes = np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n)
        out.append(np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64))
        at += 4 * n
    return out


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def segments_of(text: str) -> list[str]:
    """The text cut where no token reaches over; joined by spaces they are the text."""
    return CUT.split(text) if ODD.search(text) else text.split(" ") if not (text[:1].isspace() or text[-1:].isspace()) else CUT.split(text)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray):
    """Groups and links of two sorted, gapless sequences of intervals over the same bytes: (group of each A
    interval, group of each B interval, links as A places, links as B places)."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    breaks = np.ones(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    # the B intervals that overlap an A interval stand next to each other
    first = np.searchsorted(b_end, a_start, "right")
    count = np.searchsorted(b_start, a_end, "left") - first
    return group[:len(a_start)], group[len(a_start):], np.repeat(np.arange(len(a_start)), count), ranges(first, count)


class Aligned:
    """The texts of a chunk, aligned: distinct segments with their tokens, groups and links."""

    def __init__(self, packed: bytes, a_size: np.ndarray, b_size: np.ndarray):
        self.a, self.n_a, self.b, self.n_b, self.lengths, self.flat = _unpack(packed, 6)
        self.count = len(self.n_a)
        a_end, b_end = np.cumsum(a_size[self.a]), np.cumsum(b_size[self.b])
        self.group_a, self.group_b, self.link_a, self.link_b = coalesce(
            a_end - a_size[self.a], a_end, b_end - b_size[self.b], b_end)
        a_seg = np.repeat(np.arange(self.count), self.n_a)
        self.n_groups = np.bincount(a_seg, np.diff(self.group_a, prepend=-1) > 0, self.count).astype(np.int64)
        self.link_seg = a_seg[self.link_a]
        self.n_links = np.bincount(self.link_seg, minlength=self.count)
        # links by id pair
        pairs = self.a[self.link_a] << 32 | self.b[self.link_b]
        self.pairs = sorted_distinct(pairs)
        self.link_pair = np.searchsorted(self.pairs, pairs)

    def per_text(self, per_segment: np.ndarray) -> np.ndarray:
        """Sum over the segments of each text, repeats included."""
        total = np.concatenate([[0], np.cumsum(per_segment[self.flat])])
        stops = np.cumsum(self.lengths)
        return total[stops] - total[stops - self.lengths]

    def document_counts(self) -> np.ndarray:
        """How many of the texts hold each pair of ``pairs``."""
        owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        once = sorted_distinct(owner * self.count + self.flat)
        owner, segment = np.divmod(once, max(self.count, 1))
        first = np.cumsum(self.n_links) - self.n_links
        size = self.n_links[segment]
        held = np.repeat(owner, size) * max(len(self.pairs), 1) + self.link_pair[ranges(first[segment], size)]
        return np.bincount(sorted_distinct(held) % max(len(self.pairs), 1), minlength=len(self.pairs))

    def groups(self) -> list[str]:
        """The groups of each text: a1,a2|b1;a3|b2,b3."""
        cuts = [np.concatenate([np.nonzero(np.diff(g, prepend=-1))[0], [len(g)]]) for g in (self.group_a, self.group_b)]
        stops = np.cumsum(self.n_groups)
        named: list[str] = []
        for i in range(0, self.count, 16 * BATCH):  # of some segments at a time
            here = stops[i:i + 16 * BATCH].tolist()
            first, sides = here[0] - int(self.n_groups[i]), []
            for ids, cut in zip((self.a, self.b), cuts):
                cut = cut[first:here[-1] + 1]
                words, cut = list(map(str, ids[cut[0]:cut[-1]].tolist())), (cut - cut[0]).tolist()
                sides.append([words[j] if k == j + 1 else ",".join(words[j:k]) for j, k in zip(cut, cut[1:])])
            both = [f"{a}|{b}" for a, b in zip(*sides)]
            named += [";".join(both[j - n - first:j - first]) for j, n in zip(here, self.n_groups[i:i + 16 * BATCH].tolist())]
        flat, stops = self.flat.tolist(), np.cumsum(self.lengths).tolist()
        return [";".join(map(named.__getitem__, flat[j - n:j])) for j, n in zip(stops, self.lengths.tolist())]


def _asked(pairs: np.ndarray, counts: np.ndarray, shards: int):
    """(shard, message) of the pairs, spread by a bijection of their keys, and how many texts hold them."""
    for shard, part in chunks.messages(_spread(pairs), shards, PAIR_BITS):
        own = np.stack([_spread(pairs)[part].astype(np.int64), counts[part]])
        yield shard, zlib.compress(np.ascontiguousarray(own.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1)).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(2, 8, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.int64).reshape(2, -1)


MULTIPLIER = 0x9E3779B97F4A7D


def _spread(pairs: np.ndarray) -> np.ndarray:
    """A bijection of 56-bit keys: multiplied by an odd number."""
    return pairs.astype(np.uint64) * np.uint64(MULTIPLIER) & np.uint64((1 << PAIR_BITS) - 1)


def _gathered(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(pow(MULTIPLIER, -1, 1 << PAIR_BITS)) & np.uint64((1 << PAIR_BITS) - 1)).astype(np.int64)


def align(docs: DataFrame, text: str = "text", a_file: str = f"{FOLDER}/{A_FILE}", b_file: str = f"{FOLDER}/{B_FILE}",
          groups_col: str = "groups") -> DataFrame:
    """All rows of ``docs`` and all columns but ``text``, with n_a, n_b, n_groups, n_links, n_best, count_sum
    and ``groups``: the alignment as text, ``a1,a2|b1;a3|b2,b3`` (ids of a group, A's then B's).

    A tokenizes space + text and B the text (it adds the space), both without special tokens; the files
    must exist on every executor.  n_best: links whose id pair is held by as many texts as any pair of
    its A id; count_sum: the sum over links of the texts that hold the pair, over all rows of ``docs``.
    Texts that are null, empty, or whose tokens' bytes differ from space + text have no tokens: zeros and
    an empty ``groups``.  Rows that repeat count as texts of their own; very long texts are read whole,
    each in one task; an empty table gives an empty result; columns called like the new ones are replaced.
    """
    spark = docs.sparkSession
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    docs = docs.drop(*sums, groups_col)
    shards = chunks.shards_for(docs, text)
    here = Pair(a_file, b_file)
    quick, sizes = here.quick is not None, (here.a_size, here.b_size)
    del here
    loaded: dict = {}

    def pair():
        if not loaded:
            loaded["pair"] = Pair(a_file, b_file, quick)
        return loaded["pair"]

    table = chunks.chunked(docs, text, "alignment-chunks", lambda texts: pair().pack(texts), CHUNK_BYTES)
    # the bytes of each token, for both vocabularies
    widths = spark.sparkContext.broadcast(sizes)

    def read(packed):
        return Aligned(packed, *widths.value)

    def ask(found, _):
        order = np.argsort(_spread(found.pairs))
        return _asked(found.pairs[order], found.document_counts()[order], shards)

    def reply(messages):
        """Counts over all texts; before the first, the pairs' highest count of each A id."""
        parts = [_unpacked(m) for m in messages]
        keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)
        ids, at = np.unique(_gathered(keys) >> 32, return_inverse=True)
        best = np.zeros(len(ids), np.int64)
        np.maximum.at(best, at, total)
        out = [zlib.compress(x.tobytes(), 1) for x in np.split(total[place], np.cumsum([p.shape[1] for p in parts])[:-1])]
        head = zlib.compress(np.stack([ids, best]).tobytes(), 1)
        return [len(x).to_bytes(8, "little") + x + out_ for x, out_ in zip([head] + [b""] * (len(out) - 1), out)]

    replies = written(chunks.answered(table, None, ask, reply, read).withColumn("round", F.lit(1)), "alignment-pairs")

    def highest(batches):
        for batch in batches:
            best: dict[int, int] = {}
            for raw in batch.column("reply").to_pylist():
                n = int.from_bytes(raw[:8], "little")
                if n:
                    for i, c in np.frombuffer(zlib.decompress(raw[8:8 + n]), np.int64).reshape(2, -1).T.tolist():
                        best[i] = max(best.get(i, 0), c)
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array(list(best.values()), pa.int64())], names=["id", "n"])

    # one row per A id: bounded by the vocabulary
    best = replies.select("reply").mapInArrow(highest, "id bigint, n bigint").groupBy("id").agg(F.max("n").alias("n")).toArrow()
    top = np.zeros(max(best.column("id").to_pylist(), default=0) + 1, np.int64)
    top[best.column("id").to_numpy()] = best.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(top)

    def columns(found, said):
        order = np.argsort(_spread(found.pairs))
        counts = np.zeros(len(found.pairs), np.int64)
        counts[order] = np.concatenate([np.frombuffer(zlib.decompress(raw[8 + int.from_bytes(raw[:8], "little"):]), np.int64) for _, raw in said]
                                       + [np.zeros(0, np.int64)])
        link = counts[found.link_pair]
        is_best = link == shared.value[found.a[found.link_a]]
        per_segment = [found.n_a, found.n_b, found.n_groups, found.n_links,
                       np.bincount(found.link_seg, is_best, found.count).astype(np.int64),
                       np.bincount(found.link_seg, link, found.count).astype(np.int64)]
        return [*[pa.array(found.per_text(x), pa.int64()) for x in per_segment], pa.array(found.groups(), pa.string())]

    return chunks.finished(table, replies, columns, [*[(c, "bigint") for c in sums], (groups_col, "string")], read)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the two tokenizers over all ``documents``."""
    out = align(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"))
