"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1.  A letter trigram is bound from its
letters' vectors, rotated by 2, 1 and 0 places and multiplied; a text is the sum (bundle) of
its trigrams' vectors; a language's prototype is the sum over its training texts.  A text gets
the language with the largest cosine.

Trigrams are centred on a letter; everything else counts as one boundary class.  a-z are
classes of their own, other letters share classes by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import col, crc_mod, fresh, read_table

DIM, SEED = 1024, 11
CLASSES, OTHER = 64, 37
#: Code points held in arrays at once, and texts in one matrix.
CHUNK, ROWS = 1 << 20, 256
#: Prototypes are sent to every task: languages learned at most (4 KB each).
MAX_LANGUAGES = 4096
UNKNOWN = "und"


def letter_classes() -> np.ndarray:
    """Class by code point: 0 for what is not a letter; a letter counts as its lower case."""
    table = np.zeros(0x33480, np.uint8)
    for point in range(len(table)):
        char = chr(point)
        if char.isalpha():
            low = ord(char.lower()[0])
            table[point] = low - 96 if 97 <= low <= 122 else 27 + low % OTHER
    return table


def letter_vectors(dim: int, seed: int) -> list[np.ndarray]:
    """The classes' vectors rotated by 2, 1 and 0 places: what a trigram's letters are bound from."""
    base = np.random.default_rng(seed).integers(0, 2, (CLASSES, dim), np.int8) * 2 - 1
    return [np.roll(base, k, axis=1) for k in (2, 1, 0)]


def bound(codes: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """Trigram vectors of the codes, as float32 rows."""
    first, second, third = vectors
    return (first[codes >> 12] * second[codes >> 6 & 63] * third[codes & 63]).astype(np.float32)


def trigrams(texts: list[str | None], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, trigram code) arrays that together hold every trigram; long texts come in pieces
    that overlap by two code points."""
    rows: list[int] = []
    pieces: list[str] = []
    held = 0

    def flush():
        lengths = np.array([len(p) for p in pieces])
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = table[np.minimum(points, len(table) - 1)].astype(np.int32)
        owner = np.repeat(np.array(rows, np.int32), lengths)
        codes = kinds[:-2] << 12 | kinds[1:-1] << 6 | kinds[2:]
        # a window across two pieces has a boundary (first or last code point of a piece) inside
        inside = np.ones(len(points), bool)
        ends = np.cumsum(lengths)
        inside[ends - 1] = inside[ends - 2] = False
        good = inside[:-2] & (kinds[1:-1] > 0)
        return owner[:-2][good], codes[good]

    for row, text in enumerate(texts):
        padded = f"\n{text or ''}\n"
        for start in range(0, len(padded) - 2, CHUNK):
            piece = padded[start:start + CHUNK + 2]
            if held + len(piece) > CHUNK + 2 and pieces:
                yield flush()
                rows, pieces, held = [], [], 0
            rows.append(row)
            pieces.append(piece)
            held += len(piece)
    if pieces:
        yield flush()


def gram_counts(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes that occur, and the texts x codes matrix of their counts (float32)."""
    parts = list(trigrams(texts, table))
    present = np.unique(np.concatenate([np.unique(c) for _, c in parts] or [np.zeros(0, np.int32)]))
    place = np.zeros(CLASSES ** 3, np.int64)
    place[present] = np.arange(len(present))
    total = np.zeros(len(texts) * len(present), np.float32)
    for owner, codes in parts:
        if len(present):
            total += np.bincount(owner.astype(np.int64) * len(present) + place[codes], minlength=len(total))
    return present, total.reshape(len(texts), len(present))


def groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list]]:
    """Slices of a batch: ROWS texts at most, ended early once they hold CHUNK code points."""
    texts = batch.column(column).to_pylist()
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= CHUNK or i + 1 - start >= ROWS:
            yield start, i + 1, texts[start:i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts), texts[start:]


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", dim: int = DIM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototype per non-null language of all rows of ``docs``: the sum of their trigram vectors."""

    def profiles(batches):
        table, vectors, counts = letter_classes(), letter_vectors(dim, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, stop, texts in groups(batch, "text"):
                for owner, codes in trigrams(texts, table):
                    mine = np.array([langs[start + i] for i in range(stop - start)], object)[owner]
                    for name in set(mine):
                        held = counts.setdefault(name, np.zeros(CLASSES ** 3, np.int64))
                        held += np.bincount(codes[mine == name], minlength=CLASSES ** 3)
        for name, held in counts.items():
            present, total = np.nonzero(held)[0], np.zeros(dim)
            for at in range(0, len(present), 4096):
                part = present[at:at + 4096]
                total += held[part].astype(np.float64) @ bound(part, vectors).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total.astype(np.int64).tolist()])],
                                             names=["lang", "profile"])

    rows = (docs.filter(col(lang).isNotNull() & col(text).isNotNull())
            .select(col(lang).cast("string").alias("lang"), col(text).alias("text"))
            .mapInArrow(profiles, "lang string, profile array<bigint>")
            .select("lang", F.posexplode("profile").alias("dim", "value"))
            .groupBy("lang", "dim").agg(F.sum("value").alias("value"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("profile"))
            .select("lang", F.col("profile.value").alias("profile")).limit(MAX_LANGUAGES + 1).collect())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r["lang"]: np.array(r["profile"], np.float64) for r in sorted(rows, key=lambda r: r["lang"])}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", seed: int = SEED,
             lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``lang_pred`` and ``score``, the cosine with that language's
    prototype, 0 where it is negative.

    Texts that are null, empty or without a letter, and all texts if nothing was learned, are
    ``und`` with score 0; of equal cosines the first language in the alphabet wins; very long texts
    are read in pieces; equal rows get equal answers.  Columns called like the new ones are replaced.
    """
    docs = docs.drop(lang_col, score_col)
    names = [k for k, v in prototypes.items() if np.any(v)]
    dim = len(next(iter(prototypes.values()))) if prototypes else DIM
    matrix = np.array([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]).astype(np.float32)

    def predict(batches):
        table, vectors = letter_classes(), letter_vectors(dim, seed)
        for batch in batches:
            found, scores = [], []
            for _, _, texts in groups(batch, text):
                present, counts = gram_counts(texts, table)
                whole = np.zeros((len(texts), dim), np.float32)
                for at in range(0, len(present), 8192):
                    whole += counts[:, at:at + 8192] @ bound(present[at:at + 8192], vectors)
                size = np.linalg.norm(whole, axis=1)
                lettered = counts.any(axis=1) & bool(names)
                cosine = (whole / np.where(size > 0, size, 1)[:, None]) @ matrix.T if names else np.zeros((len(texts), 1))
                best = cosine.argmax(axis=1)
                found += [names[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                scores.append(np.where(lettered, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()),
                 pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, lang_col, score_col])

    schema = docs.withColumns({lang_col: F.lit(""), score_col: F.lit(0.0)}).schema
    return docs.mapInArrow(predict, schema)


def training(docs: DataFrame, folds: int = 5, key: str = "doc_id") -> DataFrame:
    return docs.filter(crc_mod(col(key), folds) != 0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``; learned from the rows outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    prototypes = learn(training(docs))
    return identify(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
