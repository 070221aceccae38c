"""Spelling variants by permuterm rotations.

Every word is closed by a terminator and rotated in all ways; the rotations are dealt out by their
first code points and sorted.  Two words that differ in one code point have, rotated to end with it,
equal text before it: y T x a and y T x b.  A word that lacks the code point has y T x itself as a
rotation, which sorts before all rotations that begin with it.  So one scan of the sorted rotations
meets every edit: rotations equal up to their last code point are replacements of each other, and the
rotation that ends there is the word without it.

A group holds a word per character at most, and only counts and the best neighbour leave it, never
pairs.  An insertion into a run of equal characters is met once per place of the run; it counts at the
first of them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import LOWER, UPPER, read_table, written

TERMINATOR = "\x00"
#: Shortest word in code points, fewest occurrences, and how many times more frequent a form must be.
LEAST, OCCURRENCES, RATIO = 7, 2, 10
#: One in so many (document, run) loses a code point, by its hash.
LOSES = 31
#: Distinct words that a task holds before it passes their counts on.
HELD = 1 << 19
_LOWER = str.maketrans(UPPER, LOWER)
NEIGHBOURS = "word string, n_near bigint, near_n bigint, near string"


def _close(whole: tuple | None, edits: list[tuple]):
    """Rows (word, neighbours, count of the best, the best) of a group: ``whole`` (count, word) lacks the
    character that each of ``edits`` (count, word, counts as an insertion) has."""
    if not edits or (whole is None and len(edits) == 1):
        return
    rank = lambda m: (-m[0], m[1])
    ranked = sorted(edits, key=rank)
    for edit in edits:
        others = len(edits) - 1
        best = next((m for m in ranked[:2] if m is not edit), None)
        if whole and edit[2]:
            others += 1
            best = min(filter(None, (best, whole)), key=rank)
        if best:
            yield edit[1], others, best[0], best[1]
    insertions = [m for m in ranked if m[2]]
    if whole and insertions:
        yield whole[1], len(insertions), insertions[0][0], insertions[0][1]


def scan(rotations):
    """Rows of NEIGHBOURS from sorted (rotation, count of its word); groups stay open while the rotations
    begin with their text, so no more are open than a rotation is long."""
    open_: list[list] = []  # [text, whole, edits], each text the beginning of the next
    for rotation, n in rotations:
        while open_ and not rotation.startswith(open_[-1][0]):
            group = open_.pop()
            yield from _close(group[1], group[2])
        at = rotation.index(TERMINATOR)
        word = rotation[at + 1:] + rotation[:at]
        if at + 1 < len(rotation):
            text = rotation[:-1]
            if not open_ or open_[-1][0] != text:
                open_.append([text, None, []])
            open_[-1][2].append((n, word, rotation[-2] != rotation[-1]))
        open_.append([rotation, (n, word), []])
    while open_:
        group = open_.pop()
        yield from _close(group[1], group[2])


def neighbours(words: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n_near, near_n, near) of the rows (word, n), whose words are distinct, of ``least`` code points
    or more and free of U+0000: how many others differ by one inserted, deleted or replaced code point,
    and the most frequent of them (ties: the first in code-point order).  Words without any are left out."""

    def read(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column("rotation").to_pylist(), batch.column("n").to_pylist())

        held, kinds = [], (pa.string(), pa.int64(), pa.int64(), pa.string())
        make = lambda: pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in held], t) for k, t in enumerate(kinds)], names=["word", "n_near", "near_n", "near"])
        for row in scan(rows()):
            held.append(row)
            if len(held) >= 10_000:
                yield make()
                held = []
        if held:
            yield make()

    marked = words.select("n", F.concat("word", F.lit(TERMINATOR)).alias("marked"))
    rotated = marked.select("n", F.expr(
        "explode(transform(sequence(1, length(marked)), i -> concat(substring(marked, i), substring(marked, 1, i - 1))))").alias("rotation"))
    # equal beginnings stay together: every text that a scan compares is as long as this or longer
    found = (rotated.repartition(F.substring("rotation", 1, max(1, least))).sortWithinPartitions("rotation")
             .mapInArrow(read, NEIGHBOURS))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the rows (word, form): the last word that following the forms reaches.  Forms must not
    go round.  Every step doubles the length of the way."""
    pointers = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = pointers.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(pointers.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                    F.col("further").isNotNull().alias("moved")), "spelling-roots")
        pointers = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return pointers


def group_variants(words: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the rows (word, n).

    A word's form is its most frequent neighbour (see :func:`neighbours`; ties: the first in code-point
    order) if that is ``ratio`` times as frequent as the word, or more; its root is the word at the end of
    the forms, itself without one.  Rows that repeat a word count together; null words, words of fewer
    than ``least`` code points and words with U+0000 are left out; very long words are rotated like all
    (their rotations grow with the square of their length); an empty table gives an empty result.  Other
    columns than word and n are left out.
    """
    words = written(words.filter(F.length("word") >= least).filter(~F.col("word").contains(TERMINATOR))
                    .groupBy("word").agg(F.sum("n").cast("long").alias("n")), "spelling-words")
    near = words.join(neighbours(words, least), "word", "left")
    good = F.col("near_n") >= F.col("n") * ratio
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near")).alias("form"),
                               F.when(good, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(near.filter("form IS NOT NULL"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, loses: int = LOSES) -> DataFrame:
    """(word, n): maximal runs of A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z lower-cased, of ``least``
    code points or more.  Where ``loses`` divides the crc32 h of <key>:<run>, the run's code point h mod its
    length is left out.  Null texts have no runs; a null key stands as empty text."""
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def count(batches):
        held: dict[str, int] = {}
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for owner, body in zip(batch.column("owner").to_pylist(), batch.column("body").to_pylist()):
                base, mine = zlib.crc32(f"{owner}:".encode()), {}
                for word in run.findall((body or "").translate(_LOWER) if not (body or "").isascii() else (body or "").lower()):
                    mine[word] = mine.get(word, 0) + 1
                for word, n in mine.items():
                    h = zlib.crc32(word.encode(), base)
                    if h % loses == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    slim = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("owner"), F.col(f"`{text}`").alias("body"))
    return slim.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents`` that occur at least twice."""
    return group_variants(word_counts(read_table(spark, sf_dir, "documents")).filter(F.col("n") >= OCCURRENCES))


#: crc32 by its table (256 values from the rule of its polynomial) over the bytes of each distinct
#: (document, run); neighbours by equal text around one left-out code point.
OP11_SQL = f"""WITH RECURSIVE table_ AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
      lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM range(256) r(b))),
  runs AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
  bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= {LEAST}),
  hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) AS h FROM bytes, table_),
  words AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % {LOSES} = 0
        THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
  cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM
    (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
  pairs AS (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT DISTINCT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT DISTINCT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
  best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
  forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form,
      CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
  ways AS (SELECT word, form, 0 AS step, word AS reached FROM forms UNION ALL
    SELECT ways.word, f.form, step + 1, f.word FROM ways JOIN forms f ON ways.form = f.word)
  SELECT word, forms.form, arg_max(reached, step) AS root, n, n_near, form_n FROM forms JOIN ways USING (word)
  GROUP BY word, forms.form, n, n_near, form_n"""
