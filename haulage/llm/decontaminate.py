"""Benchmark decontamination with a distributed positional inverted index (native).

Test texts are cut into windows of consecutive words.  The corpus frequency of their terms comes
from one pass over all documents; of every window the RAREST terms are its anchors.  The index
stores the postings (term, document, position) of the anchor terms.  A window's posting lists,
each shifted by its term's offset, are intersected from the rarest on: a start on which all
anchors agree is a candidate, and the words of the document at that place decide.  With a
tolerance instead of equal starts the same lists give proximity matches.

Windows, frequencies and anchors are as large as the benchmark; Spark broadcasts them only below
its threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from haulage.llm.common import LOWER, UPPER, ascii_lower, col, fresh, read_table, written

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Anchors of a window (fewer if it has fewer words).
RAREST = 3
#: Words that a proximity match may have between or beside its anchors.
SLOP = 4
#: What stands between words, A-Z being lower case (fixed values).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text in order; none if it is null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def windows_of(items: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Distinct windows: win (a hash of the words), words, items (their keys as strings)."""
    item = items.select(col(key).cast("string").alias("item"), words_of(col(text)).alias("words")).filter("item IS NOT NULL")
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))))
    cut = (item.filter(F.size("words") > 0).select("item", "words", start.alias("at"))
           .select("item", F.slice("words", F.col("at") + 1, F.least(F.size("words"), F.lit(size))).alias("words")))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("win", F.xxhash64("words"))


def anchors_of(windows: DataFrame, docs: DataFrame, rarest: int) -> DataFrame:
    """(term, win, offset, rank): the rarest terms of each window by their count in ``docs`` (words).
    A window with a term that no document has cannot occur and has no anchors."""
    terms = windows.select("win", F.posexplode("words").alias("offset", "term"))
    # a written vocabulary: Spark knows its size, and can split a term that is very frequent
    vocabulary = written(terms.select("term").distinct(), "decon-terms")
    counts = (docs.select(F.explode("words").alias("term")).join(vocabulary, "term")
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy("win").orderBy("n", "offset")
    ranked = (terms.join(written(counts, "decon-counts"), "term", "left")
              .withColumns({"rank": F.row_number().over(order), "missing": F.max(F.col("n").isNull()).over(Window.partitionBy("win"))}))
    return ranked.filter((F.col("rank") <= rarest) & ~F.col("missing")).select("term", "win", "offset", "rank")


def postings(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """The index: (term, row, pos) of the anchor terms in all documents, written."""
    rare = written(anchors.select("term").distinct(), "decon-rare")
    found = docs.select("row", F.posexplode("words").alias("pos", "term")).join(rare, "term")
    return written(found.select("term", "row", "pos"), "decon-postings")


def aligned(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Postings as (row, win, start, rank): where the window would start."""
    return (index.join(anchors, "term").select("row", "win", (F.col("pos") - F.col("offset")).alias("start"), "rank"))


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(row, win, start) on which all anchors of the window agree."""
    wanted = anchors.groupBy("win").agg(F.count(F.lit(1)).alias("n"))
    agreed = (aligned(index, anchors).filter("start >= 0").groupBy("row", "win", "start")
              .agg(F.bit_or(F.expr("shiftleft(1, rank - 1)")).alias("ranks")))
    return (agreed.join(wanted, "win").filter(F.bit_count("ranks") == F.col("n")).select("row", "win", "start"))


def nearby(index: DataFrame, anchors: DataFrame, slop: int = SLOP) -> DataFrame:
    """Proximity matches (row, win, start): all anchors of the window, in any order, with starts at most
    ``slop`` words apart; ``start`` is the smallest of them."""
    wanted = anchors.groupBy("win").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("row", "win").orderBy("start").rangeBetween(0, slop)
    seen = aligned(index, anchors).distinct().withColumn(
        "ranks", F.bit_or(F.expr("shiftleft(1, rank - 1)")).over(ahead))
    return (seen.join(wanted, "win").filter(F.bit_count("ranks") == F.col("n")).select("row", "win", "start").distinct())


def _prepared(docs: DataFrame, items: DataFrame, window: int, rarest: int, key: str, text: str, item_key: str, item_text: str):
    """(documents with row and words, windows, anchors, index)."""
    # a document is told by its key and text, so rows that repeat a key are kept apart
    worded = docs.select(F.xxhash64(col(key), col(text)).alias("row"), words_of(col(text)).alias("words"))
    windows = written(windows_of(items, window, item_key, item_text), "decon-windows")
    anchors = written(anchors_of(windows, worded, rarest), "decon-anchors")
    return worded, windows, anchors, postings(worded, anchors)


def near_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW, rarest: int = RAREST, key: str = "doc_id",
                 text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc key, item, start) of all proximity matches; ``start`` in words from 0, below 0 where the window
    would begin before the text."""
    _, windows, anchors, index = _prepared(docs, items, window, rarest, key, text, item_key, item_text)
    found = written(nearby(index, anchors, slop).join(windows.select("win", F.explode("items").alias("item")), "win"), "decon-near")
    keyed = docs.select(F.xxhash64(col(key), col(text)).alias("row"), col(key).alias(key)).distinct()
    return found.join(keyed, "row").select(key, "item", "start").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, n_hit (words inside any occurrence of a window),
    ``items`` (sorted strings: the items with an occurring window), ``spans`` (start, length) and
    contaminated.

    Null and empty texts have no words and no hits; very long texts are searched whole; rows that
    repeat are all answered; items with a null key are left out, repeated items count once.  Empty
    tables give no rows or no hits.  Columns called like the new ones are replaced.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    row, words, found, hits = fresh([*docs.columns, "n_words", "n_hit", "items", "spans", "contaminated"], "row", "words", "found", "hits")
    _, windows, anchors, index = _prepared(docs, items, window, rarest, key, text, item_key, item_text)
    places = written(candidates(index, anchors).join(windows, "win").groupBy(F.col("row").alias(row))
                     .agg(F.collect_list(F.struct("start", F.col("words"), "items")).alias(found)), "decon-candidates")
    joined = (docs.withColumn(row, F.xxhash64(col(key), col(text))).join(places, row, "left")
              .withColumn(words, words_of(col(text))))
    nothing = "array<struct<start:int,words:array<string>,items:array<string>>>"
    true_ = F.filter(F.coalesce(col(found), F.array().cast(nothing)),
                     lambda c: F.slice(col(words), c["start"] + 1, F.size(c["words"])) == c["words"])
    marked = joined.withColumns({"n_words": F.size(col(words)).cast("long"), hits: true_})
    spans = F.array_sort(F.array_distinct(F.transform(col(hits), lambda c: F.struct(c["start"].alias("start"), F.size(c["words"]).alias("length")))))
    within = F.array_distinct(F.flatten(F.transform(col(hits), lambda c: F.sequence(c["start"], c["start"] + F.size(c["words"]) - 1))))
    return marked.select(
        *[col(c) for c in docs.columns], "n_words", F.size(within).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(col(hits), lambda c: c["items"])))).alias("items"),
        spans.alias("spans"), (F.size(col(hits)) > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`contamination` of all ``documents`` by all of ``benchmark``."""
    out = contamination(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


_WORDS = (f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), "
          f"'{GAP}'), lambda w: w <> '')")
OP3_SQL = f"""WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
  win AS (SELECT DISTINCT item, n, array_to_string(w[st + 1:st + n], ' ') AS s FROM
    (SELECT item, w, least(len(w), {WINDOW}) AS n, unnest(range(greatest(len(w) - {WINDOW}, 0) + 1)) AS st FROM item WHERE len(w) > 0)),
  doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  cut AS (SELECT doc_id, n, st, array_to_string(w[st + 1:st + n], ' ') AS s FROM
    (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS st FROM doc JOIN (SELECT DISTINCT n FROM win) ON len(w) >= n)),
  hit AS (SELECT doc_id, item, n, st FROM cut JOIN win USING (n, s)),
  pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(st, st + n)) AS p FROM
    (SELECT DISTINCT doc_id, n, st FROM hit)) GROUP BY doc_id),
  its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM
    (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(list, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
