"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over the presence of words and word beginnings are trained in numpy from confirmed toxic texts
and unlabelled texts.  With class prior p the risk is
``p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)])`` (l: logistic loss): the middle term estimates
the negative risk, and a step that drives it below zero is reversed.  Several classifiers from
bootstrap samples are averaged.

Training reads a bounded sample (POSITIVES and UNLABELLED texts, whole); the prior and the
sampling rates come from all labels and documents, and all documents are scored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm.common import col, crc_mod, read_table, written

#: Bound of the training sample: expected numbers of texts.
POSITIVES, UNLABELLED = 12_000, 24_000
#: Word hashes kept as features, by the strength of their difference between the two samples.
FEATURES, LEAST_DOCS, LEAST_Z = 4096, 5, 4.0
MODELS, STEPS, RATE, SPARSITY, SEED = 5, 600, 0.1, 5e-5, 5
#: Besides whole words, their first so many letters are features: one beginning per word, since
#: beginnings of each other would count a single word several times.
PREFIXES = (4,)
#: A word: letters only, lower case.
WORD = r"[^\W\d_]+"


def word_hashes(text: str | None, pattern) -> list[int]:
    """Hashes of the distinct words, and word beginnings, of a whole text."""
    words = set(pattern.findall((text or "").lower()))
    starts = {f"^{w[:n]}" for n in PREFIXES for w in words if len(w) > n}
    return [zlib.crc32(w.encode()) for w in words | starts]


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, folds: int, seed: int) -> tuple[DataFrame, float]:
    """Written word hashes of the sampled training texts, marked toxic (confirmed) and unlabelled,
    and the share of toxic among the labelled."""
    judged = (labels.filter((crc_mod(F.col("doc_id"), folds) != 0) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = judged.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    pool = docs.filter(crc_mod(col(key), folds) != 0)
    n_pool = pool.count()

    def keep(share: float, salt: int):
        return F.pmod(F.xxhash64(F.lit(seed + salt), F.col("doc_id")), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))

    confirmed = judged.filter("toxic = 1").select("doc_id").filter(keep(POSITIVES / max(counts["toxic"] or 0, 1), 0))
    slim = pool.select(col(key).alias("doc_id"), col(text).alias("text")).withColumn(
        "unlabelled", keep(UNLABELLED / max(n_pool, 1), 1))
    # POSITIVES ids at most: a bounded broadcast
    marked = (slim.join(F.broadcast(confirmed.withColumn("toxic", F.lit(True))), "doc_id", "left")
              .withColumn("toxic", F.coalesce("toxic", F.lit(False))).filter("unlabelled OR toxic"))

    def hashes(batches):
        pattern = re.compile(WORD)
        for batch in batches:
            found = [sorted(word_hashes(t, pattern)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("unlabelled"), pa.array(found, pa.list_(pa.int64()))],
                                             names=["toxic", "unlabelled", "words"])

    table = written(marked.mapInArrow(hashes, "toxic boolean, unlabelled boolean, words array<bigint>")
                    .dropDuplicates(["toxic", "unlabelled", "words"]), "toxicity-sample")  # copies teach once
    return table, (counts["toxic"] or 0) / max(counts["n"], 1)


def pick_features(sample: DataFrame) -> np.ndarray:
    """Word hashes whose share of texts differs most between the samples (two-proportion z), sorted."""
    sizes = sample.agg(F.count_if("toxic").alias("p"), F.count_if("unlabelled").alias("u")).first()
    n_p, n_u = max(sizes["p"], 1), max(sizes["u"], 1)
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    spread = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u))
    found = (sample.select("toxic", "unlabelled", F.explode("words").alias("word"))
             .groupBy("word").agg(F.count_if("toxic").alias("p"), F.count_if("unlabelled").alias("u"))
             .filter(F.col("p") + F.col("u") >= LEAST_DOCS)
             .withColumn("z", F.when(spread > 0, F.abs(F.col("p") / n_p - F.col("u") / n_u) / spread))
             .filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(FEATURES).collect())
    return np.sort(np.array([r["word"] for r in found], np.int64))


def _rows(sample: DataFrame, features: np.ndarray) -> tuple[tuple, tuple]:
    """(row, feature, rows) of the toxic and of the unlabelled texts, in the order of their features: the
    bootstrap counts rows by place, and the order of a table depends on the run."""

    def known(batches):
        for batch in batches:
            lists = [np.nonzero(np.isin(features, np.array(words, np.int64), assume_unique=True))[0] for words in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("unlabelled"),
                                              pa.array(lists, pa.list_(pa.int64()))], names=["toxic", "unlabelled", "words"])

    table = sample.mapInArrow(known, "toxic boolean, unlabelled boolean, words array<bigint>").toArrow()

    def rows(column):
        chosen = sorted(table.filter(table.column(column))["words"].to_pylist())
        lengths = np.array([len(c) for c in chosen], np.int64)
        return (np.repeat(np.arange(len(chosen)), lengths), np.array([f for c in chosen for f in c], np.int64), len(chosen))

    return rows("toxic"), rows("unlabelled")


def nonnegative_pu(pos: tuple, unl: tuple, n: int, prior: float, rng: np.random.Generator,
                   sparsity: float = SPARSITY) -> np.ndarray:
    """Weights and bias (last) of one linear classifier, averaged over the second half of the steps;
    pos and unl: (row, feature, rows)."""
    weights = np.zeros(n + 1)
    weights[n] = np.log(prior / (1 - prior))
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    # bootstrap: how often each text counts
    share_p, share_u = (rng.multinomial(x[2], np.full(x[2], 1 / x[2])) / x[2] for x in (pos, unl))

    def margin(x):
        return weights[n] + np.bincount(x[0], weights[x[1]], minlength=x[2])

    def slope(x, by_row):
        return np.append(np.bincount(x[1], by_row[x[0]], minlength=n), by_row.sum())

    total = np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        gp, gu = margin(pos), margin(unl)
        negative = share_u @ np.logaddexp(0, gu) - prior * (share_p @ np.logaddexp(0, gp))
        rise_p, rise_u = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        of_negative = slope(unl, share_u * rise_u) - prior * slope(pos, share_p * rise_p)
        grad = of_negative + prior * slope(pos, share_p * (rise_p - 1)) if negative >= 0 else -of_negative
        grad[:n] += sparsity * np.sign(weights[:n])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad ** 2
        weights -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
        if step > STEPS // 2:  # reversed steps keep the weights moving: their mean is the answer
            total += weights
    return total / (STEPS - STEPS // 2)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5,
          prior: float | None = None, seed: int = SEED) -> tuple[dict[int, float], float]:
    """Weight by word hash, and bias, learned from the rows whose crc32(key) mod ``folds`` is not 0.

    Without a confirmed toxic or an unlabelled text nothing is learned: no weights, and a bias that
    scores every text near 0.  ``prior`` defaults to the share of toxic among the labelled.
    """
    sample, share = _sample(docs, labels, key, text, folds, seed)
    features = pick_features(sample)
    pos, unl = _rows(sample, features)
    if not pos[2] or not unl[2]:
        return {}, -10.0
    prior = min(max(share if prior is None else prior, 1e-4), 0.9)
    rng = np.random.default_rng(seed)
    weights = np.mean([nonnegative_pu(pos, unl, len(features), prior, rng) for _ in range(MODELS)], axis=0)
    return dict(zip(features.tolist(), weights[:-1].tolist())), float(weights[-1])


def score(docs: DataFrame, weights: dict[int, float], bias: float, text: str = "text",
          score_col: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` plus ``score``, the probability of being toxic (0 to 1).

    Null and empty texts score by the bias alone; whole texts are read, however long; equal texts
    score alike.  A column called like the new one is replaced.
    """
    docs = docs.drop(score_col)

    def scored(batches):
        pattern = re.compile(WORD)
        for batch in batches:
            margins = np.array([bias + sum(weights.get(h, 0.0) for h in sorted(word_hashes(t, pattern)))
                                for t in batch.column(text).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(margins, -500, 500))))],
                                             names=[*batch.schema.names, score_col])

    return docs.mapInArrow(scored, docs.withColumn(score_col, F.lit(0.0)).schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text of ``documents``, learned outside the held-out fold."""
    docs = read_table(spark, sf_dir, "documents")
    weights, bias = learn(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), weights, bias)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
