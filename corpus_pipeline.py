"""A training-corpus pipeline over ``documents``: five operators, each stage written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulage.llm import decontaminate, langid, minhash, mixing, sharding
from haulage.llm.common import col, fresh, read_table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognisable language (``und``: null texts and texts without
    letters) go."""
    [found, score] = fresh(docs.columns, "lang_pred", "score")
    prototypes = langid.learn(langid.training(docs))
    return (langid.identify(docs, prototypes, lang_col=found, score_col=score)
            .filter(col(found) != langid.UNKNOWN).drop(found, score))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup on shingles of five words, similarity 0.8: of each group the document with
    the smallest id stays."""
    return minhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of ``benchmark`` go."""
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).filter("NOT contaminated").select(
        *[col(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document stands once per epoch in which it is taken; the one at a
    leaf's cut keeps the prefix of its text that holds its tokens."""
    domain, epoch, tokens, take = fresh(docs.columns, "domain", "epoch", "n_tokens", "take_tokens")
    mixed = mixing.mix(docs.withColumn(domain, F.expr(mixing.DOMAIN_SQL)), [domain, "lang", "source"], mixing.WEIGHTS,
                       epoch_col=epoch, tokens_col=tokens, take_col=take)
    text = F.when(col(take) < col(tokens), mixing.token_prefix(F.col("text"), col(take))).otherwise(F.col("text"))
    return (mixed.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
            .select(*[col(c) for c in docs.columns]))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: all rows with their shard (of 8) and slot."""
    return sharding.shard(docs, 8)


STAGES = [("language ID", language_stage), ("MinHash near-dedup", near_duplicate_stage),
          ("benchmark decontamination", decontamination_stage), ("mixing sources", mixing_stage), ("sharding", sharding_stage)]

#: Trained profiles and a seeded shuffle have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
