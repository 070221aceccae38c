"""Mixing sources to target weights by hierarchical budgeting (native).

A token budget is propagated from the root through the levels of ``path`` (by default
domain, language, source).  Every node's budget is split among its children by weight; a
child never gets more than its subtree can give (``max_epochs`` times its tokens), and what
it cannot take goes to its siblings by weight.  Since a parent's own limit is the sum of its
children's, a shortage reaches an ancestor's siblings only when all siblings are full.

A leaf's share is then cut from its seeded epochs: whole epochs first, and of the last one
the prefix, in the order of md5(seed:epoch:doc_id), that holds the tokens still missing; the
document at the cut gives a prefix of its tokens.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulage.llm.common import SPACE, col, fresh, read_table, written

SEED = 7
DOMAIN_SQL = ("CASE WHEN source = 'src0' THEN 'crawl' "
              "WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') THEN 'books' "
              "WHEN source IS NULL THEN NULL ELSE 'forums' END")
#: Target weights of the production mix; a node that is not listed weighs 1.
WEIGHTS = {
    ("crawl",): 5, ("books",): 3, ("forums",): 2,
    **{(d, lang): w for d in ("crawl", "books", "forums")
       for lang, w in (("en", 4), ("fr", 2), ("de", 2), ("es", 2))},
    ("books", "en", "src1"): 3, ("forums", "en", "src9"): 2, ("forums", "fr", "src10"): 0,
}
BUDGET_SHARE, MAX_EPOCHS = (6, 10), 2


def n_tokens(text: Column) -> Column:
    """Words of a text, cut at white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def token_prefix(text: Column, tokens: Column) -> Column:
    """The shortest prefix of ``text`` with its first ``tokens`` words."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*[^{SPACE}]+"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), tokens.cast("int")), "")


def _node(parts: list[Column]) -> Column:
    """A node's name: its parts behind '=', and '' for a null part."""
    return F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("")) for p in parts])


def _weights(spark: SparkSession, weights: Mapping[tuple, int]) -> DataFrame:
    rows = [("\x1f".join("" if p is None else f"={p}" for p in k), int(w)) for k, w in weights.items()]
    return spark.createDataFrame(rows, T.StructType([T.StructField("node", T.StringType()),
                                                     T.StructField("weight", T.LongType())]))


def _split(nodes: DataFrame) -> DataFrame:
    """Children with parent, node, weight, cap, amount (the parent's) -> node, amount (own).

    Water-filling: in the order of cap / weight the children that reach their cap at the
    common level come first; the rest share what is left by weight, and the tokens lost to
    rounding go to the largest remainders.  All in exact integers.
    """
    by = Window.partitionBy("parent")
    order = by.orderBy(F.col("cap").cast("double") / F.col("weight"), "node")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    big = "decimal(38,0)"
    filled = (nodes.withColumns({"run_cap": F.sum("cap").over(run), "run_w": F.sum("weight").over(run),
                                 "all_w": F.sum("weight").over(by)})
              .withColumn("full", F.col("run_cap").cast(big) * F.col("weight")
                          + F.col("cap").cast(big) * (F.col("all_w") - F.col("run_w"))
                          <= F.col("amount").cast(big) * F.col("weight")))
    left = (filled.withColumns({
        "left": F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0)),
        "left_w": F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)})
        .withColumn("share", F.when(~F.col("full"), F.expr(
            "CAST((CAST(left AS DECIMAL(38,0)) * weight) div left_w AS BIGINT)")))
        .withColumn("rest", F.when(~F.col("full"), F.expr(
            "CAST((CAST(left AS DECIMAL(38,0)) * weight) % left_w AS BIGINT)"))))
    return (left.withColumn("spare", F.col("left") - F.sum("share").over(by))
            .withColumn("rank", F.row_number().over(by.orderBy("full", F.col("rest").desc(), "node")))
            .select("node", F.when(F.col("full"), F.col("cap")).otherwise(
                F.col("share") + F.when(F.col("rank") <= F.col("spare"), 1).otherwise(0)).cast("long").alias("amount")))


def leaf_budgets(leaves: DataFrame, path: list[str], weights: Mapping[tuple, int], budget: int,
                 max_epochs: int) -> DataFrame:
    """leaves: the path columns and ``tokens``.  Adds ``amount``, the tokens to take of each leaf."""
    spark = leaves.sparkSession
    given = _weights(spark, weights)
    leaves = leaves.withColumns({f"node{d}": _node([col(p) for p in path[:d]]) for d in range(1, len(path) + 1)})
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    for d in range(1, len(path) + 1):
        own = given.select(F.col("node").alias(f"node{d}"), F.col("weight").alias(f"w{d}"))
        leaves = (leaves.join(own, f"node{d}", "left")
                  .withColumn(f"w{d}", F.coalesce(f"w{d}", F.lit(1)).cast("long"))
                  .withColumn("cap", F.when(F.col(f"w{d}") > 0, F.col("cap")).otherwise(0).cast("long")))
    leaves = written(leaves, "mix-leaves")
    top = min(budget, leaves.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap")).first()["cap"])
    for d in range(1, len(path) + 1):
        parent = F.col(f"node{d - 1}") if d > 1 else F.lit("")
        nodes = (leaves.filter("cap > 0").groupBy(parent.alias("parent"), F.col(f"node{d}").alias("node"),
                                                 F.col(f"w{d}").alias("weight")).agg(F.sum("cap").alias("cap")))
        amount = _split(nodes.withColumn("amount", F.lit(top).cast("long")) if d == 1 else
                        nodes.join(amount.withColumnRenamed("node", "parent"), "parent"))
    last = f"node{len(path)}"
    return (leaves.join(amount.withColumnRenamed("node", last), last, "left")
            .select(F.col(last).alias("leaf"), "tokens", F.coalesce("amount", F.lit(0)).cast("long").alias("amount")))


def mix(docs: DataFrame, path: list[str], weights: Mapping[tuple, int], budget_share: tuple[int, int] = BUDGET_SHARE,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text",
        epoch_col: str = "epoch", tokens_col: str = "n_tokens", take_col: str = "take_tokens") -> DataFrame:
    """One row per document and epoch in which it is taken: all columns of ``docs`` plus
    ``epoch`` (from 0), ``n_tokens`` and ``take_tokens`` (fewer only at a leaf's cut).

    The budget is ``budget_share`` of all tokens, rounded down.  Nulls in a path column make a
    node of their own (weight 1); null and empty texts have no tokens and come with their place
    in the order; weight 0 takes nothing; a null key sorts as empty text; rows with one key keep
    their number and are ordered by a hash of the text; an empty table gives none.  Input columns called like
    the three new ones are replaced.

    A leaf with any share of all rows is ordered in 256 ranges of the hash, each a task of its
    own; only their sums meet.
    """
    docs = docs.drop(epoch_col, tokens_col, take_col)
    leaf, head, order, tie, start, last, whole, rest = fresh(
        [*docs.columns, epoch_col, tokens_col, take_col],
        "leaf", "head", "order", "tie", "start", "last_epoch", "whole", "rest")
    counted = docs.withColumn(tokens_col, n_tokens(col(text)))
    leaves = written(counted.groupBy(*[col(p) for p in path]).agg(F.sum(col(tokens_col)).alias("tokens")), "mix-tokens")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    budget = total * budget_share[0] // budget_share[1]
    budgets = written(leaf_budgets(leaves, path, weights, budget, max_epochs), "mix-budgets")
    budgets = budgets.select(
        F.col("leaf").alias(leaf), F.expr("amount div greatest(tokens, 1)").cast("long").alias(whole),
        F.expr("amount % greatest(tokens, 1)").cast("long").alias(rest))
    keyed = (counted.withColumn(leaf, _node([col(p) for p in path])).join(budgets, leaf)
             .withColumn(order, F.md5(F.concat_ws(":", F.lit(str(seed)), col(whole).cast("string"),
                                                  F.coalesce(col(key).cast("string"), F.lit(""))).cast("binary")))
             .withColumns({head: F.substring(col(order), 1, 2), tie: F.xxhash64(col(text))}))
    sums = keyed.groupBy(leaf, head).agg(F.sum(col(tokens_col)).alias("t"))
    starts = written(sums.select(leaf, head, F.coalesce(F.sum("t").over(
        Window.partitionBy(leaf).orderBy(head).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start)), "mix-starts")
    inside = (Window.partitionBy(leaf, head).orderBy(order, tie)
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn(last, F.coalesce(F.sum(col(tokens_col)).over(inside), F.lit(0)))
              .join(starts, [leaf, head])
              .withColumn(last, F.greatest(F.lit(0), col(rest) - col(start) - col(last)))
              .withColumn(epoch_col, F.explode(F.sequence(F.lit(0).cast("long"), col(whole))))
              .filter((col(epoch_col) < col(whole)) | (col(last) > 0)))
    taken = F.when(col(epoch_col) < col(whole), col(tokens_col)).otherwise(F.least(col(last), col(tokens_col)))
    return placed.select(*[col(c) for c in docs.columns], col(epoch_col).cast("int").alias(epoch_col),
                         col(tokens_col), taken.cast("long").alias(take_col))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production mix over all of ``documents``; domains come from the source names."""
    docs = read_table(spark, sf_dir, "documents").withColumn("domain", F.expr(DOMAIN_SQL))
    return mix(docs, ["domain", "lang", "source"], WEIGHTS).select(
        "doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens")


def _sql() -> str:
    """The same budgeting and selection in DuckDB SQL, one CTE per tree level."""
    listed = ", ".join("('" + "' || chr(31) || '".join("" if p is None else f"={p}" for p in k) + f"', {w})"
                       for k, w in WEIGHTS.items())
    part = "CASE WHEN {0} IS NULL THEN '' ELSE '=' || {0} END"
    names = ["domain", "lang", "source"]
    node = [" || chr(31) || ".join(part.format(n) for n in names[:d]) for d in (1, 2, 3)]
    ctes = [f"""docs AS (SELECT doc_id, {DOMAIN_SQL} AS domain, lang, source, CAST(coalesce(
        len(regexp_extract_all(text, '[^{SPACE}]+')), 0) AS BIGINT) AS n_tokens FROM documents)""",
            f"given(node, weight) AS (VALUES {listed})",
            f"""named AS (SELECT *, {node[0]} AS node1, {node[1]} AS node2, {node[2]} AS node3 FROM docs)""",
            f"""leaves AS (SELECT l.*, coalesce(a.weight, 1) AS w1, coalesce(b.weight, 1) AS w2,
        coalesce(c.weight, 1) AS w3, CASE WHEN coalesce(a.weight, 1) > 0 AND coalesce(b.weight, 1) > 0
        AND coalesce(c.weight, 1) > 0 THEN tokens * {MAX_EPOCHS} ELSE 0 END AS cap
        FROM (SELECT node1, node2, node3, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM named GROUP BY ALL) l
        LEFT JOIN given a ON a.node = node1 LEFT JOIN given b ON b.node = node2 LEFT JOIN given c ON c.node = node3)""",
            f"""got0 AS (SELECT '' AS node, least(coalesce(sum(cap), 0),
        (SELECT coalesce(sum(tokens), 0) FROM leaves) * {BUDGET_SHARE[0]} // {BUDGET_SHARE[1]})::HUGEINT AS amount FROM leaves)"""]
    for d in (1, 2, 3):
        parent = f"node{d - 1}" if d > 1 else "''"
        ctes += [f"""kids{d} AS (SELECT k.*, g.amount FROM (SELECT {parent} AS parent, node{d} AS node, w{d}::HUGEINT AS w,
        sum(cap)::HUGEINT AS cap FROM leaves WHERE cap > 0 GROUP BY ALL) k JOIN got{d - 1} g ON g.node = k.parent)""",
                 f"""runs{d} AS (SELECT *, sum(cap) OVER o AS run_cap, sum(w) OVER o AS run_w, sum(w) OVER (PARTITION BY parent) AS all_w
        FROM kids{d} WINDOW o AS (PARTITION BY parent ORDER BY cap::DOUBLE / w::DOUBLE, node ROWS UNBOUNDED PRECEDING))""",
                 f"""fill{d} AS (SELECT *, run_cap * w + cap * (all_w - run_w) <= amount * w AS isfull FROM runs{d})""",
                 f"""rest{d} AS (SELECT *, amount - coalesce(sum(cap) FILTER (isfull) OVER p, 0) AS remaining,
        sum(w) FILTER (NOT isfull) OVER p AS w_left FROM fill{d} WINDOW p AS (PARTITION BY parent))""",
                 f"""cut{d} AS (SELECT *, CASE WHEN NOT isfull THEN remaining * w // w_left END AS share,
        CASE WHEN NOT isfull THEN remaining * w % w_left END AS rem FROM rest{d})""",
                 f"""rank{d} AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY isfull, rem DESC, node) AS rk,
        remaining - sum(share) OVER (PARTITION BY parent) AS spare FROM cut{d})""",
                 f"""got{d} AS (SELECT node, CASE WHEN isfull THEN cap ELSE share + CASE WHEN rk <= spare THEN 1 ELSE 0 END END
        AS amount FROM rank{d})"""]
    ctes += ["""leaf AS (SELECT node3, coalesce(amount, 0) // greatest(tokens, 1) AS whole,
        coalesce(amount, 0) % greatest(tokens, 1) AS rest FROM leaves LEFT JOIN got3 ON node = node3)""",
             f"""placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY node3 ORDER BY md5('{SEED}:' || whole || ':' || doc_id)
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM named JOIN leaf USING (node3))""",
             """taken AS (SELECT *, unnest(range(0, whole::BIGINT + 1)) AS epoch FROM placed)"""]
    return "WITH " + ",\n".join(ctes) + """
        SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens,
        CASE WHEN epoch < whole THEN n_tokens ELSE least(rest - before, n_tokens) END::BIGINT AS take_tokens
        FROM taken WHERE epoch < whole OR before < rest"""


OP1_SQL = _sql()
