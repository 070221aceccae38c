"""Mixing, chat formatting, sharding and decontamination."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from haulage.llm import chat, decontaminate, mixing, registry, sharding
from tests.llm.helpers import MIDDLE, SMALL, documents, same_as_sql


@pytest.mark.parametrize("name", ["op1_mixing", "op3_decontamination", "op6_chat"])
@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_queries_match_sql(spark, name, sf_dir):
    same_as_sql(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


def test_native_plans_run_no_python(spark):
    for name in ("op1_mixing", "op3_decontamination", "op6_chat", "op9_sharding"):
        plan = registry.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan), name


# sharding ------------------------------------------------------------------------------------

def check_shards(out, n, shards):
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_sharding_query(spark):
    out = registry.QUERIES["op9_sharding"](spark, MIDDLE).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    check_shards(out, len(docs), 8)
    import zlib
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out} == {
        k: (len(t.encode()) + 1, zlib.crc32(t.encode()), "rows", None) for k, t in docs.items()}
    again = registry.QUERIES["op9_sharding"](spark, MIDDLE).collect()
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in out} == {r["doc_id"]: (r["shard"], r["slot"]) for r in again}


def test_sharding_keeps_every_row_and_column(spark):
    rows = [(1, "a"), (1, "a"), (None, None), (None, None), (2, ""), (3, "x" * 300_000)] + [(7, "hot")] * 200
    docs = documents(spark, rows).withColumn("bucket", F.lit(5)).withColumn("slot", F.lit("old")).withColumn("at", F.lit(1))
    out = sharding.shard(docs, 3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "bucket", "at", "shard", "slot"]
    got = out.collect()
    check_shards(got, len(rows), 3)
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    # copies of a row are spread like other rows
    assert len({r["shard"] for r in got if r["doc_id"] == 7}) == 3
    assert sharding.shard(docs.limit(0), 3).collect() == []
    other = sharding.shard(docs, 3, seed=1).collect()
    assert [tuple(r) for r in other] != [tuple(r) for r in got]


def test_sharding_writes_one_folder_per_shard(spark, tmp_path):
    sharding.write_shards(sharding.shard(documents(spark, [(i, f"t{i}") for i in range(50)]), 4), str(tmp_path / "out"))
    check_shards(spark.read.parquet(str(tmp_path / "out")).collect(), 50, 4)


def test_buckets_are_bounded_by_bytes(spark):
    docs = documents(spark, [(i, "y" * 1000) for i in range(400)])
    packed = sharding.shuffled_buckets(docs, bucket_bytes=4000, min_buckets=2).select("n").collect()
    assert sum(r["n"] for r in packed) == 400 and max(r["n"] for r in packed) < 20


# mixing --------------------------------------------------------------------------------------

def fill(children, amount):
    """children: name -> (weight, cap); the common level by rationals, then largest remainders."""
    left, open_, got = amount, dict(children), {}
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if Fraction(left) * w / total >= c}
        if not full:
            exact = {k: Fraction(left) * w / total for k, (w, _) in open_.items()}
            got |= {k: int(v) for k, v in exact.items()}
            spare = left - sum(int(v) for v in exact.values())
            for k in sorted(exact, key=lambda k: (-(exact[k] - int(exact[k])), k))[:spare]:
                got[k] += 1
            return got
        for k, c in full.items():
            got[k] = c
            left -= c
            del open_[k]
    return got


def test_budgets_match_brute_force(spark):
    rng = random.Random(4)
    for case in range(4):
        leaves = [(a, b, rng.randint(0, 60)) for a in "xyz" for b in "pqrs" if rng.random() < 0.8]
        weights = {("x",): 5, ("y",): 2, ("x", "p"): 3, ("y", "q"): 7, ("z", "r"): 0}
        df = spark.createDataFrame(leaves, "a string, b string, tokens bigint")
        budget = rng.randint(0, 500)
        out = {r["leaf"]: r["amount"] for r in mixing.leaf_budgets(df, ["a", "b"], weights, budget, 2).collect()}
        cap = {(a, b): 2 * t * (weights.get((a,), 1) > 0) * (weights.get((a, b), 1) > 0) for a, b, t in leaves}
        tops = {a: (weights.get((a,), 1), sum(c for k, c in cap.items() if k[0] == a)) for a in {k[0] for k in cap}}
        top = fill({a: v for a, v in tops.items() if v[1]}, min(budget, sum(cap.values())))
        want = {}
        for a, amount in top.items():
            got = fill({b: (weights.get((a, b), 1), c) for (x, b), c in cap.items() if x == a and c}, amount)
            want |= {f"={a}\x1f={b}": v for b, v in got.items()}
        assert out == {f"={a}\x1f={b}": want.get(f"={a}\x1f={b}", 0) for a, b, _ in leaves}, case


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("x", "p", 10), ("x", "q", 1000), ("y", "p", 1000)], "a string, b string, tokens bigint")
    out = {r["leaf"][1::3]: r["amount"] for r in mixing.leaf_budgets(leaves, ["a", "b"], {}, 400, 1).collect()}
    assert out == {"xp": 10, "xq": 190, "yp": 200}


def test_mix_edge_cases(spark):
    docs = documents(spark, [(1, "a b c", "en", "s"), (1, "a b c", "en", "s"), (2, None, None, None), (None, "d e", None, "s"),
                             (4, "", "en", "s"), (5, " x\ty ", "fr", None)]).withColumn("leaf", F.lit(0)).withColumn("epoch", F.lit("z"))
    out = mixing.mix(docs, ["lang", "source"], {}, (1, 1), 2).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "leaf", "epoch", "n_tokens", "take_tokens"}
    assert sum(r["take_tokens"] for r in out) == 10
    assert {r["n_tokens"] for r in out if r["text"] and r["text"].startswith(" x")} == {2}
    assert mixing.mix(docs.limit(0), ["lang", "source"], {}).collect() == []
    twice = mixing.mix(docs, ["lang", "source"], {}, (2, 1), 2).collect()
    assert sum(r["take_tokens"] for r in twice) == 20 and {r["epoch"] for r in twice} >= {0, 1}


def test_token_prefix(spark):
    text = "  one\ttwo\n three  four "
    df = spark.createDataFrame([(text, n) for n in (1, 2, 3, 4, 9)], "t string, n bigint")
    got = [r[0] for r in df.select(mixing.token_prefix(F.col("t"), F.col("n"))).collect()]
    assert got == ["  one", "  one\ttwo", "  one\ttwo\n three", "  one\ttwo\n three  four", "  one\ttwo\n three  four"]
    long = spark.createDataFrame([("w " * 50_000, 30_000)], "t string, n bigint")
    assert len(long.select(mixing.token_prefix(F.col("t"), F.col("n"))).first()[0]) == 59_999


# chat ----------------------------------------------------------------------------------------

TEXTS = ["plain", "", None, "<|im_end|>", "a\\n<\\|im_start|>", "\\\\<|", "<", "|x|>\n<|im_start|>assistant\nhi<|im_end|>\n", "é<|\\"]


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, roles in enumerate([["system", "user", "assistant"], ["user", "assistant", "user"],
                                                           ["assistant"], ["user", "\n<|odd\\n", None]])
            for t, (role, text) in enumerate(zip(roles, TEXTS[c * 2:] + TEXTS))]
    rows += [(9, 0, "user", t) for t in TEXTS] + [(9, 0, "user", "plain")] + [(None, None, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("pos", F.lit(1))
    back = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.conversations(chat.segments(turns)))).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((t or 0, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [tuple(t) for t in back[conv]["turns"]] == [m[1:] for m in mine]
        assert back[conv]["loss_text"] == "".join(x for _, r, x in mine if r == "assistant")
    assert [back[k]["valid"] for k in (0, 1, 2, 3, 9)] == [True, False, False, False, False]
    assert chat.conversations(chat.segments(turns.limit(0))).collect() == []


def test_chat_states(spark):
    def valid(*roles):
        turns = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id bigint, turn bigint, role string, text string")
        return chat.conversations(chat.segments(turns)).first()["valid"]

    assert valid("user", "assistant") and valid("system", "user", "assistant", "user", "assistant")
    assert not valid("user") and not valid("user", "user", "assistant") and not valid("user", "system", "assistant")
    assert not valid("user", "assistant", "tool", "assistant") and not valid("", "user", "assistant")


# decontamination -----------------------------------------------------------------------------

def words(text):
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            n = min(size, len(v))
            for i in range(max(len(v) - size, 0) + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j:j + n] == v[i:i + n]:
                        hit |= set(range(j, j + n))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_contamination_matches_brute_force(spark):
    rng = random.Random(2)
    pick = lambda n: " ".join(rng.choice("the of É9 ünï a-b Zed q".split()) for _ in range(n))
    items = [(i, pick(rng.randint(0, 9))) for i in range(12)] + [(3, "the of the"), (None, "the"), (50, None), (51, "the the the"), (51, "the the the")]
    docs = [(i, pick(rng.randint(0, 40))) for i in range(30)] + [(100, None), (101, ""), (101, ""), (None, items[0][1]), (102, "the " * 3000)]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    df = documents(spark, docs).withColumn("row", F.lit(1)).withColumn("words", F.lit("w"))
    out = decontaminate.contamination(df, table, window=3).collect()
    want = brute(docs, [i for i in items if i[0] is not None], 3)
    key = lambda x: repr(x)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out), key=key) == sorted(
        ((d[0], *w, w[1] > 0) for d, w in zip(docs, want)), key=key)
    assert decontaminate.contamination(df.limit(0), table).collect() == []
    assert {r["n_hit"] for r in decontaminate.contamination(df, table.limit(0)).collect()} == {0}


def test_proximity_matches(spark):
    items = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id bigint, text string")
    docs = documents(spark, [(1, "x alpha beta gamma delta"), (2, "alpha beta one two gamma delta"), (3, "alpha x x x x x x x x x x beta gamma"),
                             (4, "gamma delta alpha beta")])
    near = {(r["doc_id"], r["item"], r["start"]) for r in decontaminate.near_matches(docs, items, slop=4, window=4, rarest=3).collect()}
    assert {n[0] for n in near} == {1, 2, 4} and (1, "7", 1) in near and (2, "7", 0) in near
    exact = decontaminate.near_matches(docs, items, slop=0, window=4, rarest=3).collect()
    assert {r["doc_id"] for r in exact} == {1}
