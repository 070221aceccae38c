"""Line dedup, MinHash and embedding near-duplicates, components."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulage.llm import blocks, embeddings, lines, minhash, perfect_hash, registry
from haulage.llm.components import components
from tests.llm.helpers import MIDDLE, SMALL, documents, same_as_sql


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name,sf_dir", [("op2_line_dedup", SMALL), ("op2_line_dedup", MIDDLE), ("op4_embedding_dedup", SMALL)])
def test_queries_match_sql(spark, name, sf_dir):
    same_as_sql(registry.QUERIES[name](spark, sf_dir), registry.ORACLE_SQL[name], sf_dir)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(50)] + [(5, 5), (200, 199)] * 2
    links += [(300, i) for i in range(301, 400)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = roots({x for e in links for x in e}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert out == {k: v for k, v in want.items() if k in linked}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_blocks_let_every_pair_meet_once(spark):
    rows = spark.createDataFrame([("x", i) for i in range(50)] + [("y", 1)], "bucket string, id bigint")
    groups = defaultdict(list)
    for r in blocks.in_blocks(rows, ["bucket"], "id", block=7).collect():
        groups[r["left_block"], r["right_block"]].append((r["own_block"], r["id"]))
    met = defaultdict(int)
    for (left, right), members in groups.items():
        for a in members:
            for b in members:
                if a[1] < b[1] and (a[0] != b[0] or left == right):
                    met[a[1], b[1]] += 1
    assert met == {(a, b): 1 for a in range(50) for b in range(a + 1, 50)}


# lines ---------------------------------------------------------------------------------------

def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    for n in (0, 1, 2, 63, len(keys)):
        tables = perfect_hash.build(keys[:n])
        assert sorted(perfect_hash.lookup(tables, keys[:n])) == list(range(n))
        assert tables["bits"].nbytes * 8 <= 4 * n + 64


def test_lines_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    pool = ["Shared line number %d" % i for i in range(30)] + ["short", "", "   ", "É" * 10, "é" * 9, "\tshared LINE number 3 \x0b"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    docs += [(70, None), (71, ""), (72, "one line\n"), (73, "only in this one\n" * 3), (None, "Shared line number 1\nnobody else has it"),
             (5, "same id again here\nShared line number 2"), (74, "x" * 200_000 + "\nshared line number 4")]
    docs += [(100 + i, "a very common line\nrow %d of many rows" % i) for i in range(100)]
    owner = defaultdict(set)
    order = lambda d: (d is None, d)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    for d, t in docs:
        for x in (t or "").split("\n"):
            owner[key(x)].add(d)
    want = []
    for d, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < 10 or len(owner[key(x)]) < 2 or min(owner[key(x)], key=order) == d]
        want.append((d, len(all_), len(all_) - len(kept), "\n".join(kept)))
    df = documents(spark, docs).withColumn("doc", F.lit(1)).withColumn("dropped", F.lit("x")).withColumn("n_lines", F.lit("old"))
    for hot in (lines.HOT, 1 << 40, 2):  # whether common lines are sent to the tasks or not, the answer is one
        monkeypatch.setattr(lines, "HOT", hot)
        out = lines.dedup_lines(df)
        assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert {"doc", "dropped", "lang"} <= set(out.columns)
    assert lines.dedup_lines(df.limit(0)).collect() == []


# MinHash -------------------------------------------------------------------------------------

def shingles(text, size):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar(docs, size):
    sets = {d: shingles(t, size) for d, t in docs}
    ids = sorted(sets)
    return sets, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
                  if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def corpus():
    """Groups round a text, chains in which only neighbours are similar, a large group of variants, and
    texts that share a passage."""
    rng = random.Random(7)
    word = lambda: "w%d" % rng.randint(0, 10_000)
    docs, at = [], 0

    def add(words):
        nonlocal at
        docs.append((at, " ".join(words)))
        at += 1

    def varied(base, n):
        out = list(base)
        for _ in range(n):
            out[rng.randrange(len(out))] = word()
        return out

    for _ in range(6):
        base = [word() for _ in range(rng.randint(5, 200))]
        for k in range(8):
            add(varied(base, k // 2))
    chain = [word() for _ in range(120)]
    for _ in range(12):
        chain = varied(chain, 2)
        add(chain)
    base = [word() for _ in range(150)]
    for _ in range(60):
        add(varied(base, 3))
    passage = [word() for _ in range(60)]
    for _ in range(30):
        add(passage + [word() for _ in range(rng.randint(10, 60))])
    return docs


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_matches_brute_force(spark, size):
    docs = corpus()
    sets, links = similar(docs, size)
    want = roots(sets, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, docs), words=size).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[k]) and r["kept"] == (want[k] == k) for k, r in got.items())


def test_minhash_in_small_blocks(spark, monkeypatch):
    docs = corpus()
    sets, links = similar(docs, 4)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "COLUMNS", 100)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, docs), words=4).collect()}
    assert got == roots(sets, links)


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 60)).astype(np.uint64)) for _ in range(20)]
    assert (minhash.common_counts(sets) == [[len(np.intersect1d(x, y)) for y in sets] for x in sets]).all()


def test_minhash_query_on_the_test_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    sets, links = similar(docs, 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.QUERIES["op5_minhash"](spark, SMALL).collect()}
    want = roots(sets, links)
    assert got == {k: (len(sets[k]), want[k]) for k in sets}


def test_minhash_edge_cases(spark):
    docs = [(3, "One two"), (1, "one  TWO\n"), (2, "two one"), (4, None), (5, ""), (6, " \t"), (None, "one two"), (None, "alone here"),
            (9, "É x"), (10, "é x"), (8, "b " * 100_000), (7, "b " * 90_000), (3, "One two")]
    df = documents(spark, docs).withColumn("key", F.lit(1)).withColumn("component_id", F.lit(2))
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, 1, 1, False), (3, 1, 1, False), (1, 1, 1, True), (2, 1, 2, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
                          (None, 1, 1, False), (None, 1, None, True), (9, 1, 9, True), (10, 1, 10, True), (8, 1, 7, False), (7, 1, 7, True)], key=repr)
    assert minhash.near_duplicates(df.limit(0)).collect() == []
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 4, 5, 6, 7, 9, 10]


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(0)
    factors, offsets = minhash.permutations(1, 64)
    common = rng.integers(0, 1 << 64, 8000, np.uint64)
    a, b = common[:6000], common[2000:]
    signed = [minhash.min_max(x, factors, offsets) for x in (a, b)]
    assert len(signed[0]) == 128 and abs((signed[0] == signed[1]).mean() - 0.5) < 0.15


# embeddings ----------------------------------------------------------------------------------

def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)]
    for g in range(6):  # tight groups, copies and a chain of small turns
        base = rng.standard_normal(16)
        rows += [(1000 + 40 * g + k, (base + 0.07 * rng.standard_normal(16)).tolist()) for k in range(30)]
        rows += [(2000 + 5 * g + k, base.tolist()) for k in range(5)]
    turn = rng.standard_normal(16)
    for k in range(20):
        turn = turn + 0.2 * rng.standard_normal(16)
        rows.append((3000 + k, turn.tolist()))
    bad = [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [float("nan")] * 16), (4004, [1.0, None]), (4005, [float("inf")] * 16),
           (4006, [1.0, 0.0]), (4007, [2.0, 0.0]), (None, [1.0, 0.0]), (4008, [-0.0, 1.0]), (4009, [0.0, 1.0])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows + bad], "vec_id bigint, embedding array<float>, unit int, n_links string")
    got = embeddings.near_duplicates(df)
    assert got.columns == ["vec_id", "embedding", "unit", "n_links", "component_id", "kept"]
    got = {r["vec_id"]: r for r in got.collect()}
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    ids = [k for k, _ in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near)))] + [(4006, 4007), (4008, 4009)]
    want = roots(ids + [k for k, _ in bad if k is not None], links)
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    assert {k: r["component_id"] for k, r in got.items() if k is not None} == want
    assert {k: r["n_links"] for k, r in got.items()} == {**{k: count[k] for k in want}, None: 0}
    assert got[None]["kept"] and embeddings.near_duplicates(df.limit(0)).collect() == []


def test_embeddings_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks.in_blocks, "__defaults__", (8,))
    base = np.random.default_rng(1).standard_normal((3, 8))
    rows = [(i, (base[i % 3] + 0.01 * np.random.default_rng(i).standard_normal(8)).tolist()) for i in range(120)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert all(r["n_links"] == 39 and r["component_id"] == r["vec_id"] % 3 for r in got)


def test_tables_reach_the_recall():
    for n in (100, 50_000, 10**9):
        planes, tables = embeddings.tables_for(n)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** planes) ** tables <= embeddings.MISS


def test_kept_lines_hash(spark):
    r = registry.QUERIES["op2_line_dedup"](spark, SMALL).first()
    assert len(r["kept_sha256"]) == len(hashlib.sha256().hexdigest())
