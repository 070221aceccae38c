"""Language ID, toxicity, the language model and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from haulage.llm import elias_fano, langid, language_model, mixing, registry, toxicity
from tests.llm.helpers import MIDDLE, SMALL, documents
from tests.llm.test_dedup import roots, similar
from tests.llm.test_native import brute, check_shards


def fold(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


# language ID ---------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    out = registry.QUERIES["op8_language_id"](spark, MIDDLE).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_matches_brute_force():
    texts = ["The cat", "", None, "é!ß", "123", "x" * 10]
    table, vectors = langid.letter_classes(), langid.letter_vectors(64, 1)
    present, counts = langid.gram_counts(texts, table)
    whole = counts @ langid.bound(present, vectors)
    base = vectors[2].astype(int)
    for i, text in enumerate(texts):
        kinds = [0, *[int(table[ord(c)]) for c in text or ""], 0]
        want = sum((np.roll(base[a], 2) * np.roll(base[b], 1) * base[c] for a, b, c in zip(kinds, kinds[1:], kinds[2:]) if b), np.zeros(64, int))
        assert (whole[i] == want).all()


def test_long_texts_are_read_in_pieces(monkeypatch):
    table = langid.letter_classes()
    texts = ["ab cd" * 50, "zz", "q" * 33]
    whole = langid.gram_counts(texts, table)
    monkeypatch.setattr(langid, "CHUNK", 16)
    pieces = langid.gram_counts(texts, table)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()


def test_language_edge_cases(spark):
    train = documents(spark, [(1, "der die das und ist", "de", None), (2, "the and is of this", "en", None), (3, None, "fr", None),
                              (4, "the thing", None, None), (5, "42", "xx", None)])
    learned = langid.learn(train)
    assert set(learned) == {"de", "en"}
    docs = documents(spark, [(1, None), (2, ""), (3, "12 ?"), (4, "this and that"), (4, "this and that"), (None, "das ist")]).withColumn("score", F.lit("old"))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, learned).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "en" and out[None][0] == "de"
    assert langid.identify(docs.limit(0), learned).collect() == []
    assert langid.learn(train.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}


# toxicity ------------------------------------------------------------------------------------

def test_toxicity_held_out(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = registry.QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1").collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in labels]
    right = sum(p and t for p, t in held)
    assert right >= 0.85 * sum(t for _, t in held) and right >= 0.85 * sum(p for p, _ in held)


def test_toxicity_does_not_depend_on_the_layout(spark):
    """The same weights to the last bit from other partitions, in another order."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    first = toxicity.learn(docs, labels)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    try:
        again = toxicity.learn(docs.repartition(3, "n_chars"), labels.orderBy("quality", "doc_id"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(first[0]) > 50 and first == again


def test_unlabelled_positives_do_not_hurt():
    """With a third of the unlabelled texts positive, the corrected risk still separates the classes."""
    rng = np.random.default_rng(0)

    def texts(n, positive):
        rows = [np.nonzero(rng.random(6) < ([.8, .8, .5, .5, .1, .1] if p else [.05, .05, .5, .5, .6, .6]))[0] for p in positive]
        return np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate(rows), n

    truth = rng.random(1500) < 1 / 3
    unl = texts(1500, truth)
    pos = texts(500, [True] * 500)
    weights = np.mean([toxicity.nonnegative_pu(pos, unl, 6, 1 / 3, rng) for _ in range(toxicity.MODELS)], axis=0)
    margin = weights[6] + np.bincount(unl[0], weights[unl[1]], 1500)
    # the best rule there is knows the chances of every feature
    p, n = np.array([.8, .8, .5, .5, .1, .1]), np.array([.05, .05, .5, .5, .6, .6])
    best = np.log(1 / 2) + np.log((1 - p) / (1 - n)).sum() + np.bincount(unl[0], np.log(p * (1 - n) / (n * (1 - p)))[unl[1]], 1500)
    assert ((margin > 0) == truth).mean() > ((best > 0) == truth).mean() - 0.05


def test_toxicity_edge_cases(spark):
    docs = documents(spark, [(i, f"bad awful words x{chr(97 + i % 26)}{chr(97 + i // 26)}" if i % 3 == 0 else f"nice day y{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(90)] + [(500, None), (501, ""), (None, "bad"), (1, "nice day")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(0, 90, 2)] + [(None, 1, 1), (3, None, None), (6, 1, 1)],
                                   "doc_id bigint, quality int, toxic int")
    weights, bias = toxicity.learn(docs, labels)
    out = {r["doc_id"]: r for r in toxicity.score(docs.withColumn("toxic", F.lit(9)).withColumn("score", F.lit("x")), weights, bias).collect()}
    assert out[87]["score"] > 0.5 > out[88]["score"] and out[500]["score"] == out[501]["score"] == pytest.approx(1 / (1 + math.exp(-bias)))
    nothing = toxicity.learn(docs, labels.limit(0))
    assert nothing[0] == {} and toxicity.learn(docs.limit(0), labels)[0] == {}
    assert max(r["score"] for r in toxicity.score(docs, *nothing).collect()) < 0.01
    assert toxicity.score(docs.limit(0), weights, bias).collect() == []


# language model ------------------------------------------------------------------------------

def test_elias_fano(monkeypatch):
    rng = np.random.default_rng(0)
    for n, top in ((0, 10), (1, 1), (1, 1000), (10, 10), (1000, 10**6), (1000, 500), (20_000, 10**9), (50, 2**40)):
        values = np.sort(rng.integers(0, top, n))
        coded = elias_fano.Sequence(elias_fano.encode(values))
        assert (coded.access(np.arange(n)) == values).all()
        asked = np.concatenate([values, rng.integers(0, top * 2, 500)])
        at = np.searchsorted(values, asked)
        assert (coded.find(asked) == np.where((at < n) & (np.append(values, -1)[np.minimum(at, n)] == asked), at, -1)).all()
    arrays = elias_fano.encode(np.unique(rng.integers(0, 10**9, 100_000)))
    assert sum(a.nbytes for a in arrays.values()) < 2.6 * 100_000


class Reference:
    """The same model with dictionaries and without quantisation."""

    def __init__(self, texts):
        lists = [language_model.tokens(t) for t in texts]
        self.count = Counter(w for x in lists for w in x)
        self.n = sum(self.count.values())
        self.room = self.n + 0.1 * (len(self.count) + 1)
        self.pairs = Counter(g for x in lists for g in zip([b"", *x], x))
        self.grams = Counter(g for x in lists for g in zip([b"", *x], x, x[1:]))

    def base(self, w):
        return (self.count[w] + 0.1) / self.room

    def second(self, b, c):
        weight = 4 * math.sqrt(self.count[b])
        return (self.pairs[b, c] + weight * self.base(c)) / (self.count[b] + weight) if self.count[b] else self.base(c)

    def prob(self, a, b, c):
        return (self.grams[a, b, c] + language_model.MU * self.second(b, c)) / (self.pairs[a, b] + language_model.MU)

    def score(self, text):
        x = language_model.tokens(text)
        return math.log10(self.second(b"", x[0])) + sum(math.log10(self.prob(*g)) for g in zip([b"", *x], x, x[1:]))


def close_to(exact, text, score):
    # each token's probability is rounded down, in its mass, its prior's weight and its context
    return exact - 3 * len(language_model.tokens(text)) / language_model.STEPS - 1e-6 <= score <= exact + 1e-6


def check_model(spark, docs, train):
    ref = Reference([t for _, t in train])
    out = language_model.score(documents(spark, docs).withColumn("n", F.lit(1)), documents(spark, train)).collect()
    assert len(out) == len(docs)
    for r, (key, text) in zip(sorted(out, key=lambda r: repr(r["doc_id"])), sorted(docs, key=lambda d: repr(d[0]))):
        words = language_model.tokens(text)
        assert (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (key, len(words), sum(ref.count[w] > 0 for w in words), ref.n)
        assert r["base_score"] == pytest.approx(sum(math.log10(ref.base(w)) for w in words), abs=1e-7)
        assert close_to(ref.score(text), text, r["score"])
    return ref


def sentences(n, seed):
    rng = random.Random(seed)
    pool = ["a", "b", "C", "the", "Of", "é", "cat"] + ["rare%d" % i for i in range(200)]
    return [(i, " ".join(rng.choices(pool, [20] * 7 + [1] * 200, k=rng.randint(0, 40)))) for i in range(n)]


def test_model_matches_brute_force(spark):
    docs = sentences(80, 1) + [(100, None), (101, ""), (102, " \t\n"), (None, "never seen a b"), (103, "the cat " * 4000)]
    check_model(spark, docs, docs[:70])


def test_model_with_few_frequent_words_and_many_shards(spark, monkeypatch):
    # most words are coded by their hashes and have their counts from the shards
    for name, value in (("COUNTED", 5), ("SHARD", 200), ("CHUNK", 500)):
        monkeypatch.setattr(language_model, name, value)
    docs = sentences(120, 2)
    check_model(spark, docs, docs[:100])


def test_rare_words_and_n_grams_count_in_a_large_corpus(spark, monkeypatch):
    # 150,000 tokens and more: words and n-grams seen once have less than 1/100,000 of them
    docs = sentences(60, 4) + [(1000 + i, "the cat of a " * 1500) for i in range(25)] + [(2000, "seldom met words"), (2001, "seldom met words here")]
    monkeypatch.setattr(language_model, "SHARD", 20_000)
    ref = check_model(spark, docs, docs[:-1])
    assert ref.n > 150_000


def follows():
    rng = random.Random(5)
    return [(i, " ".join(f"w{rng.randrange(400)} hub" for _ in range(100))) for i in range(30)]


def test_a_word_after_which_everything_follows_is_cut(spark, monkeypatch):
    for name, value in (("HOT", 100), ("SHARD", 400), ("CHUNK", 1000)):
        monkeypatch.setattr(language_model, name, value)
    docs = follows()
    ref = check_model(spark, docs, docs[:25])
    table = {"words": np.array([7, 5, language_model.hash_of(b"")]), "counts": np.array([ref.count[b"hub"], 1, 25]), "totals": np.array([ref.n, 3])}
    words = language_model.Words(table)
    after, middle = np.arange(-400, 0), np.zeros(400, np.int64)
    parts = [len(rows) for _, rows in language_model._by_shard([middle, after, after], words, 50)]
    assert len(parts) > 10 and max(parts) < 100 and sum(parts) == 400
    assert len(list(language_model._by_shard([middle + 1, after, after], words, 50))) == 1


def test_scores_come_from_the_trie(spark, monkeypatch):
    docs = sentences(40, 6)
    ref = Reference([t for _, t in docs[:30]])
    found = language_model.Trie.child

    def blind(self, level, parent, word):
        node, rank = found(self, level, parent, word)
        return (node, rank) if level != "gram" else (node * 0 - 1, rank)

    monkeypatch.setattr(language_model.Trie, "child", blind)
    out = {r["doc_id"]: r["score"] for r in language_model.score(documents(spark, docs), documents(spark, docs[:30])).collect()}
    assert sum(not close_to(ref.score(t), t, out[k]) for k, t in docs) > 20


def trie(texts):
    """The trie of all trigrams of the texts, the reference model, and the words by number."""
    ref = Reference(texts)
    words = sorted(ref.count) + [None]
    number = {w: i for i, w in enumerate(words)}
    grams = ref.grams + Counter({(None, b"", c): n for (b, c), n in ref.pairs.items() if b == b""})
    rows = np.array(sorted((number[b], number[c], number[a], n) for (a, b, c), n in grams.items()))
    totals = np.array([ref.count[w] if w is not None else 0 for w in words])
    levels = language_model.grow(rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3], totals, len(words) - 1)
    return language_model.Trie(language_model.pack(levels)), ref, words


def test_trie_answers_trigrams_it_does_not_hold():
    held, ref, words = trie([t for _, t in sentences(60, 3)])
    rng = np.random.default_rng(0)
    asked = np.unique(rng.integers(0, len(words) - 1, (5000, 3)), axis=0)
    middle, after, before = asked.T
    mass, rest, room = (language_model._mass(x) for x in held.masses(middle, after, before))
    missing = 0
    for b, c, a, m, r, z in zip(middle, after, before, mass, rest, room):
        a, b, c = words[a], words[b], words[c]
        want = ref.grams[a, b, c] + language_model.MU * ref.second(b, c)
        missing += not ref.grams[a, b, c]
        assert want * 10 ** (-2.1 / language_model.STEPS) <= m + r * ref.base(c) <= want * (1 + 1e-9)
        full = ref.pairs[b, c] + language_model.MU
        assert full <= z * (1 + 1e-9) and z <= full * 10 ** (1.1 / language_model.STEPS)
    assert missing > 1000


def test_probabilities_sum_to_one_at_most():
    held, ref, words = trie([t for _, t in sentences(60, 3)])
    every = np.arange(len(words) - 1)
    base = np.array([ref.base(w) for w in words[:-1]])
    for a, b in ((1, 2), (2, 1), (0, 3), (len(words) - 1, 0), (5, 200), (200, 5)):
        mass, rest, _ = held.masses(np.full(len(every), b), every, np.full(len(every), a))
        total = (language_model._mass(mass) + language_model._mass(rest) * base).sum() / (ref.pairs[words[a], words[b]] + language_model.MU)
        assert 0.97 < total <= 1.0


def test_model_edge_cases(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    out = {r["doc_id"]: r for r in language_model.score(docs, docs.limit(0)).collect()}
    assert out[1]["n_known"] == 0 and out[1]["train_tokens"] == 0 and out[1]["score"] == pytest.approx(out[1]["base_score"])
    assert language_model.score(docs.limit(0), docs).collect() == []


def test_model_beats_its_base_on_held_out_texts(spark):
    out = [r for r in registry.QUERIES["op10_lm_scoring"](spark, MIDDLE).collect()]
    assert all(r["held_out"] == (fold(r["doc_id"], 10) == 0) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


# pipeline ------------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    """Every stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").unionByName(
        documents(spark, [(9001, None), (9002, "12 34"), (9003, "")]))
    before, columns = {r["doc_id"]: r for r in docs.collect()}, docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    after = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), "test")
        rows = docs.collect()
        if name == "sharding":
            check_shards(rows, len(after), 8)
            assert sorted(map(repr, (tuple(r)[:-2] for r in rows))) == sorted(map(repr, (tuple(r) for r in after)))
            continue
        assert docs.columns == columns
        kept = {r["doc_id"] for r in rows}
        if name == "language ID":
            assert kept == {k for k, r in before.items() if any(c.isalpha() for c in r["text"] or "")}
        elif name == "MinHash near-dedup":
            sets, links = similar([(k, r["text"]) for k, r in before.items()], 5)
            assert kept == {k for k, root in roots(sets, links).items() if k == root}
        elif name == "benchmark decontamination":
            keys = list(before)
            found = brute([(k, before[k]["text"]) for k in keys], items, 10)
            assert kept == {k for k, f in zip(keys, found) if not f[2]}
        else:
            words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            total = sum(words(r["text"]) for r in before.values())
            assert kept <= set(before) and all(before[r["doc_id"]]["text"].startswith(r["text"]) for r in rows)
            assert sum(words(r["text"]) for r in rows) == total * mixing.BUDGET_SHARE[0] // mixing.BUDGET_SHARE[1]
        before, after = {r["doc_id"]: r for r in rows}, rows


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[-2:] == ["shard", "slot"] and out.count() > 0
