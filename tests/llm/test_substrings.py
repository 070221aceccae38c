"""Substring dedup against brute force and SQL."""

import random
from collections import Counter

import numpy as np
import pytest

from haulage.llm import chunks
from haulage.llm import substrings as S
from tests.llm.helpers import MIDDLE, SMALL, documents, same_as_sql


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i:i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def passages(rng, window):
    """Texts with passages of about a window's length from a common stock, at any place, and runs of one word."""
    stock = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(window - 2, 2 * window))] for _ in range(6)]
    texts = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(0, 4)):
            own += [f"w{rng.random()}" for _ in range(rng.randint(0, window))] + rng.choice(stock)[rng.randint(0, 3):]
        texts.append(rng.choice([" ", "\n", "\t "]).join(own))
    return [*texts, None, "", " \n ", "same " * (3 * window), "x", texts[0], texts[0], *["once " * (window - 1)] * 2]


@pytest.mark.parametrize("window", [1, 2, 7, 35])
def test_random_texts(spark, window, monkeypatch):
    """Nulls, empty and repeated texts, repeats in a text and across; many chunks and shards."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(chunks, "SHARD_BYTES", 5_000)
    texts = passages(random.Random(window), window)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"])
           for r in S.drop_repeated(documents(spark, list(enumerate(texts))), window=window).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_any_two_places_share_an_anchor():
    for window in (1, 2, 5, 12, 35, 60):
        period = S.period_for(window)
        places = set(S.cover(period))
        assert period <= window and all(any((i + s) % period in places and (j + s) % period in places for s in range(period))
                                        for i in range(period) for j in range(period))


def test_clashing_names_nulls_and_empty_table(spark):
    docs = documents(spark, [(None, "a b"), (None, "a b"), (1, "ä " * 40)]).selectExpr(
        "doc_id", "text", "1 AS n_words", "map('k', 2) AS chunk", "3 AS texts", "array(4) AS rows", "5 AS kept_bytes", "6 AS round")
    out = S.drop_repeated(docs, window=2)
    assert out.columns == ["doc_id", "chunk", "texts", "rows", "kept_bytes", "round", "n_words", "n_removed", "kept_text"]
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"], r["chunk"]["k"]) for r in out.collect()) == [(2, 2, "", 2), (2, 2, "", 2), (40, 40, "", 2)]
    assert S.drop_repeated(docs.filter("false")).collect() == []


def test_long_text(spark):
    text = " ".join(f"word{i}" for i in range(200_000))
    [row] = S.drop_repeated(documents(spark, [(1, text + " " + text[:2000])])).collect()
    assert row["n_removed"] > 400 and row["n_words"] > 200_000


def test_equal_keys_with_other_marks():
    keys, marks = np.array([5, 5, 5, 2], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    first, place, counts = S.distinct(keys, marks)
    assert counts.tolist() == [1, 2, 1] and place.tolist() == [1, 2, 1, 0] and keys[first].tolist() == [2, 5, 5]


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_sql(spark, sf_dir):
    same_as_sql(S.op13_substring_dedup(spark, sf_dir), S.OP13_SQL, sf_dir)
