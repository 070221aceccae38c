"""Spelling variants against brute force and SQL."""

import random
import zlib

import pytest

from haulage.llm import spelling as S
from tests.llm.helpers import MIDDLE, SMALL, documents, same_as_sql


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio):
    out = {}
    for w, n in words.items():
        others = [v for v in words if near(v, w)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form = best if best and words[best] >= ratio * n else None
        out[w] = (form, n, len(others), words[form] if form else None)
    rows = []
    for w, (form, n, count, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, count, form_n))
    return sorted(rows)


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def rows(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


@pytest.mark.parametrize("letters, least, ratio", [("ab", 1, 2), ("abc", 3, 10), ("aé\U00010400", 2, 1.5)])
def test_random_words(spark, letters, least, ratio):
    """Few letters: runs of equal characters, ties, long ways of forms, prefixes of each other."""
    rng = random.Random(least)
    words = {"".join(rng.choices(letters, k=rng.randint(least, least + 5))): rng.choice([1, 1, 2, 3, 20, 50, 400, 9000]) for _ in range(400)}
    assert rows(S.group_variants(frame(spark, words), least, ratio)) == brute(words, ratio)


def test_way_of_forms_and_ties(spark):
    words = {"variant": 10**6, "varian": 10**4, "varia": 10**2, "vari": 1, "planter": 50, "planted": 50, "plantez": 5}
    got = {r[0]: r for r in rows(S.group_variants(frame(spark, words), 4))}
    assert got["vari"][1:3] == ("varia", "variant") and got["varia"][2] == "variant"
    assert got["plantez"][1] == "planted"  # both 50: the first in code-point order


def test_odd_rows(spark):
    """Null, short, very long and repeated words, U+0000, other columns, an empty table."""
    words = spark.createDataFrame([(None, 5, 0), ("short", 9, 0), ("l" * 700, 1, 0), ("l" * 699, 10, 1), ("twofold", 1, 1), ("twofold", 2, 2),
                                   ("nul\x00word", 3, 0)], "word string, n long, form int")
    assert rows(S.group_variants(words)) == [("l" * 699, None, "l" * 699, 10, 1, None), ("l" * 700, "l" * 699, "l" * 699, 1, 1, 10),
                                             ("twofold", None, "twofold", 3, 0, None)]
    assert S.group_variants(words.filter("false")).collect() == []


def test_runs_of_texts(spark):
    """Runs, lower case of A-Z alone, the left-out code point, nulls and empty texts."""
    texts = [(1, "Alphabet ALPHABET-alphabet"), (2, None), (3, ""), (None, "Éclairage"), (4, "six6digits sevenup")]
    want: dict = {}
    for owner, runs in ((1, ["alphabet"] * 3), ("", ["Éclairage"]), (4, ["sevenup"])):
        for run in runs:
            h = zlib.crc32(f"{owner}:{run}".encode())
            word = run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]
            if len(word) >= 7:
                want[word] = want.get(word, 0) + 1
    assert {r["word"]: r["n"] for r in S.word_counts(documents(spark, texts)).collect()} == want


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_sql(spark, sf_dir):
    same_as_sql(S.op11_spelling_variants(spark, sf_dir), S.OP11_SQL, sf_dir)
