"""Cross-tokenizer alignment against a plain form that encodes whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from haulage.llm import token_alignment as T
from haulage.llm.common import read_table
from tests.llm.helpers import SMALL, documents

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.fixture(scope="module")
def pair():
    return T.Pair(f"{T.FOLDER}/{T.A_FILE}", f"{T.FOLDER}/{T.B_FILE}")


def plain(pair, texts):
    """(sums, groups) per text, from whole texts and all pairs of tokens that may overlap."""
    linked, out = [], []
    for text in texts:
        a, b = ([], []) if not text else (pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text))
        whole = b" " + (text or "").encode()
        if not text or b"".join(pair.a_bytes[i] for i in a) != whole or b"".join(pair.b_bytes[i] for i in b) != whole:
            linked.append([])
            out.append((0, 0, 0, ""))
            continue
        spans = []
        for ids, names in ((a, pair.a_bytes), (b, pair.b_bytes)):
            ends = np.cumsum([len(names[i]) for i in ids]).tolist()
            spans.append([(e - len(names[i]), e, i) for i, e in zip(ids, ends)])
        common = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, links, before, i, j = [], [], 0, 0, 0
        for end in common:
            left, right = [], []
            while i < len(a) and spans[0][i][1] <= end:
                left.append(spans[0][i])
                i += 1
            while j < len(b) and spans[1][j][1] <= end:
                right.append(spans[1][j])
                j += 1
            groups.append(",".join(str(x[2]) for x in left) + "|" + ",".join(str(x[2]) for x in right))
            links += [(x[2], y[2]) for x in left for y in right if x[0] < y[1] and y[0] < x[1]]
            before = end
        assert before == len(whole)
        linked.append(links)
        out.append((len(a), len(b), len(groups), ";".join(groups)))
    counts = Counter(p for links in linked for p in set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [((n_a, n_b, n_g, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links)), groups)
            for (n_a, n_b, n_g, groups), links in zip(out, linked)]


ODD = [None, "", " ", "a", "  two  spaces  ", "tab\there\nline \n  next", "café naïve 你好世界 \U0001f600 x", "<|endoftext|> <s> </s> <0x41> <unk>",
       "low▁line", "nbsp here   there", "a　b  c", "it's we'll 'tis", "\x00 zero", "fi ﬁ é ́x", "word " * 3000, "x" * 5000,
       "same text here", "same text here", "123456789 3.14159 $5,000.00 !!! ...", "نص عربي", " lead", "trail ", "\n", "a \n b"]


def test_odd_texts(spark, pair):
    """Nulls, empty and long texts, white space of every kind, special strings, repeats: as whole texts give."""
    got = {r["doc_id"]: r for r in T.align(documents(spark, list(enumerate(ODD)))).collect()}
    for i, (sums, groups) in enumerate(plain(pair, ODD)):
        assert (tuple(got[i][c] for c in COLUMNS), got[i]["groups"]) == (sums, groups), ODD[i]
    assert got[8]["n_a"] == 0  # U+2581 comes back as a space


def test_query_on_small_table(spark, pair):
    rows = read_table(spark, SMALL, "documents").select("doc_id", "text").collect()
    want = {r["doc_id"]: (*sums, hashlib.sha256(groups.encode()).hexdigest() if sums[0] else "")
            for r, (sums, groups) in zip(rows, plain(pair, [r["text"] for r in rows]))}
    got = {r["doc_id"]: tuple(r[c] for c in [*COLUMNS, "groups_sha256"]) for r in T.op12_token_alignment(spark, SMALL).collect()}
    assert got == want


def test_columns_and_empty_table(spark):
    docs = documents(spark, [(1, "one two")]).selectExpr("doc_id", "text", "1 AS n_a", "map('k', 2) AS chunk", "3 AS texts", "array(4) AS rows")
    out = T.align(docs)
    assert out.columns == ["doc_id", "chunk", "texts", "rows", *COLUMNS, "groups"]
    assert out.first()["chunk"] == {"k": 2} and out.first()["n_a"] == 2
    assert T.align(docs.filter("false")).collect() == []
    # a null id, and the text column alone
    assert T.align(documents(spark, [(None, "x")])).first()["n_a"] == 1
    assert T.align(docs.select("text")).first()["n_groups"] == 2


def test_quick_encoder_agrees(pair):
    """The encoder by ranks and the listed merges, also on letters that make up no common word."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(33, 0x250, rng.integers(1, 12)))) for _ in range(3000)]
    words = [w for w in words if not any(c.isspace() for c in w)]
    assert pair.quick is not None
    ids, sizes = pair.encode(words)[0]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [pair.a.encode(" " + w, add_special_tokens=False).ids for w in words]
    other = T.Pair(f"{T.FOLDER}/{T.A_FILE}", f"{T.FOLDER}/{T.B_FILE}", quick=False)
    assert other.quick is None and (other.encode(words[:500])[0][0] == ids[:sizes[:500].sum()]).all()


def test_coalesce_by_hand():
    group_a, group_b, a, b = T.coalesce(*map(np.array, ([0, 3, 5], [3, 5, 9], [0, 2, 5, 7], [2, 5, 7, 9])))
    assert group_a.tolist() == [0, 0, 1] and group_b.tolist() == [0, 0, 1, 1]
    assert list(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3)]
