import collections
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import spelling as S
from tests.llm.brute import LOWER


def vocabulary(docs):
    c = collections.Counter()
    for i, t in docs:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = r.translate(LOWER)
            h = zlib.crc32(f"{i}:{r}".encode())
            if i is not None and h % 31 == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            c[r] += len(r) >= 7
    return {w: n for w, n in c.items() if n >= 2}


def apart(v, w):
    if len(v) == len(w):
        return sum(a != b for a, b in zip(v, w)) == 1
    v, w = sorted((v, w), key=len)
    return len(w) == len(v) + 1 and any(w[:k] + w[k + 1 :] == v for k in range(len(w)))


def variants(words, times=10):
    near = {v: [w for w in words if apart(v, w)] for v in words}
    best = {v: min(near[v], key=lambda w: (-words[w], w), default=None) for v in words}
    form = {v: b if b is not None and words[b] >= times * words[v] else None for v, b in best.items()}
    out = {}
    for v in words:
        root = v
        while form[root] is not None:
            root = form[root]
        out[v] = (form[v], root, words[v], len(near[v]), words[form[v]] if form[v] is not None else None)
    return out


def run(spark, words, **more):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    return {r.word: tuple(r)[1:] for r in S.variants(df, **more).collect()}


def test_vocabulary(spark):
    r = random.Random(3)
    letters = "abABÉéÿ×"
    docs = [(i, " 1 ".join("".join(r.choices(letters[:3], k=r.randint(6, 8))) for _ in range(40))) for i in range(60)]
    docs += [(None, "aaaaaaa aaaaaaa"), (61, None), (62, ""), (63, "ÉTRANGE-ÉTRANGE ×aaaaaa ×aaaaaa Āaaaaaa"), (64, "x" * 100_000 + " " + "x" * 100_000), (64, docs[3][1])]
    got = S.vocabulary(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as word", "2 as n", "3 as run"))
    assert {r.word: r.n for r in got.collect()} == vocabulary(docs)


@pytest.mark.parametrize("limit", [None, 60])
def test_variants_equal_brute_force(spark, monkeypatch, limit):
    """Few letters, so that keys are crowded; a limit of 60 letters cuts most of them again and again."""
    monkeypatch.setattr(S.near_pairs, "__defaults__", (limit or S.KEY_LETTERS, S.BLOCK_LETTERS))
    r = random.Random(limit)
    words = {"".join(r.choices("abé", k=r.randint(1, 7))): r.choice([2, 3, 20, 30, 200, 400, 5000]) for _ in range(250)}
    words |= {"a" * k: 10**k for k in range(1, 9)}
    assert run(spark, words) == variants(words)


def test_ties_chains_and_long_words(spark):
    long = "".join(random.Random(1).choices("abc", k=20_000))
    words = {"letters": 2, "lettars": 20, "lettors": 20, "lettarss": 200, "lettarsss": 2000, "lettarssss": 19_999, long: 2, long[:9000] + long[9001:]: 20, long + "b": 3, "￿bcdefg": 5, "\U00010000bcdefg": 5, "abcdefg": 2}
    got = run(spark, words)
    assert got == variants(words)
    assert got["letters"][:2] == ("lettars", "lettarsss")


def test_nothing(spark):
    assert run(spark, {}) == {} and run(spark, {"abcdefg": 2}) == {"abcdefg": (None, "abcdefg", 2, 0, None)}
    assert S.vocabulary(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wavelet_tree_reports_rectangles():
    r = np.random.default_rng(4)
    for m in (1, 2, 3, 50, 64, 65):
        v = r.permutation(m)
        left, right, lo, hi = (r.integers(0, m + 1, 40) for _ in range(4))
        query, value = S.Wavelet(v).report(left, right, lo, hi)
        want = sorted((q, x) for q in range(40) for x in v[left[q] : max(left[q], right[q])].tolist() if lo[q] <= x < hi[q])
        assert sorted(zip(query.tolist(), value.tolist())) == want
