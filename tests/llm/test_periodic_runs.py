import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs as P
from tests.llm.brute import spaced


def brute(w, least=12):
    n, best = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - s >= max(p, least - p):
                best.setdefault((s, i + p), p)
            i += i == s
    return sorted(((s, e, p) for (s, e), p in best.items()), key=lambda r: (r[0], r[2]))


def expected(i, t):
    w = spaced(t)
    if i is not None and w and zlib.crc32(str(i).encode()) % 10 == 0:
        g, n = zlib.crc32(str(i).encode()) // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = brute(w)
    gone = {k for s, e, p in found for k in range(s + p, e)}
    best = min(((s - e, s, p) for s, e, p in found), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), digest("".join(f"{s},{e - s},{p}\n" for s, e, p in found)), digest(" ".join(x for k, x in enumerate(w) if k not in gone)))


def word_lists(r):
    kind, n, a = r.randint(0, 5), r.randint(0, 70), r.choice([1, 2, 2, 3, 4])
    some = lambda k: [r.randrange(a) for _ in range(k)]
    if kind < 2:
        return some(n)
    if kind == 2:
        w = (some(r.randint(1, 9)) * 20)[:n]
        return w + w[::-1] * r.randint(0, 1)
    if kind == 3:
        x, y = [0], [0, 1]
        while len(y) < n:
            x, y = y, y + x
        return y[: n + 5]
    return (some(r.randint(1, 5)) * r.randint(2, 5) + [r.randrange(9) for _ in range(3)]) * r.randint(1, 4)


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_equal_brute_force(least):
    r = random.Random(least)
    for _ in range(400):
        docs = [word_lists(r) for _ in range(r.randint(1, 4))]
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        symbols = np.array([100 * d + x for d, w in enumerate(docs) for x in w], np.int64)
        want = [(s + first[d], e + first[d], p) for d, w in enumerate(docs) for s, e, p in brute(w, least)]
        assert [tuple(x) for x in P.runs(symbols, first, least).tolist()] == want, docs


def test_documents(spark, monkeypatch):
    r = random.Random(6)
    docs = [(i, r.choice(" \t\n\r").join(r.choice(["the", "word", "é", "￿", "x"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    docs += [(150, None), (151, ""), (152, " \n "), (None, "a b " * 10), (7, docs[7][1]), (154, "go " * 3000), (155, "a b\x00c " * 12), (156, "  one  two\x0bthree " * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as id", "3 as n_runs").repartition(3)
    want = sorted((expected(*d) for d in docs), key=str)
    for size in (P.CHUNK_BYTES, 64):
        monkeypatch.setattr(P, "CHUNK_BYTES", size)
        assert sorted((tuple(x) for x in P.periodic_runs(df).collect()), key=str) == want
    assert sum(x[1] for x in want) > 4
    assert P.periodic_runs(df.limit(0)).count() == 0


def test_long_document_in_proportion(spark):
    """A document of 300,000 words that is one repetition, with another inside its period."""
    inner = ["a", "b"] * 20 + [f"w{k}" for k in range(960)]
    t = " ".join(inner * 300)
    got = P.periodic_runs(spark.createDataFrame([(1, t)], "doc_id long, text string"), plant=False).first()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (301, 0, 300_000, 1000, 300_000)
    assert got.collapsed_sha256 == hashlib.sha256(" ".join(["a", "b"] + inner[40:]).encode()).hexdigest()
