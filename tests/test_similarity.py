"""Structural dedup against all pairs, whatever is hot or long."""

import itertools
import math
import random

import pytest

from tessera.operators import similarity as D
from tests.test_whole import CLAIM


def brute(claims, roles, min_shared, coefficient, weight):
    sig = {}
    for _, p, a, b, *_ in claims:
        sig.setdefault(a, set()).add(f"{p}|out|{b or ''}")
        if b is not None:
            sig.setdefault(b, set()).add(f"{p}|in|{a}")
    df = {}
    for e in itertools.chain(*sig.values()):
        df[e] = df.get(e, 0) + 1
    out = {}
    for a, b in itertools.combinations(sorted(x for x in sig if x in roles), 2):
        common = sig[a] & sig[b]
        share, own = len(common) / max(len(sig[a]), len(sig[b])), sum(math.log1p(len(sig) / df[e]) for e in common)
        if roles[a] == roles[b] and len(common) >= min_shared and share >= coefficient and own >= weight:
            out[a, b] = (len(common), round(share, 6), round(own, 4))
    return out


def rows(spark, seed):
    r = random.Random(seed)
    claims, k = [], 0
    for i in range(70):
        likes = r.sample(range(14), r.randint(1, 6)) if i < 50 else r.sample(range(60), r.randint(20, 50))
        for j in likes:
            claims.append((f"c{k}", r.choice("PQ") if i % 5 else "P", f"e{i}", r.choice([f"o{j}", f"o{j}", f"o{j}", None]), None, "f"))
            k += 1
    for i in range(70, 80):  # copies but for an edge or two
        claims += [(f"d{i}{c[0]}", c[1], f"e{i}", c[3], None, "f") for c in claims if c[2] == f"e{i - 30}" and r.random() < 0.9]
    names = sorted({x for c in claims for x in c[2:4] if x} - {"e3"})
    roles = {x: "Event" if x[0] == "e" else "Concept" for x in names}
    return claims, roles, spark.createDataFrame(claims, CLAIM), spark.createDataFrame(list(roles.items()), "var_name string, role_type string")


@pytest.mark.parametrize(("seed", "hot", "long"), [(1, 32, 48), (2, 0, 1000), (3, 0, 3), (4, 4, 0), (5, 6, 8)])
@pytest.mark.parametrize(("shared", "coefficient"), [(2, 0.5), (2, 0.2), (1, 0.6)])
def test_candidates_equal_all_pairs(spark, seed, hot, long, shared, coefficient):
    claims, roles, c, e = rows(spark, seed)
    got = {(x.a, x.b): (x.shared, x.coefficient, round(x.weight, 4)) for x in D.candidates(c, e, shared, coefficient, 1.5, hot, long).collect()}
    want = brute(claims, roles, shared, coefficient, 1.5)
    assert got.keys() == want.keys() and len(want) > 10
    assert all(g[:2] == want[k][:2] and abs(g[2] - want[k][2]) < 2e-4 for k, g in got.items())


def test_hot_edges_meet_two_by_two(spark, monkeypatch):
    """1,640 events with six edges of forty events each, of which no two share more than one: no pair is looked at."""
    c = spark.createDataFrame([(f"c{i}-{j}", "P", f"e{i}", f"o{j}-{(i + j * (i // 41)) % 41}", None, "f") for i in range(41 * 40) for j in range(6)], CLAIM)
    e = spark.range(41 * 40).selectExpr("'e' || id AS var_name", "'Event' AS role_type")
    assert c.groupBy("object").count().where("count <> 40").isEmpty()
    looked, keep = {}, D.written
    monkeypatch.setattr(D, "written", lambda df, name: looked.setdefault(name, keep(df, name)))
    assert D.candidates(c, e, 2, 0.5, 1.0).isEmpty()
    assert looked["dedup-met"].isEmpty()
