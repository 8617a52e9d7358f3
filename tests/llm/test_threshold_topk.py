import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import threshold_topk as T

BY_TEN = "vec_id % 10 = 0"


def brute(rows, k, step=10):
    own = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            own[i] = min(own[i], v) if i in own else v
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in own.items()}
    out = {}
    for q in sorted(i for i in whole if i % step == 0):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:k]
        out |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(s)}
    return out


def run(spark, rows, k=5, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in T.top_k(df, F.expr(BY_TEN), k, **more).collect()}


@pytest.mark.parametrize("part", [None, 70])
def test_equals_brute_force(spark, part):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=12).round(2)]) for i in range(400)]
    assert run(spark, rows, part_rows=part) == brute(rows, 5)


@pytest.mark.parametrize("part", [None, 60])
def test_ties_and_hot_vectors(spark, part):
    r = np.random.default_rng(3)
    x = r.integers(-1, 2, size=(300, 3)).astype(float)
    x[r.permutation(300)[:120]] = [1.0, 1.0, 1.0]
    rows = [(int(i), v.tolist()) for i, v in zip(r.permutation(300), x)]
    assert run(spark, rows, part_rows=part) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (0, [0.25, 1.0]), (None, [9.0, 9.0]), (1, None), (10, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, []), (20, [0.0, 0.0]), (30, [1.0]), (5, [0.5, 0.5, 7.0]), (30, [1.0])]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == {} and run(spark, [(0, [1.0])]) == {}


def test_beyond_exact_doubles(spark):
    rows = [(10, [float(1 << 22), 1.0]), (1, [float(1 << 22), 0.5]), (2, [float(1 << 22), 0.25]), (3, [float(1 << 22), 0.5]), (5, [1e31, 0.0]), (4, [1e30, 0.0])]
    got, most = run(spark, rows), (1 << 63) - 1
    want = brute(rows, 5)
    assert [got[10, i] for i in range(1, 6)] == [(4, most), (5, most)] + [want[10, i] for i in (3, 4, 5)]
    assert [v[0] for k, v in sorted(got.items())][2:] == [1, 3, 2]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 3, 4), (1, [2.0], 3, 4)], "vec_id long, embedding array<double>, part int, score int").withColumn("rank", F.lit(1)).withColumn("query_id", F.lit(2)).withColumn("vector", F.lit(2))
    assert [tuple(r) for r in T.top_k(df, F.expr(BY_TEN)).collect()] == [(0, 1, 1, 256 * 512)]


def test_lists_stop_before_their_end():
    """Vectors along the axes: the few that point the query's way lead its lists."""
    r = np.random.default_rng(5)
    x = np.floor(256 * (np.eye(16)[r.integers(0, 16, 4000)] + 0.05 * r.normal(size=(4000, 16))))
    lists = T.Lists(np.arange(4000), x)
    q = np.floor(256 * np.eye(16)[3])
    ids, score, met = lists.best(-1, q, 5)
    s = x @ q
    assert list(ids) == list(np.lexsort((np.arange(4000), -s))[:5]) and list(score) == list(s[ids]) and met < 400
