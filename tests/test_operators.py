"""Operators on tiny literal inputs, against brute force."""

import random
from datetime import datetime

import pytest

from tessera.operators import graph as G
from tessera.operators import integrity as I
from tessera.operators import retrieval as R
from tessera.streaming import jobs

CLAIM = "var_name string, predicate string, subject string, object string, prov_ref string, file string"


def claims(spark, edges, predicate="TheoryOf"):
    return spark.createDataFrame([(f"c{i}", predicate, a, b, None, "f") for i, (a, b) in enumerate(edges)], CLAIM)


def reach(edges, skip=None):
    nodes = {n for e in edges for n in e if n is not None} - {skip}
    adj = {n: set() for n in nodes}
    for a, b in edges:
        if b is not None and skip not in (a, b):
            adj[a].add(b)
            adj[b].add(a)
    parts = []
    while nodes:
        todo, part = [min(nodes)], set()
        while todo:
            n = todo.pop()
            if n not in part:
                part.add(n)
                todo += adj[n]
        nodes -= part
        parts.append(part)
    return parts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_articulation(spark, seed):
    r = random.Random(seed)
    edges = [(f"n{r.randint(0, 14)}", f"n{r.randint(0, 14)}") for _ in range(14)] + [("x", "x"), ("chain1", "chain2"), ("chain2", "chain3")]
    df = claims(spark, edges)
    got = {x["node"]: x["component"] for x in G.components(df).collect()}
    assert got == {n: min(p) for p in reach(edges) for n in p}
    cut = {x["node"] for x in G.articulation(df).collect()}
    degree = lambda n: len({m for e in edges if n in e for m in e if m != n})
    want = {n for n in got if degree(n) >= 2 and len(reach(edges, n)) > len(reach(edges))}
    assert cut == want


def test_star_centre_is_a_bridge_only_with_singletons(spark):
    df = claims(spark, [("hub", "a"), ("hub", "b"), ("hub", "c")])
    assert [x["node"] for x in G.articulation(df).collect()] == ["hub"]
    assert G.articulation(df, count_singletons=False).count() == 0


def test_empty_graph(spark):
    df = spark.createDataFrame([], CLAIM)
    assert G.components(df).count() == 0
    assert G.articulation(df).count() == 0


def test_unary_claims_and_orphans(spark):
    df = spark.createDataFrame([("u", "IsX", "a", None, None, "f")], CLAIM)
    e = spark.createDataFrame([("a", "Person"), ("b", "Person")], "var_name string, role_type string")
    assert [r["var_name"] for r in I.orphans(e, df).collect()] == ["b"]
    assert G.adjacency(df).count() == 0


def test_fusion_of_one_list(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 1.0)], "doc long, score double")
    none = spark.createDataFrame([], "doc long, score double")
    got = [(r["doc"], r["score"]) for r in R.fuse(a, none).orderBy("doc").collect()]
    assert got == [(1, round(1 / 61, 6)), (2, round(1 / 62, 6))]


def test_bm25_without_hits(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc long, text string")
    assert R.bm25(docs, ["gamma"]).count() == 0
    assert [r["doc"] for r in R.bm25(docs, ["alpha"]).collect()] == [1]


def test_walk_keeps_to_edges(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")]
    got = [r["node"] for r in G.walk(claims(spark, edges), "a", 5, 3).orderBy("step").collect()]
    assert len(set(got)) == len(got)
    assert all((x, y) in edges or (y, x) in edges for x, y in zip(got, got[1:], strict=False))


def test_stream_of_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), "view", 1.0) for h in range(3)] + [(datetime(2024, 1, 4), "view", 2.0)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    out = jobs.windowed(jobs.read_events(spark, str(tmp_path / "in"), df.schema))
    q = jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]
