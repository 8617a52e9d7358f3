"""Cut vertices of components that no task takes whole, against removing each vertex."""

import random

import pytest

from tessera.operators import graph as G
from tests.test_operators import claims, reach


def brute(edges, singletons):
    nodes = {n for e in edges for n in e}
    near = {n: {m for e in edges if n in e for m in e if m != n} for n in nodes}
    parts = {}
    for n in nodes:
        left = [p for p in reach(edges, n) if p & near[n]]
        parts[n] = sum(len(p) > 1 for p in left) + (sum(len(p) == 1 for p in left) if singletons else 0)
    return {n: len(near[n]) for n in nodes if len(near[n]) >= 2 and parts[n] >= 2}


def some(seed):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(26)}", f"n{r.randrange(26)}") for _ in range(24)] + [(f"m{r.randrange(30)}", f"m{r.randrange(30)}") for _ in range(42)]
    edges += [("loop", "loop"), ("a", "b"), ("c0", "c1"), ("c1", "c0")] + [(f"p{i}", f"p{i + 1}") for i in range(7)] + [(f"q{i}", f"q{(i + 1) % 7}") for i in range(7)] + [("q3", "p0"), ("q3", "p2")]
    return edges + [("hub", f"n{i}") for i in range(0, 26, 5)] if seed % 2 else edges


@pytest.mark.parametrize("singletons", [True, False])
@pytest.mark.parametrize(("seed", "whole"), [(1, 0), (2, 0), (3, 0), (4, 40), (5, 1000)])
def test_cut_vertices_equal_brute_force(spark, seed, whole, singletons):
    edges = some(seed)
    got = {x["node"]: x["degree"] for x in G.articulation(claims(spark, edges), singletons, whole).collect()}
    want = brute(edges, singletons)
    assert got == want and len(want) > 5


