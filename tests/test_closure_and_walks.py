import collections
import random

import pytest

from tessera.operators import closure as C
from tessera.operators import graph as G
from tests.test_operators import CLAIM


def test_planted_briefs(spark):
    """a supports b supports c and d; a is referred to once."""
    claims = [("1", "Proposes", "a", "b", None, "f"), ("2", "TheoryOf", "b", "c", None, "f"), ("3", "DerivedFrom", "d", "b", None, "f"), ("4", "Disputes", "d", "c", None, "f"), ("5", "IsX", "b", None, None, "f"), ("6", "Proposes", "z", "c", None, "f")]
    briefs = {"a": "Obviously right", "b": "thin air", "c": "It is WELL known, of course", "d": "everyone knows, although", "e": "Beyond dispute", "f": "", "g": None}
    e = spark.createDataFrame(list(briefs.items()), "var_name string, brief string")
    got = {r.entity: tuple(r)[1:] for r in C.findings(spark.createDataFrame(claims, CLAIM), e).collect()}
    assert got == {"a": ("obviously", False, False, "info"), "c": ("it is well known", True, True, "warning"), "d": ("", True, True, "info"), "e": ("beyond dispute", True, False, "info")}
    assert C.audit(C.findings(spark.createDataFrame(claims, CLAIM), e)).first()["value"] == 1
    assert not C.audit(C.findings(spark.createDataFrame([], CLAIM), e.limit(0))).first()["triggered"]


def claims_of(spark, edges):
    return spark.createDataFrame([(str(i), "P", a, b, None, "f") for i, (a, b) in enumerate(edges)], CLAIM)


@pytest.mark.parametrize("tries", [1, 8])
def test_walks(spark, tries):
    r = random.Random(3)
    edges = [(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(60)] + [("a", "b"), ("hub", "n1")] + [("hub", f"m{i}") for i in range(40)]
    adj = collections.defaultdict(set)
    for u, v in edges:
        if u != v:
            adj[u].add(v)
            adj[v].add(u)
    starts = [*sorted(adj), "nowhere"]
    got = collections.defaultdict(list)
    for x in G.walks(claims_of(spark, edges), spark.createDataFrame([(s,) for s in starts], "start string"), 5, 7, tries, piece=4).orderBy("start", "step").collect():
        got[x.start].append(x.node)
    assert set(got) == set(starts)
    for s, path in got.items():
        assert path[0] == s and len(set(path)) == len(path) <= 6
        assert all(v in adj[u] for u, v in zip(path, path[1:]))
        assert len(path) == 6 or not adj[path[-1]] - set(path)


def test_walks_draw_by_weight(spark):
    """From the centre to neighbours of degrees 1, 2 and 5, that is with weights 1/2, 1/3 and 1/6; by draws and by exponentials."""
    edges = [("c", "x"), ("c", "y"), ("c", "z"), ("y", "y1")] + [("z", f"z{i}") for i in range(4)] + [(f"s{i}", "c") for i in range(1)]
    seen = {8: collections.Counter(), 0: collections.Counter()}
    for tries, n in seen.items():
        for seed in range(3):
            base = [(u + f"@{k}", v + f"@{k}") for k in range(400) for u, v in edges]
            starts = spark.createDataFrame([(f"s0@{k}",) for k in range(400)], "start string")
            n.update(x.node.split("@")[0] for x in G.walks(claims_of(spark, base), starts, 2, seed, tries).where("step = 2").collect())
        total = sum(n.values())
        assert total == 1200 and all(abs(n[k] / total - w) < 0.05 for k, w in (("x", 1 / 2), ("y", 1 / 3), ("z", 1 / 6)))
