"""Two-hop counts against sets, whatever is a hub."""

import random

import pytest

from tessera.operators import graph as G
from tessera.operators import reach
from tests.test_operators import claims


@pytest.mark.parametrize(("seed", "heavy"), [(1, 1000), (2, 0), (3, 2), (4, 8)])
def test_two_hop_sizes_equal_sets(spark, seed, heavy):
    r = random.Random(seed)
    edges = [(f"n{r.randrange(50)}", f"n{r.randrange(50)}") for _ in range(45)] + [("hub", f"n{i}") for i in range(20)] + [(f"n{i}", "bub") for i in range(12, 30)] + [("hub", "bub"), ("loop", "loop"), ("far", "away"), ("solo", None)]
    near = {}
    for a, b in edges:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {u: len({w for v in near[u] for w in {v} | near[v]} - {u}) for u in near}
    assert {x["u"]: x["n_two_hop"] for x in G.two_hop_sizes(claims(spark, edges), heavy).collect()} == want


def test_neighbours_of_a_hub_are_not_paired(spark, monkeypatch):
    """Of 300 neighbours of one hub no list goes to another: what is sent grows with the edges."""
    sent, keep = [], G._cut
    monkeypatch.setattr(G, "_cut", lambda df, name: (sent.append(name), keep(df, name))[1])
    got = G.two_hop_sizes(claims(spark, [("hub", f"n{i}") for i in range(300)]), 100)
    assert {x["n_two_hop"] for x in got.collect()} == {300} and "hop-meets" in sent


@pytest.mark.parametrize("heavy", [8, 1000])
def test_blocks_of_rows_and_lists(spark, monkeypatch, heavy):
    """Rows and lists in many blocks; no list goes out once for each neighbour."""
    r = random.Random(9)
    edges = [(f"s{r.randrange(12)}", f"p{r.randrange(60)}") for _ in range(260)] + [(f"s{i}", "land") for i in range(12)] + [("p1", "end"), ("s1", "p1")]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {u: len({w for v in near[u] for w in {v} | near[v]} - {u}) for u in near}
    sent, keep = [], reach.counted
    monkeypatch.setattr(reach, "counted", lambda rows, *a: (sent.append(rows.count()), keep(rows, *a))[1])
    monkeypatch.setattr(reach, "ROWS", 40)
    monkeypatch.setattr(reach, "LISTS", 90)
    assert {x["u"]: x["n_two_hop"] for x in G.two_hop_sizes(claims(spark, edges), heavy).collect()} == want
    assert len(sent) == 1 and (heavy == 8 or sent[0] > 50)
