import itertools
import random

import pytest

from tessera.operators import affinity as A
from tests.test_whole import CLAIM


def graph(r, nodes, edges, hub=0):
    names = [f"n{i}" for i in range(nodes)]
    rows = [(r.choice(names), r.choice(names)) for _ in range(edges)] + [("hub", x) for x in names[:hub]] + [(x, "bub") for x in names[hub // 2 : hub]]
    return [(f"c{i}", r.choice(["P", "Q", "R"]), a, b if r.random() < 0.95 else None, None, "f") for i, (a, b) in enumerate(rows)]


def adjacency(claims):
    adj = {}
    for _, _, a, b, *_ in claims:
        if b is not None:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    return adj


def two_hops(claims):
    adj = adjacency(claims)
    return {x: {y for m in adj[x] for y in {m} | adj[m]} - {x} for x in adj}


def jaccard(x, y, weight):
    return len(x & y) * weight // len(x | y) if x and y else 0


def known(claims, entities):
    preds = {}
    for _, p, a, b, *_ in claims:
        for e in (a, b):
            if e is not None:
                preds.setdefault(e, set()).add(p)
    return {e: (preds.get(e, set()), {w for w in (brief or "").lower().split() if len(w) >= 4}) for e, _, brief, _ in entities}


ENTITY = "var_name string, role_type string, brief string, file string"


@pytest.mark.parametrize(("seed", "heavy"), [(1, 1000), (2, 0), (3, 1), (4, 3), (5, 8)])
def test_affinity_equals_brute_force(spark, seed, heavy):
    """Whatever is heavy, the sets are the same: with 0 all are counted by signature, with 1000 all are listed."""
    r = random.Random(seed)
    claims = graph(r, 40, 50, 25)
    names = sorted({e for c in claims for e in c[2:4] if e} | {"alone"})
    entities = [(e, "Idea", r.choice([None, "", "some words here", "other words", "here"]), "f") for e in names]
    pairs = r.sample(list(itertools.permutations(names, 2)), 300) + [(names[0], names[0])]
    hop, own = two_hops(claims), known(claims, entities)
    got = A.affinity(spark.createDataFrame(pairs, "a string, b string"), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(claims, CLAIM), heavy)
    got = {(x.a, x.b): (x.two_hop, x.predicates, x.brief) for x in got.collect() if x.a != x.b}
    want = {(a, b): (jaccard(hop.get(a, set()), hop.get(b, set()), 300), jaccard(own[a][0], own[b][0], 400), jaccard(own[a][1], own[b][1], 300)) for a, b in pairs if a != b}
    assert got == want
    sizes = A.TwoHop(spark.createDataFrame(claims, CLAIM), spark.createDataFrame([(e,) for e in names], "x string"), heavy).sizes()
    assert {x.x: x.n for x in sizes.collect()} == {e: len(hop.get(e, ())) for e in names}


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_across_clusters(spark, seed):
    r = random.Random(seed)
    trip = []
    for i in range(120):
        cluster = r.choice(["A", "A", "A", "B", "C", None])
        trip.append((f"e{i}", "Idea", cluster, r.random() < 0.2, sorted(r.sample("PQR", r.randint(0, 3))), sorted(r.sample(["here", "some", "word"], r.randint(0, 2)))))
    df = spark.createDataFrame(trip, "entity string, role_type string, cluster string, bridge boolean, predicates array<string>, tokens array<string>")
    of = {t[0]: t for t in trip}

    def rank(a, b):
        x, y = of[a], of[b]
        s = jaccard(set(x[4]), set(y[4]), 400) + jaccard(set(x[5]), set(y[5]), 300)
        return (s, bool(x[5]) + bool(y[5]) + 3 * x[3] + 3 * y[3])

    all_ = {}
    for a, b in itertools.permutations(of, 2):
        if of[a][2] and of[b][2] and of[a][2] < of[b][2] and rank(a, b)[0] >= 250:
            all_.setdefault((of[a][2], of[b][2]), []).append((a, b))
    # refute the very best of A and B, some of them the other way round
    best = sorted(all_["A", "B"], key=lambda p: -(62 * rank(*p)[1] + rank(*p)[0]))[:40]
    refuted = [p if i % 2 else p[::-1] for i, p in enumerate(best)]
    got = A.pair_across(df, spark.createDataFrame(refuted, "a string, b string"), 7).collect()
    for cs, pairs in all_.items():
        own = [(x.a, x.b) for x in got if (x.cluster_a, x.cluster_b) == cs]
        left = [p for p in pairs if p not in best]
        value = lambda p: 62 * rank(*p)[1] + rank(*p)[0]
        assert len(set(own)) == len(own) == min(7, len(left)) and set(own) <= set(left)
        assert sorted(map(value, own)) == sorted(map(value, left))[-7:]
    assert all((x.affinity, x.score) == rank(x.a, x.b) for x in got)
    assert A.pair_across(df.limit(0), spark.createDataFrame(refuted, "a string, b string"), 7).count() == 0


def test_two_hop_sets_are_listed_in_batches(spark, monkeypatch):
    """What is listed at once is a part of all, whose files are gone when the next part is made; the result is the same."""
    r = random.Random(9)
    claims = spark.createDataFrame([(f"c{i}", "P", f"s{r.randrange(30)}", f"p{r.randrange(200)}", None, "f") for i in range(500)], CLAIM)
    entities = spark.createDataFrame([("s1", "Idea", "some words", "f")], ENTITY)
    pairs = claims.selectExpr("subject as a", "object as b").distinct().where("hash(b) % 8 = 0")
    whole = sorted(map(tuple, A.affinity(pairs, entities, claims).collect()))
    made, written = [], A.written

    def kept(df, name):
        got = written(df, name)
        if name == "twohop-outside":
            made.append((got, got.count()))
        return got

    monkeypatch.setattr(A, "written", kept)
    A.affinity(pairs, entities, claims)
    (_, all_), = made
    made.clear()
    assert sorted(map(tuple, A.affinity(pairs, entities, claims, listed=1000).collect())) == whole and whole
    assert len(made) > 1 and max(n for _, n in made) < all_
    for df, _ in made:
        with pytest.raises(Exception, match="(?i)not.*exist"):
            df.count()
