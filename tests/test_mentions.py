import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import mentions as M
from tessera.operators import skew


def brute(texts, entities):
    out = {}
    for target, name, aliases in entities:
        forms = dict.fromkeys(s.strip() for s in [name, *(aliases or [])] if s)
        forms = [s for s in forms if 6 <= len(s.encode()) <= 60]
        for i, t in texts:
            m = forms and i != target and re.search(r"\b(?:" + "|".join(map(re.escape, forms)) + r")\b", t or "", re.A)
            if m:
                out[i, target] = m[0]
    return out


def frames(spark, texts, entities):
    return spark.createDataFrame(texts, "id string, text string"), spark.createDataFrame(entities, "var_name string, name string, aliases array<string>")


WORDS = ["theory", "mind", "of", "Brand#2", "Brand#25", "naïve", "été-vous", "\\E.*", "(x", "a_b", "12", "éééééé", "Ж"]


@pytest.mark.parametrize("seed", [1, 2])
def test_mentions_equal_nested_loops(spark, seed):
    r = random.Random(seed)
    some = lambda k: "".join(r.choice(WORDS) + r.choice([" ", " ", "", "-", ", "]) for _ in range(r.randint(1, k)))
    entities = [(f"e{i}", r.choice([some(3), some(2), None, ""]), r.choice([None, [], [some(2)], [some(3), None, some(1)]])) for i in range(150)]
    texts = [(f"e{i}", some(30)) for i in range(120)] + [("n", None), ("m", ""), ("long", some(20) * 2000)]
    t, e = frames(spark, texts, entities)
    want = brute(texts, entities)
    got = {(x["id"], x["target"]): x["surface"] for x in M.mentions(t, M.surfaces(e)).collect()}
    assert got == want and len(want) > 100


def test_surfaces(spark):
    rows = [("a", "  Name of it ", ["Name of it", "short", "x" * 60, "y" * 61, "ééé", "éé"]), ("b", None, None), ("c", "", [])]
    _, e = frames(spark, [], rows)
    assert sorted((r["target"], r["surface"], r["place"]) for r in M.surfaces(e).collect()) == [("a", "Name of it", 0), ("a", "x" * 60, 3), ("a", "ééé", 5)]


def test_drift(spark):
    entities = [("Ann", "Ann Example", ["A. Example"]), ("Bob", "Bobby Tables", None), ("Cat", "Catherine", None), ("Dog", "Doggerel", ["Ann Example"]), ("Far", "Far Away", None)]
    texts = [("Ann", "Ann Example met Bobby Tables, Catherine and Doggerel Far Away."), ("Bob", "Not Catherine's, but A. Example!"), ("Far", "Catherines; Bobby Tables_ and Doggerel"), ("Cat", None)]
    t, e = frames(spark, texts, entities)
    claims = spark.createDataFrame([("Ann", "Mid"), ("Mid", "Cat"), ("Bob", "Ann"), ("Far", None)], "subject string, object string")
    exempt = spark.createDataFrame([("Ann", "Dog"), ("Ann", "Dog"), ("Far", "Cat")], "entity string, target string")
    got = M.drift(t, e, claims, exempt)
    assert sorted(tuple(r) for r in got.collect()) == [("Ann", "Dog", "Ann Example", True), ("Ann", "Far", "Far Away", False), ("Bob", "Cat", "Catherine", False), ("Far", "Dog", "Doggerel", False)]
    assert sorted(tuple(r) for r in M.report(got).collect()) == [("Ann", 1, 1, "Far"), ("Bob", 1, 0, "Cat"), ("Far", 1, 0, "Dog")]
    assert M.drift(t.limit(0), e, claims, exempt).count() == 0


def test_related_equals_brute_force(spark):
    r = random.Random(4)
    edges = [(str(r.randrange(40)), str(r.randrange(60))) for _ in range(50)] + [("hub", str(i)) for i in range(30)]
    adj = {}
    for u, v in edges:
        adj.setdefault(u, set()).add(v)
        adj.setdefault(v, set()).add(u)
    nodes = sorted({*adj, "none"})
    pairs = [(a, b) for a in nodes for b in nodes if a != b]
    want = {(a, b) for a, b in pairs if b in adj.get(a, ()) or any(b in adj[m] for m in adj.get(a, ()))}
    claims = spark.createDataFrame(edges, "subject string, object string")
    got = M.related(spark.createDataFrame(pairs, "a string, b string"), claims)
    assert {tuple(x) for x in got.collect()} == want


@pytest.mark.parametrize("least", [1, 50, 10_000])
def test_salted_join(spark, least):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"), F.col("id").alias("x"))
    few = spark.range(120).select(F.col("id").alias("k"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("y"))
    got = skew.join_salted(many, few, "k", least)
    assert got.columns == ["k", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(few, "k").collect()))
    assert skew.join_salted(many.limit(0), few, "k").count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_drift_equals_brute_force(spark, seed):
    """Kinds with many targets, briefs named alike, paths of one and two claims of several predicates, marks that aren't mentions."""
    r = random.Random(seed)
    names = ["Red Widget", "Blue Gadget", "Brand#25", "Grey Thing"]
    entities = [(f"e{i}", r.choice(names), r.choice([None, [r.choice(names)], ["Odd Name"]])) for i in range(60)]
    texts = [(f"e{i}", ", ".join(r.sample(names, r.randint(0, 2)))) for i in range(70)]
    edges = [(r.choice("PQR") + "s", f"e{r.randrange(75)}", f"e{r.randrange(75)}") for _ in range(60)] + [("P", "e1", None), (None, "e3", "e4")] + [("Hub", f"e{i}", "hub") for i in range(0, 70, 9)]
    adj = {}
    for _, u, v in edges:
        if v:
            adj.setdefault(u, set()).add(v)
            adj.setdefault(v, set()).add(u)
    marks = [(f"e{r.randrange(70)}", f"e{r.randrange(60)}") for _ in range(400)]
    near = lambda a, b: b in adj.get(a, ()) or any(b in adj[m] for m in adj.get(a, ()))
    t, e = frames(spark, texts, entities)
    want = {(a, b, s, (a, b) in set(marks)) for (a, b), s in brute(texts, entities).items() if not near(a, b)}
    args = t, e, spark.createDataFrame(edges, "predicate string, subject string, object string"), spark.createDataFrame(marks, "entity string, target string")
    got = M.drift(*args)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 300
    assert sorted(map(tuple, M.drift_report(*args).collect())) == sorted(map(tuple, M.report(got).collect()))


def test_pairs_are_not_shuffled(spark):
    """40 texts that name 500 targets each: nothing that is shuffled or stored has the 20,000 pairs."""
    t, e = frames(spark, [(f"t{i}", "a Red Widget") for i in range(40)], [(f"e{i}", "Red Widget", None) for i in range(500)])
    got = M.mentions(t, M.surfaces(e))
    assert got.count() == 20_000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") == 1


def test_lists_of_targets_travel_whole(spark, monkeypatch):
    """40 suppliers that each name another part and one brand of 500: brands meet them as one list, not as 20,000 rows."""
    joined, keep = [], M.join_salted
    monkeypatch.setattr(M, "join_salted", lambda many, few, key, *a: (joined.append((key, keep(many, few, key, *a).count())), keep(many, few, key, *a))[1])
    t, e = frames(spark, [(f"t{i}", f"a Widget{i}x of Brand#25") for i in range(40)], [(f"p{i}", f"Widget{i}x", None) for i in range(40)] + [(f"q{i}", "Brand#25", None) for i in range(500)])
    claims = spark.createDataFrame([("Sells", "t0", "q0")], "predicate string, subject string, object string")
    marks = spark.createDataFrame([("t0", "q0"), ("t0", "q1")], "entity string, target string")
    got = {r["entity"]: r for r in M.drift_report(t, e, claims, marks).collect()}
    assert len(got) == 40 and got["t1"]["n_open"] == 501 and (got["t0"]["n_open"], got["t0"]["n_exempted"]) == (499, 1)
    assert got["t0"]["targets"] == ",".join(sorted(["p0"] + [f"q{i}" for i in range(2, 500)]))
    assert max(n for key, n in joined if key in ("kind", "kinds")) <= 80


def test_near_in_batches(spark, monkeypatch):
    """Claims looked up a few at a time give what they give at once."""
    t, e = frames(spark, [(f"t{i}", "a Red Widget") for i in range(20)], [(f"e{i}", "Red Widget", None) for i in range(9)])
    claims = spark.createDataFrame([("P", f"t{i}", f"e{i % 9}") for i in range(20)], "predicate string, subject string, object string")
    marks = spark.createDataFrame([("t0", "e1")], "entity string, target string")
    whole = sorted(map(tuple, M.drift_report(t, e, claims, marks).collect()))
    monkeypatch.setattr(M, "CLAIMS", 3)
    assert sorted(map(tuple, M.drift_report(t, e, claims, marks).collect())) == whole and len(whole) == 20
