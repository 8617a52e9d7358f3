import collections
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import fulltext, retrieval

FORM = "kind string, doc string, text string"


def tokens(t):
    return [w for w in re.findall(r"[^\W_]+", (t or "").lower()) if len(w.encode()) >= 2]


def brute(docs, query):
    d = {k: tokens(t) for k, t in docs.items() if tokens(t)}
    n, av = len(d), sum(map(len, d.values())) / len(d)
    df = collections.Counter(t for w in d.values() for t in set(w))
    out = {}
    for k, w in d.items():
        s = sum(math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / av)) for t in query if t in w)
        if s > 0:
            out[k] = round(s, 6)
    return out


def ask(index, query, **more):
    return {(r.kind, r.doc): r.score for r in index.search(query, **({"k": None} | more)).collect()}


def some(r, n, kinds=("entity", "provenance")):
    return {(r.choice(kinds), str(i)): r.choice([" ".join(r.choices("one two three vier cinq été x 66".split(), k=r.randint(1, 12))), None, "", "! ?"]) for i in range(n)}


def rows(spark, docs):
    return spark.createDataFrame([(*k, t) for k, t in docs.items()], FORM)


def test_batches_equal_one_whole(spark, tmp_path):
    r, index, all_ = random.Random(3), fulltext.Index(spark, str(tmp_path / "i"), 4), {}
    for n in (40, 25, 60):
        docs = some(r, n)  # ids come again: those documents are replaced, some by nothing
        index.add(rows(spark, docs))
        all_ |= docs
        for query in (["one", "été", "one"], ["66"], ["none"]):
            assert ask(index, query) == brute(all_, query)
    want = brute(all_, ["two", "vier"])
    assert ask(index, ["two", "vier"], kind="entity") == {k: s for k, s in want.items() if k[0] == "entity"}
    best = sorted(want, key=lambda k: (-want[k], k))[:5]
    assert [(x.kind, x.doc) for x in index.search(["two", "vier"], 5).collect()] == best
    counts = collections.Counter(t for d in all_.values() for t in tokens(d))
    assert {x.term: x.occurrences for x in index.terms().collect()} == counts
    assert index.search([]).count() == 0


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    index = fulltext.Index(spark, str(tmp_path / "i"), 4)
    assert ask(index, ["one"]) == {}
    first, second = {("entity", "a"): "one two", ("entity", "b"): "two"}, {("entity", "c"): "one one", ("entity", "a"): "vier"}
    index.add(rows(spark, first))
    before = set((tmp_path / "i" / "sizes").iterdir())
    index.add(rows(spark, second))
    for f in set((tmp_path / "i" / "sizes").iterdir()) - before:
        f.unlink()
    for query in (["one"], ["two"], ["vier"]):
        assert ask(index, query) == brute(first, query)
    index.add(rows(spark, second))  # once more, and now to the end
    for query in (["one"], ["two"], ["vier"]):
        assert ask(index, query) == brute(first | second, query)


def test_a_query_reads_its_buckets_alone(spark, tmp_path):
    index = fulltext.Index(spark, str(tmp_path / "i"), 16)
    index.add(rows(spark, some(random.Random(5), 80)))
    read = {f.split("bucket=")[1].split("/")[0] for f in index._live(["one"]).inputFiles() if "bucket=" in f}
    plan = index._live(["one"])._jdf.queryExecution().executedPlan().toString()
    assert len(read) > 1 and "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]


@pytest.mark.parametrize("role", [None, "b"])
def test_hybrid_ranks_all_before_the_role(spark, role):
    """The rare role's documents come last in both rankings, and are still found."""
    n = 600
    lexical = spark.range(n).select(F.col("id").alias("doc"), (n - F.col("id")).cast("double").alias("score"))
    similar = spark.range(n).select(F.col("id").alias("doc"), (2.0 * n - F.col("id")).alias("score"))
    about = spark.range(n).select(F.col("id").alias("doc"), F.when(F.col("id") >= 590, "b").otherwise("a").alias("role"))
    got = [r.doc for r in retrieval.hybrid(lexical, similar, about, role, 5).collect()]
    assert got == (list(range(5)) if role is None else list(range(590, 595)))


def test_a_batch_leaves_no_tokens_behind(spark, tmp_path):
    from tessera.sources.stored import shared_dir

    place = shared_dir(spark).removeprefix("file:")
    held = lambda: {f for f in os.listdir(place) if f.startswith(("index-tokens", "index-again"))}
    before, index = held(), fulltext.Index(spark, str(tmp_path / "index"))
    for text in ("red red widget", "red building"):
        index.add(spark.createDataFrame([("entity", "a", text), ("entity", "b", "blue")], "kind string, doc string, text string"))
    assert held() == before
    assert {tuple(r) for r in index.terms().collect()} == {("red", 1, 1), ("building", 1, 1), ("blue", 1, 1)}
