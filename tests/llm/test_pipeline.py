"""The pipeline's stages, each on its own input, against brute force."""

import random

import pytest

import corpus_pipeline
from tessera.llm.tables import written
from tests.llm import brute
from tests.llm.test_text_operators import DOC


def documents(n=90):
    r = random.Random(8)
    syl = {"en": ["the", "ing", "th", "on"], "de": ["sch", "ung", "ein", "ver"]}
    out, shared = [], " ".join(f"passage{i}" for i in range(60))
    for i in range(n):
        lang = r.choice(list(syl))
        t = " ".join("".join(r.choice(syl[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(30, 120)))
        out.append((i, t + (" " + shared if i % 11 == 0 else ""), lang, "s", len(t)))
    out.append((n, out[3][1], "en", "s", 1))
    w = out[5][1].split(" ")
    w[7] = "other"
    out.append((n + 1, " ".join(w), "de", "s", 1))
    return [*out, (n + 2, "12 !!", "en", "s", 5), (n + 3, None, None, None, None)]


def test_stages(spark, tmp_path):
    rows = documents()
    item = " ".join(rows[20][1].split(" ")[4:20])
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, str(tmp_path)), "test-stage")
        seen[name] = (before, {r["doc_id"]: r.asDict() for r in docs.collect()})
    before, after = seen["language_id"]
    assert set(before) - set(after) == {92, 93}
    before, after = seen["near_dedup"]
    classes = brute.near(sorted(before.items()))
    assert set(after) == set(classes.values()) and 90 not in after and 91 not in after
    before, after = seen["substring_dedup"]
    want = brute.substrings(sorted(before.items()))
    assert set(after) == {i for i in before if want[i][1] < max(1, want[i][0])}
    assert all(len(brute.spaced(r["text"])) == want[i][0] - want[i][1] for i, r in after.items())
    before, after = seen["decontamination"]
    hit = brute.contamination(sorted(before.items()), [(1, item)])
    assert set(after) == {i for i in before if not hit[i][1]} and 20 not in after
    before, after = seen["sentencepiece"]
    assert set(before) == set(after) and all(r["round_trip"] for r in after.values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_nothing(spark, tmp_path, k):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], DOC), str(tmp_path)).count() == 0
