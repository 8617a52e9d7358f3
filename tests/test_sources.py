"""Sources, sinks and streams on small literal files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.sources import files, markdown
from tessera.streaming import jobs


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_json_logs(spark, tmp_path):
    put(tmp_path / "log.json", json.dumps({"cycles": [{"hypothesis": "a", "n": 1}, {"hypothesis": "b"}]}))
    got = files.read_log(spark, str(tmp_path / "log.json"), "hypothesis:string,n:int").collect()
    assert [(r["pos"], r["hypothesis"], r["n"]) for r in got] == [(0, "a", 1), (1, "b", None)]
    put(tmp_path / "rows.jsonl", '{"k": 1}\n\n{"k": 2}\n{"k": \n{"k": 3}\n')
    assert [r["k"] for r in files.read_lines(spark, str(tmp_path / "rows.jsonl"), "k int").collect()] == [1, 2, 3]
    marked = files.read_lines_marked(spark, str(tmp_path / "rows.jsonl"), "k int")
    assert [r["k"] for r in files.before_malformed(marked).collect()] == [1, 2]
    files.append_json(spark.createDataFrame([(1,)], "k int"), str(tmp_path / "out"))
    files.append_json(spark.createDataFrame([(2,)], "k int"), str(tmp_path / "out"))
    assert sorted(r["k"] for r in files.read_lines(spark, str(tmp_path / "out"), "k int").collect()) == [1, 2]
    files.write_state(spark.createDataFrame([(9,)], "k int"), str(tmp_path / "out"))
    assert [r["k"] for r in files.read_state(spark, str(tmp_path / "out"), "k int").collect()] == [9]


def test_vault(spark, tmp_path):
    put(tmp_path / "v" / "a b.md", "---\ntitle: First\ntype: Idea\naliases: [One, 'Uno']\ntags:\n  - x\nowner: me\n---\n# Head\nLead  line with #tag and `[[no]]`.\n## Part\nSee [[Other|that]] and [c](sub/c.md#top), [web](https://x.y/z.md).\n```\n[[fenced]]\n```\n")
    put(tmp_path / "v" / "sub" / "c.md", "no heading")
    put(tmp_path / "v" / ".hidden" / "d.md", "# D")
    got = {r["rel_path"]: r for r in files.read_vault(spark, str(tmp_path / "v")).collect()}
    assert set(got) == {"a b.md", "sub/c.md"}
    a = got["a b.md"]
    assert (a["title"], a["type"], a["aliases"], a["tags"], a["frontmatter"], a["lead"]) == ("First", "Idea", ["One", "Uno"], ["x", "tag"], {"owner": "me"}, "Lead line with #tag and `[[no]]`.")
    assert [(x["target"], x["section"], x["display"], x["wiki"]) for x in a["links"]] == [("Other", "Part", "that", True), ("sub/c.md", "Part", "c", False)]
    assert (got["sub/c.md"]["title"], got["sub/c.md"]["dir"]) == ("c", "sub")


@pytest.mark.parametrize("name", ["v", "a.b", "x+y", "p%20q", "two words", "(c)"])
def test_folders_named_like_their_ancestors(spark, tmp_path, name):
    root = tmp_path / "srv" / name / "srv" / name
    put(root / "x.md", "# X\ntext")
    put(root / "docs" / "y z+1.md", "# Y\ntext")
    assert {r["rel_path"] for r in files.read_vault(spark, str(root)).collect()} == {"x.md", "docs/y z+1.md"}
    assert {r["file"] for r in files.read_docs(spark, f"file:{root}/").collect()} == {"x.md", "docs/y z+1.md"}


def test_lines_of_several_files_stop_apart(spark, tmp_path):
    put(tmp_path / "l" / "a.jsonl", '{"k": 1}\n{"k": \n{"k": 2}\n')
    put(tmp_path / "l" / "b.jsonl", "".join(f'{{"k": {k}}}\n' for k in range(10, 20)))
    marked = files.read_lines_marked(spark, str(tmp_path / "l"), "k int")
    assert sorted(r["k"] for r in files.before_malformed(marked).collect()) == [1, *range(10, 20)]


def test_fences_end_by_their_own_mark():
    text = "# T\n```\ncode [[a]]\n~~~\n[[b]]\n```\n[[c]]\n~~~\n```\n# not\n~~~\n## D\n[[d]]"
    assert [x["target"] for x in markdown.links(text)] == ["c", "d"]
    assert [s[1] for s in markdown.sections(text)] == ["T", "T › D"]


def test_front_matter_of_other_systems():
    for text in ("---\r\ntitle: A\r\ntags:\r\n- x\r\n---\r\nbody", "---\ntitle: A\ntags: [x]\n...\nbody"):
        assert markdown.front_matter(text) == ({"title": ["A"], "tags": ["x"]}, "body")
    assert markdown.front_matter("---\n---\nbody") == ({}, "body") and markdown.front_matter("--- a\n---\n")[0] == {}


def test_each_request_is_sent_once_a_round(spark):
    sent = spark.sparkContext.accumulator(0)

    def answer(df):
        def go(frames):
            for f in frames:
                sent.add(len(f))
                yield f.assign(reply=["" if i % 2 else "yes" for i in f["id"]])

        return df.mapInPandas(go, "id long, reply string")

    got = jobs.retried(spark.range(10), answer)
    assert got.count() == 10 and got.where("round = 2").count() == 5 and sent.value == 15


def test_docs(spark, tmp_path):
    put(tmp_path / "d" / "docs" / "x.md", "# Top\nintro\n## A `b`!\none\n### deep\n```\n# not a head\n```\n## C\n")
    put(tmp_path / "d" / "skip.md", "# S\n")
    put(tmp_path / "d" / "docs" / "deeper" / "y.md", "# Y\n")
    got = files.read_docs(spark, str(tmp_path / "d"), ("skip.md",)).orderBy("pos").collect()
    assert [(r["anchor"], r["heading"]) for r in got] == [("top", "Top"), ("a-b", "Top › A b!"), ("c", "Top › C")]
    assert got[1]["text"] == "Top › A b!\none\n### deep\n```\n# not a head\n```"


def test_segments(spark):
    text = "word " * 300
    for t in (text, "x" * 1300, "日本" * 400, "short", "a" * 500 + " " + "b" * 100):
        got = markdown.segments(t)
        assert all(len(s.encode()) <= 512 for s in got) and "".join(got).replace(" ", "") == t.replace(" ", "")
    assert markdown.segments("a" * 500 + " " + "b" * 100) == ["a" * 500, "b" * 100]
    assert [len(r[0]) for r in spark.createDataFrame([(text,), (None,)], "t string").select(files.segments("t")).collect()] == [3, 1]


def test_feeds(spark):
    one = lambda s: spark.createDataFrame([(s,)], "value string")
    atom = "<feed><entry><id>i1</id><title>Deep\n nets</title><summary>About nets</summary><published>2024-02-03T00:00:00Z</published></entry><entry><id>i2</id><title>T</title></entry></feed>"
    assert [tuple(r) for r in files.atom_papers(one(atom)).collect()] == [("i1", "Deep nets", "About nets", 2024), ("i2", "T", "", 0)]
    rss = "<rss><channel><item><title>Rain</title><link>l1</link><description>wet weather</description><pubDate>Mon, 02 Jan 2023 10:00:00 +0000</pubDate></item><item><title>Sun</title><link>l2</link></item></channel></rss>"
    assert [tuple(r) for r in files.feed_papers(one(rss), "the weather", 5).collect()] == [("l1", "Rain", "wet weather", 2023)]
    assert files.feed_papers(one(rss), "", 5).count() == 2 and files.feed_papers(one(atom), "nets", 5).count() == 1
    assert [tuple(r) for r in files.scholar_papers(one('{"data":[{"paperId":"p","title":"t","year":2020}]}')).collect()] == [("p", "t", "", 2020)]
    assert [r["id"] for r in files.web_papers(one('{"data":[{"t":0,"url":"u","title":"x"},{"t":1,"url":"v"}]}'), 5).collect()] == ["u"]
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta delta"), (3, "alpha")], "doc long, text string")
    assert [(r["doc"], r["held"]) for r in files.relaxed(docs, ["alpha", "beta", "gamma"], 9).collect()] == [(1, 2), (2, 2)]
    assert [r["doc"] for r in files.relaxed(docs, ["alpha", "beta", "delta"], 9).collect()] == [2]


def test_sinks(spark):
    c = spark.createDataFrame([("a", None), ("b", "NONE"), ("c", "TheoryOf")], "x string, predicate string")
    assert [r["x"] for r in files.isolated(c).collect()] == ["a", "b"]
    assert [r["timestamp"] for r in files.with_time(spark.createDataFrame([("",), ("t",)], "timestamp string"), "now").collect()] == ["now", "t"]
    assert files.usage(spark.createDataFrame([(1, "q", ["--ask=secret", "-v", "word"], 5)], "ts long, tool string, argv array<string>, wall_ms int")).first()["flags"] == ["ask", "v"]


def test_bundle_round_trip(spark):
    e = spark.createDataFrame([("a", "Ann B", "who", "Person"), ("b", "Ann  B!", None, "Person"), ("t", "Thing", "", "Concept")], "var_name string, name string, brief string, role_type string")
    c = spark.createDataFrame([("c1", "Proposes", "a", "t"), ("c2", "IsX", "t", None), ("c3", "Knows", "a", "b")], "var_name string, predicate string, subject string, object string")
    docs = files.bundle(e, c)
    got = {r["path"]: r["text"] for r in docs.collect()}
    assert set(got) == {"person/ann-b.md", "person/ann-b-2.md", "concept/thing.md"}
    assert got["person/ann-b.md"].endswith("\n## Knows\n- [Ann  B!](/person/ann-b-2.md)\n\n## Proposes\n- [Thing](/concept/thing.md)")
    assert files.bundle_faults(docs).count() == 0
    bad = docs.union(spark.createDataFrame([("x.md", "no front"), ("d/y.md", "---\ntitle: z\n---\n[a](gone.md) [ok](/x.md#h) [w](https://w)"), ("log.md", "## 2024-01-02\n## 2024-01-03\n## soon")], "path string, text string"))
    assert sorted((r["path"], r["fault"], r["detail"]) for r in files.bundle_faults(bad).collect()) == [("d/y.md", "broken link", "gone.md"), ("d/y.md", "no type", ""), ("log.md", "log heading is no date", "soon"), ("log.md", "log not newest first", "2024-01-03"), ("log.md", "log not newest first", "soon")][:4] + [("x.md", "no front matter", "")]


def test_streams(spark, tmp_path):
    rows = [(i, datetime(2024, 1 + i // 3, 1 + i), f"p{i % 4}", float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, paper_id string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.read_events(spark, str(tmp_path / "in"), df.schema)
    jobs.run_available(jobs.unseen(stream()), str(tmp_path / "o1"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o1")).count() == 4
    q = jobs.latest_per_key(stream(), "paper_id").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["paper_id"]: r["value"] for r in spark.table("latest").collect()} == {"p0": 4.0, "p1": 5.0, "p2": 2.0, "p3": 3.0}
    q = jobs.monthly(stream(), 10.0).writeStream.outputMode("complete").format("memory").queryName("spent").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["month"]: r["left"] for r in spark.table("spent").collect()} == {"2024-01": 7.0, "2024-02": -2.0}
    jobs.emit(stream(), str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination(60)
    assert len(files.read_lines(spark, str(tmp_path / "o2"), "event_id long").collect()) == 6
    jobs.refresh(stream(), lambda b: b.groupBy("paper_id").count(), str(tmp_path / "snap"), str(tmp_path / "c3")).awaitTermination(60)
    assert jobs.snapshot(spark, str(tmp_path / "snap")).count() == 4
    assert [r["event_id"] for r in jobs.tail(df, 2).collect()] == [4, 5]


def test_gates_retries_and_ticks(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0),)], "ts timestamp")
    assert tuple(jobs.due(df, 24, "2024-01-02 00:00:00").first()) == (24.0, True)
    assert not jobs.due(df, 25, "2024-01-02 00:00:00").first()["fire"] and jobs.due(df.limit(0), 9, "2024-01-02 00:00:00").first()["fire"]
    asked = []

    def answer(r):
        asked.append(r.count())
        return r.select("id", F.when((F.col("id") > 1) & F.lit(len(asked) == 1), "").otherwise("yes").alias("reply"))

    out = jobs.retried(spark.range(4), answer).collect()
    assert asked == [4, 2] and sorted((r["id"], r["round"]) for r in out) == [(0, 1), (1, 1), (2, 2), (3, 2)]
    ran = []
    assert jobs.tick({"trip": lambda: ran.append(1), "bias": lambda: ran.append(0), "sense": lambda: ran.append(9)}, {"sense": False}) == ["bias", "trip"] and ran == [0, 1]


def test_chains_with_a_cycle(spark):
    df = spark.createDataFrame([("c", "b"), ("b", "a"), ("y", "x"), ("p", "q"), ("q", "p")], "newer string, older string")
    assert {tuple(r) for r in G.chains(df).collect()} == {("c", 2, "a"), ("y", 1, "x")}


@pytest.mark.parametrize("n", [1, 3, 10, 50])
def test_spaced_rows(spark, n):
    df = spark.createDataFrame([(i,) for i in range(0, 40, 2)], "pos long").repartition(5)
    got = sorted(r["pos"] for r in R.spaced(df, "pos", n).collect())
    assert got == [2 * int(i * 20 / n) for i in range(n)] if n < 20 else got == list(range(0, 40, 2))


def test_texts_by_hand(spark):
    df = spark.createDataFrame([("He met e.g. Fig. Two. Then left.", "```\nx\n```")], "a string, b string")
    got = df.select(X.summary_sentence(F.col("a")).alias("s"), X.without_fences(F.col("b")).alias("f"), X.truncate(F.lit("日本語\nx"), 7).alias("t"), X.quote_found(F.lit("A  long enough\nquoted passage here"), F.lit('"a long enough quoted"')).alias("q"), X.drift(F.lit("refuted"), F.lit("confirmed"), F.lit("a"), F.lit("b")).alias("d"), X.history_bucket(F.lit("odd"), F.lit(True)).alias("h"), X.gap_status(F.lit(""), F.lit(2), F.lit(1), F.lit(2)).alias("g"), X.novel(F.lit("A Title"), F.lit("x1"), F.array(F.lit("a-title"))).alias("n")).first()
    assert (got["s"], got["f"], got["t"], got["q"], got["d"], got["h"], got["g"], got["n"]) == ("He met e.g.", "```\nx\n```", "日本…", True, "flipped_to_confirmed", 1, "mixed_overlap", False)
