import itertools
import json
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, html_extract, tool_calls, url_rules


def test_nearest_recall_and_bad_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 16)).round(3)
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)]
    bad = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [None] * 16), (1080, [1.0] * 5), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    out = ann.nearest(df, F.expr("vec_id % 20 = 0"), k=10, block=7).toPandas()
    assert set(out.query_id) == set(range(0, 400, 20)) and (out.groupby("query_id").size() == 10).all()
    hit = 0
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(400), -s))[:10])
        own = out[out.query_id == q].sort_values("rank")
        hit += len(best & set(own.vec_id))
        assert np.allclose(own.score, [x[i] @ x[q] for i in own.vec_id]) and list(own.score) == sorted(own.score, reverse=True)
    assert hit / 200 >= 0.9
    assert ann.nearest(df.limit(0), F.expr("vec_id % 20 = 0")).count() == 0


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_nearest_of_many_equal_vectors(spark, metric):
    r = np.random.default_rng(8)
    x = r.normal(size=(1500, 8)).round(3)
    x[r.permutation(1500)[:700]] = 3 * x[0]  # one vector in almost half of the rows
    ids = r.permutation(1500)
    df = spark.createDataFrame([(int(i), [float(v) for v in x[i]]) for i in ids], "vec_id long, embedding array<double>").coalesce(1)
    out = ann.nearest(df, F.expr("vec_id % 30 = 0"), k=20, metric=metric).toPandas()
    for q in range(0, 1500, 30):
        s = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s.round(9)))[:20]
        own = out[out.query_id == q].sort_values("rank")
        assert len(set(own.vec_id) & set(best)) >= 18, q


@pytest.mark.parametrize("parts", [1, 6])
def test_recall_where_reranking_reads_a_sixtieth(spark, parts):
    r = np.random.default_rng(3)
    x = r.normal(size=(50_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64)})).repartition(parts)
    out = ann.nearest(df, F.expr("vec_id % 500 = 0"), block=60).toPandas()
    hit = 0
    for q, own in out.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(set(own.vec_id) & set(np.argpartition(-s, 20)[:20]))
    assert len(out) == 2000 and hit / 2000 >= 0.95


def test_additive_codes_get_nearer_with_books_and_beam():
    x = np.random.default_rng(2).normal(size=(500, 12))
    err = lambda b, beam: (lambda q: ((x - q.decode(q.encode(x, beam))) ** 2).sum())(ann.Quantiser(x, books=b, words=32))
    assert err(4, 4) < err(2, 4) < err(1, 4)
    assert err(4, 8) <= err(4, 1)


def test_url_rules(spark):
    urls = ["http://a.com/x", "https://Sub.Example.com/en/1?q=2", "http://www.example.com/en/1", "http://b.net/es/", "http://c.net/es", "http://com", "x", None, "http://notexample.com/en/", "http://e.org/p#/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(df, none).collect()}
    assert got == {
        0: ("a.com", "/x", "com/", "allow"),
        1: ("sub.example.com", "/en/1", "example.com/en/", "block"),
        2: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        3: ("b.net", "/es/", "net/es/", "block"),
        4: ("c.net", "/es", None, "allow"),
        5: ("com", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("notexample.com", "/en/", "com/", "allow"),
        9: ("e.org", "/p", None, "allow"),
    }


def test_mined_rules_match_all_their_tokens(spark):
    r = random.Random(1)
    rows = []
    for i in range(400):
        host, word = r.choice(["spam", "good"]), r.choice(["win", "news"])
        rows.append((f"http://{host}.org/{word}/{i}", host == "spam" and word == "win"))
    df = spark.createDataFrame(rows, "url string, bad boolean")
    rules = url_rules.mine(df)
    assert sorted(map(tuple, (x["items"] for x in rules.collect()))) == [("h:spam.org", "p:win")]
    pages = df.withColumn("page_id", F.monotonically_increasing_id())
    out = url_rules.judge(pages, rules, carry=("page_id", "bad")).collect()
    assert all((x["verdict"] == "block") == x["bad"] for x in out)


def test_rules_do_not_vanish_in_a_larger_table(spark):
    """A bad host of 12 urls is found among 400 labelled urls and among 20,000."""
    for n in (400, 20_000):
        rows = [(f"http://bad.org/{i}", True) for i in range(12)] + [(f"http://host{i % 40}.org/{i}", False) for i in range(n - 12)]
        rules = url_rules.mine(spark.createDataFrame(rows, "url string, bad boolean"))
        assert [tuple(x["items"]) for x in rules.collect()] == [("h:bad.org",)]


def brute_rules(rows, sure, least):
    """Every combination of tokens, by counting; those with a part that is as sure go (shortest first)."""
    baskets = [({"h:" + h, *("p:" + w for w in words)}, bad) for h, words, bad in rows]
    every = sorted({t for b, _ in baskets for t in b})
    rules = {}
    for k in range(1, 5):
        for combo in itertools.combinations(every, k):
            met = [bad for b, bad in baskets if set(combo) <= b]
            if sum(met) >= least and sum(met) / len(met) >= sure:
                rules[combo] = sum(met) / len(met)
    return {c: v for c, v in rules.items() if not any(rules.get(c[:i] + c[i + 1 :], 0) >= v for i in range(len(c)))}


def test_mined_rules_equal_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        h, words = r.choice(["a.org", "b.org", "c.org"]), sorted({r.choice(["x", "y", "z", "w"]) for _ in range(r.randint(1, 4))})
        rows.append((h, words, r.random() < (0.9 if {"x", "y"} <= set(words) else 0.5 if h == "b.org" else 0.15)))
    df = spark.createDataFrame([(f"http://{h}/{'/'.join(words)}/{i}", bad) for i, (h, words, bad) in enumerate(rows)], "url string, bad boolean")
    got = {tuple(x["items"]): x["confidence"] for x in url_rules.mine(df, min_confidence=0.55).collect()}
    want = brute_rules(rows, 0.55, 10)
    assert set(got) == set(want) and got and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    # Matching, against every rule in turn.
    rules = url_rules.mine(df, min_confidence=0.55)
    out = url_rules.judge(df.withColumn("page_id", F.monotonically_increasing_id()), rules, explicit=(), carry=("url",)).collect()
    for x in out:
        has = {"h:" + x["host"], *("p:" + w for w in x["path"].split("/") if w.isalpha())}
        fit = [c for k, c in want.items() if set(k) <= has]
        assert (x["verdict"] == "block") == bool(fit) and (not fit or abs(x["confidence"] - max(fit)) < 1e-12)


def test_rules_against_the_base_rate(spark):
    """Urls of one kind are bad three times as often as others, though seldom; long urls that repeat make no blow-up."""
    r = random.Random(7)
    rows = [(f"http://h{i % 7}.org/{'risky' if i % 5 == 0 else 'plain'}/{i}", r.random() < (0.36 if i % 5 == 0 else 0.12)) for i in range(3000)]
    rows += [("http://long.org/" + "/".join(f"w{chr(97 + j)}" for j in range(26)) + f"?{i}", i % 2 == 0) for i in range(24)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    assert url_rules.mine(df).count() == 0
    train, held = df.where("xxhash64(url) % 4 <> 0"), df.where("xxhash64(url) % 4 = 0")
    rules = url_rules.mine(train, min_confidence=None)
    assert ("p:risky",) in [tuple(x["items"]) for x in rules.collect()]
    out = url_rules.judge(held, rules, carry=("bad",)).where("rule is null").collect()
    hit = [x["bad"] for x in out if x["verdict"] == "block"]
    assert len(hit) > 50 and sum(hit) / len(hit) > 1.5 * sum(x["bad"] for x in out) / len(out)


def test_url_filter_of_nothing_repeated_rows_and_clash(spark):
    rules = spark.createDataFrame([(["h:a.org"], 1.0, "h:a.org")], "items array<string>, confidence double, key string")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none, rules).count() == 0
    df = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None), (2, None), (3, "")], "page_id long, url string")
    assert sorted((x["page_id"] or 0, x["verdict"]) for x in url_rules.judge(df, rules).collect()) == [(0, "allow"), (1, "block"), (1, "block"), (2, "allow"), (3, "allow")]
    with pytest.raises(ValueError):
        url_rules.judge(df.withColumn("host", F.lit(1)), rules, carry=("host",))


def test_extraction(spark):
    words = [f"word{i}" for i in range(3000)]
    pool = spark.createDataFrame([(i, "<html><body><nav><a href='/'>Home</a></nav><article><p>" + " ".join(words[i * 20 : i * 20 + 60]) + ".</p></article><footer>Foot</footer></body></html>") for i in range(40)], "page_id long, html string")
    net = html_extract.train(pool)
    r = np.random.default_rng(99)
    fresh = [html_extract.made_page(r, words) for _ in range(60)]
    right = total = 0
    for page, told in fresh:
        got = html_extract.blocks(page)
        prob, _ = net.forward(html_extract.features([got]))
        want = dict(told)
        for (_, t, _), p in zip(got, prob, strict=True):
            if t in want:
                total += 1
                right += (p >= 0.5) == want[t]
    assert right / total > 0.95
    page = "<body><nav><ul><li><a href='/'>Menu</a></ul></nav><script>var a='<p>no</p>'</script><article><h1>A &amp; B</h1><p>first  line<br>second &lt;x&gt; and some more words here.<p>last <b>bold</b> part of the text, with words.</article><footer>&copy; me</footer>"
    out = {x["page_id"]: x for x in html_extract.extract(spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string"), net, carry=("page_id",)).collect()}
    assert out[1]["text"] == "A & B first line second <x> and some more words here. last bold part of the text, with words."
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == out[3]["text"] == ""


def test_blocks_of_pages_written_by_hand():
    """What the parser cuts a page into: text and characters within links."""
    cut = lambda page: [(t, n) for _, t, n in html_extract.blocks(page)]
    assert cut("<p>a<p>b<ul><li>c<li><a href=x>d</a>e</ul>") == [("a", 0), ("b", 0), ("c", 0), ("de", 1)]
    assert cut("x<!-- <p>no</p> -->y<!doctype z><br>w") == [("xy w", 0)]
    assert cut("<div title='a>b' class=\"q\">1 < 2 &lt; 3</div") == [("1 < 2 < 3", 0)]
    assert cut("<script>if (a<b) '<p>'</SCRIPT >t<style>u") == [("t", 0)]
    assert cut("<p>one</b></div>two</i></p>three<a>four<span>five</a>six") == [("one", 0), ("two", 0), ("threefourfivesix", 8)]
    assert cut("<p>\u00a0 x\n\ty &amp;amp; z</p><p> </p>") == [("x y &amp; z", 0)]
    assert cut("") == cut("<div><p></p></div>") == cut("<!-- never closed") == []
    assert cut("a <b c='") == [("a", 0)] and cut("a <3 <") == [("a <3 <", 0)]


@pytest.mark.parametrize("page", ["<div>" * 200_000, '<a b="c" ' * 110_000, "".join(f"<div class='c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}'>t" for i in range(30_000)), "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<!" * 500_000, "<a '\"'>" * 100_000, "<div>" * 80_000 + "</p>" * 120_000, "word " * 200_000])
def test_long_and_broken_pages_take_time_in_proportion(page):
    began = time.process_time()
    html_extract.main_text(html_extract.Labeller(), [page])
    assert time.process_time() - began < 8


def test_extraction_of_nothing_repeated_rows_and_clash(spark):
    net = html_extract.Labeller()
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(none, net).count() == 0
    assert isinstance(html_extract.train(none), html_extract.Labeller)
    rows = [(1, "u", "<p>" + "long text " * 30_000 + "</p>"), (1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), net).collect()
    assert len(out) == 4 and all(x["n_chars"] == len(x["text"]) for x in out)
    with pytest.raises(ValueError):
        html_extract.extract(none.withColumnRenamed("url", "text"), net, carry=("page_id", "text"))


CALL = "conv_id long, call_id string, position long, name string, arguments string, after array<string>"


def test_tool_calls(spark):
    calls = [
        (1, "a", 0, "add", '{"y": 2, "x": 1}', []),
        (1, "b", 1, "add", '{"x": "one", "y": 2}', ["a"]),
        (1, "c", 2, "add", "{", ["b", "a", "gone"]),
        (1, "d", 3, "what", "{}", ["e"]),
        (1, "e", 4, "add", None, ["d"]),
        (1, "a", 9, "add", '{"x": 5, "y": 5}', []),
        (2, "a", 0, "add", '{"x": 1, "y": 1, "z": NaN}', None),
        (None, "a", 0, "add", "{}", []),
    ]
    results = [(1, "a", 5, "3"), (1, "a", 6, "4"), (1, "zz", 7, "lost"), (2, "a", 1, None)]
    schema = {"type": "object", "required": ["x", "y"], "additionalProperties": False, "properties": {"x": {"type": "number"}, "y": {"type": "number"}}}
    out = tool_calls.link(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, "conv_id long, call_id string, position long, content string"), {"add": schema}).collect()
    apart = {(r["conv_id"], r["call_id"], r["position"], r["status"], *r["errors"]) for r in out if r["status"].startswith("repeated") or r["status"] == "no_identifier"}
    assert apart == {(1, "a", 9, "repeated_call", "$: repeated identifier"), (1, "a", 6, "repeated_result", "$: repeated identifier"), (None, "a", 0, "no_identifier", "$: no identifier", "$.x: missing", "$.y: missing")}
    got = {(r["conv_id"], r["call_id"]): r for r in out if r["status"] in ("linked", "no_result", "no_call")}
    assert len(out) == len(got) + 3 == 10
    assert {k[1]: r["level"] for k, r in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "zz": None}
    assert got[1, "a"]["json"] == '{"call":{"arguments":{"x":1,"y":2},"id":"a","name":"add"},"result":"3"}'
    assert [got[1, k]["valid"] for k in "abcde"] == [True, False, False, False, False]
    assert got[1, "b"]["errors"] == ["$.x: not number"] and got[2, "a"]["errors"] == ["$: not JSON"]
    assert (got[1, "zz"]["status"], got[1, "b"]["status"], got[2, "a"]["status"]) == ("no_call", "no_result", "linked")
    assert all(json.loads(r["json"]) is not None for r in out)


def brute_levels(calls):
    """Longest chain of needs of each call; None in or behind a cycle."""
    ids = {(c, i) for c, i, *_ in calls}
    needs = {(c, i): {(c, n) for n in after if (c, n) in ids} for c, i, _, after in calls}
    level = {}
    for _ in range(len(ids) + 1):
        level.update({k: max((level[n] + 1 for n in v), default=0) for k, v in needs.items() if k not in level and all(n in level for n in v)})
    return {k: level.get(k) for k in ids}


@pytest.mark.parametrize("rows", [20_000, 7])
def test_levels_equal_brute_force(spark, rows):
    """Whole conversations, and ones in chunks: chains, forward needs, cycles, equal positions."""
    r = random.Random(8)
    calls = [(1, f"c{i}", i, [f"c{i - 1}"]) for i in range(60)]
    calls += [(2, f"c{i}", r.randrange(40), [f"c{r.randrange(i)}" for _ in range(r.randint(0, 3))] if i else []) for i in range(50)]
    calls += [(3, f"c{i}", 5, [f"c{i + 1}"]) for i in range(30)]
    calls += [(4, f"c{i}", None if i % 5 == 0 else i, [f"c{r.randrange(40)}"]) for i in range(40)] + [(5, "x", 0, ["x"]), (5, "y", 1, []), (6, "z", 0, ["none"])]
    df = spark.createDataFrame(calls, "conv_id long, call_id string, position long, after array<string>").repartition(3)
    got = {(x["conv_id"], x["call_id"]): x["level"] for x in tool_calls.levels(df, rows).collect()}
    assert got == brute_levels(calls)


def test_tool_calls_of_nothing_equal_positions_and_clash(spark):
    none = spark.createDataFrame([], CALL)
    results = spark.createDataFrame([], "conv_id long, call_id string, position long, content string")
    assert tool_calls.link(none, results, {}).count() == 0
    calls = spark.createDataFrame([(1, "a", 0, "t", '{"k":1}', []), (1, "a", 0, "t", '{"k":1}', []), (1, "a", 0, "s", "{}", None)], CALL).withColumn("level", F.lit(9)).withColumn("status", F.lit("x"))
    out = tool_calls.link(calls, results, {}).collect()
    assert sorted((x["name"], x["status"], x["level"]) for x in out if x["level"] is not None) == [("s", "no_result", 0)]
    assert sorted((x["name"], x["status"]) for x in out) == [("s", "no_result"), ("t", "repeated_call"), ("t", "repeated_call")]


@pytest.mark.parametrize("value,schema,n", [([1, 2], {"type": "array", "items": {"type": "string"}}, 2), ("ab", {"pattern": "^a", "maxLength": 1}, 1), (3, {"enum": [1, 2]}, 1), (True, {"type": "integer"}, 1), (2.0, {"type": "integer"}, 0)])
def test_schema_keywords(value, schema, n):
    assert len(tool_calls.violations(value, schema)) == n
