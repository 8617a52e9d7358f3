"""Names from briefs, queries of sensors and rejected claims, by hand-made cases."""

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import retrieval as R


def test_derive_names(spark):
    rows = [("The ore-sorting conveyor belt: how it works", "OresortingConveyorBelt", "Ore-sorting conveyor belt"), ("a b", "Note20240102030405", "Note 2024-01-02"), (None, "Note20240102030405", "Note 2024-01-02"), ("one two three four five", "OneTwoThreeFour", "One two three four"), ("2024 in review (short)", "024Review", None)]
    df = spark.createDataFrame([r[:1] for r in rows], "brief string")
    name, shown = X.derive_names(F.col("brief"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    got = {r["brief"]: (r["n"], r["s"]) for r in df.select("brief", name.alias("n"), shown.alias("s")).collect()}
    for brief, n, s in rows[:4]:
        assert got[brief] == (n, s)
    # once its first digit is gone the name still begins with one, so that none is left
    assert got["2024 in review (short)"] == ("Note20240102030405", "Note 2024-01-02")


def test_a_display_name_begins_with_one_letter(spark):
    rows = [("\u00dfbest der", "\u1e9ebest der"), ("\u00e4hnlich", "\u00c4hnlich"), ("\u1f80abc", "\u1f88abc"), ("\ufb01nal", "\ufb01nal")]
    df = spark.createDataFrame(rows, "brief string, want string")
    _, shown = X.derive_names(F.col("brief"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert [r for r in df.select("brief", shown.alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_sensor_query(spark):
    rows = [
        ("BaloneyDetectionKit", "Baloney Detection Kit", "tools for thinking", "Carl Sagan", "Sagan Baloney Detection"),
        ("DarkForestThesis", "every one of these words makes for a long name", "", "", "Dark Forest"),
        ("Apophenia", "Apophenia", "seeing patterns in random data with apophenia", None, "Apophenia seeing patterns random"),
        ("ChaosTheory", "Theory", "", "", "Chaos"),
        ("X", None, None, None, ""),
    ]
    df = spark.createDataFrame(rows, "v string, n string, b string, p string, want string")
    for r in df.select("want", X.sensor_query(F.col("v"), F.col("n"), F.col("b"), F.col("p")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_anti_exemplars(spark):
    code = "a\n// 2026-04-27 audit: `A Of B` was deleted here. It was\n\t//   wrong.\nb\n// `C Of D` no audit\n// 2026-04-28 audit: no phrase\n\n//2026-04-29 audit: `E Of F` is bad\n// 2026-04-30 audit: `G Of H`"
    df = spark.createDataFrame([("f", code), ("g", None), ("h", "")], "file string, text string")
    got = sorted(tuple(r) for r in R.anti_exemplars(df).collect())
    assert got == [("f", "A Of B", "It was wrong."), ("f", "E Of F", "2026-04-29 audit: `E Of F` is bad 2026-04-30 audit: `G Of H`")]
    assert R.anti_exemplars(df, n=1).count() == 1


def test_pick_across(spark):
    rows = [("a", "b", "1", "2", 1, 900), ("c", "d", "2", "1", 1, 800), ("e", "f", "1", "3", 1, 400), ("g", "h", "1", "3", 9, 200), ("i", "j", "1", "1", 9, 900), ("k", "l", "2", "3", 8, 999)]
    df = spark.createDataFrame(rows, "a string, b string, cluster_a string, cluster_b string, score int, affinity int")
    refuted = spark.createDataFrame([("l", "k")], "a string, b string")
    pick = lambda n: [(r["a"], r["rank"]) for r in R.pick_across(df, refuted, n).collect()]
    assert pick(9) == [("a", 962), ("e", 462), ("c", 862)]
    assert pick(2) == [("a", 962), ("e", 462)]
    assert R.pick_across(df.limit(0), refuted, 3).count() == 0
