from datetime import datetime, timedelta

from tessera.streaming import jobs

PAPER = "paper_id string, ts timestamp"
ASK = "ts timestamp, request_id long, estimate double, actual double"


def drain(spark, tmp_path, schema, make, batches):
    """The rows that come out, with a stop and a new start of the query after every batch."""
    got = []
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = make(jobs.read_events(spark, str(tmp_path / "in"), schema))
        jobs.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        n = len(got)
        got = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=str)
        assert len(got) >= n and k >= 0
    return got


def test_an_id_stays_known_for_years(spark, tmp_path):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    batches = [[("a", day(0)), ("b", day(0)), ("a", day(1))], [("c", day(60)), ("a", day(60))], [("b", day(800)), ("d", day(3))]]
    got = drain(spark, tmp_path, PAPER, jobs.unseen, batches)
    assert sorted(r.paper_id for r in got) == ["a", "b", "c", "d"]


def test_settled_budget_equals_a_loop(spark, tmp_path):
    at = lambda month, hour: datetime(2024, month, 5, hour)
    batches = [
        [(at(1, 3), 3, 40.0, None), (at(1, 1), 1, 50.0, 20.0), (at(1, 2), 2, 90.0, 1.0)],
        [(at(1, 4), 4, 40.0, 70.0), (at(1, 5), 5, 1.0, 1.0), (at(2, 1), 6, 100.0, 99.5), (at(2, 2), 7, 0.5, 0.25)],
        [(at(2, 3), 8, 0.3, 0.3), (at(2, 4), 9, 0.25, 9.0)],
    ]
    spent, want = {}, []
    for rows in batches:
        for ts, i, estimate, actual in sorted(rows):
            month = ts.strftime("%Y-%m")
            ok = estimate <= 100 - spent.get(month, 0.0)
            spent[month] = spent.get(month, 0.0) + ((estimate if actual is None else actual) if ok else 0.0)
            want.append((month, i, ok, spent[month]))
    got = drain(spark, tmp_path, ASK, lambda s: jobs.settled(s, 100.0), batches)
    assert sorted(tuple(r) for r in got) == sorted(want) and {r[2] for r in want} == {True, False}
