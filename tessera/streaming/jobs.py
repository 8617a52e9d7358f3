"""Structured Streaming forms of the incremental behaviours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..sources.stored import written


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def unseen(papers: DataFrame, late: str | None = None) -> DataFrame:
    """Papers whose id was never seen before; an id stays known for ever, in the state store.

    With ``late`` (an interval over ts) an id is forgotten that long after, and the state stays bounded.
    """
    if late is None:
        return papers.dropDuplicates(["paper_id"])
    return papers.withWatermark("ts", late).dropDuplicatesWithinWatermark(["paper_id"])


def latest_per_key(events: DataFrame, key: str) -> DataFrame:
    """Running latest value of each key (complete mode)."""
    return events.groupBy(key).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))


def windowed(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts by kind: an addition of this engine."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Drain what is there into parquet and stop."""
    return df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emit(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events as JSON lines; several writers may, each with a folder of its own below path."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(events: DataFrame, n: int) -> DataFrame:
    """The last n events, oldest first."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n).orderBy("ts", "event_id")


def refresh(changes: DataFrame, build, place: str, checkpoint: str):
    """Rebuild a snapshot (build(batch) -> DataFrame) whenever files came; a batch that fails leaves the last one in place."""

    def swap(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        build(batch).write.mode("overwrite").parquet(f"{place}/{number}")
        batch.sparkSession.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").json(f"{place}/ready")

    return changes.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, place: str) -> DataFrame:
    """The latest snapshot that was finished."""
    number = spark.read.schema("number long").json(f"{place}/ready").agg(F.max("number")).first()[0]
    return spark.read.parquet(f"{place}/{number}")


def due(events: DataFrame, hours: float, now: str) -> DataFrame:
    """(hours, fire): whether the last event is so long ago; without any, it fires."""
    ago = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.max("ts").cast("timestamp"))) / 3600
    return events.agg(ago.alias("hours")).select("hours", F.coalesce(F.col("hours") >= hours, F.lit(True)).alias("fire"))


def monthly(events: DataFrame, cap: float) -> DataFrame:
    """Running spend of each month and what is left of the cap (complete mode); a new month begins at nothing."""
    return events.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("value").alias("spent")).withColumn("left", F.lit(cap) - F.col("spent"))


SETTLED = "month string, request_id long, allowed boolean, spent double"


def settled(requests: DataFrame, cap: float) -> DataFrame:
    """(month, request_id, allowed, spent) of requests (ts, request_id, estimate, actual) against a monthly cap.

    A request is allowed if its estimate fits into what the month has left, and is then
    settled at its actual cost (the estimate, while that is null); one that isn't allowed
    costs nothing.  So each decision depends on those before it: a month's state is what it
    has spent, and a month begins at nothing.  Requests of one batch are taken by ts, then
    id; a replay after a failure starts from the state of the batch before, and decides alike.
    """

    def go(key, frames, state):
        spent = state.get[0] if state.exists else 0.0
        batch = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "request_id"], kind="stable")
        rows = []
        for r in batch.itertuples(index=False):
            allowed = bool(r.estimate <= cap - spent)
            if allowed:
                spent += float(r.estimate if pd.isna(r.actual) else r.actual)
            rows.append((key[0], r.request_id, allowed, spent))
        state.update((spent,))
        yield pd.DataFrame(rows, columns=["month", "request_id", "allowed", "spent"])

    by = requests.withColumn("month", F.date_format("ts", "yyyy-MM")).groupBy("month")
    return by.applyInPandasWithState(go, SETTLED, "spent double", "append", GroupStateTimeout.NoTimeout)


def retried(requests: DataFrame, answer) -> DataFrame:
    """answer(DataFrame) -> (id, reply): those without a reply are asked once more.

    The first round's answers are written before they are read: each request is sent once a round.
    """
    good = written(answer(requests), "answers").where("reply is not null and reply <> ''")
    again = written(answer(requests.join(good.select("id"), "id", "left_anti")), "answers")
    return good.withColumn("round", F.lit(1)).unionByName(again.withColumn("round", F.lit(2)))


#: The order of a tick's phases.
PHASES = ("bias", "sense", "resolve", "ingest", "trip", "dream", "calibrate")


def tick(phases: dict, gates: dict | None = None) -> list[str]:
    """Run the phases (name -> callable) in their order, but those whose gate (name -> bool) is shut; the names of those run."""
    ran = []
    for name in PHASES:
        if name in phases and (gates or {}).get(name, True):
            phases[name]()
            ran.append(name)
    return ran
