"""Observation-log analytics and statistical audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .lookup import involvement

_IS = lambda *r: F.col("resolution").isin(*r)


def verdict() -> Column:
    """Ordered rules over a hypothesis's counts."""
    c, x, i = F.col("corroborated"), F.col("challenged"), F.col("irrelevant")
    none = c + x + i == 0
    return (
        F.when(none & (F.col("n_cycles") > F.col("n_signal")), "pending")
        .when(none, "no_signal")
        .when((x > c) & (x >= i), "challenged")
        .when(c > i, "corroborated")
        .when(i > 0, "irrelevant")
        .when(x > 0, "challenged")
        .otherwise("pending")
    )


def score_hypotheses(cycles: DataFrame) -> DataFrame:
    kind = F.when(F.col("prediction_type") == "", "structural_fragility").otherwise(F.col("prediction_type"))
    names = ("corroborated", "challenged", "irrelevant", "no_signal")
    g = cycles.groupBy("hypothesis", kind.alias("prediction_type")).agg(F.count("*").alias("n_cycles"), *[F.count_if(_IS(n)).alias(n) for n in names], F.count_if(F.col("resolution") != "").alias("n_signal"))
    hit, miss = F.col("corroborated") + F.col("challenged"), F.col("irrelevant") + F.col("no_signal")
    return g.withColumn("verdict", verdict()).withColumn("precision", F.round(100 * X.pct(hit, hit + miss), 6))


def calibrate(cycles: DataFrame) -> DataFrame:
    """Signal and hit rates by backend (none reads as arxiv)."""
    backend = F.when(F.col("backend") == "", "arxiv").otherwise(F.col("backend"))
    hit, miss = F.count_if(_IS("corroborated", "challenged")), F.count_if(_IS("irrelevant", "no_signal"))
    return cycles.groupBy(backend.alias("backend")).agg(F.count("*").alias("n"), F.sum("papers_found").alias("papers"), F.round(X.pct(F.count_if(F.col("papers_found") > 0), F.count("*")), 6).alias("signal_rate"), F.round(X.pct(hit, hit + miss), 6).alias("hit_rate"))


def latest(cycles: DataFrame, key: str) -> DataFrame:
    """Each key's last row by time; of equal times the first."""
    g = cycles.groupBy(key).agg(F.max_by(F.struct("pos", "resolution"), F.struct("ts", (-F.col("pos")).alias("p"))).alias("r"))
    return g.select(key, "r.pos", "r.resolution")


def best_resolution(cycles: DataFrame) -> DataFrame:
    g = cycles.where("resolution <> ''").groupBy("hypothesis").agg(F.max_by("resolution", F.struct(X.resolution_rank(F.col("resolution")), "resolution")).alias("best"))
    return g


def auto_resolve(cycles: DataFrame) -> DataFrame:
    g = cycles.groupBy("hypothesis").agg(F.count_if(F.col("papers_found") > 0).alias("signal"), F.count_if(F.col("resolution") == "").alias("open"), F.count_if(_IS("corroborated", "challenged")).alias("settled"))
    return g.where("signal >= 3 and open >= 1 and settled = 0").select("hypothesis", "signal", "open")


def trend(cycles: DataFrame) -> DataFrame:
    """Daily mean value and its change from the day before."""
    d = cycles.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.orderBy("day")  # one row a day
    return d.select("day", F.round("v", 6).alias("v"), F.round(F.col("v") - F.lag("v").over(w), 6).alias("delta"))


def spend(cycles: DataFrame, cap: float) -> DataFrame:
    """Running spend within each month and whether the cap still allows it."""
    w = Window.partitionBy("month", "hypothesis").orderBy("ts", "pos").rowsBetween(Window.unboundedPreceding, 0)
    s = cycles.withColumn("month", F.date_format("ts", "yyyy-MM")).withColumn("spent", F.sum(F.col("papers_found")).over(w))
    return s.groupBy("month", "hypothesis").agg(F.sum("papers_found").alias("total"), F.count_if(F.col("spent") <= cap).alias("allowed"))


def phase_gate(cycles: DataFrame, at_least: int) -> DataFrame:
    open_ = cycles.where("resolution = ''").groupBy("hypothesis").agg(F.count("*").alias("n"))
    return open_.agg(F.count_if(F.col("n") >= at_least).alias("n_ready"))


def confirmation(cycles: DataFrame) -> DataFrame:
    c = F.count_if(_IS("corroborated"))
    n = F.count_if(_IS("corroborated", "challenged", "irrelevant"))
    v = X.pct(c, n)
    return cycles.agg(F.lit("ConfirmationBias").alias("bias"), F.round(v, 6).alias("value"), (v > 0.75).alias("triggered"))


def survivorship(cycles: DataFrame) -> DataFrame:
    i, c = F.count_if(_IS("irrelevant")), F.count_if(_IS("challenged"))
    v = F.when(c == 0, (i + 1).cast("double")).otherwise(X.pct(i, c))
    return cycles.agg(F.lit("SurvivorshipBias").alias("bias"), F.round(v, 6).alias("value"), F.when(c == 0, i > 3).otherwise(v > 5).alias("triggered"))


def availability(prov: DataFrame) -> DataFrame:
    """Concentration (sum of squared shares) over the kinds of sources."""
    g = prov.groupBy(X.classify_origin(F.col("origin")).alias("c")).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("t"))
    v = F.sum(F.pow(F.col("n") / F.col("t"), 2))
    return g.join(F.broadcast(t), F.lit(True)).agg(F.lit("AvailabilityHeuristic").alias("bias"), F.round(v, 6).alias("value"), (v > 0.25).alias("triggered"))


def base_rate(claims: DataFrame) -> DataFrame:
    g = claims.groupBy("predicate").agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    v = -F.sum(p * F.log2(p))
    return g.join(F.broadcast(t), F.lit(True)).agg(F.lit("BaseRateNeglect").alias("bias"), F.round(v, 6).alias("value"), (v < 3.0).alias("triggered"))


def clustering_illusion(entities: DataFrame, parts: DataFrame) -> DataFrame:
    """Jaccard of 'same file' and 'same cluster' pairs, from counts alone."""
    e = entities.select("var_name", "file").join(parts.select(F.col("node").alias("var_name"), "component"), "var_name")
    pairs = lambda *k: e.groupBy(*k).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2))
    one = pairs("file").toDF("f").join(pairs("component").toDF("c"), F.lit(True)).join(pairs("file", "component").toDF("b"), F.lit(True))
    v = X.pct(F.col("b"), F.col("f") + F.col("c") - F.col("b"))
    return one.select(F.lit("ClusteringIllusion").alias("bias"), F.round(v, 6).alias("value"), (v > 0.7).alias("triggered"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """1 - 6 sum d^2 / (n (n^2 - 1)) with average ranks; 0 under three rows. One row per group value: small inputs."""
    wx, wy = Window.orderBy(x), Window.orderBy(y)
    avg = lambda w, c: F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    d = df.select((avg(wx, x) - avg(wy, y)).alias("d"))
    n = F.count("*")
    return d.agg(F.round(F.when(n < 3, 0.0).otherwise(1 - 6 * F.sum(F.col("d") * F.col("d")) / (n * (n * n - 1))), 6).alias("rho"))


def overconfidence(claims: DataFrame, marked: DataFrame) -> DataFrame:
    """Share of entities with one or two references that are not marked."""
    d = involvement(claims).groupBy("entity").agg(F.count("*").alias("refs"))
    m = marked.select(F.col("object").alias("entity"), F.lit(1).alias("m")).distinct()
    j = d.join(m, "entity", "left")
    few = F.col("refs") <= 2
    v = X.pct(F.count_if(few & F.col("m").isNull()), F.count_if(few))
    return j.agg(F.lit("DunningKrugerEffect").alias("bias"), F.round(v, 6).alias("value"), ((v > 0.9) & (F.count_if(few) >= 5)).alias("triggered"))


def agreement(labels: DataFrame) -> DataFrame:
    return labels.groupBy("quality", "toxic").agg(F.count("*").alias("n"))
