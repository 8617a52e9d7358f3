"""Ranked retrieval: BM25, cosine, rank fusion, keyword and fact ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import written as cut


def bm25(docs: DataFrame, query: list[str], k: int | None = 15, k1: float = 1.5, b: float = 0.75, clamped: bool = False) -> DataFrame:
    """doc, score: the k best (all, without k), ties by doc. Repeated query terms count repeatedly.

    One pass over the texts gives each document's length and its counts of the query's
    terms; these narrow rows are kept, and how many documents there are, how long and
    which hold a term are sums over them.
    """
    terms = sorted(set(query))
    words = docs.select("doc", X.tokens(F.col("text")).alias("t")).select("doc", F.size("t").alias("dl"), F.filter("t", lambda t: t.isin(*terms)).alias("t"))
    # Empty documents go after the write: a filter would be pushed down, and cut the text once more.
    rows = cut(words.select("doc", "dl", *[(F.size("t") - F.size(F.array_remove("t", w))).alias(f"n{i}") for i, w in enumerate(terms)]), "bm25").where("dl > 0")
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"n{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    some = F.lit(False)
    for i in range(len(terms)):
        some = some | (F.col(f"n{i}") > 0)
    hit = rows.where(some).join(F.broadcast(total), F.lit(True))
    score = F.lit(0.0)
    for i, w in enumerate(terms):
        tf = F.col(f"n{i}")
        score = score + query.count(w) * idf(F.col("n"), F.col(f"df{i}"), clamped) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    out = hit.select("doc", F.round(score, 6).alias("score")).where("score > 0")
    return out if k is None else out.orderBy(F.desc("score"), "doc").limit(k)


def idf(n: Column, df: Column, clamped: bool = False) -> Column:
    ratio = (n - df + 0.5) / (df + 0.5)
    return F.greatest(F.lit(0.0), F.log(ratio)) if clamped else F.log1p(ratio)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def semantic(segments: DataFrame, query: DataFrame, k: int | None = None) -> DataFrame:
    """owner, score: the best cosine of its segments to the one query vector."""
    q = query.select(unit(F.col("vector").cast("array<double>")).alias("q"))
    s = segments.select("owner", unit(F.col("vector").cast("array<double>")).alias("v")).join(F.broadcast(q), F.lit(True))
    out = s.groupBy("owner").agg(F.round(F.max(dot(F.col("v"), F.col("q"))), 6).alias("score"))
    return out if k is None else out.orderBy(F.desc("score"), "owner").limit(k)


def fuse(a: DataFrame, b: DataFrame, constant: int = 60) -> DataFrame:
    """(doc, score): reciprocal rank fusion of two whole rankings (doc, score), ties by doc."""
    ra, rb = (ranked(d).select("doc", F.col("rank").alias(n)) for d, n in ((a, "ra"), (b, "rb")))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    return ra.join(rb, "doc", "full").select("doc", F.round(part("ra") + part("rb"), 6).alias("score"))


def ranked(df: DataFrame) -> DataFrame:
    """(doc, score) with the column rank: 1 for the largest score, ties by doc."""
    return numbered(df.select("doc", "score"), F.desc("score"), F.col("doc")).withColumn("rank", F.col("number") + 1).drop("number")


def keyword(docs: DataFrame, words: list[str], k: int) -> DataFrame:
    """Distinct keyword hits, then total occurrences, then doc."""
    low = F.lower("text")
    n = [F.regexp_count(low, F.lit(w)) for w in words]
    total = sum(n[1:], n[0])
    hits = sum([(x > 0).cast("int") for x in n[1:]], (n[0] > 0).cast("int"))
    return docs.select("doc", hits.alias("hits"), total.alias("total")).where("hits > 0").orderBy(F.desc("hits"), F.desc("total"), "doc").limit(k)


def rank_facts(facts: DataFrame, question: list[str], k: int) -> DataFrame:
    """Facts by the number of distinct question terms in them; zero scores stay, in order."""
    q = F.array(*[F.lit(t) for t in sorted(set(question))])
    return facts.select("pos", F.size(F.array_intersect(X.fact_terms(F.col("text")), q)).alias("score")).orderBy(F.desc("score"), "pos").limit(k)


def quota(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__i") <= n).drop("__i")


def spaced(df: DataFrame, order: str, n: int) -> DataFrame:
    """n rows at even steps of the order (all, if fewer): those numbered floor(i * count / n)."""
    rows = numbered(df, order)
    total = df.agg(F.count("*").alias("total"))
    picks = df.sparkSession.range(n).join(F.broadcast(total), F.lit(True)).select(F.when(F.col("total") <= n, F.col("id")).otherwise(F.floor(F.col("id") * F.col("total") / n)).alias("number")).distinct()
    return rows.join(F.broadcast(picks), "number").drop("number")  # n rows


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """With the column number: 0, 1, 2 ... in order, without one task for all: rows are sorted by range, and each part's count shifts the next."""
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__id", 33)
    sizes = parts.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    shift = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("shift"))  # one row a part
    own = parts.join(F.broadcast(shift), part == F.col("p"))
    return own.withColumn("number", F.col("shift") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "p", "shift", "n")


def hybrid(lexical: DataFrame, similar: DataFrame, about: DataFrame, role: str | None, k: int = 15) -> DataFrame:
    """Two whole rankings (doc, score) fused, then the k best of one role with what is known of them (about: doc, role, ...)."""
    kept = about if role is None else about.where(F.col("role") == role)
    return kept.drop("role").join(fuse(lexical, similar), "doc").orderBy(F.desc("score"), "doc").limit(k)


def anti_exemplars(files: DataFrame, text: str = "text", n: int | None = None, seed: int = 0) -> DataFrame:
    """Rejected claims (columns of files but the text, shape, reason) from dated audit comments: the first back-quoted phrase, and what follows the word of deletion.

    A block is an audit line and the comment lines right after it; one without a phrase gives no row.
    With n, that many of them in an order by hash.
    """
    block = r"(?m)^[ \t]*//[ \t]*\d{4}-\d{2}-\d{2}[ \t]+audit:[^\n]*(?:\n[ \t]*//[^\n]*)*"
    keep = [files[c] for c in files.columns if c not in (text, "shape", "reason")]
    said = files.select(*keep, F.explode(F.regexp_extract_all(F.col(text), F.lit(block), F.lit(0))).alias("__block"))
    body = F.array_join(F.transform(F.split("__block", "\n"), lambda x: F.btrim(F.regexp_replace(x, r"^\s*//", ""), F.lit(" \t\r"))), " ")
    said = said.select(*[c for c in said.columns if c != "__block"], body.alias("__body"), F.regexp_extract(body, "`([^`]+)`", 1).alias("shape")).where("shape <> ''")
    reason = F.when(F.locate("deleted here.", F.col("__body")) > 0, F.trim(F.regexp_replace("__body", "^.*?deleted here\\.", ""))).otherwise(F.col("__body"))
    out = said.withColumn("reason", reason).drop("__body")
    return out if n is None else out.orderBy(F.xxhash64("shape", "reason", F.lit(seed)), "shape", "reason").limit(n)


def pick_across(pairs: DataFrame, refuted: DataFrame, n: int, floor: int = 250, weight: int = 62, seed: str = "") -> DataFrame:
    """n pairs (a, b, cluster_a, cluster_b, rank) of entities in different clusters, spread over the pairs of clusters.

    pairs: a, b, their clusters, score, affinity; those refuted (a, b, either way round) or of an affinity under the
    floor go.  The best of each pair of clusters by score * weight + affinity are taken in turns, the pair of clusters
    with the best one first; ties fall to a seeded hash.  No more than n of a pair of clusters are looked at.
    """
    key = lambda d: F.concat_ws("|", F.least(d["a"], d["b"]), F.greatest(d["a"], d["b"]))
    gone = refuted.select(key(refuted).alias("key")).distinct()
    left = pairs.withColumn("key", key(pairs)).where((F.col("cluster_a") != F.col("cluster_b")) & (F.col("affinity") >= floor)).join(gone, "key", "left_anti")
    left = left.select("a", "b", "cluster_a", "cluster_b", (F.col("score") * weight + F.col("affinity")).alias("rank"), F.md5(F.concat(F.lit(seed), "a", F.lit("|"), "b")).alias("tie"))
    left = left.withColumn("low", F.least("cluster_a", "cluster_b")).withColumn("high", F.greatest("cluster_a", "cluster_b"))
    best = [F.desc("rank"), "tie", "a", "b"]
    turn = Window.partitionBy("low", "high").orderBy(*best)
    top = left.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n)
    top = top.withColumn("lead", F.first("rank").over(turn)).withColumn("lead_tie", F.first("tie").over(turn))
    return top.orderBy("turn", F.desc("lead"), "lead_tie", "low", "high").limit(n).select("a", "b", "cluster_a", "cluster_b", "rank")
