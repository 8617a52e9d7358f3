"""A stored BM25 index: postings dealt by term, so that a query reads its terms' buckets alone.

An index is a folder of four tables, each only ever appended to:

* ``postings``  (bucket, term, kind, doc, tf, dl, batch), one folder a bucket, sorted by term;
* ``docs``      (kind, doc, dl, batch);
* ``sizes``     (batch, docs, words): what a batch added to the number and the length of documents;
* ``gone``      (kind, doc, batch): documents whose postings of earlier batches no longer count.

Documents that are added again replace their former version; how many documents hold a
term is counted from the postings of the query's terms.  A batch counts once its row
of sizes is there, which is written last: one that failed midway is as if never begun.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import dropped, written
from .retrieval import idf

BUCKETS = 32
_POSTINGS = "bucket int, term string, kind string, doc string, tf long, dl long, batch long"
_SIZES = "batch long, docs long, words long"
_DOCS = "kind string, doc string, dl long, batch long"
_GONE = "kind string, doc string, batch long"


def entity_docs(entities: DataFrame) -> DataFrame:
    """(kind, doc, text) of entities (var_name, name, brief, aliases)."""
    text = F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("brief", F.lit("")), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
    return entities.select(F.lit("entity").alias("kind"), F.col("var_name").alias("doc"), text.alias("text"))


def provenance_docs(provenance: DataFrame) -> DataFrame:
    """(kind, doc, text) of provenance records (var_name, origin, quote)."""
    text = F.concat_ws(" ", F.coalesce("origin", F.lit("")), F.coalesce("quote", F.lit("")))
    return provenance.select(F.lit("provenance").alias("kind"), F.col("var_name").alias("doc"), text.alias("text"))


class Index:
    def __init__(self, spark: SparkSession, place: str, buckets: int = BUCKETS):
        self.spark, self.place, self.buckets = spark, place.rstrip("/"), buckets

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.place}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.place}/{name}") if there else self.spark.createDataFrame([], schema)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame) -> None:
        """Index (kind, doc, text); a text without tokens leaves no document, those that are there already are replaced.

        Of rows with equal kind and doc in one call, the least text counts.
        """
        done = self._read("sizes", _SIZES)
        last = done.agg(F.max("batch")).first()[0] or 0
        batch = max(last + 1, time.time_ns())  # not that of a batch which failed
        one = docs.groupBy("kind", F.col("doc").cast("string").alias("doc")).agg(F.min("text").alias("text"))
        tokens = written(one.select("kind", "doc", X.tokens(F.coalesce("text", F.lit(""))).alias("t")).select("kind", "doc", "t", F.size("t").cast("long").alias("dl")), "index-tokens")
        known = self._current(self._read("docs", _DOCS)) if last else None
        old_docs = old_words = 0
        if known is not None:
            again = written(known.select("kind", "doc", "dl").join(tokens.select("kind", "doc"), ["kind", "doc"]), "index-again")
            old_docs, old_words = again.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            again.select("kind", "doc", F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.place}/gone")
        # Words are dealt by bucket before they are counted, so that they are shuffled once.
        words = tokens.select("kind", "doc", "dl", F.explode("t").alias("term")).withColumns({"bucket": self._bucket(F.col("term")), "share": F.pmod(F.xxhash64("doc"), F.lit(8))}).repartition("bucket", "share")
        rows = words.groupBy("bucket", "share", "kind", "doc", "dl", "term").agg(F.count("*").alias("tf"))
        rows = rows.select("bucket", "term", "kind", "doc", "tf", "dl", F.lit(batch).cast("long").alias("batch"))
        rows.sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.place}/postings")
        tokens.where("dl > 0").select("kind", "doc", "dl", F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{self.place}/docs")
        new = tokens.where("dl > 0").agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        self.spark.createDataFrame([(batch, new[0] - old_docs, new[1] - old_words)], _SIZES).coalesce(1).write.mode("append").parquet(f"{self.place}/sizes")
        dropped(tokens, *([again] if known is not None else []))

    def _live(self, terms: list[str] | None = None) -> DataFrame:
        rows = self._read("postings", _POSTINGS)
        if terms is not None:
            wanted = self.spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(self._bucket(F.col("t")).alias("b")).distinct()
            rows = rows.where(F.col("bucket").isin([r["b"] for r in wanted.collect()]) & F.col("term").isin(terms))  # one row a term of the query
        return self._current(rows)

    def _current(self, rows: DataFrame) -> DataFrame:
        """Rows of finished batches that no later one replaces."""
        done = self._read("sizes", _SIZES).select("batch")
        rows = rows.join(F.broadcast(done), "batch")  # one row a batch
        gone = self._read("gone", _GONE).join(F.broadcast(done), "batch").groupBy("kind", "doc").agg(F.max("batch").alias("since"))
        return rows.join(gone, ["kind", "doc"], "left").where("since is null or batch >= since").drop("since")

    def search(self, query: list[str], k: int | None = 15, kind: str | None = None, clamped: bool = False, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(kind, doc, score): the k best (all, without k) of one kind or of both; repeated terms count repeatedly.

        How many documents there are, how long and which hold a term is counted over both kinds.
        """
        terms = sorted(set(query))
        if not terms:
            return self.spark.createDataFrame([], "kind string, doc string, score double")
        live = written(self._live(terms), "index-hits")
        total = self._read("sizes", _SIZES).agg(F.sum("docs").alias("n"), (F.sum("words") / F.sum("docs")).alias("avg"))
        weight = reduce(lambda w, t: w.when(F.col("term") == t, query.count(t)), terms[1:], F.when(F.col("term") == terms[0], query.count(terms[0])))
        df = live.groupBy("term").agg(F.count("*").alias("df"))  # one row a term of the query
        part = weight * idf(F.col("n"), F.col("df"), clamped) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
        own = live if kind is None else live.where(F.col("kind") == kind)
        got = own.join(F.broadcast(df), "term").join(F.broadcast(total), F.lit(True)).select("kind", "doc", part.alias("part")).groupBy("kind", "doc").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
        return got if k is None else got.orderBy(F.desc("score"), "kind", "doc").limit(k)

    def terms(self) -> DataFrame:
        """(term, docs, occurrences) of the whole index."""
        return self._live().groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))
