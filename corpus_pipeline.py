"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, langid, minhash_dedup, sentencepiece_codec, substring_dedup
from tessera.llm.tables import table, written

#: Below this a text is of none of the learned languages.
LEAST_SCORE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language that the network is not at a loss about."""
    net = langid.train(docs, F.lit(True))
    seen = langid.identify(docs, net, carry=COLUMNS)
    return seen.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id."""
    return minhash_dedup.distinct_texts(docs, bag=True, carry=COLUMNS[2:]).select(*COLUMNS)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start earlier too; untouched texts stay as they are."""
    out = substring_dedup.dedup_substrings(docs, carry=COLUMNS[1:])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    n = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("kept").cast("long"))
    emptied = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_words"))
    return out.where(~emptied).select("doc_id", text.alias("text"), "lang", "source", n.alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    out = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=COLUMNS)
    return out.where("not contaminated").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, round_trip."""
    return sentencepiece_codec.encode(docs, carry=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontaminated),
    ("sentencepiece", encoded),
]

#: A network's decisions and merge order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
