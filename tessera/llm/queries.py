"""Queries of this subpackage, by name: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontamination, hmm, html_extract, langid, minhash_dedup, periodic_runs, sentencepiece_codec, spelling, substring_dedup, threshold_topk, tool_calls, url_rules
from .tables import table


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(_remainder(5) == 1, F.lit(False))
    return hmm.score_texts(docs.withColumn("held_out", held), ~held, carry=("held_out",))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 20 = 0"), k=20)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), bag=True)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled url is one whose page_id is a labelled doc_id; toxic or poor ones are bad. A rule is judged against their share."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    rules = url_rules.mine(pages.join(labels, pages["page_id"] == labels["doc_id"]).select("url", "bad"), min_confidence=None)
    return url_rules.judge(pages, rules)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


#: What the two tools take: a question is a sentence that has an end, an instruction opens the conversation.
TOOLS = {
    "ask": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1, "pattern": "[.!?]\\s*$"}, "turn": {"type": "integer", "minimum": 0}},
    },
    "instruct": {
        "type": "object",
        "required": ["text", "turn"],
        "additionalProperties": False,
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"const": 0}},
    },
}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn is a call of the tool ``ask``, a system's one of ``instruct``, any other but an assistant's one of a tool that isn't known.

    A call is identified by its turn and comes after the calls of the eight turns before it.
    The assistant's turn is the result of the turn before it.  A text that is a JSON
    object gives the arguments itself; else they are the text and the turn.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("position"), "role", "text")
    ident = lambda turn: F.concat(F.lit("turn_"), turn.cast("string"))
    made = F.to_json(F.struct("text", F.col("position").alias("turn")), {"ignoreNullFields": "false"})
    arguments = F.when(F.col("text").rlike("^\\s*[{]") & F.json_object_keys("text").isNotNull(), F.col("text")).otherwise(made)
    name = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "instruct").otherwise(F.coalesce("role", F.lit("nobody")))
    asks = F.coalesce(F.col("role") != "assistant", F.lit(True))
    calls = turns.where(asks).select("conv_id", ident(F.col("position")).alias("call_id"), "position", name.alias("name"), arguments.alias("arguments"))
    after = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ident(F.col("position") - i))
    calls = calls.withColumn("after", F.when(F.col("position").isNull(), F.array().cast("array<string>")).otherwise(after))
    results = turns.where(~asks).select("conv_id", ident(F.col("position") - 1).alias("call_id"), "position", F.col("text").alias("content"))
    return tool_calls.link(calls, results, TOOLS)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_remainder(4) == 2, F.lit(False))
    net = langid.train(docs, ~held)
    return langid.identify(docs.withColumn("held_out", held), net, carry=("doc_id", "held_out"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0"), k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(own.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return ORACLES
