"""Premature closure: briefs that end a question by a phrase, and entities that rest on thin support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Predicates whose subject supports the object, and those whose object supports the subject.
SUBJECT_GROUNDS = ("Proposes", "ProposesOrg", "Authored", "AuthoredOrg", "TheoryOf", "HypothesisExplains", "CommentaryOn")
OBJECT_GROUNDS = ("DerivedFrom", "InfluencedBy", "BelongsTo", "IsFictional")
#: Phrases that end a question, in the order in which they are looked for, and those that reopen it.
PHRASES = (
    "it goes without saying", "obviously", "everyone knows", "it is well known", "it is well established", "there is no doubt",
    "undeniably", "unquestionably", "it is clear that", "needless to say", "of course", "self-evident", "beyond dispute",
    "universally accepted", "widely recognized", "generally agreed",
)
REOPENED = ("remains debated", "remains contested", "still debated", "still contested", "not universally", "despite", "although", "however")
#: An entity that so many claim ends or fewer refer to is weak.
WEAK = 2


def support(claims: DataFrame, entities: DataFrame, subject_grounds: tuple[str, ...] = SUBJECT_GROUNDS, object_grounds: tuple[str, ...] = OBJECT_GROUNDS) -> DataFrame:
    """(upstream, downstream, n): which entity supports which, by how many claims; both ends are known entities."""
    known = entities.select(F.col("var_name").alias("k")).distinct()
    c = claims.where("object is not null").select("predicate", "subject", "object")
    e = c.where(F.col("predicate").isin(*subject_grounds)).select(F.col("subject").alias("upstream"), F.col("object").alias("downstream"))
    e = e.unionByName(c.where(F.col("predicate").isin(*object_grounds)).select(F.col("object").alias("upstream"), F.col("subject").alias("downstream")))
    e = e.groupBy("upstream", "downstream").agg(F.count("*").alias("n"))
    return e.join(known, e["upstream"] == F.col("k"), "left_semi").join(known, e["downstream"] == F.col("k"), "left_semi")


def references(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, refs): the claim ends that refer to each entity, none included."""
    ends = claims.select(F.col("subject").alias("entity")).unionByName(claims.where("object is not null").select(F.col("object").alias("entity")))
    n = ends.groupBy("entity").agg(F.count("*").alias("refs"))
    return entities.select(F.col("var_name").alias("entity")).distinct().join(n, "entity", "left").select("entity", F.coalesce("refs", F.lit(0)).alias("refs"))


def footing(claims: DataFrame, entities: DataFrame, **grounds: tuple[str, ...]) -> DataFrame:
    """(entity, n_upstream, n_downstream, leaf, weak_upstream).

    A leaf supports nothing.  Weak upstream: an entity that supports it, or one that
    supports such a one, is weak.  Weakness goes down the edges twice, so a hub's
    supporters aren't listed for each that the hub supports.
    """
    edges, refs = support(claims, entities, **grounds), references(claims, entities)
    first = edges.join(refs.where(F.col("refs") <= WEAK), edges["upstream"] == F.col("entity"), "left_semi").select(F.col("downstream").alias("entity")).distinct()
    second = edges.join(first, edges["upstream"] == first["entity"], "left_semi").select(F.col("downstream").alias("entity"))
    weak = first.unionByName(second).distinct().withColumn("weak", F.lit(True))
    up = edges.groupBy(F.col("downstream").alias("entity")).agg(F.count("*").alias("up"))
    down = edges.groupBy(F.col("upstream").alias("entity")).agg(F.count("*").alias("down"))
    out = refs.select("entity").join(up, "entity", "left").join(down, "entity", "left").join(weak, "entity", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return out.select("entity", n("up").alias("n_upstream"), n("down").alias("n_downstream"), F.col("down").isNull().alias("leaf"), F.coalesce("weak", F.lit(False)).alias("weak_upstream"))


def closing_phrase(brief: Column) -> Column:
    """The first phrase of the list that the brief holds, none ('') if it reopens the question."""
    low = F.lower(brief)
    held = F.filter(F.array(*[F.lit(p) for p in PHRASES]), lambda p: F.contains(low, p))
    reopened = F.exists(F.array(*[F.lit(p) for p in REOPENED]), lambda p: F.contains(low, p))
    return F.when(reopened | (F.size(held) == 0), "").otherwise(held[0])


def findings(claims: DataFrame, entities: DataFrame, **grounds: tuple[str, ...]) -> DataFrame:
    """(entity, phrase, leaf, weak_upstream, severity) of entities (var_name, brief): a phrase, or a leaf on weak support; a warning if both."""
    own = entities.where("brief <> ''").groupBy(F.col("var_name").alias("entity")).agg(F.max("brief").alias("brief"))
    got = own.join(footing(claims, entities, **grounds), "entity").withColumn("phrase", closing_phrase(F.col("brief")))
    said, thin = F.col("phrase") != "", F.col("leaf") & F.col("weak_upstream")
    return got.where(said | thin).select("entity", "phrase", "leaf", "weak_upstream", F.when(said & thin, "warning").otherwise("info").alias("severity"))


def audit(found: DataFrame) -> DataFrame:
    """One row: bias, value (warnings), triggered by the first."""
    value = F.count_if(F.col("severity") == "warning")
    return found.agg(value.cast("double").alias("value"), F.count("*").alias("n_findings")).select(F.lit("PrematureClosure").alias("bias"), "value", "n_findings", (F.col("value") >= 1).alias("triggered"))
