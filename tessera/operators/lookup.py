"""Lookups over entities, claims and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(q: str) -> Column:
    """Case-insensitive substring of any naming field or alias."""
    q = q.lower()
    fields = [F.lower(F.col(c)).contains(q) for c in ("var_name", "name", "brief", "id", "alias")]
    out = fields[0]
    for f in fields[1:]:
        out = out | f
    return out


def search(entities: DataFrame, claims: DataFrame, q: str) -> DataFrame:
    """Matching entities, and the number of claims that each takes part in."""
    hit = entities.where(matches(q)).select("var_name", "role_type", "name")
    ends = involvement(claims)
    n = ends.join(hit.select(F.col("var_name").alias("entity")), "entity", "left_semi").groupBy("entity").agg(F.countDistinct("claim").alias("n_claims"))
    return hit.join(n, hit["var_name"] == n["entity"], "left").select("var_name", "role_type", "name", F.coalesce("n_claims", F.lit(0)).cast("long").alias("n_claims"))


def involvement(claims: DataFrame) -> DataFrame:
    """(entity, claim, role): one row for each end of a claim."""
    ends = F.array(F.struct(F.col("subject").alias("entity"), F.when(F.col("object").isNull(), "unary").otherwise("subject").alias("role")), F.struct(F.col("object").alias("entity"), F.lit("object").alias("role")))
    return claims.select(F.col("var_name").alias("claim"), "predicate", F.explode(ends).alias("e")).select("e.entity", "claim", "predicate", "e.role").where("entity is not null")


def resolve(entities: DataFrame, q: str) -> DataFrame:
    """One row: the first matching entity by name, or the text itself."""
    return entities.where(matches(q)).agg(F.coalesce(F.min("var_name"), F.lit(q)).alias("target"))


def claims_of(entities: DataFrame, claims: DataFrame, q: str) -> DataFrame:
    t = F.broadcast(resolve(entities, q))  # one row
    c = claims.join(t, (F.col("subject") == F.col("target")) | (F.col("object") == F.col("target")))
    role = F.when(F.col("object").isNull(), "unary").when(F.col("subject") == F.col("target"), "subject").otherwise("object")
    return c.select("var_name", "predicate", "subject", "object", role.alias("role"))


def theories(claims: DataFrame, entities: DataFrame, q: str) -> DataFrame:
    c = claims.where((F.col("predicate") == "TheoryOf") & ((F.col("object") == q) | F.lower("object").contains(q.lower())))
    return c.join(entities.select(F.col("var_name").alias("subject"), "name"), "subject", "left").select("var_name", "subject", "object", F.col("name").alias("subject_name"))


def provenance(prov: DataFrame, claims: DataFrame, q: str) -> DataFrame:
    hit = prov.where(F.lower("origin").contains(q.lower()) | F.lower("var_name").contains(q.lower())).select("var_name", "origin")
    used = claims.groupBy(F.col("prov_ref").alias("var_name")).agg(F.count("*").alias("n_used"))
    return hit.join(used, "var_name", "left").select("var_name", "origin", F.coalesce("n_used", F.lit(0)).cast("long").alias("n_used"))


def by_predicates(claims: DataFrame, *names: str) -> DataFrame:
    return claims.where(F.col("predicate").isin(*names)).select("var_name", "predicate", "subject", "object")


def neighborhood(claims: DataFrame, entities: DataFrame, var_name: str) -> DataFrame:
    """Per claim of an entity: predicate, other end and its role, arrow."""
    out = claims.where(F.col("subject") == var_name).select("predicate", F.col("object").alias("other"), F.when(F.col("object").isNull(), "unary").otherwise("->").alias("arrow"))
    into = claims.where(F.col("object") == var_name).select("predicate", F.col("subject").alias("other"), F.lit("<-").alias("arrow"))
    both = out.unionByName(into)
    return both.join(entities.select(F.col("var_name").alias("other"), "role_type"), "other", "left").select("predicate", "other", "arrow", "role_type")


def nearest_by_tokens(entities: DataFrame, want: str, n: int) -> DataFrame:
    """Entities sharing most name tokens with the wanted text, ties by name."""
    words = sorted(set(want.lower().split()))
    shared = F.size(F.array_intersect(F.array_distinct(F.split(F.lower("name"), " ")), F.array(*[F.lit(w) for w in words])))
    return entities.select("var_name", shared.alias("shared")).where("shared > 0").orderBy(F.desc("shared"), "var_name").limit(n)


def two_hop(claims: DataFrame, first: str, second: str) -> DataFrame:
    """(who, what): subjects of ``first`` on an object that subjects of ``second`` also point to."""
    a = claims.where(F.col("predicate") == first).select(F.col("subject").alias("who"), "object")
    b = claims.where(F.col("predicate") == second).select(F.col("subject").alias("what"), "object")
    return a.join(b, "object").where("who <> what").select("who", "what").distinct()
