"""Aggregates, lint rules and invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lookup import involvement


def counts(claims: DataFrame, key: str) -> DataFrame:
    return claims.groupBy(key).agg(F.count("*").alias("n"))


def stats(entities: DataFrame, claims: DataFrame, prov: DataFrame) -> DataFrame:
    """Counts by name, from one pass over each relation."""
    theory = claims.where("predicate = 'TheoryOf'").groupBy("object").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") >= 2).alias("contested"))
    c = claims.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("predicate") == "Disputes").alias("d")).select("file", F.lit(0).alias("e"), "n", "d")
    e = entities.groupBy("file").agg(F.count("*").alias("e")).select("file", "e", F.lit(0).alias("n"), F.lit(0).alias("d"))
    both = c.union(e).agg(F.sum("e").alias("entities"), F.sum("n").alias("claims"), F.sum("d").alias("disputes"), F.countDistinct("file").alias("files"))
    rows = [both.select(F.expr("stack(4, 'entities', coalesce(entities, 0), 'claims', coalesce(claims, 0), 'files', files, 'disputes', coalesce(disputes, 0)) as (stat, n)")), prov.agg(F.count("*").alias("n")).select(F.lit("provenance").alias("stat"), "n"), theory.select(F.lit("contested").alias("stat"), F.col("contested").alias("n"))]
    return rows[0].union(rows[1]).union(rows[2])


def contested(claims: DataFrame, predicate: str, k: int) -> DataFrame:
    g = claims.where(F.col("predicate") == predicate).groupBy("object").agg(F.countDistinct("subject").alias("n_subjects"))
    return g.where(F.col("n_subjects") >= k)


def contested_concepts(claims: DataFrame, predicate: str) -> DataFrame:
    """Objects with two subjects and more, the subjects sorted and joined."""
    g = claims.where(F.col("predicate") == predicate).groupBy("object").agg(F.array_join(F.array_sort(F.collect_set("subject")), ",").alias("subjects"))
    return g.where(F.col("subjects").contains(","))


def file_balance(entities: DataFrame) -> DataFrame:
    """Entities per file against the upper median: small, large or ok."""
    g = entities.groupBy("file").agg(F.count("*").alias("n"))
    # The upper median from the counts of counts, which are few.
    sizes = g.groupBy("n").agg(F.count("*").alias("files"))
    below = sizes.select("n", F.sum("files").over(Window.orderBy("n")).alias("upto"))
    total = g.agg(F.floor(F.count("*") / 2).alias("half"))
    med = below.join(F.broadcast(total), F.col("upto") > F.col("half")).agg(F.min("n").alias("median"))
    kind = F.when((F.col("n") <= 2) & (F.col("median") > 5), "small").when((F.col("n") > 3 * F.col("median")) & (F.col("n") > 20), "large").otherwise("ok")
    return g.join(F.broadcast(med), F.lit(True)).select("file", "n", "median", kind.alias("kind"))


def provenance_split(claims: DataFrame, prov: DataFrame) -> DataFrame:
    """Origins cited from more than one file."""
    c = claims.select("prov_ref", "file").join(prov.select(F.col("var_name").alias("prov_ref"), F.lower(F.trim("origin")).alias("origin")), "prov_ref")
    return c.groupBy("origin").agg(F.countDistinct("file").alias("n_files")).where("n_files > 1")


def brief_quality(entities: DataFrame) -> DataFrame:
    n = F.octet_length("brief")
    kind = F.when(n == 0, "missing").when(n < 20, "short").when(n > 300, "long").otherwise("ok")
    return entities.select("var_name", kind.alias("kind"))


def orphans(entities: DataFrame, claims: DataFrame) -> DataFrame:
    return entities.join(involvement(claims).select(F.col("entity").alias("var_name")), "var_name", "left_anti").select("var_name", "role_type")


def value_conflicts(claims: DataFrame, *functional: str) -> DataFrame:
    g = claims.where(F.col("predicate").isin(*functional)).groupBy("predicate", "subject").agg(F.count("*").alias("n_claims"), F.countDistinct("object").alias("n_objects"))
    return g.where("n_claims >= 2 and n_objects >= 2")


def duplicate_ids(entities: DataFrame) -> DataFrame:
    return entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def dangling(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claim ends that name no entity."""
    ends = involvement(claims)
    return ends.join(entities.select(F.col("var_name").alias("entity")), "entity", "left_anti").select("claim", "entity", "role")


def slot_mismatch(claims: DataFrame, entities: DataFrame, slots: dict[str, tuple[str, str]]) -> DataFrame:
    """Binary claims whose ends aren't of the roles their predicate asks for (Entity takes any)."""
    m = F.create_map(*[F.lit(x) for p, (s, o) in slots.items() for x in (p, f"{s}|{o}")])
    want = F.split(F.element_at(m, F.col("predicate")), "\\|")
    role = entities.select("var_name", "role_type")
    c = claims.where(F.col("object").isNotNull() & F.col("predicate").isin(*slots)).select("var_name", "predicate", "subject", "object", want[0].alias("ws"), want[1].alias("wo"))
    c = c.join(role.select(F.col("var_name").alias("subject"), F.col("role_type").alias("rs")), "subject").join(role.select(F.col("var_name").alias("object"), F.col("role_type").alias("ro")), "object")
    bad = ((F.col("ws") != "Entity") & (F.col("ws") != F.col("rs"))) | ((F.col("wo") != "Entity") & (F.col("wo") != F.col("ro")))
    return c.where(bad).select("var_name", "rs", "ro")


def lexicon_fence(prov: DataFrame, pattern: str) -> DataFrame:
    return prov.where(F.col("quote").rlike(pattern) | F.col("origin").rlike(pattern)).select("var_name", "origin")


def single_source(claims: DataFrame, *proposing: str) -> DataFrame:
    g = claims.where(F.col("predicate").isin(*proposing)).groupBy("object").agg(F.count("*").alias("n"))
    return g.where("n = 1").select("object")


def uncontested(claims: DataFrame) -> DataFrame:
    p = claims.where("predicate = 'Proposes'").select("object").distinct()
    return p.join(claims.where("predicate = 'Disputes'").select("object"), "object", "left_anti")


def thin_files(claims: DataFrame, prov: DataFrame) -> DataFrame:
    """Files none of whose claims cite a quote, with their number of claims."""
    quoted = prov.where(F.length("quote") > 0).select(F.col("var_name").alias("prov_ref"), F.lit(1).alias("q")).distinct()
    g = claims.join(quoted, "prov_ref", "left").groupBy("file").agg(F.count("*").alias("n_claims"), F.count("q").alias("n_quoted"))
    return g.where("n_quoted = 0").select("file", "n_claims")


def degree_outliers(claims: DataFrame, floor: float = 5.0) -> DataFrame:
    """Entities with a claim degree of max(floor, mean + 2 sigma) and more."""
    d = involvement(claims).groupBy("entity").agg(F.count("*").alias("degree"))
    cut = d.agg((F.avg("degree") + 2 * F.stddev_pop("degree")).alias("cut"))
    return d.join(F.broadcast(cut), F.col("degree") >= F.greatest("cut", F.lit(floor))).select("entity", "degree")


def collision_names(entities: DataFrame) -> DataFrame:
    """Unique paths in order of var_name: a base, then base-2, base-3 ..."""
    w = Window.partitionBy("role_type", "base").orderBy("var_name")
    e = entities.select("var_name", "role_type", F.lower(F.regexp_replace("name", "[^A-Za-z]+", "-")).alias("base")).withColumn("i", F.row_number().over(w))
    return e.select("var_name", F.concat("role_type", F.lit("/"), "base", F.when(F.col("i") > 1, F.concat(F.lit("-"), F.col("i").cast("string"))).otherwise("")).alias("path"))
