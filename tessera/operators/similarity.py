"""Structural dedup: entities whose claims look alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written


#: Rare edges that a pair must meet in before it is looked at: MEET, or one in PART of those that it must share.
MEET, PART = 3, 8
#: An edge of more entities than this is met in pairs of edges; an entity of more than LONG such edges meets edge by edge.
HOT, LONG = 32, 48


def signatures(claims: DataFrame) -> DataFrame:
    """(entity, edge, n): predicate, direction and neighbor, with multiplicity."""
    edge = lambda d, o: F.concat_ws("|", "predicate", F.lit(d), F.coalesce(o, F.lit("")))
    out = claims.select(F.col("subject").alias("entity"), edge("out", F.col("object")).alias("edge")).where(F.col("entity").isNotNull())
    into = claims.where("object is not null").select(F.col("object").alias("entity"), edge("in", F.col("subject")).alias("edge"))
    return out.unionByName(into).groupBy("entity", "edge").agg(F.count("*").alias("n"))


def edge_weights(sig: DataFrame) -> DataFrame:
    """ln(1 + N / df) of each edge."""
    n = sig.agg(F.countDistinct("entity").alias("total"))
    return sig.groupBy("edge").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).select("edge", F.log1p(F.col("total") / F.col("df")).alias("idf"), "df")


def _meet(least: Column) -> Column:
    """Of the edges that a pair must share, how many must be among the rarest; what is left of them never falls as they grow."""
    return F.greatest(F.least(F.lit(MEET), least), F.floor(least / PART).cast("int"))


def candidates(claims: DataFrame, entities: DataFrame, min_shared: int, min_coefficient: float, min_weight: float, hot: int = HOT, long: int = LONG) -> DataFrame:
    """Pairs a < b of one role that share enough edges.

    A pair of sizes up to s must share R = max(min_shared, c s) edges.  In any order that
    both keep (here by number of entities, then name) the first m of them are among
    the n - R + m rarest edges of either, so only these are joined, and a pair goes on
    if it meets in m of them at least.  What goes on is counted on all its edges.

    An edge of ``hot`` entities at most is a key.  Those of more are keys two by two, as
    hardly any two entities share two of them by chance: a pair with h in common meets in
    h (h - 1) / 2 keys, and one that meets in none has at most one.  An entity with more
    than ``long`` of those meets the others edge by edge.  Hashed keys that fall together
    only let more pairs go on.
    """
    if min_shared < 2:  # a pair may have one edge in common
        hot = (1 << 31) - 1
    sig = written(signatures(claims).select("entity", "edge"), "dedup-edges")
    w = edge_weights(sig).where("df > 1")
    known = sig.join(w, "edge").join(entities.select(F.col("var_name").alias("entity")), "entity", "left_semi")
    shared = known.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("df", "edge", "idf"))).alias("edges")).where(F.size("edges") >= min_shared)
    own = shared.join(sig.groupBy("entity").agg(F.count("*").cast("int").alias("size")), "entity").join(entities.select(F.col("var_name").alias("entity"), "role_type"), "entity")
    own = written(own.withColumn("id", F.monotonically_increasing_id()), "dedup-own")
    must = lambda size: F.greatest(F.lit(min_shared), F.ceil(size * min_coefficient - 1e-9).cast("int"))
    # Edges of one entity alone come first in the order, and meet nothing.
    n = F.size("edges") - must(F.col("size")) + _meet(must(F.col("size")))
    rare = own.select("id", "role_type", "size", F.slice("edges", 1, F.greatest(F.lit(0), F.least(F.size("edges"), n))).alias("first")).where(F.size("first") >= _meet(must(F.col("size"))))
    rare = rare.select("id", "role_type", "size", F.filter("first", lambda e: e["df"] <= hot).alias("light"), F.filter("first", lambda e: e["df"] > hot).alias("heavy"))
    rare = rare.withColumn("hot", F.size("heavy"))
    key = lambda *e: F.xxhash64("role_type", *[x["edge"] for x in e])
    two = F.flatten(F.transform("heavy", lambda x, i: F.transform(F.slice("heavy", i + 2, F.greatest(F.lit(0), F.col("hot") - i - 1)), lambda y: F.struct(F.lit(2).alias("kind"), key(x, y).alias("key")))))
    two = F.when(F.col("hot") <= long, two).otherwise(F.slice(two, 1, 0)) if hot < (1 << 31) - 1 else F.expr("cast(array() as array<struct<kind: int, key: bigint>>)")
    keys = rare.select("id", "size", "hot", F.explode(F.concat(F.transform("light", lambda x: F.struct(F.lit(1).alias("kind"), key(x).alias("key"))), two)).alias("k")).select("k.key", "k.kind", "id", "size", "hot")

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("key", "kind", F.col("id").alias(x), F.col("size").alias("s" + x), F.col("hot").alias("h" + x))

    more = F.greatest("sa", "sb") * min_coefficient - 1e-9
    met = side(keys, "a").join(side(keys, "b"), ["key", "kind"]).where((F.col("a") < F.col("b")) & (F.least("sa", "sb") >= more))
    if not rare.where(F.col("hot") > long).isEmpty():
        one = rare.select("id", "size", "hot", F.explode(F.transform("heavy", lambda x: key(x))).alias("key")).withColumn("kind", F.lit(3))
        x = side(one.where(F.col("hot") > long), "a").join(side(one, "b"), ["key", "kind"]).where(((F.col("a") < F.col("b")) | (F.col("hb") <= long)) & (F.least("sa", "sb") >= more))
        first = F.col("a") < F.col("b")
        turn = [F.when(first, F.col(p + q)).otherwise(F.col(p + r)).alias(p + q) for q, r in ("ab", "ba") for p in ("", "s", "h")]
        met = met.unionByName(x.select("key", "kind", *turn))
    met = met.groupBy("a", "b", "sa", "sb", "ha", "hb").agg(*[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in (1, 2, 3)])
    by_two = F.when(F.col("n2") > 0, F.ceil((1 + F.sqrt(1 + 8 * F.col("n2"))) / 2)).otherwise(F.least(F.lit(1), "ha", "hb"))
    both_hot = F.when(F.greatest("ha", "hb") > long, F.col("n3")).otherwise(by_two)
    met = written(met.where(F.col("n1") + both_hot >= _meet(F.greatest(F.lit(min_shared), F.ceil(more).cast("int")))).select("a", "b", F.greatest("sa", "sb").alias("base")), "dedup-met")
    kept = lambda x: own.select(F.col("id").alias(x), F.col("entity").alias("n" + x), F.col("edges").alias("e" + x))
    both = met.join(kept("a"), "a").join(kept("b"), "b").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "base", F.array_intersect("ea", "eb").alias("common"))
    out = both.select("a", "b", F.size("common").cast("long").alias("shared"), (F.size("common") / F.col("base")).alias("coefficient"), F.aggregate("common", F.lit(0.0), lambda s, e: s + e["idf"]).alias("weight"))
    return out.where((F.col("a") < F.col("b")) & (F.col("shared") >= min_shared) & (F.col("coefficient") >= min_coefficient) & (F.col("weight") >= min_weight)).select("a", "b", "shared", F.round("coefficient", 6).alias("coefficient"), F.round("weight", 6).alias("weight"))
