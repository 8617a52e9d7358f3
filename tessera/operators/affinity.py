"""Entities as they are paired across clusters, and how alike two of them are.

The two-hop set of a node is all that one or two claims lead to, without itself.  A
hub is a node of more than ``heavy`` neighbours; the neighbours of hubs aren't
listed for each of their neighbours in turn, which would take the square of a hub's
degree.  A node keeps the sorted list of its hubs instead (its signature): a node is
two steps from x over a hub if their signatures overlap.  So a two-hop set is

* U(x): nodes whose signature overlaps that of x, counted by signature, and
* L(x): x's neighbours and theirs over light nodes, those listed that aren't in U(x).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.stored import dropped, written
from .graph import adjacency, articulation, components
from .skew import join_salted

HEAVY, TWO_HOP, PREDICATES, BRIEF = 1000, 300, 400, 300
#: Nodes that are listed at once, over all two-hop sets of a batch.
LISTED = 20_000_000
_NONE = "cast(array() as array<string>)"


def features(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """(entity, predicates, tokens): the predicates of its claims at either end, and the words of four letters of its brief."""
    ends = claims.select(F.col("subject").alias("entity"), "predicate").unionByName(claims.where("object is not null").select(F.col("object").alias("entity"), "predicate"))
    of = ends.where("predicate <> ''").groupBy("entity").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))
    own = entities.select(F.col("var_name").alias("entity"), F.array_sort(X.brief_tokens(F.coalesce("brief", F.lit("")))).alias("tokens"))
    none = F.expr(_NONE)
    return own.join(of, "entity", "left").select("entity", F.coalesce("predicates", none).alias("predicates"), F.coalesce("tokens", none).alias("tokens"))


class Steps:
    """Neighbours, hubs and signatures of all nodes: what the two-hop sets of any of them are made from."""

    def __init__(self, claims: DataFrame, heavy: int = HEAVY):
        self.adj = adj = written(adjacency(claims), "twohop-adj")
        self.degree = written(adj.groupBy("u").agg(F.count("*").alias("n")), "twohop-degree")
        self.hubs = hubs = written(self.degree.where(F.col("n") > heavy).select("u"), "twohop-hubs")
        # By node: its hubs. A hub's rows come from its neighbours, one each.
        self.signature = written(adj.join(hubs.select(F.col("u").alias("v")), "v").groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("hubs")), "twohop-signatures")
        self.shapes = written(self.signature.groupBy("hubs").agg(F.count("*").alias("n")), "twohop-shapes")

    def work(self, asked: DataFrame) -> DataFrame:
        """(x, n): how many rows are listed for a node asked for, at most."""
        first = join_salted(asked.select(F.col("x").alias("u")).distinct(), self.adj, "u")
        light = self.degree.join(self.hubs, "u", "left_anti").withColumnRenamed("u", "v")
        return first.join(light, "v", "left").groupBy(F.col("u").alias("x")).agg(F.sum(F.coalesce("n", F.lit(0)) + 1).alias("n"))


class TwoHop:
    """Two-hop sets of the nodes asked for (one column, x)."""

    def __init__(self, claims: DataFrame | Steps, asked: DataFrame, heavy: int = HEAVY):
        none = F.expr(_NONE)
        steps = claims if isinstance(claims, Steps) else Steps(claims, heavy)
        adj, hubs, self.signature, self.shapes = steps.adj, steps.hubs, steps.signature, steps.shapes
        asked = asked.select("x").distinct()
        first = join_salted(asked.withColumnRenamed("x", "u"), adj, "u").select(F.col("u").alias("x"), F.col("v").alias("y"))
        light = first.join(hubs.select(F.col("u").alias("y")), "y", "left_anti").select("x", F.col("y").alias("u"))
        second = join_salted(light, adj, "u").select("x", F.col("v").alias("y"))
        listed = first.unionByName(second).where("x <> y").distinct()
        self.asked = written(asked.join(self.signature.select(F.col("u").alias("x"), "hubs"), "x", "left").select("x", F.coalesce("hubs", none).alias("hubs")), "twohop-asked")
        both = listed.join(self.asked, "x").join(self.signature.select(F.col("u").alias("y"), F.col("hubs").alias("over")), "y", "left").select("x", "y", "hubs", F.coalesce("over", none).alias("over"))
        self.outside = written(both.where(~F.arrays_overlap("hubs", "over")).select("x", "y", "over"), "twohop-outside")
        self.made = [self.asked, self.outside]

    def sizes(self) -> DataFrame:
        """(x, n): how many nodes each two-hop set has."""
        own = self.asked.select("hubs").distinct().where("size(hubs) > 0")
        over = self._shapes_of(own.select("hubs", F.col("hubs").alias("other"))).groupBy("hubs").agg(F.sum("n").alias("over"))
        out = self.outside.groupBy("x").agg(F.count("*").alias("listed"))
        n = F.coalesce("listed", F.lit(0)) + F.coalesce(F.col("over") - 1, F.lit(0))  # x is over its hubs itself
        return self.asked.join(over, "hubs", "left").join(out, "x", "left").select("x", n.alias("n"))

    def _shapes_of(self, pairs: DataFrame) -> DataFrame:
        """(hubs, other, n): signatures that overlap both, each once."""
        by_hub = self.shapes.select(F.col("hubs").alias("shape"), "n", F.explode("hubs").alias("hub"))
        met = pairs.select("hubs", "other", F.explode("hubs").alias("hub")).join(by_hub, "hub").where(F.arrays_overlap("shape", "other"))
        return met.select("hubs", "other", "shape", "n").distinct()

    def common(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both): how many nodes are in the two-hop sets of both."""
        pairs = pairs.select("a", "b").where("a <> b").distinct()
        own = pairs.join(self.asked.select(F.col("x").alias("a"), F.col("hubs").alias("ha")), "a").join(self.asked.select(F.col("x").alias("b"), F.col("hubs").alias("hb")), "b")
        own = written(own, "twohop-pairs")
        self.made.append(own)
        sides = own.select("ha", "hb").distinct().where("size(ha) > 0 and size(hb) > 0").select(F.col("ha").alias("hubs"), F.col("hb").alias("other"))
        over = self._shapes_of(sides).groupBy(F.col("hubs").alias("ha"), F.col("other").alias("hb")).agg(F.sum("n").alias("over"))
        total = own.join(over, ["ha", "hb"], "left")
        ends = F.when(F.arrays_overlap("ha", "hb"), 2).otherwise(0)  # a and b themselves are over a common hub
        parts = [total.select("a", "b", (F.coalesce("over", F.lit(0)) - ends).alias("n"))]
        for x, other, hubs in (("a", "b", "hb"), ("b", "a", "ha")):
            met = own.join(self.outside.withColumnRenamed("x", x), x).where(F.col("y") != F.col(other))
            parts.append(met.where(F.arrays_overlap("over", hubs)).select("a", "b", F.lit(1).cast("long").alias("n")))
        met = own.join(self.outside.select(F.col("x").alias("a"), "y"), "a").select("a", "b", "y").join(self.outside.select(F.col("x").alias("b"), "y"), ["b", "y"])
        parts.append(met.select("a", "b", F.lit(1).cast("long").alias("n")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("a", "b").agg(F.sum("n").alias("both"))


def _share(common: Column, n: Column, m: Column, weight: int) -> Column:
    """weight * |both| / |either|, whole; 0 if one is empty."""
    return F.when((n > 0) & (m > 0), F.floor(common * weight / (n + m - common))).otherwise(0).cast("long")


def affinity(pairs: DataFrame, entities: DataFrame, claims: DataFrame, heavy: int = HEAVY, listed: int = LISTED) -> DataFrame:
    """(a, b, two_hop, predicates, brief, affinity) of given pairs (a, b): Jaccard similarities in whole thousandths of 300, 400 and 300, and their sum.

    Two-hop sets are listed for some of the pairs at a time, about ``listed`` nodes in all; those of a batch go with it.
    """
    pairs = written(pairs.select("a", "b").distinct(), "affinity-pairs")
    steps = Steps(claims, heavy)
    work = steps.work(pairs.select(F.col("a").alias("x")).union(pairs.select("b")))
    batches = max(1, math.ceil((work.agg(F.sum("n")).first()[0] or 0) / listed))
    f = written(features(entities, claims), "affinity-features")
    out = None
    for i in range(batches):
        # By the second end: the part of a theory, of which there are more than suppliers.
        own = pairs.where(F.pmod(F.xxhash64("b"), F.lit(batches)) == i)
        hop = TwoHop(steps, own.select(F.col("a").alias("x")).union(own.select("b")), heavy)
        one = written(_scored(own, hop, f), "affinity")
        dropped(*hop.made)
        out = one if out is None else out.unionByName(one)
    return out


def _scored(pairs: DataFrame, hop: TwoHop, f: DataFrame) -> DataFrame:
    sizes = written(hop.sizes(), "affinity-sizes")
    hop.made.append(sizes)
    out = pairs.join(hop.common(pairs), ["a", "b"], "left")
    for e in ("a", "b"):
        out = out.join(f.select(F.col("entity").alias(e), F.col("predicates").alias(f"p{e}"), F.col("tokens").alias(f"t{e}")), e, "left").join(sizes.select(F.col("x").alias(e), F.col("n").alias(f"n{e}")), e, "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    common = lambda c: F.coalesce(F.size(F.array_intersect(f"{c}a", f"{c}b")), F.lit(0))
    two = _share(F.coalesce("both", F.lit(0)), F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0)), TWO_HOP)
    out = out.select("a", "b", two.alias("two_hop"), _share(common("p"), size("pa"), size("pb"), PREDICATES).alias("predicates"), _share(common("t"), size("ta"), size("tb"), BRIEF).alias("brief"))
    return out.withColumn("affinity", F.col("two_hop") + F.col("predicates") + F.col("brief"))


def trip_entities(entities: DataFrame, claims: DataFrame, without: list[str]) -> DataFrame:
    """(entity, role_type, cluster, bridge, predicates, tokens) of the entities outside the files in ``without``.

    The cluster is the least entity of its component, null for one without claims that
    have two ends; a bridge is a node whose removal splits its component.
    """
    cluster = components(claims).select(F.col("node").alias("entity"), F.col("component").alias("cluster"))
    bridge = articulation(claims).select(F.col("node").alias("entity"), F.lit(True).alias("bridge"))
    kept = entities.where(~F.col("file").isin(without)).select(F.col("var_name").alias("entity"), "role_type")
    own = kept.join(features(entities, claims), "entity").join(cluster, "entity", "left").join(bridge, "entity", "left")
    return own.select("entity", "role_type", "cluster", F.coalesce("bridge", F.lit(False)).alias("bridge"), "predicates", "tokens")


def pair_across(trip: DataFrame, refuted: DataFrame, n: int, floor: int = 250, unit: int = 62, seed: str = "") -> DataFrame:
    """(a, b, cluster_a, cluster_b, score, affinity): for each two clusters the n best pairs, by score * unit + affinity, but the refuted (a, b), either way round.

    Entities of a cluster with the same predicates, tokens and bridge are one shape; two
    entities of different clusters have no common two-hop node, so all pairs of two
    shapes rank alike.  Shapes meet by a predicate or token, and are compared; only then
    are the first entities of the best shapes, by a seeded hash, paired: with r refuted
    pairs between clusters, n + r shapes of n + sqrt(r) entities each always hold n others.
    score is 1 for each end with a brief and 3 for each that is a bridge.
    """
    known = written(trip.where("cluster is not null").withColumn("shape", F.xxhash64("cluster", "predicates", "tokens", "bridge")).withColumn("h", F.xxhash64("entity", F.lit(seed))), "trip-known")
    at = known.select(F.col("entity").alias("a"), F.col("cluster").alias("ca"))
    gone = refuted.select("a", "b").join(at, "a").join(at.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").where("ca <> cb")
    gone = written(gone.select(F.when(F.col("ca") < F.col("cb"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("ca") < F.col("cb"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct(), "trip-refuted")
    r = gone.count()
    deep = n + math.isqrt(r) + 1
    first = known.withColumn("i", F.row_number().over(Window.partitionBy("shape").orderBy("h", "entity"))).where(F.col("i") <= deep)
    first = written(first.select("shape", "h", "entity"), "trip-first")
    shape = written(known.select("shape", "cluster", "predicates", "tokens", "bridge").distinct(), "trip-shapes")
    marks = shape.select("shape", "cluster", F.explode(F.concat(F.transform("predicates", lambda p: F.concat(F.lit("p"), p)), F.transform("tokens", lambda t: F.concat(F.lit("t"), t)))).alias("mark"))
    x, y = (marks.select("mark", F.col("shape").alias(s), F.col("cluster").alias(f"cluster_{c}")) for s, c in (("sx", "a"), ("sy", "b")))
    met = x.join(y, "mark").where("cluster_a < cluster_b").select("sx", "sy").distinct()
    side = lambda s, c: shape.select(F.col("shape").alias(s), *[F.col(k).alias(f"{k}_{c}") for k in ("cluster", "predicates", "tokens", "bridge")])
    both = met.join(side("sx", "a"), "sx").join(side("sy", "b"), "sy")
    part = lambda k, w: _share(F.size(F.array_intersect(f"{k}_a", f"{k}_b")), F.size(f"{k}_a"), F.size(f"{k}_b"), w)
    end = lambda c: F.when(F.size(f"tokens_{c}") > 0, 1).otherwise(0) + F.when(F.col(f"bridge_{c}"), 3).otherwise(0)
    both = both.withColumn("affinity", part("predicates", PREDICATES) + part("tokens", BRIEF)).withColumn("score", end("a") + end("b")).where(F.col("affinity") >= floor)
    best = Window.partitionBy("cluster_a", "cluster_b").orderBy(F.desc(F.col("score") * unit + F.col("affinity")), "sx", "sy")
    both = both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n + r).select("sx", "sy", "cluster_a", "cluster_b", "score", "affinity", "place")
    ends = [first.select(F.col("shape").alias(s), F.col("h").alias(f"h{e}"), F.col("entity").alias(e)) for s, e in (("sx", "a"), ("sy", "b"))]
    pairs = both.join(ends[0], "sx").join(ends[1], "sy").join(gone, ["a", "b"], "left_anti")
    turn = Window.partitionBy("cluster_a", "cluster_b").orderBy("place", "ha", "hb", "a", "b")
    return pairs.withColumn("i", F.row_number().over(turn)).where(F.col("i") <= n).select("a", "b", "cluster_a", "cluster_b", "score", "affinity")
