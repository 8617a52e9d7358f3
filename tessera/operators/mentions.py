"""Which texts name which targets: many surfaces against many texts, without comparing all with all.

A surface is found where it stands with a word boundary at both ends (a boundary is
between an ASCII letter, digit or underscore and anything else).  So each maximal run
of word characters in a surface is a whole token of every text that names it.  A
surface is keyed by that of its tokens which the fewest texts hold; texts and surfaces
meet by it, and only those that meet are compared letter by letter.  A surface
without word characters can only stand between two words: it is a whole gap of the
text, and its own key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written
from .graph import adjacency
from .skew import SHARE, join_salted

#: Bytes of a surface: a shorter one is too common, a longer one a sentence.
SHORTEST, LONGEST = 6, 60
#: Claims whose ends are looked up at once; the shuffles of each batch go with it.
CLAIMS = 10_000_000
_WORD, _GAP = "[0-9A-Za-z_]+", "[^0-9A-Za-z_]+"


def surfaces(entities: DataFrame, target: str = "var_name", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """(target, surface, place): the name (place 0) and aliases that can be looked for, trimmed, each once."""
    all_ = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    s = entities.select(F.col(target).alias("target"), F.posexplode(all_).alias("place", "surface")).withColumn("surface", F.regexp_replace("surface", r"(?U)^\s+|\s+$", ""))
    return s.where(F.octet_length("surface").between(SHORTEST, LONGEST)).groupBy("target", "surface").agg(F.min("place").alias("place"))


def _tokens(text: Column) -> Column:
    gaps = F.filter(F.regexp_extract_all(text, F.lit(_GAP), F.lit(0)), lambda g: F.octet_length(g).between(SHORTEST, LONGEST))
    return F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), gaps))


def pattern(surface: Column) -> Column:
    """The surface between word boundaries, as a regular expression."""
    first, last = F.substring(surface, 1, 1), F.substring(surface, -1, 1)
    before = F.when(first.rlike(_WORD), F.lit("(?<![0-9A-Za-z_])")).otherwise(F.lit("(?<=[0-9A-Za-z_])"))
    after = F.when(last.rlike(_WORD), F.lit("(?![0-9A-Za-z_])")).otherwise(F.lit("(?=[0-9A-Za-z_])"))
    return F.concat(before, F.lit("\\Q"), F.replace(surface, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"), after)


def found(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, surface, at): where (1: at the first character) each of the wanted surfaces first stands in a text (id, text).

    Tokens that many texts hold but no surface is keyed by are left out before anything is shuffled.
    """
    texts = written(texts.select("id", "text"), "mention-texts")
    token = texts.select("id", F.explode(_tokens(F.col("text"))).alias("token"))
    common = written(token.groupBy("token").agg(F.count("*").alias("texts")), "mention-common")
    own = F.when(F.col("surface").rlike(_WORD), F.array_distinct(F.regexp_extract_all("surface", F.lit(_WORD), F.lit(0)))).otherwise(F.array("surface"))
    parts = wanted.select("surface").distinct().select("surface", F.explode(own).alias("token")).join(common, "token", "left")
    keys = parts.groupBy("surface").agg(F.min(F.struct("texts", "token")).alias("key"), F.count_if(F.col("texts").isNull()).alias("absent"))
    keys = written(keys.where("absent = 0").select("surface", F.col("key.token").alias("token")), "mention-keys")
    often = common.join(F.broadcast(common.agg(F.sum("texts").alias("all"))), F.col("texts") * SHARE >= F.col("all")).join(keys, "token", "left_anti").select("token")  # SHARE rows at most
    token = written(token.join(F.broadcast(often), "token", "left_anti").select("id", "token"), "mention-tokens")
    met = join_salted(token, keys, "token").groupBy("id").agg(F.collect_set("surface").alias("surfaces"))
    both = texts.join(met, "id").select("id", "text", F.explode("surfaces").alias("surface"))
    return both.select("id", "surface", F.regexp_instr("text", pattern(F.col("surface"))).alias("at")).where("at > 0")


def named(texts: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, surface) and (kind, target): which kinds of targets a text names, and what is of a kind.

    Targets of the same surfaces are of one kind, whose name is its least target: what names one
    of them names all.  So nothing but the result itself is as large as texts times targets.
    """
    hits = written(found(texts, wanted), "mention-hits")
    held = wanted.join(hits.select("surface").distinct(), "surface", "left_semi")
    own = written(held.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("place", "surface"))).alias("forms")), "mention-forms")
    kinds = written(own.groupBy("forms").agg(F.min("target").alias("kind")), "mention-kinds")
    of = written(join_salted(own, kinds, "forms").select("kind", "target"), "mention-targets")
    met = join_salted(hits, kinds.select("kind", F.inline("forms")), "surface")
    out = written(met.groupBy("id", "kind").agg(F.min_by("surface", F.struct("at", "place")).alias("surface")), "mention-named")
    return out, of


def mentions(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, target, surface) of the targets of ``wanted`` (target, surface, place) that a text (id, text) names.

    The surface is the first that stands in the text; of two at one place that of the lesser place in
    the list.  A text doesn't mention itself (its id as target).  Texts of one id are taken together.
    """
    by_kind, of = named(texts, wanted)
    return join_salted(by_kind, of, "kind").where("id <> target").select("id", "target", "surface")


def related(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """The (a, b) of pairs that a claim joins, or two claims over a third entity.

    Neighbours are listed for the end that has fewer of them.
    """
    adj = written(adjacency(claims), "mention-adj")
    pairs = written(pairs.select("a", "b").distinct(), "mention-pairs")
    degree = adj.groupBy("u").agg(F.count("*").alias("n"))
    sized = pairs.join(degree.select(F.col("u").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("u").alias("b"), F.col("n").alias("nb")), "b")
    near, far = F.when(F.col("na") <= F.col("nb"), F.col("a")).otherwise(F.col("b")), F.when(F.col("na") <= F.col("nb"), F.col("b")).otherwise(F.col("a"))
    ends = sized.select("a", "b", near.alias("u"), far.alias("far"))
    steps = join_salted(ends, adj, "u")
    direct = steps.where("v = far").select("a", "b")
    over = steps.where("v <> far").select("a", "b", F.xxhash64("v", "far").alias("edge"), F.col("v").alias("mid"), "far")
    two = over.join(adj.select(F.xxhash64("u", "v").alias("edge"), F.col("u").alias("mid"), F.col("v").alias("far")), ["edge", "mid", "far"], "left_semi").select("a", "b")
    return direct.unionByName(two).distinct()


def _near(by_kind: DataFrame, of: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, kind, near): those of a named kind that a claim joins with id, or two claims over a third entity.

    A step is a claim's predicate and the way it is gone.  Only where the steps that leave an id, or those that
    leave what they lead to, are among the steps that lead to a kind, claims are looked up.
    """
    predicate = F.coalesce("predicate", F.lit("")) if "predicate" in claims.columns else F.lit("")
    ends = written(claims.where("object is not null").select(predicate.alias("predicate"), "subject", "object"), "mention-claims")
    there, back = F.concat(F.lit(">"), "predicate"), F.concat(F.lit("<"), "predicate")
    edges = ends.select(F.col("subject").alias("id"), F.col("object").alias("to"), there.alias("step")).unionByName(ends.select(F.col("object").alias("id"), F.col("subject").alias("to"), back.alias("step")))
    turned = lambda c: F.concat(F.when(F.substring(c, 1, 1) == ">", "<").otherwise(">"), F.substring(c, 2, 1 << 30))
    steps = written(edges.groupBy("id").agg(F.array_sort(F.collect_set("step")).alias("steps")), "mention-steps")
    sets = written(steps.select("steps").distinct(), "mention-step-sets")
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    after = sets.select(F.explode("steps").alias("step"), "steps").groupBy(turned(F.col("step")).alias("step")).agg(merged("steps").alias("after"))
    second = sets.select("steps", F.explode("steps").alias("step")).join(after, "step").groupBy("steps").agg(merged("after").alias("second"))
    into = of.join(steps.withColumnRenamed("id", "target"), "target").groupBy("kind").agg(F.transform(merged("steps"), turned).alias("into"))
    asked = by_kind.select("id", "kind").join(steps.join(second, "steps"), "id").join(into, "kind")
    asked = asked.select("id", "kind", F.array_intersect("steps", "into").alias("one"), F.array_intersect("second", "into").alias("two"))
    asked = written(asked.where("size(one) > 0 or size(two) > 0"), "mention-asked")

    def last(which: str, edges: DataFrame = edges) -> DataFrame:
        """(id, kind, near): steps into the kinds asked for."""
        some = asked.select(F.explode(which).alias("step")).distinct()
        return edges.join(some, "step", "left_semi").select("id", F.col("to").alias("target")).join(of, "target").select("id", "kind", F.col("target").alias("near"))

    one, two = (asked.where(F.size(c) > 0).select("id", "kind") for c in ("one", "two"))
    batches = math.ceil(ends.count() / CLAIMS) or 1
    out = None
    for i in range(batches):
        own = F.pmod(F.xxhash64("id"), F.lit(batches)) == i
        some = written(last("one", edges.where(own)).join(one.where(own), ["id", "kind"], "left_semi"), "mention-near")
        out = some if out is None else out.unionByName(some)
    if not two.isEmpty():
        over = join_salted(edges.select("id", F.col("to").alias("mid")), two, "id").select("id", F.struct("mid", "kind").alias("at"))
        onward = last("two").select(F.struct(F.col("id").alias("mid"), "kind").alias("at"), "near")
        further = join_salted(written(over.distinct(), "mention-over"), onward, "at").select("id", "at.kind", "near")
        out = out.unionByName(written(further, "mention-further"))
    return out


def _judged(texts: DataFrame, entities: DataFrame, claims: DataFrame, exempt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, kind, surface, near, marked) and (kind, target): the kinds a text names, with those of them that claims lead to and that are marked."""
    by_kind, of = named(texts, surfaces(entities))
    near = _near(by_kind, of, claims).select("id", "kind", "near", F.lit(None).cast("string").alias("marked"))
    marks = exempt.select(F.col("entity").alias("id"), "target").join(of, "target").select("id", "kind", F.lit(None).cast("string").alias("near"), F.col("target").alias("marked"))
    apart = near.unionByName(marks).groupBy("id", "kind").agg(F.collect_set("near").alias("near"), F.collect_set("marked").alias("marked"))
    none = F.expr("cast(array() as array<string>)")
    out = by_kind.join(apart, ["id", "kind"], "left").select("id", "kind", "surface", F.coalesce("near", none).alias("near"), F.coalesce("marked", none).alias("marked"))
    out = written(out, "mention-judged")
    return out, of


def drift(texts: DataFrame, entities: DataFrame, claims: DataFrame, exempt: DataFrame) -> DataFrame:
    """(entity, target, surface, exempted): what an entity's brief (id, text) names though no path of one or two claims leads there.

    exempt holds the (entity, target) that were marked as mere mentions; they are shown, and marked.
    """
    judged, of = _judged(texts, entities, claims, exempt)
    left = join_salted(judged, of, "kind").where((F.col("id") != F.col("target")) & ~F.array_contains("near", F.col("target")))
    return left.select(F.col("id").alias("entity"), "target", "surface", F.array_contains("marked", F.col("target")).alias("exempted"))


def drift_report(texts: DataFrame, entities: DataFrame, claims: DataFrame, exempt: DataFrame) -> DataFrame:
    """``report`` of ``drift``: targets are listed once for all entities that name the same kinds.

    A kind's targets travel as one list, so rows that are shuffled grow with the kinds named, not with the targets.
    """
    judged, of = _judged(texts, entities, claims, exempt)
    own = judged.groupBy("id").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("marked")).alias("marked"))
    exempted = F.size(F.array_except("marked", F.concat(F.array("id"), "near"))).cast("long")
    own = written(own.select("id", "kinds", exempted.alias("n_exempted"), F.array_distinct(F.concat("near", "marked")).alias("less")), "mention-entities")
    each = written(own.select("kinds").distinct().select("kinds", F.explode("kinds").alias("kind")), "mention-together")
    lists = written(of.groupBy("kind").agg(F.collect_list("target").alias("targets")), "mention-lists")
    lists = join_salted(each, lists, "kind").groupBy("kinds").agg(F.array_sort(F.flatten(F.collect_list("targets"))).alias("targets"))
    out = join_salted(own, lists, "kinds").select(F.col("id").alias("entity"), "n_exempted", F.array_except("targets", F.concat(F.array("id"), "less")).alias("open"))
    out = out.select("entity", F.size("open").cast("long").alias("n_open"), "n_exempted", F.array_join("open", ",").alias("targets"))
    return out.where("n_open > 0 or n_exempted > 0")


def report(drifted: DataFrame) -> DataFrame:
    """(entity, n_open, n_exempted, targets): the open ones of each entity, in order of the target."""
    opened = F.when(~F.col("exempted"), F.col("target"))
    return drifted.groupBy("entity").agg(F.count(opened).alias("n_open"), F.count_if("exempted").alias("n_exempted"), F.array_join(F.array_sort(F.collect_list(opened)), ",").alias("targets"))
