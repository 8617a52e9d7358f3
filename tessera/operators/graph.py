"""Graph operators over binary claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import written as _cut
from . import reach


def adjacency(claims: DataFrame) -> DataFrame:
    """(u, v) both ways, distinct."""
    e = claims.where("object is not null").select(F.col("subject").alias("u"), F.col("object").alias("v"))
    return e.union(e.select("v", "u")).distinct()


def edge_count(claims: DataFrame) -> DataFrame:
    return adjacency(claims).agg(F.floor(F.count("*") / 2).alias("n_edges"))


def components(claims: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached; nodes of claims only.

    Minimum labels spread along edges and then jump (the label's own label), so the
    rounds grow with the logarithm of a component's width.
    """
    return _labels(_cut(adjacency(claims), "adj"))


def _labels(adj: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v), given both ways."""
    label = _cut(adj.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("l")), "label")
    while True:
        near = adj.join(label.select(F.col("u").alias("v"), F.col("l").alias("lv")), "v").groupBy("u").agg(F.min("lv").alias("m"))
        step = label.join(near, "u").select("u", F.least("l", "m").alias("l"))
        jump = step.select(F.col("u").alias("l"), F.col("l").alias("ll"))
        fresh = _cut(step.join(jump, "l", "left").select("u", F.least("l", F.coalesce("ll", "l")).alias("l")), "label")
        if fresh.join(label.withColumnRenamed("l", "was"), "u").where("l <> was").isEmpty():
            return fresh.select(F.col("u").alias("node"), F.col("l").alias("component"))
        label = fresh


def component_sizes(claims: DataFrame) -> DataFrame:
    return components(claims).groupBy("component").agg(F.count("*").alias("size"))


#: Edges, both ways, of a component that one task may take whole.
WHOLE = 1_000_000


def _parts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Iterative low-link pass over one component: the parts left when a vertex goes."""
    nodes = sorted(set(pdf["u"]))
    at = {n: i for i, n in enumerate(nodes)}
    adj: list[list[int]] = [[] for _ in nodes]
    for u, v in zip(pdf["u"], pdf["v"], strict=True):
        adj[at[u]].append(at[v])
    n = len(nodes)
    order, low, size, parent = [-1] * n, [0] * n, [1] * n, [-1] * n
    parts, below = [0] * n, [0] * n
    clock = 0
    stack = [(0, 0)]
    order[0] = low[0] = 0
    while stack:
        v, i = stack.pop()
        if i < len(adj[v]):
            stack.append((v, i + 1))
            w = adj[v][i]
            if order[w] < 0:
                clock += 1
                order[w] = low[w] = clock
                parent[w] = v
                stack.append((w, 0))
            elif w != parent[v]:
                low[v] = min(low[v], order[w])
        elif parent[v] >= 0:
            p = parent[v]
            low[p] = min(low[p], low[v])
            size[p] += size[v]
            if low[v] >= order[p]:
                parts[p] += 1
                below[p] += size[v]
    return pd.DataFrame([(nodes[v], parts[v] + (n - 1 > below[v])) for v in range(n)], columns=["node", "n"])


def _breadth_first(adj: DataFrame, roots: DataFrame) -> list[DataFrame]:
    """(node, parent) of each level of breadth-first trees; the neighbours of a level are in it, the one before or the next."""
    levels = [_cut(roots.select("node", F.lit(None).cast("string").alias("parent")), "bfs")]
    while not levels[-1].isEmpty():
        near = adj.join(levels[-1].select(F.col("node").alias("u")), "u").groupBy(F.col("v").alias("node")).agg(F.min("u").alias("parent"))
        for seen in levels[-2:]:
            near = near.join(seen.select("node"), "node", "left_anti")
        levels.append(_cut(near, "bfs"))
    return levels[:-1]


def _spread_parts(adj: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, n): what ``_parts`` says, for components of any size; the rounds grow with a component's width.

    A tree edge goes by the name of its lower end.  An edge outside a breadth-first tree
    closes a circle over the lowest common ancestor of its ends, which is neither of them, and all
    tree edges of a circle are of one block.  Pairs of ends climb level by level, those of
    one pair of parents as one, until they meet; what was passed is linked.  Blocks are the
    components of the links, and a vertex parts its component into the blocks that it is in.
    """
    levels = _breadth_first(adj, roots)
    tree = levels[0].withColumn("level", F.lit(0))
    for i, level in enumerate(levels[1:], 1):
        tree = tree.unionByName(level.withColumn("level", F.lit(i)))
    tree = _cut(tree, "bfs-tree")
    own = lambda x: tree.select(F.col("node").alias(x), F.col("parent").alias("p" + x), F.col("level").alias("l" + x))
    # From the lower end to the upper; of equal ones from the lesser name.
    rest = adj.join(own("u"), "u").join(own("v"), "v").where("lu > lv or lu = lv and u < v").where("pu is null or pu <> v")
    rest = _cut(rest.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("pu").alias("px"), F.col("lu").alias("level"), (F.col("lu") > F.col("lv")).alias("slant")), "outside")
    link = lambda df, x, y: df.select(F.col(x).alias("u"), F.col(y).alias("v"))
    pair = lambda df, x, y: df.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
    slant = rest.where("slant")
    links = link(rest, "x", "y").unionByName(link(slant, "x", "px"))
    up = None
    for i in range(len(levels) - 1, 0, -1):
        now = pair(rest.where((F.col("level") == i) & ~F.col("slant")), "x", "y")
        now = now.unionByName(pair(slant.where(F.col("level") == i + 1), "px", "y"))
        now = now if up is None else now.unionByName(pair(up, "px", "py"))
        parent = lambda x: levels[i].select(F.col("node").alias(x), F.col("parent").alias("p" + x))  # noqa: B023, E731
        up = _cut(now.distinct().join(parent("x"), "x").join(parent("y"), "y").where("px <> py"), "climbing")
        links = links.unionByName(link(up, "x", "px")).unionByName(link(up, "y", "py"))
        links = links.unionByName(link(up, "px", "py"))
    links = links.distinct()
    block = _labels(_cut(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links"))
    lower = tree.where("parent is not null").join(block, "node", "left").select("node", "parent", F.coalesce("component", "node").alias("block"))
    return lower.select("node", "block").unionByName(lower.select(F.col("parent").alias("node"), "block")).distinct().groupBy("node").agg(F.count("*").alias("n"))


def articulation(claims: DataFrame, count_singletons: bool = True, whole: int = WHOLE) -> DataFrame:
    """(node, degree): vertices of degree 2 and more whose removal splits their component.

    With count_singletons false only parts of two vertices and more count.  A part of one
    vertex is a neighbour of degree 1: such are counted, and left out of what is searched.
    Components of up to ``whole`` edges are each searched by one task, larger ones by all.
    """
    adj = _cut(adjacency(claims).where("u <> v"), "cut-adj")
    degree = _cut(adj.groupBy("u").agg(F.count("*").alias("degree")), "cut-degree")
    inner = degree.where("degree > 1").select("u")
    core = _cut(adj.join(inner, "u", "left_semi").join(inner.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v"), "cut-core")
    of = _labels(core)
    sizes = of.join(core.withColumnRenamed("u", "node"), "node").groupBy("component").agg(F.count("*").alias("edges"))
    large = _cut(sizes.where(F.col("edges") > whole).select("component"), "cut-large")
    at = _cut(core.join(of.select(F.col("node").alias("u"), "component"), "u").join(large.withColumn("large", F.lit(True)), "component", "left"), "cut-edges")
    parts = at.where("large is null").groupBy("component").applyInPandas(_parts, "node string, n long")
    if not large.isEmpty():
        parts = parts.unionByName(_spread_parts(at.where("large").select("u", "v"), large.select(F.col("component").alias("node"))))
    leaves = adj.join(degree.where("degree = 1").select(F.col("u").alias("v")), "v", "left_semi").groupBy("u").agg(F.count("*").alias("leaves"))
    got = degree.where("degree > 1").join(parts.withColumnRenamed("node", "u"), "u", "left").join(leaves, "u", "left")
    n = F.coalesce("n", F.lit(0)) + (F.coalesce("leaves", F.lit(0)) if count_singletons else F.lit(0))
    return got.where(n >= 2).select(F.col("u").alias("node"), "degree")


def within_two_hops(claims: DataFrame) -> DataFrame:
    adj = adjacency(claims)
    far = adj.join(adj.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
    return adj.union(far).where("u <> v").distinct()


#: Neighbours of a node whose lists are sent to each of its neighbours.
HEAVY = 1000


def two_hop_sizes(claims: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(u, n_two_hop): how many other nodes one or two claims lead to.

    A hub is a node of more than ``heavy`` neighbours.  Nodes of the same hubs have one
    shape, and those over a common hub are counted by shape.  The others are over light
    nodes: lists of light nodes meet the nodes that ask for them block by block
    (``reach``).  A node of one light neighbour has as many as that neighbour has.
    """
    ends = claims.where("object is not null and subject <> object")
    half = _cut(ends.select(F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v")).distinct(), "hop-adj")
    both = half.unionByName(half.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = _cut(both.groupBy("u").agg(F.count("*").alias("d")), "hop-degree")
    hubs = degree.where(F.col("d") > heavy).select(F.col("u").alias("v"))
    over = _cut(both.join(hubs, "v").groupBy("u").agg(F.array_sort(F.collect_list("v")).alias("hubs")), "hop-over")
    shapes = _cut(over.groupBy("hubs").agg(F.count("*").alias("n")).withColumn("shape", F.monotonically_increasing_id()), "hop-shapes")
    by_hub = shapes.select("shape", "n", F.explode("hubs").alias("hub"))
    meets = by_hub.select("shape", "hub").join(by_hub.select(F.col("shape").alias("other"), "n", "hub"), "hub").select("shape", "other", "n").distinct()
    meets = _cut(meets, "hop-meets")
    counted = meets.groupBy("shape").agg((F.sum("n") - 1).alias("over"))  # a node is over its hubs itself
    nodes = degree.join(over, "u", "left").join(shapes.select("hubs", "shape"), "hubs", "left")
    nodes = reach.dense(_cut(nodes.select("u", "shape", "d").withColumn("id", F.monotonically_increasing_id()), "hop-nodes"))
    as_ = lambda x: nodes.select(F.col("u").alias(x), F.col("id").alias(f"id_{x}"), F.col("shape").alias(f"shape_{x}"), F.col("d").alias(f"d_{x}"))
    half = _cut(half.join(as_("u"), "u").drop("u").join(as_("v"), "v").drop("v"), "hop-edges")
    e = half.unionByName(half.select(*[F.col(f"{c}_{x}").alias(f"{c}_{y}") for x, y in ("vu", "uv") for c in ("id", "shape", "d")]))
    hub_u, hub_v = F.col("d_u") > heavy, F.col("d_v") > heavy
    leaf = ~hub_u & ~hub_v & (F.col("d_u") == 1)
    lists = e.where(~hub_u & ~leaf).groupBy("id_u", "shape_u").agg(F.collect_list("id_v").alias("near"), F.collect_list("shape_v").alias("shapes"), F.max(~hub_v & (F.col("d_v") > 1)).alias("far"))
    lists = _cut(lists, "hop-lists")
    known = meets.select(F.col("shape").alias("shape_u"), "other")
    fresh = lambda df: df.join(known, ["shape_u", "other"], "left_anti")
    # Direct neighbours alone, where no other light node lies behind them.
    near = lists.where("not far")
    plain = near.select("id_u", (F.size("near") - F.size("shapes")).cast("long").alias("n"))
    direct = fresh(near.select("id_u", "shape_u", F.explode("shapes").alias("other"))).select("id_u", F.lit(1).cast("long").alias("n"))
    wide = lists.where("far")
    none = F.lit(None).cast(wide.schema["near"].dataType)
    rows = wide.select(F.col("id_u").alias("row"), F.col("shape_u").alias("mine"), F.col("id_u").alias("a"), F.col("near").alias("near_a"), F.lit(None).cast("long").alias("b"), none.alias("near_b"))
    light = reach.counted(rows, wide.select(F.col("id_u").alias("v"), "near"), nodes.where("shape is not null").select("id", "shape"))
    light = fresh(light.select(F.col("row").cast(nodes.schema["id"].dataType).alias("id_u"), F.col("mine").alias("shape_u"), "other", "n")).select("id_u", "n")
    light = _cut(light.unionByName(plain).unionByName(direct).unionByName(e.where(leaf).select("id_u", F.col("d_v").alias("n"))), "hop-light")
    # From a hub: a node of one light neighbour is met once, and so are all nodes met directly but for those behind light ones as well.
    first = e.where(hub_u)
    behind = e.where(~hub_u).select(F.col("id_u").alias("id_v"), F.col("id_v").alias("to"), F.col("shape_v").alias("other"), F.col("d_v").alias("d"))
    onward = behind.where("d > 1")
    second = first.where(~hub_v).select("id_u", "shape_u", "id_v").join(onward, "id_v").where("id_u <> to").select("id_u", "shape_u", F.col("to").alias("id_v"), "other")
    far = fresh(first.select("id_u", "shape_u", "id_v", F.col("shape_v").alias("other")).unionByName(second).distinct()).groupBy("id_u").agg(F.count("*").alias("n"))
    ends = behind.where("d = 1").groupBy("id_v").agg(F.count("*").alias("n"))
    alone = first.where(~hub_v).select("id_u", "id_v").join(ends, "id_v").groupBy("id_u").agg(F.sum("n").alias("n"))
    listed = light.unionByName(far).unionByName(alone).groupBy(F.col("id_u").alias("id")).agg(F.sum("n").alias("n"))
    out = nodes.join(counted, "shape", "left").join(listed, "id", "left").select("u", (F.coalesce("n", F.lit(0)) + F.coalesce("over", F.lit(0))).alias("n_two_hop"))
    return out.where("n_two_hop > 0")


def support_edges(claims: DataFrame) -> DataFrame:
    kind = F.when(F.col("predicate").isin("Proposes", "TheoryOf"), "supports").when(F.col("predicate") == "Disputes", "challenges").otherwise("related")
    return claims.where("object is not null").select("object", kind.alias("kind")).groupBy("object", "kind").agg(F.count("*").alias("n"))


#: Neighbours in one piece of a node's list.
PIECE = 512


def walks(claims: DataFrame, starts: DataFrame, hops: int = 5, seed: int = 1, tries: int = 8, piece: int = PIECE) -> DataFrame:
    """(start, step, node): a walk without revisits from every start (column start); the next node is drawn with weight 1 / (1 + degree).

    All walks take a hop at once.  A node's neighbours stand in pieces with running
    weights: a walk draws a piece, then a neighbour in it, and draws again if that was
    visited, so it never meets all the neighbours of a hub.  Walks that were unlucky
    ``tries`` times draw by the least of keyed exponentials among all they haven't
    visited; a walk without such a neighbour ends.  Draws are by hashes of seed, start and step.
    """
    adj = _cut(adjacency(claims).where("u <> v"), "walk-adj")
    degree = adj.groupBy("u").agg(F.count("*").alias("d"))
    weighted = _cut(adj.join(degree.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v").join(degree, "u").select("u", "v", (1 / (1 + F.col("dv"))).alias("w"), F.pmod(F.xxhash64("v"), F.ceil(F.col("d") / piece).cast("long")).alias("piece")), "walk-weights")
    # A piece holds about ``piece`` neighbours, whatever the degree; a node has one row of its pieces' weights.
    lists = _cut(weighted.groupBy("u", "piece").agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("near"), F.sum("w").alias("w")), "walk-pieces")
    heads = _cut(lists.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("piece", "w"))).alias("pieces")), "walk-heads")
    draw = lambda *by: (F.pmod(F.xxhash64("start", F.lit(seed), *by), F.lit(1 << 53)).cast("double") + 0.5) / float(1 << 53)

    def pick(items: Column, u: Column) -> Column:
        """The element that u (0 to 1) of the whole weight falls on."""
        total = F.aggregate(items, F.lit(0.0), lambda s, x: s + x["w"])
        spot = lambda s, x: F.struct((s["left"] - x["w"]).alias("left"), F.when(s["at"] >= 0, s["at"]).when(s["left"] < x["w"], s["n"]).otherwise(F.lit(-1)).alias("at"), (s["n"] + 1).alias("n"))
        at = F.aggregate(items, F.struct((u * total).alias("left"), F.lit(-1).alias("at"), F.lit(0).alias("n")), spot)["at"]
        return F.element_at(items, F.when(at < 0, F.size(items)).otherwise(at + 1).cast("int"))

    now = _cut(starts.select("start").distinct().withColumn("path", F.array("start")), "walk")
    for step in range(1, hops + 1):
        open_ = now.where(F.size("path") == step)
        done, key = None, F.element_at("path", -1)
        for t in range(tries):
            at = open_.withColumn("u", key).join(heads, "u").withColumn("piece", pick(F.col("pieces"), draw(F.lit(step), F.lit(t), F.lit("piece")))["piece"])
            got = at.join(lists.select("u", "piece", "near"), ["u", "piece"]).select("start", "path", pick(F.col("near"), draw(F.lit(step), F.lit(t), F.lit("near")))["v"].alias("v"))
            got = _cut(got.withColumn("new", ~F.array_contains("path", F.col("v"))), "walk-try")
            hit = got.where("new").select("start", F.array_append("path", F.col("v")).alias("path"))
            done = hit if done is None else done.unionByName(hit)
            open_ = got.where("not new").select("start", "path")
            if open_.isEmpty():
                break
        else:
            rest = open_.withColumn("u", key).join(weighted, "u").where(~F.array_contains("path", F.col("v")))
            rest = rest.groupBy("start", "path").agg(F.min_by("v", F.struct((-F.log(draw(F.lit(step), F.col("v"))) / F.col("w")).alias("k"), "v")).alias("v"))
            rest = rest.select("start", F.array_append("path", F.col("v")).alias("path"))
            done = rest if done is None else done.unionByName(rest)
        ended = now.join(done.select("start"), "start", "left_anti")
        now = _cut(done.unionByName(ended), "walk")
    return now.select("start", F.posexplode("path").alias("step", "node"))


def walk(claims: DataFrame, start: str, hops: int = 5, seed: int = 1) -> DataFrame:
    """(step, node): the walk from one node."""
    one = claims.sparkSession.range(1).select(F.lit(start).alias("start"))
    return walks(claims, one, hops, seed).select("step", "node")


def label_propagation(claims: DataFrame, rounds: int = 12) -> DataFrame:
    """Synchronous label propagation: each round takes the neighbours' most frequent label, smallest of equals."""
    adj = _cut(adjacency(claims), "lpa")
    label = adj.select("u").distinct().withColumn("l", F.col("u"))
    for _ in range(rounds):
        votes = adj.join(label.select(F.col("u").alias("v"), "l"), "v").groupBy("u", "l").agg(F.count("*").alias("n"))
        fresh = _cut(votes.groupBy("u").agg(F.min_by("l", F.struct((-F.col("n")).alias("n"), "l")).alias("l")), "lpa")
        if fresh.join(label.withColumnRenamed("l", "was"), "u").where("l <> was").isEmpty():
            break
        label = fresh
    return label.select(F.col("u").alias("node"), F.col("l").alias("community"))


def merge_entity(claims: DataFrame, a: str, b: str) -> DataFrame:
    """Claims with a replaced by b, and one audit claim."""
    sub = lambda c: F.when(F.col(c) == a, b).otherwise(F.col(c)).alias(c)
    out = claims.select("predicate", sub("subject"), sub("object"))
    audit = claims.sparkSession.range(1).select(F.lit("AbsorbedAlternate").alias("predicate"), F.lit(b).alias("subject"), F.lit(None).cast("string").alias("object"))
    return out.unionByName(audit)


def union_stores(stores: dict[str, DataFrame]) -> DataFrame:
    """Claims of several stores under their namespaces; equal names stay apart."""
    parts = [df.select(F.concat(F.lit(n + "."), "subject").alias("subject"), "predicate", F.concat(F.lit(n + "."), "object").alias("object")) for n, df in stores.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def chains(supersedes: DataFrame) -> DataFrame:
    """(head, n_superseded, oldest) of each decision that none supersedes, from (newer, older).

    Pointers double each round, so a chain of n decisions takes log n rounds; of several older
    ones of a decision the last by name is followed.  Decisions on a cycle have no head.
    """
    step = supersedes.groupBy("newer").agg(F.max("older").alias("older"))
    jump = _cut(step.select("newer", F.col("older").alias("far"), F.lit(1).cast("long").alias("n")), "chains")
    nodes = jump.count()
    reach = 1
    while reach < nodes:
        more = jump.select(F.col("newer").alias("far"), F.col("far").alias("farther"), F.col("n").alias("m"))
        fresh = _cut(jump.join(more, "far", "left").select("newer", F.coalesce("farther", "far").alias("far"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "chains")
        if fresh.agg(F.sum("n")).first()[0] == jump.agg(F.sum("n")).first()[0]:
            break
        jump, reach = fresh, reach * 2
    return jump.join(supersedes.select(F.col("older").alias("newer")), "newer", "left_anti").select(F.col("newer").alias("head"), F.col("n").alias("n_superseded"), F.col("far").alias("oldest"))
