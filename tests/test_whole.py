"""Queries over every claim, against brute force on a small set of tables."""

from collections import Counter, defaultdict
from datetime import datetime

import pytest

from tessera.operators import integrity as I
from tessera.plans import registry
from tessera.sources.views import view

from .test_operators import CLAIM, reach

PRIORITY = ("1-URGENT", "5-LOW")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Two regions; what is below the views' old limits of quantity, price and size is here too."""
    at = tmp_path_factory.mktemp("small")
    put = lambda name, ddl, rows: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    put("region", "r_regionkey long, r_name string", [(0, "AFRICA"), (1, "ASIA")])
    put("nation", "n_nationkey long, n_name string, n_regionkey long", [(0, "A", 0), (1, "B", 0), (2, "C", 1)])
    put("customer", "c_custkey long, c_name string, c_mktsegment string, c_nationkey long", [(0, "c0", "AUTO", 0), (1, "c1", "AUTO", 1), (2, "c2", "BUILD", 2)])
    put("supplier", "s_suppkey long, s_name string, s_nationkey long", [(0, "s0", 0), (1, "s1", 2)])
    put("part", "p_partkey long, p_name string, p_type string, p_brand string, p_size int", [(0, "p0", "steel", "B1", 1), (1, "p1", "tin", "B1", 4), (2, "p2", "tin", "B2", 40)])
    put("orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", [(i, i % 2, "O", 1000.0 if i else 500000.0, datetime(2024, 1, 1), PRIORITY[i % 2]) for i in range(4)])
    put("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string", [(0, 0, 0, 1, 50.0, "N"), (0, 1, 0, 2, 7.0, "R"), (1, 2, 1, 1, 49.0, "R"), (1, 1, 1, 2, 3.0, "N")])
    put("documents", "doc_id long, text string, lang string, source string", [(i, "quoted", "en", "src1") for i in range(300)])
    return str(at)


def edges(rows):
    return [(r["subject"], r["object"]) for r in rows if r["object"] is not None]


def run(spark, sf, name):
    return registry.queries()[name](spark, sf).collect()


def test_graph_of_every_claim(spark, small):
    e = edges(registry.queries()["a22_edges"](spark, small).collect())
    nodes = {n for x in e for n in x}
    assert {"R0", "N0", "C0", "S0"} <= nodes
    parts = reach(e)
    assert {r["node"]: r["component"] for r in run(spark, small, "g3_components")} == {n: min(p) for p in parts for n in p}
    assert {r["component"]: r["size"] for r in run(spark, small, "g4_component_sizes")} == {min(p): len(p) for p in parts}
    near = defaultdict(set)
    for a, b in e:
        near[a].add(b)
        near[b].add(a)
    assert {r["u"]: r["n_two_hop"] for r in run(spark, small, "g20_two_hops")} == {u: len({w for v in near[u] for w in {v} | near[v]} - {u}) for u in near}
    file = {r["var_name"]: r["file"] for r in view(spark, small, "entities").collect()}
    where = {n: i for i, p in enumerate(parts) for n in p if n in file}
    pairs = lambda key: sum(n * (n - 1) / 2 for n in Counter(map(key, where)).values())
    both = pairs(lambda n: (file[n], where[n]))
    assert run(spark, small, "w3_clustering")[0]["value"] == round(both / (pairs(file.get) + pairs(where.get) - both), 6)


def test_cuts_communities_and_walks_go_over_every_claim(spark, small):
    e = edges(registry.queries()["a22_edges"](spark, small).collect())
    nodes = {n for x in e for n in x}
    degree = lambda n: len({m for x in e if n in x for m in x if m != n})
    assert {r["node"] for r in run(spark, small, "g16_articulation")} == {n for n in nodes if degree(n) >= 2 and len(reach(e, n)) > len(reach(e))}
    large = lambda n: sum(len(p) > 1 for p in reach(e, n)) - sum(len(p) > 1 for p in reach(e) if n not in p)
    assert {r["node"] for r in run(spark, small, "g8_bridges")} == {n for n in nodes if degree(n) >= 2 and large(n) >= 2}
    assert {r["node"] for r in run(spark, small, "g14_label_propagation")} == nodes
    steps = [r["node"] for r in sorted(run(spark, small, "g18_walk"))]
    assert steps[0] == "S1" and len(steps) > 1
    assert all((a, b) in e or (b, a) in e for a, b in zip(steps, steps[1:], strict=False))


def test_claims_of_every_subject(spark, small):
    want = defaultdict(list)
    for r in run(spark, small, "a2_claims"):
        want[r["subject"], r["predicate"]].append(r["var_name"])
    got = {(r["subject"], r["predicate"]): r["names"] for r in run(spark, small, "h14_claims_by_predicate")}
    assert got == {k: ",".join(sorted(x)) for k, x in want.items()}
    assert {"C0", "N0", "P0"} <= {s for s, _ in got}


def test_relations_have_no_limits(spark, small):
    c = run(spark, small, "a2_claims")
    kinds = Counter(r["predicate"] for r in c)
    assert kinds == {"LocatedIn": 8, "InvestigatedBy": 4, "TheoryOf": 2, "Disputes": 2, "Proposes": 2, "FormedAt": 2, "IsCognitiveBias": 2}
    assert len({r["var_name"] for r in c}) == len(c)
    assert {r["var_name"] for r in run(spark, small, "a1_entities") if r["role_type"] == "Event"} == {"O0", "O1", "O2", "O3"}
    assert {r["n"] for r in run(spark, small, "h2_by_role") if r["role_type"] == "Event"} == {4}
    assert {r["subject"] for r in run(spark, small, "q13_disputes")} == {"S0", "S1"}


def test_claims_cite_documents_over_150(spark, tmp_path):
    """Nine hundred orders over 300 documents: each is cited by three."""
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where("o_orderkey < 900").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(300).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'src1' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    used = view(spark, str(tmp_path), "claims").where("predicate = 'InvestigatedBy'").groupBy("prov_ref").count().collect()
    assert len(used) == 300 and {r["count"] for r in used} == {3}


def test_thin_files(spark, small):
    c = [("c0", "P", "a", "b", "D0", "quoted"), ("c1", "P", "a", "b", "D1", "quoted"), ("c2", "P", "a", "b", "D1", "empty"), ("c3", "P", "a", "b", "D9", "empty"), ("c4", "P", "a", "b", None, "none"), ("c5", "P", "a", "b", "D2", "null")]
    p = spark.createDataFrame([("D0", "o", "said"), ("D0", "o", "again"), ("D1", "o", ""), ("D2", "o", None)], "var_name string, origin string, quote string")
    assert {(r["file"], r["n_claims"]) for r in I.thin_files(spark.createDataFrame(c, CLAIM), p).collect()} == {("empty", 2), ("none", 1), ("null", 1)}
    assert run(spark, small, "g7_thin_provenance") == []
