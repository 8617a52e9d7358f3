"""Weak spots: what nothing disputes, without a list of all that is disputed in the driver."""

import pytest

from tessera.plans import knowledge, registry

SF = "/root/testdata/sf0.001"
CLAIM = "var_name string, predicate string, subject string, object string, prov_ref string, file string"


@pytest.mark.parametrize("disputed", [[], ["P1"], ["P1", None], [None]])
def test_calm_is_what_not_in_says(spark, disputed):
    rows = [("Proposes", o) for o in ("P1", "P2", "P2", None)] + [("Disputes", o) for o in disputed]
    claims = spark.createDataFrame([(f"c{i}", p, "S1", o, "D1", "f") for i, (p, o) in enumerate(rows)], CLAIM)
    calm = lambda text: sorted(str(r[0]) for r in spark.sql(f"WITH {text[text.index('calm AS'):text.index('vulns AS')].rstrip().rstrip(',')} SELECT object FROM calm", claims=claims).collect())
    assert calm(knowledge._SPARK_VULNS) == calm(knowledge._VULNS)


@pytest.mark.parametrize("name", ["b3_node_lines", "h7_report", "r14_sensor_targets", "r23_vulnerabilities", "g11_why", "g12_topology_report"])
def test_disputed_objects_are_not_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftAnti" in plan and not [line for line in plan.splitlines() if "BroadcastHashJoin" in line]


def test_claims_are_counted_before_they_meet_the_schema(spark):
    plan = registry.queries()["a42_slots"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("count(var_name")
