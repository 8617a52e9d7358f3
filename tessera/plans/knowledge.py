"""Queries over the knowledge base that one SQL text states for both engines, and some in DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import retrieval as R
from ..operators import similarity as D
from ..sources.stored import written

_ENDS = "ends AS (SELECT subject AS entity, var_name AS claim, predicate FROM {claims} UNION ALL SELECT object, var_name, predicate FROM {claims} WHERE object IS NOT NULL)"
#: Weak spots of the knowledge base, as the detectors report them.
_VULNS = """sole AS (SELECT object FROM {claims} WHERE predicate IN ('Proposes', 'ProposesOrg') GROUP BY object HAVING count(*) = 1),
calm AS (SELECT DISTINCT object FROM {claims} WHERE predicate = 'Proposes' AND object NOT IN (SELECT object FROM {claims} WHERE predicate = 'Disputes')),
vulns AS (SELECT 'single_source' AS kind, object AS entity, 'warning' AS severity FROM sole UNION ALL SELECT 'uncontested', object, 'info' FROM calm
  UNION ALL SELECT 'concentration_risk', entity, 'info' FROM (SELECT entity, count(*) AS d FROM ends GROUP BY entity) x
    JOIN (SELECT greatest(5.0, avg(d) + 2 * stddev_pop(d)) AS cut FROM (SELECT count(*) AS d FROM ends GROUP BY entity) y) z ON x.d >= z.cut
  UNION ALL SELECT 'thin_provenance', c.file, 'warning' FROM {claims} c LEFT JOIN (SELECT DISTINCT var_name FROM {provenance} WHERE length(quote) > 0) q ON q.var_name = c.prov_ref GROUP BY c.file HAVING count(q.var_name) = 0)"""
#: What Spark runs for calm: NOT IN would send all disputed objects to the driver. One null among them leaves nothing; a null is never calm, unless nothing is disputed.
_CALM = """calm AS (SELECT p.object FROM (SELECT DISTINCT object FROM {claims} WHERE predicate = 'Proposes') p CROSS JOIN (SELECT count(*) AS n, count(object) AS known FROM {claims} WHERE predicate = 'Disputes') t
  LEFT ANTI JOIN (SELECT DISTINCT object FROM {claims} WHERE predicate = 'Disputes') d ON d.object = p.object WHERE n = 0 OR n = known AND p.object IS NOT NULL)"""
_SPARK_VULNS = re.sub(r"calm AS .*", lambda _: _CALM + ",", _VULNS, count=1)
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_NET = "row_number() OVER (PARTITION BY {} ORDER BY {})"
_VERDICT = """CASE WHEN c + x + i = 0 AND p > 0 THEN 'pending' WHEN c + x + i = 0 THEN 'no_signal' WHEN x > c AND x >= i THEN 'challenged' WHEN c > i THEN 'corroborated'
  WHEN i > 0 THEN 'irrelevant' WHEN x > 0 THEN 'challenged' ELSE 'pending' END"""
_TALLY = """tally AS (SELECT hypothesis, CASE WHEN prediction_type = '' THEN 'structural_fragility' ELSE prediction_type END AS kind, count(*) AS n, min(pos) AS seen,
  count(CASE WHEN resolution = 'corroborated' THEN 1 END) AS c, count(CASE WHEN resolution = 'challenged' THEN 1 END) AS x, count(CASE WHEN resolution = 'irrelevant' THEN 1 END) AS i,
  count(CASE WHEN resolution = '' THEN 1 END) AS p, min(CASE WHEN resolution <> '' THEN pos END) AS told FROM {cycles} GROUP BY 1, 2)"""
#: A link's key, and a note's keys in the order in which they are tried.
_KEY = "trim(BOTH '-' FROM regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9/]+', '-'{g}), '/-', '/'{g}))"


def _resolved(g: str) -> str:
    key = lambda c: _KEY.replace("{}", c).replace("{g}", g)
    return f"""keys AS (SELECT doc_id, 1 AS priority, {key('path')} AS k FROM {{vault}} UNION ALL SELECT doc_id, 2, {key("'note-' || doc_id")} FROM {{vault}}
  UNION ALL SELECT doc_id, 3, {key('title')} FROM {{vault}} UNION ALL SELECT doc_id, 4, {key('alias')} FROM {{vault}}),
asked AS (SELECT from_doc, target, section, {key('target')} AS k FROM {{links}}),
counted AS (SELECT k, priority, count(DISTINCT doc_id) AS n, min(doc_id) AS doc FROM keys GROUP BY 1, 2),
tried AS (SELECT a.from_doc, a.target, a.section, c.n, c.doc, {_NET.format("a.from_doc, a.target, a.section", "c.priority")} AS r FROM asked a LEFT JOIN counted c ON c.k = a.k),
resolved AS (SELECT from_doc, target, section, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS state, CASE WHEN n = 1 THEN doc END AS to_doc FROM tried WHERE r = 1)"""


def register(add: Callable, more: Callable, both: Callable) -> None:
    def vault(name: str, sql: str) -> None:
        """Links resolved by the first key that has hits; the dialects differ in how they replace all matches."""
        add(name, lambda v: v.sql(f"WITH {_resolved('')} {sql}"), more(_resolved(", 'g'").replace("{vault}", "vault").replace("{links}", "links"), sql.replace("{vault}", "vault")))

    def weak(name: str, sql: str) -> None:
        """A query over the weak spots, whose claims are made once; the engines take those that nothing disputes in different ways."""
        plain = lambda x: re.sub("[{}]", "", x)
        add(name, lambda v: v.sql(f"WITH {_ENDS}, {_SPARK_VULNS} {sql}", claims=written(v.claims, "claims")), more(plain(f"{_ENDS}, {_VULNS}"), plain(sql)))

    # Fields, and relations as pivots of them
    both("a6_literal_fields", "SELECT def_name, field_name, field_value FROM {fields} WHERE field_name IN ('Name', 'Brief') AND type_name LIKE '%Con%' AND field_value LIKE '%STEEL%'")
    both("a7_fields_by_name", "SELECT def_name, field_value FROM {fields} WHERE field_name = 'Origin'")
    both("a11_claim_fields", "SELECT field_name, count(*) AS n, count(DISTINCT field_value) AS n_values FROM {fields} WHERE field_name IN ('Subject', 'Object', 'Prov') GROUP BY 1")
    both("a12_entity_fields", "SELECT def_name, field_name, field_value FROM {fields} WHERE field_name IN ('Name', 'Brief', 'ID') AND type_name <> 'Event'")
    both("a13_fields_of_type", "SELECT def_name, field_name, field_value FROM {fields} WHERE type_name LIKE '%Of%'")
    both("a15_roles_of_vars", "SELECT def_name AS var_name, min(type_name) AS role_type FROM {fields} WHERE type_name IN (SELECT DISTINCT role_type FROM {entities}) GROUP BY 1")
    both("a16_pragmas", "SELECT predicate, pragma FROM {predicates} WHERE pragma LIKE 'fun%'")
    both("a17_definitions", "SELECT var_name, role_type, file FROM {entities} WHERE lower(var_name) LIKE '%s1%'")
    both("a20_pivot_claims", "SELECT def_name, max(CASE WHEN field_name = 'Subject' THEN field_value END) AS subject, max(CASE WHEN field_name = 'Object' THEN field_value END) AS object, max(CASE WHEN field_name = 'Prov' THEN field_value END) AS prov_ref FROM {fields} GROUP BY 1 HAVING max(CASE WHEN field_name = 'Subject' THEN field_value END) <> ''")
    both("a21_pivot_provenance", "SELECT def_name, max(CASE WHEN field_name = 'Origin' THEN field_value END) AS origin, max(CASE WHEN field_name = 'Quote' THEN length(field_value) END) AS n_quote FROM {fields} WHERE type_name = 'Provenance' GROUP BY 1")
    both("a24_pragma_sets", "SELECT c.predicate, p.pragma, count(*) AS n FROM {claims} c JOIN {predicates} p ON p.predicate = c.predicate WHERE p.pragma <> '' GROUP BY 1, 2")
    both("a30_by_ids", "SELECT i.pos, d.doc_id, d.lang FROM (VALUES (1, 17), (2, 3), (3, 99), (4, -1)) AS i(pos, id) JOIN {documents} d ON d.doc_id = i.id")
    both("a39_blocks", "SELECT var_name, role_type || '{' || name || ': ' || brief || '}' AS block FROM {entities}".replace("'{'", "'('").replace("'}'", "')'"))
    both("a40_goals", "SELECT goal, cover_at, in_domain FROM (VALUES ('N1', 40, true), ('N2', 90, true), ('N3', 5, false)) AS g(goal, cover_at, in_domain)")
    both("a41_kb_metadata", "SELECT e.role_type, count(*) AS n, CAST(sum(d.n) AS BIGINT) AS n_claims, max(length(brief)) AS longest FROM {entities} e LEFT JOIN (SELECT entity, count(*) AS n FROM ends GROUP BY 1) d ON d.entity = e.var_name GROUP BY 1", _ENDS)
    # Claims are counted by predicate before they meet the schema, whose predicates are few and hot.
    add("a42_slots", lambda v: v.sql("SELECT p.predicate, subject_slot, object_slot, sum(coalesce(c.n, 0)) AS n FROM {predicates} p LEFT JOIN (SELECT predicate, count(var_name) AS n FROM {claims} GROUP BY 1) c ON c.predicate = p.predicate GROUP BY 1, 2, 3"), re.sub("[{}]", "", "SELECT p.predicate, subject_slot, object_slot, count(c.var_name) AS n FROM {predicates} p LEFT JOIN {claims} c ON c.predicate = p.predicate GROUP BY 1, 2, 3"))
    both("a43_exemptions", "SELECT c.subject, c.object FROM {claims} c JOIN (VALUES ('LocatedIn', 'R0'), ('TheoryOf', 'P1')) AS x(predicate, object) ON x.predicate = c.predicate AND x.object = c.object")
    both("a44_lint_claims", "SELECT c.var_name, c.predicate, p.pragma, k.object IS NOT NULL AS known FROM {claims} c JOIN {predicates} p ON p.predicate = c.predicate LEFT JOIN (SELECT DISTINCT object FROM {claims} WHERE predicate = 'Disputes') k ON k.object = c.object WHERE p.pragma <> ''")
    add("b1_json", lambda v: v.entities.select("var_name", F.to_json(F.struct("var_name", "role_type")).alias("json")), "SELECT var_name, '{\"var_name\":\"' || var_name || '\",\"role_type\":\"' || role_type || '\"}' AS json FROM entities")
    both("b2_payload", "SELECT c.var_name, c.predicate, c.subject, c.object, r.origin, p.pragma = 'functional' AS functional, p.pragma = 'contested' AS contested FROM {claims} c JOIN {predicates} p ON p.predicate = c.predicate LEFT JOIN {provenance} r ON r.var_name = c.prov_ref")
    weak("b3_node_lines", "SELECT entity, '\"' || entity || '\" [penwidth=' || CASE WHEN count(*) >= 3 THEN '3' ELSE '2' END || ']' AS line FROM vulns GROUP BY entity")
    both("b5_bundle_plan", "SELECT e.var_name, e.role_type, coalesce(o.n, 0) AS outgoing, coalesce(i.n, 0) AS incoming FROM {entities} e LEFT JOIN (SELECT subject, count(*) AS n FROM {claims} GROUP BY 1) o ON o.subject = e.var_name LEFT JOIN (SELECT object, count(*) AS n FROM {claims} GROUP BY 1) i ON i.object = e.var_name")
    add("b6_document", lambda v: v.claims.where("object is not null").groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_list("object")), ", ").alias("objects")).groupBy("subject").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("## "), "predicate", F.lit("\n"), "objects"))), "\n").alias("body")), "SELECT subject, string_agg('## ' || predicate || chr(10) || objects, chr(10) ORDER BY predicate) AS body FROM (SELECT subject, predicate, string_agg(object, ', ' ORDER BY object) AS objects FROM claims WHERE object IS NOT NULL GROUP BY 1, 2) GROUP BY 1")
    both("b7_generated", "SELECT hypothesis, max(ts) AS latest, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM {cycles} WHERE resolution <> '' GROUP BY 1")
    both("b8_log", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, count(*) AS n, count(CASE WHEN resolution <> '' THEN 1 END) AS resolved FROM {cycles} GROUP BY 1")
    both("b9_sections", "SELECT role_type AS section, count(*) AS n, min(name) AS first, max(name) AS last FROM {entities} GROUP BY 1")

    # Lookups
    both("q18_resolve", "SELECT q, CASE WHEN max(exact) = 1 THEN 'exact' WHEN count(var_name) = 1 THEN 'unique' WHEN count(var_name) = 0 THEN 'none' ELSE 'ambiguous' END AS state, CASE WHEN max(exact) = 1 THEN q WHEN count(var_name) = 1 THEN min(var_name) END AS target FROM (SELECT q, e.var_name, CASE WHEN e.var_name = q THEN 1 ELSE 0 END AS exact FROM (VALUES ('S1'), ('nation-24'), ('zzzz'), ('supplier-')) AS t(q) LEFT JOIN {entities} e ON lower(e.var_name) LIKE '%' || lower(q) || '%' OR lower(e.id) LIKE '%' || lower(q) || '%') x GROUP BY q")
    want = ["small", "red", "steel", "part"]
    tokens = "list_distinct(list_filter(list_transform(string_split_regex(regexp_replace({}, '([A-Z])', ' \\1', 'g'), '[ _-]'), lambda t: lower(t)), lambda t: strlen(t) > 1))"
    overlap = lambda c: F.size(F.array_intersect(X.ident_tokens(F.col(c)), F.array(*[F.lit(w) for w in want])))
    add("q19_nearest_entities", lambda v: v.entities.select("var_name", (overlap("var_name") + overlap("name")).cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "var_name").limit(20), f"SELECT var_name, (len(list_intersect({tokens.format('var_name')}, {want})) + len(list_intersect({tokens.format('name')}, {want})))::BIGINT AS score FROM entities WHERE score > 0 ORDER BY score DESC, var_name LIMIT 20")
    add("q20_missing_entity", lambda v: v.entities.select("var_name", (overlap("var_name") + overlap("name")).alias("s")).where("s > 0").orderBy(F.desc("s"), "var_name").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "var_name"))), lambda x: x["var_name"]), ", ").alias("near")).select(F.concat(F.lit("no entity small_red_steel_part; nearest: "), "near").alias("message")), f"SELECT 'no entity small_red_steel_part; nearest: ' || string_agg(var_name, ', ' ORDER BY s DESC, var_name) AS message FROM (SELECT var_name, len(list_intersect({tokens.format('var_name')}, {want})) + len(list_intersect({tokens.format('name')}, {want})) AS s FROM entities WHERE s > 0 ORDER BY s DESC, var_name LIMIT 3)")
    both("q30_score_filter", "SELECT pos, hypothesis, value FROM {cycles} WHERE value >= 50")
    both("q32_slot_accepts", "SELECT r.role_type, p.predicate, p.subject_slot IN ('Entity', r.role_type) AS as_subject, p.object_slot IN ('Entity', r.role_type) AS as_object FROM (SELECT DISTINCT role_type FROM {entities}) r JOIN {predicates} p ON p.object_slot <> ''")
    pairs = "roles AS (SELECT DISTINCT role_type AS role FROM {entities}), fits AS (SELECT a.role AS role_a, b.role AS role_b, p.predicate FROM roles a JOIN roles b ON a.role <= b.role JOIN {predicates} p ON p.object_slot <> '' AND ((p.subject_slot IN ('Entity', a.role) AND p.object_slot IN ('Entity', b.role)) OR (p.subject_slot IN ('Entity', b.role) AND p.object_slot IN ('Entity', a.role))))"
    both("q33_compatible", "SELECT role_a, role_b, predicate FROM fits", pairs)
    both("q34_promotable", "SELECT role_a, role_b, predicate FROM fits WHERE role_a <> 'Person' AND role_b <> 'Person' AND predicate NOT IN ('Disputes')", pairs)
    both("q35_flags", "SELECT var_name, CASE WHEN subject = '' THEN 'no subject' WHEN object IS NULL AND predicate <> 'IsCognitiveBias' THEN 'no object' WHEN object IS NOT NULL AND predicate = 'IsCognitiveBias' THEN 'object of a unary claim' WHEN prov_ref IS NULL THEN 'no source' WHEN var_name LIKE '%-%' THEN 'not an identifier' ELSE '' END AS fault FROM {claims}")

    # Aggregates
    weak("h7_report", "SELECT kind, count(*) AS n FROM (SELECT 'no_brief' AS kind FROM {entities} WHERE brief = '' UNION ALL SELECT 'short_brief' FROM {entities} WHERE length(brief) BETWEEN 1 AND 19 UNION ALL SELECT 'split_source' FROM (SELECT origin FROM {claims} c JOIN {provenance} p ON p.var_name = c.prov_ref GROUP BY origin HAVING count(DISTINCT c.file) > 1) s UNION ALL SELECT kind FROM vulns) f GROUP BY 1")
    goals = "goals AS (SELECT * FROM (VALUES ('N1', 'S1', 40, true), ('N1', 'S2', 40, true), ('N2', 'S3', 90, true), ('N3', 'S4', 5, false)) AS g(goal, seed, cover_at, in_domain)), tagged AS (SELECT object AS goal, count(*) AS n FROM {claims} WHERE predicate = 'LocatedIn' GROUP BY 1)"
    both("h8_goal_coverage", "SELECT DISTINCT g.goal, coalesce(t.n, 0) AS n FROM goals g LEFT JOIN tagged t ON t.goal = g.goal", goals)
    both("h9_goal_targets", "SELECT g.goal, g.seed FROM goals g LEFT JOIN tagged t ON t.goal = g.goal WHERE in_domain AND coalesce(t.n, 0) < cover_at", goals)
    both("h10_entity_cap", "SELECT count(*) AS total, count(CASE WHEN role_type = 'Event' THEN 1 END) AS reified, count(CASE WHEN role_type <> 'Event' THEN 1 END) AS counted FROM {entities}")
    vault("h12_vault_stats", "SELECT state, count(*) AS n FROM resolved GROUP BY 1")
    vault("h13_sections", "SELECT section, count(*) AS n FROM {vault} GROUP BY 1 ORDER BY n DESC, section LIMIT 5")
    both("h16_accuracy_by_type", "SELECT d.lang AS kind, count(*) AS attempted, count(l.quality) AS scored, round(avg(l.quality), 6) AS accuracy, CAST(sum(d.n_chars) AS BIGINT) AS tokens FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id GROUP BY 1")
    gold = "gold AS (SELECT DISTINCT object AS q, subject AS item FROM {claims} WHERE predicate = 'Proposes'), got AS (SELECT object AS q, subject AS item FROM {claims} WHERE predicate = 'Disputes'), hit AS (SELECT gold.q, count(*) AS n FROM gold JOIN got ON got.q = gold.q AND got.item = gold.item GROUP BY 1), g AS (SELECT q, count(*) AS n FROM gold GROUP BY 1), r AS (SELECT q, count(*) AS n FROM got GROUP BY 1)"
    both("h18_recall", "SELECT g.q, round(coalesce(hit.n, 0) * 1.0e0 / g.n, 6) AS recall FROM g LEFT JOIN hit ON hit.q = g.q", gold)
    both("h19_precision", "SELECT g.q, round(CASE WHEN r.n IS NULL THEN 0.0e0 ELSE coalesce(hit.n, 0) * 1.0e0 / r.n END, 6) AS precision FROM g LEFT JOIN r ON r.q = g.q LEFT JOIN hit ON hit.q = g.q", gold)
    both("h20_gold_match", "SELECT predicate, CAST(n AS VARCHAR(20)) AS got, CASE WHEN CAST(n AS VARCHAR(20)) = CASE predicate WHEN 'LocatedIn' THEN '1625' ELSE '7' END THEN 1.0e0 ELSE 0.0e0 END AS score FROM (SELECT predicate, count(*) AS n FROM {claims} GROUP BY 1) x")
    both("h21_recall_by_category", "SELECT substr(g.q, 1, 2) AS category, count(*) AS n, round(avg(coalesce(hit.n, 0) * 1.0e0 / g.n), 6) AS recall FROM g LEFT JOIN hit ON hit.q = g.q GROUP BY 1", gold)

    # Rules
    terms = "terms AS (SELECT * FROM (VALUES ('person'), ('place'), ('organization')) AS t(term))"
    both("i1_naming", "SELECT role_type, max(CASE WHEN term IS NULL THEN 1 ELSE 0 END) = 0 AS grounded FROM (SELECT DISTINCT role_type FROM {entities}) r LEFT JOIN terms ON term = lower(role_type) GROUP BY 1", terms)
    both("i6_briefs", "SELECT var_name, length(brief) AS n FROM {entities} WHERE role_type = 'Concept' AND (brief = '' OR length(brief) > 22)")
    both("i7_split_sources", "SELECT lower(trim(origin)) AS origin, count(DISTINCT c.file) AS n_files FROM {claims} c JOIN {provenance} p ON p.var_name = c.prov_ref GROUP BY 1 HAVING count(DISTINCT c.file) > 1")
    alike = more("sig AS (SELECT entity, edge FROM (SELECT subject AS entity, predicate || '|out|' || coalesce(object, '') AS edge FROM claims UNION ALL SELECT object, predicate || '|in|' || subject FROM claims WHERE object IS NOT NULL) s GROUP BY 1, 2), size AS (SELECT entity, count(*) AS n FROM sig GROUP BY 1), w AS (SELECT edge, ln(1 + (SELECT count(*) FROM size) / count(*)) AS idf FROM sig GROUP BY 1), cand AS (SELECT x.entity AS a, y.entity AS b, count(*) AS shared, count(*) / greatest(any_value(sx.n), any_value(sy.n)) AS coefficient, sum(idf) AS weight FROM sig x JOIN sig y ON x.edge = y.edge AND x.entity < y.entity JOIN w ON w.edge = x.edge JOIN size sx ON sx.entity = x.entity JOIN size sy ON sy.entity = y.entity JOIN entities ex ON ex.var_name = x.entity JOIN entities ey ON ey.var_name = y.entity AND ey.role_type = ex.role_type GROUP BY 1, 2 HAVING count(*) >= 2), best AS (SELECT a, b, shared, round(coefficient, 6) AS coefficient, round(weight, 6) AS weight FROM cand WHERE coefficient >= 0.5 AND weight >= 8)", "SELECT {} FROM best ORDER BY weight DESC, coefficient DESC, shared DESC, b, a LIMIT {}")  # noqa: E501
    add("i9_structural_dedup", lambda v: D.candidates(v.claims, v.entities, 2, 0.5, 8.0).orderBy(F.desc("weight"), F.desc("coefficient"), F.desc("shared"), "b", "a").limit(15), alike.format("*", 15))
    hood = "names AS (SELECT entity, count(*) AS n, min(claim) AS first, max(claim) AS last FROM ends GROUP BY 1)"
    both("i11_neighborhoods", "SELECT entity, n, first, last FROM names WHERE n > 0", f"{_ENDS}, {hood}")
    both("i12_neighborhoods_all", "SELECT e.var_name, coalesce(n, 0) AS n, first FROM {entities} e LEFT JOIN names ON entity = e.var_name", f"{_ENDS}, {hood}")
    both("i14_exit_code", "SELECT max(code) AS code FROM (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS code FROM {entities} WHERE brief = '' UNION ALL SELECT CASE WHEN count(*) > 0 THEN 2 ELSE 0 END FROM (SELECT subject FROM {claims} WHERE predicate = 'FormedAt' GROUP BY 1 HAVING count(DISTINCT object) > 1) c) x")
    both("i17_provenance_completeness", "SELECT var_name, CASE WHEN coalesce(origin, '') = '' THEN 'no origin' WHEN coalesce(quote, '') = '' THEN 'no quote' ELSE 'short quote' END AS fault FROM {provenance} WHERE coalesce(origin, '') = '' OR length(coalesce(quote, '')) < 40")
    both("i19_orphans_but", "SELECT e.var_name FROM {entities} e LEFT JOIN (SELECT DISTINCT entity FROM ends) x ON x.entity = e.var_name WHERE x.entity IS NULL AND e.role_type <> 'Event'", _ENDS)
    add("i21_docs_coverage", lambda v: v.entities.where("role_type = 'Place'").join(v.table("documents").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9]+"))).alias("w")).distinct(), F.lower("name") == F.col("w"), "left_anti").select("name"), "SELECT name FROM entities WHERE role_type = 'Place' AND lower(name) NOT IN (SELECT unnest(string_split_regex(lower(text), '[^a-z0-9]+')) FROM documents)")
    vault("i23_broken_links", "SELECT from_doc, target FROM resolved WHERE state = 'unresolved'")
    both("i24_log_order", "SELECT hypothesis, count(*) AS n_out_of_order FROM (SELECT hypothesis, ts, lag(ts) OVER (PARTITION BY hypothesis ORDER BY pos) AS before FROM {cycles}) x WHERE before > ts GROUP BY 1")

    # Dedup and retrieval
    sig = "sig AS (SELECT entity, edge FROM (SELECT subject AS entity, predicate || '|out|' || coalesce(object, '') AS edge FROM {claims} UNION ALL SELECT object, predicate || '|in|' || subject FROM {claims} WHERE object IS NOT NULL) s GROUP BY 1, 2), size AS (SELECT entity, count(*) AS n FROM sig GROUP BY 1), total AS (SELECT count(*) AS n FROM size), w AS (SELECT edge, ln(1 + (SELECT n FROM total) * 1.0e0 / count(*)) AS idf FROM sig GROUP BY 1), target AS (SELECT edge FROM sig WHERE entity = 'S1'), met AS (SELECT s.entity, count(*) AS shared, sum(w.idf) AS weight FROM sig s JOIN target t ON t.edge = s.edge JOIN w ON w.edge = s.edge WHERE s.entity <> 'S1' GROUP BY 1)"
    both("d3_overlap", "SELECT m.entity, m.shared, round(m.shared * 1.0e0 / least(z.n, (SELECT count(*) FROM target)), 6) AS contain, round(m.shared * 1.0e0 / greatest(z.n, (SELECT count(*) FROM target)), 6) AS sym FROM met m JOIN size z ON z.entity = m.entity", sig)
    both("d4_weighted_shared", "SELECT entity, round(weight, 6) AS weight FROM met", sig)
    both("d6_matches_for", "SELECT m.entity AS b, m.shared, round(m.shared * 1.0e0 / least(z.n, (SELECT count(*) FROM target)), 6) AS coefficient, round(m.weight, 6) AS weight FROM met m JOIN size z ON z.entity = m.entity JOIN {entities} e ON e.var_name = m.entity AND e.role_type = 'Organization' WHERE m.shared >= 2 AND m.shared * 1.0e0 / least(z.n, (SELECT count(*) FROM target)) >= 0.1 AND m.weight >= 2", sig)
    both("d7_dupes", "SELECT m.entity AS b, m.shared FROM met m JOIN size z ON z.entity = m.entity JOIN {entities} e ON e.var_name = m.entity AND e.role_type = 'Organization' WHERE m.shared >= 2 AND m.shared * 1.0e0 / least(z.n, (SELECT count(*) FROM target)) >= 0.6 AND m.weight >= 8", sig)
    cos = "e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT a.vec_id, list_cosine_similarity(a.x, b.x) AS c FROM e a, e b WHERE b.vec_id = 0 AND a.vec_id > 0)"
    near = lambda v: R.semantic(v.table("embeddings").where("vec_id > 0").select(F.col("vec_id").alias("owner"), F.col("embedding").alias("vector")), v.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("vector")))
    add("d8_write_decision", lambda v: near(v).agg(F.max("score").alias("best")).select("best", F.when(F.col("best") >= 0.62, "block").when(F.col("best") >= 0.45, "warn").otherwise("write").alias("decision")), more(cos, "SELECT round(max(c), 6) AS best, CASE WHEN max(c) >= 0.62 THEN 'block' WHEN max(c) >= 0.45 THEN 'warn' ELSE 'write' END AS decision FROM s"))
    add("r10_docs_recall", lambda v: near(v).where("score >= 0.3").orderBy(F.desc("score"), "owner").limit(3), more(cos, "SELECT vec_id AS owner, round(c, 6) AS score FROM s WHERE c >= 0.3 ORDER BY score DESC, owner LIMIT 3"))
    preds = "p AS (SELECT subject AS entity, predicate FROM {claims} GROUP BY 1, 2), np AS (SELECT entity, count(*) AS n FROM p GROUP BY 1), pairs AS (SELECT DISTINCT subject AS a, object AS b FROM {claims} WHERE predicate = 'LocatedIn'), shared AS (SELECT x.a, x.b, count(*) AS i FROM pairs x JOIN p pa ON pa.entity = x.a JOIN p pb ON pb.entity = x.b AND pb.predicate = pa.predicate GROUP BY 1, 2)"
    both("d10_pair_score", "SELECT c.var_name, CASE WHEN a.brief <> '' THEN 1 ELSE 0 END + CASE WHEN b.brief <> '' THEN 1 ELSE 0 END + CASE WHEN a.role_type = 'Place' THEN 3 ELSE 0 END + CASE WHEN b.role_type = 'Place' THEN 3 ELSE 0 END AS score FROM {claims} c JOIN {entities} a ON a.var_name = c.subject JOIN {entities} b ON b.var_name = c.object")
    weak("r14_sensor_targets", "SELECT entity, count(*) AS n, min(CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS bucket FROM vulns GROUP BY 1 ORDER BY bucket, n DESC, entity LIMIT 5")
    es = "-ln(({} + 1) / 4294967297.0{}) / CASE WHEN brief = '' THEN 2 ELSE 1 END"
    add("r17_weighted_sample", lambda v: v.entities.orderBy(F.expr(es.format("cast(conv(substr(md5(var_name), 1, 8), 16, 10) as double)", "D")), "var_name").limit(12).select("var_name"), f"SELECT var_name FROM entities ORDER BY {es.format(chr(40) + chr(39) + '0x' + chr(39) + ' || md5(var_name)[1:8])::BIGINT', 'e0')}, var_name LIMIT 12")
    add("r18_groups", lambda v: v.entities.withColumn("g", F.pmod(F.conv(F.substring(F.md5("var_name"), 9, 6), 16, 10).cast("long"), F.lit(4))).withColumn("i", F.expr(f"row_number() over (partition by g, role_type order by {es.format('cast(conv(substr(md5(var_name), 1, 8), 16, 10) as double)', 'D')}, var_name)")).where("i <= 2").select("g", "role_type", "var_name"), f"SELECT g, role_type, var_name FROM (SELECT *, ('0x' || md5(var_name)[9:14])::BIGINT % 4 AS g FROM entities) QUALIFY row_number() OVER (PARTITION BY g, role_type ORDER BY {es.format(chr(40) + chr(39) + '0x' + chr(39) + ' || md5(var_name)[1:8])::BIGINT', 'e0')}, var_name) <= 2")
    add("r19_spaced", lambda v: R.spaced(v.cycles.where("resolution = 'irrelevant'").select("pos"), "pos", 40), more("x AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM cycles WHERE resolution = 'irrelevant')", "SELECT pos FROM x WHERE i IN (SELECT floor(k * n / 40)::BIGINT FROM range(0, 40) r(k), (SELECT max(n) AS n FROM x))"))
    audit = "concat('x := 1\\n// 2024-05-06 audit: `', lang, ' Of ', source, '` was\\n  // deleted here. It repeats ', doc_id, '\\ny := 2')"
    add("r22_anti_exemplars", lambda v: R.anti_exemplars(v.table("documents").select("doc_id", F.expr(audit).alias("text"))), "SELECT doc_id, concat(lang, ' Of ', source) AS shape, concat('It repeats ', doc_id) AS reason FROM documents")
    routes = "home AS (SELECT subject AS s, min(object) AS nation FROM {claims} WHERE predicate = 'LocatedIn' GROUP BY 1), routes AS (SELECT c.subject AS a, c.object AS b, h.nation AS cluster_a, e.alias AS cluster_b, CASE WHEN e.brief = 'PROMO' THEN 4 ELSE 1 END AS score, 50 * length(e.brief) AS affinity FROM {claims} c JOIN home h ON h.s = c.subject JOIN {entities} e ON e.var_name = c.object WHERE c.predicate = 'Proposes' AND e.alias <> '')"
    turns = "fit AS (SELECT a, b, cluster_a, cluster_b, score * 62 + affinity AS rank, md5(a || '|' || b) AS tie, least(cluster_a, cluster_b) AS low, greatest(cluster_a, cluster_b) AS high FROM routes WHERE affinity >= 250 AND (a, b) NOT IN (SELECT subject, object FROM claims WHERE predicate = 'Disputes')), dealt AS (SELECT *, row_number() OVER w AS turn, first_value(rank) OVER w AS lead_rank, first_value(tie) OVER w AS lead_tie FROM fit WINDOW w AS (PARTITION BY low, high ORDER BY rank DESC, tie, a, b))"
    plain = routes.replace("{claims}", "claims").replace("{entities}", "entities")
    add("r16_cross_cluster", lambda v: R.pick_across(v.sql(f"WITH {routes} SELECT * FROM routes"), v.claims.where("predicate = 'Disputes'").select(F.col("object").alias("a"), F.col("subject").alias("b")), 50), more(f"{plain}, {turns}", "SELECT a, b, cluster_a, cluster_b, rank FROM dealt ORDER BY turn, lead_rank DESC, lead_tie, low, high LIMIT 50"))
    both("r21_exemplars", "SELECT c.var_name, md5(c.var_name) AS k FROM {claims} c JOIN {provenance} p ON p.var_name = c.prov_ref WHERE length(p.quote) >= 200 AND c.predicate IN ('TheoryOf', 'Proposes') ORDER BY k, var_name LIMIT 25")
    weak("r23_vulnerabilities", f"SELECT kind, entity, severity, {_RANK} AS place FROM vulns")
    add("r24_candidate_order", lambda v: D.candidates(v.claims, v.entities, 2, 0.5, 8.0).orderBy(F.desc("weight"), F.desc("coefficient"), F.desc("shared"), "b", "a").limit(20).select("a", "b"), alike.format("a, b", 20))

    # Graph
    weak("g11_why", "SELECT c.var_name, CASE WHEN c.predicate IN ('Proposes', 'TheoryOf') AND c.object = 'P1' THEN 'supports' WHEN c.predicate = 'Disputes' AND c.object = 'P1' THEN 'challenges' WHEN c.predicate IN ('Proposes', 'TheoryOf') THEN 'grounds' ELSE 'related' END AS kind, CASE WHEN c.object = 'P1' THEN c.subject ELSE c.object END AS other, p.origin, coalesce(v.n, 0) AS n_vulnerabilities FROM {claims} c LEFT JOIN {provenance} p ON p.var_name = c.prov_ref LEFT JOIN (SELECT entity, count(*) AS n FROM vulns GROUP BY 1) v ON v.entity = 'P1' WHERE c.subject = 'P1' OR c.object = 'P1'")
    weak("g12_topology_report", "SELECT kind, severity, count(*) AS n, min(entity) AS first FROM vulns GROUP BY 1, 2 UNION ALL SELECT 'entities', 'total', count(*), min(var_name) FROM {entities} UNION ALL SELECT 'claims', 'total', count(*), min(var_name) FROM {claims}")
    adj = "h AS (SELECT subject AS u, object AS v FROM claims WHERE object IS NOT NULL UNION SELECT object, subject FROM claims WHERE object IS NOT NULL), comp(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM h UNION (SELECT DISTINCT ON (a.node) a.node, b.component FROM recurring.comp a JOIN h ON h.u = a.node JOIN comp b ON b.node = h.v WHERE b.component < a.component ORDER BY a.node, b.component))"
    add("g17_component_count", lambda v: G.components(v.claims).select(F.col("component").alias("node")).distinct().union(v.entities.join(G.adjacency(v.claims).select(F.col("u").alias("var_name")), "var_name", "left_anti").select("var_name")).agg(F.count("*").alias("n")), more(adj, "SELECT (SELECT count(DISTINCT component) FROM comp) + (SELECT count(*) FROM entities WHERE var_name NOT IN (SELECT u FROM h)) AS n"))
    chain = "WALK(head, cur, n) AS (SELECT newer, newer, 0 FROM {supersedes} WHERE newer NOT IN (SELECT older FROM {supersedes}) UNION ALL SELECT w.head, s.older, w.n + 1 FROM WALK w JOIN {supersedes} s ON s.newer = w.cur WHERE w.n < 90)"
    add("g19_decision_chains", lambda v: G.chains(v.supersedes), more(chain.replace("{supersedes}", "supersedes").replace("WALK", "walk"), "SELECT head, max(n)::BIGINT AS n_superseded, arg_max(cur, n) AS oldest FROM walk GROUP BY 1"))
    both("g21_support", "SELECT g.entity, g.n_up, CASE WHEN l.entity IS NULL THEN 1 ELSE 0 END AS leaf FROM (SELECT object AS entity, count(DISTINCT subject) AS n_up FROM {claims} WHERE predicate IN ('Proposes', 'TheoryOf') GROUP BY 1) g LEFT JOIN (SELECT DISTINCT subject AS entity FROM {claims} WHERE predicate IN ('Proposes', 'TheoryOf')) l ON l.entity = g.entity WHERE g.n_up <= 2")
    vault("g22_vault_edges", "SELECT DISTINCT from_doc, to_doc, section FROM resolved WHERE state = 'resolved' AND to_doc <> from_doc")
    vault("g23_vault_index", "SELECT k, priority, n FROM counted")
    vault("g24_vault_extract", "SELECT 'References_n' || from_doc || '_n' || to_doc AS var_name, count(*) AS n FROM resolved WHERE state = 'resolved' AND to_doc <> from_doc GROUP BY 1")
    both("g25_refuted_pairs", "SELECT DISTINCT least(a.hypothesis, b.hypothesis) || '|' || greatest(a.hypothesis, b.hypothesis) AS pair FROM {cycles} a JOIN {cycles} b ON b.pos = a.pos + 1 WHERE a.resolution = 'no_signal' AND a.hypothesis <> b.hypothesis")
    both("g27_rename", "SELECT var_name, predicate, CASE WHEN subject = 'S1' THEN 'S1b' ELSE subject END AS subject, CASE WHEN object = 'S1' THEN 'S1b' ELSE object END AS object, subject = 'S1' OR coalesce(object, '') = 'S1' AS changed FROM {claims}")
    both("s54_unique_names", "SELECT var_name, base || CASE WHEN i > 1 THEN CAST(i AS VARCHAR(9)) ELSE '' END AS name FROM (SELECT var_name, substr(name, 1, 4) AS base, row_number() OVER (PARTITION BY substr(name, 1, 4), role_type ORDER BY var_name) AS i FROM {entities}) x")

    # Logs
    both("l1_first_seen", f"SELECT hypothesis, kind, seen, told - seen AS until_verdict, {_VERDICT} AS verdict FROM tally", _TALLY)
    both("l2_sensor_verdicts", f"SELECT verdict, count(*) AS n FROM (SELECT {_VERDICT} AS verdict FROM tally) x GROUP BY 1", _TALLY)
    both("l3_hits", "SELECT hypothesis, count(CASE WHEN resolution IN ('corroborated', 'challenged', 'confirmed') THEN 1 END) AS hits, count(CASE WHEN resolution IN ('irrelevant', 'no_signal', 'refuted') THEN 1 END) AS misses FROM {cycles} GROUP BY 1")
    both("l4_falsifiable", "SELECT prediction_type IN ('', 'structural_fragility') AS falsifiable, count(*) AS n FROM {cycles} GROUP BY 1")
    both("l5_by_type", "SELECT CASE WHEN prediction_type = '' THEN 'structural_fragility' ELSE prediction_type END AS kind, count(*) AS n, CAST(sum(papers_found) AS BIGINT) AS papers, count(CASE WHEN papers_found > 0 THEN 1 END) AS with_signal, min(substr(CAST(ts AS VARCHAR(30)), 1, 10)) AS since, max(substr(CAST(ts AS VARCHAR(30)), 1, 10)) AS until FROM {cycles} GROUP BY 1")
    both("l6_calibration_row", "SELECT count(*) AS n, count(DISTINCT hypothesis) AS hypotheses, count(CASE WHEN papers_found > 0 THEN 1 END) AS with_signal, count(CASE WHEN resolution <> '' THEN 1 END) AS resolved, round(count(CASE WHEN backend = 'zim' AND papers_found > 0 THEN 1 END) * 1.0e0 / count(CASE WHEN backend = 'zim' THEN 1 END), 6) AS zim_signal, max(ts) AS latest FROM {cycles}")
    papers = "papers AS (SELECT pos, prediction_type, papers_found, 'src' || (pos % 33) AS title FROM {cycles} UNION ALL SELECT pos, prediction_type, papers_found, 'src' || (pos % 7) FROM {cycles} WHERE papers_found > 1), known AS (SELECT DISTINCT lower(trim(origin)) AS slug FROM {provenance}), counted AS (SELECT p.pos, p.prediction_type, p.papers_found, count(*) AS total, count(CASE WHEN k.slug IS NULL THEN 1 END) AS novel FROM papers p LEFT JOIN known k ON k.slug = p.title GROUP BY 1, 2, 3)"
    both("l8_gap_status", "SELECT pos, novel, CASE WHEN prediction_type NOT IN ('', 'structural_fragility') THEN '' WHEN papers_found = 0 THEN 'no_signal' WHEN novel = 0 THEN 'no_gap' WHEN novel = total THEN 'gap_confirmed' ELSE 'mixed_overlap' END AS gap FROM counted", papers)
    recheck = f"state AS (SELECT hypothesis, kind, resolution, digest, {_NET.format('hypothesis, kind', 'ts, pos')} AS a, {_NET.format('hypothesis, kind', 'ts DESC, pos')} AS z FROM (SELECT hypothesis, replace(prediction_type || '_recheck', '_recheck', '') AS kind, resolution, 'd' || (pos % 3) AS digest, ts, pos FROM {{cycles}} WHERE resolution <> '') c), moved AS (SELECT o.hypothesis, o.kind, o.resolution AS old, n.resolution AS new, o.digest AS old_digest, n.digest AS new_digest FROM state o JOIN state n ON n.hypothesis = o.hypothesis AND n.kind = o.kind AND o.a = 1 AND n.z = 1)"
    drift = "CASE WHEN new = 'unresolvable' THEN 'unresolvable' WHEN new = old AND old_digest <> new_digest THEN 'resolver_changed' WHEN new = old THEN 'stable' WHEN new = 'confirmed' THEN 'flipped_to_confirmed' WHEN new = 'refuted' THEN 'flipped_to_refuted' ELSE 'now_ambiguous' END"
    both("l10_recheck_state", "SELECT hypothesis, kind, resolution FROM state WHERE z = 1", recheck)
    both("l11_drift", f"SELECT hypothesis, kind, {drift} AS drift FROM moved", recheck)
    both("l12_drift_report", f"SELECT drift, count(*) AS n, count(DISTINCT hypothesis) AS hypotheses FROM (SELECT hypothesis, {drift} AS drift FROM moved) x GROUP BY 1", recheck)
    both("l13_unchanged", "SELECT kind, min(CASE WHEN old_digest = new_digest THEN 1 ELSE 0 END) = 1 AS unchanged FROM moved GROUP BY 1", recheck)
    add("l14_reify", lambda v: v.cycles.groupBy("hypothesis", "prediction_type").agg(F.count("*").alias("n"), F.count_if(F.col("papers_found") > 0).alias("with_signal"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"), F.max_by("resolution", F.expr("array_position(array('', 'refuted', 'no_signal', 'irrelevant', 'confirmed', 'challenged', 'corroborated'), resolution)")).alias("best")), "SELECT hypothesis, prediction_type, count(*) AS n, count(*) FILTER (papers_found > 0) AS with_signal, string_agg(DISTINCT backend, ',' ORDER BY backend) AS backends, arg_max(resolution, list_position(['', 'refuted', 'no_signal', 'irrelevant', 'confirmed', 'challenged', 'corroborated'], resolution)) AS best FROM cycles GROUP BY 1, 2")
    both("l15_functional_recheck", "SELECT c.predicate, c.subject, count(DISTINCT c.object) AS n, count(DISTINCT c.object) > 1 AS conflict FROM {claims} c JOIN {predicates} p ON p.predicate = c.predicate AND p.pragma = 'functional' GROUP BY 1, 2")
    both("l16_lint_recheck", "SELECT e.var_name, d.object IS NOT NULL AS named FROM {entities} e LEFT JOIN (SELECT DISTINCT object FROM {claims} WHERE predicate = 'Disputes') d ON d.object = e.var_name WHERE e.role_type = 'Concept'")
    both("l19_manual_resolve", "SELECT c.pos, CASE WHEN c.pos = l.pos THEN 'corroborated' ELSE c.resolution END AS resolution FROM {cycles} c LEFT JOIN (SELECT hypothesis, max(pos) AS pos FROM {cycles} WHERE resolution = '' GROUP BY 1) l ON l.hypothesis = c.hypothesis")
    both("l20_irrelevance_audit", "SELECT CASE WHEN value >= 60 THEN 'flipped' ELSE 'held' END AS outcome, count(*) AS n FROM {cycles} WHERE resolution = 'irrelevant' GROUP BY 1")
    both("l21_eligible", "SELECT count(*) AS n FROM {cycles} c LEFT JOIN (SELECT DISTINCT hypothesis FROM {cycles} WHERE prediction_type = 'functional' AND resolution = 'corroborated') r ON r.hypothesis = c.hypothesis WHERE c.resolution = 'irrelevant' AND c.papers_found > 0 AND r.hypothesis IS NULL")
    both("l22_phase_gates", "SELECT 'resolve' AS phase, count(*) AS n, count(*) >= 3 AS fire FROM (SELECT hypothesis FROM {cycles} WHERE resolution = '' AND papers_found > 0 GROUP BY 1 HAVING count(*) >= 3) r UNION ALL SELECT 'ingest', count(*), count(*) >= 5 FROM {cycles} WHERE resolution = 'corroborated' AND papers_found > 0 AND backend IN ('zim', 'kagi', 'arxiv') UNION ALL SELECT 'sense', count(*), max(ts) < timestamp '2024-02-01 00:00:00' FROM {cycles} UNION ALL SELECT 'trip', count(*), max(ts) < timestamp '2024-01-15 00:00:00' FROM {cycles} WHERE prediction_type = 'functional'")
    both("l23_bias_gates", "SELECT sum(CASE WHEN resolution = 'corroborated' THEN 1 ELSE 0 END) * 1.0e0 / sum(CASE WHEN resolution IN ('corroborated', 'challenged', 'irrelevant') THEN 1 ELSE 0 END) > 0.75 AS skip_sense, max(n) * max(n) * 1.0e0 / (sum(n) * sum(n)) > 0.25 AS skip_zim FROM (SELECT resolution, count(*) AS n FROM {cycles} GROUP BY 1) x")
    both("l24_budget", "SELECT month, est, actual, est - actual AS gap, est <= 400 AS allowed, round(100.0e0 * cached / (cached + fresh), 6) AS cache_hit FROM (SELECT substr(CAST(ts AS VARCHAR(30)), 1, 7) AS month, CAST(sum(papers_found) AS BIGINT) AS est, count(CASE WHEN papers_found > 1 THEN 1 END) AS actual, sum(CASE WHEN backend = 'zim' THEN papers_found ELSE 0 END) AS cached, sum(CASE WHEN backend <> 'zim' THEN papers_found ELSE 0 END) AS fresh FROM {cycles} GROUP BY 1) m")
    add("l25_narrative", lambda v: v.cycles.groupBy("hypothesis").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "pos", "resolution"))), lambda x: x["resolution"]), ">").alias("story")), "SELECT hypothesis, string_agg(resolution, '>' ORDER BY ts, pos) AS story FROM cycles GROUP BY 1")
    both("l26_crosstab", "SELECT quality, count(CASE WHEN toxic = 0 THEN 1 END) AS accepted, count(CASE WHEN toxic = 1 THEN 1 END) AS rejected FROM {labels} GROUP BY 1")
    both("l27_replay", "SELECT pos, hypothesis FROM {cycles} WHERE prediction_type = 'functional' AND resolution = '' ORDER BY pos LIMIT 30")
    both("l28_prior_claims", "SELECT predicate, subject, count(*) AS n, min(object) AS first FROM {claims} WHERE predicate = 'Proposes' GROUP BY 1, 2")
    both("l29_funnel", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN c.object IS NULL THEN 'no_predicate' WHEN c.predicate = 'Disputes' THEN 'banned' WHEN o.var_name IS NULL THEN 'unknown_entity' WHEN NOT (p.subject_slot IN ('Entity', s.role_type) AND p.object_slot IN ('Entity', o.role_type)) THEN 'slot' ELSE 'accepted' END AS reason FROM {claims} c JOIN {predicates} p ON p.predicate = c.predicate LEFT JOIN {entities} s ON s.var_name = c.subject LEFT JOIN {entities} o ON o.var_name = c.object) x GROUP BY 1")
    ranks = "f AS (SELECT file, count(*) * 1.0e0 / count(DISTINCT subject) AS density FROM {claims} GROUP BY 1), r AS (SELECT rank() OVER (ORDER BY file) AS x, rank() OVER (ORDER BY density) + (count(*) OVER (PARTITION BY density) - 1) / 2.0e0 AS y FROM f)"
    both("w2_anchoring", "SELECT 'AnchoringBias' AS bias, round(1 - 6 * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1)), 6) AS value, abs(1 - 6 * sum((x - y) * (x - y)) / (count(*) * (count(*) * count(*) - 1))) > 0.5 AND count(*) >= 5 AS triggered FROM r", ranks)
    both("w6_framing", "SELECT 'FramingEffect' AS bias, round(avg(hit), 6) AS value, avg(hit) > 0.15 AS triggered FROM (SELECT CASE WHEN lower(brief) LIKE '%groundbreaking%' OR lower(brief) LIKE '%seminal%' OR lower(brief) LIKE '%landmark%' OR lower(brief) LIKE '%influential%' OR lower(brief) LIKE '%controversial%' OR lower(brief) LIKE '%flawed%' OR lower(brief) LIKE '%polished%' THEN 1.0e0 ELSE 0.0e0 END AS hit FROM {entities} WHERE brief <> '') x")
    both("w10_bias_report", "SELECT 'ConfirmationBias' AS bias, round(sum(CASE WHEN resolution = 'corroborated' THEN n ELSE 0 END) * 1.0e0 / sum(CASE WHEN resolution IN ('corroborated', 'challenged', 'irrelevant') THEN n ELSE 0 END), 6) AS value FROM res UNION ALL SELECT 'SurvivorshipBias', round(sum(CASE WHEN resolution = 'irrelevant' THEN n ELSE 0 END) * 1.0e0 / sum(CASE WHEN resolution = 'challenged' THEN n ELSE 0 END), 6) FROM res UNION ALL SELECT 'BaseRateNeglect', round(-sum(n * 1.0e0 / t * ln(n * 1.0e0 / t) / ln(2.0e0)), 6) FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM {claims} GROUP BY predicate) c) d", "res AS (SELECT resolution, count(*) AS n FROM {cycles} GROUP BY 1)")

    # Benchmark questions
    both("lex_role_file_name", "SELECT var_name FROM {entities} WHERE role_type = 'Concept' AND file = 'Brand#11' AND lower(name) LIKE '%green%'")
    both("lex_exact", "SELECT var_name, role_type FROM {entities} WHERE var_name = 'S7'")
    both("agg_predicate", "SELECT count(*) AS n FROM {claims} WHERE predicate = 'Proposes'")
    both("agg_unary", "SELECT subject FROM {claims} WHERE predicate = 'IsCognitiveBias' AND object IS NULL")
    both("agg_role", "SELECT count(*) AS n FROM {entities} WHERE role_type = 'Person'")
    both("agg_names", "SELECT var_name FROM {claims} WHERE predicate = 'TheoryOf'")
    both("hop1_theories", "SELECT var_name FROM {claims} WHERE predicate = 'TheoryOf' AND object = 'P1'")
    both("hop2_objects", "SELECT DISTINCT object FROM {claims} WHERE predicate = 'InvestigatedBy' AND subject = 'O1'")
    both("hop3_of_target", "SELECT DISTINCT d.subject FROM {claims} h JOIN {claims} d ON d.object = h.object AND d.predicate = 'Disputes' WHERE h.predicate = 'TheoryOf' AND h.subject = 'S1'")
    both("hop4_unary_in_file", "SELECT DISTINCT subject FROM {claims} WHERE predicate = 'IsCognitiveBias' AND file = 'file3'")
    both("hop5_of_target", "SELECT DISTINCT p.subject FROM {claims} t JOIN {claims} p ON p.object = t.object AND p.predicate = 'Proposes' WHERE t.predicate = 'TheoryOf' AND t.subject = 'S2'")
    both("con_subjects", "SELECT DISTINCT subject FROM {claims} WHERE predicate = 'TheoryOf' AND object = 'P2'")
    both("con_disputes", "SELECT count(DISTINCT object) AS n FROM {claims} WHERE predicate = 'Disputes'")
