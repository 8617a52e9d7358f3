"""Queries of the operators that have structures of their own, with oracles that state the rule another way."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import affinity as A
from ..operators import closure as C
from ..operators import graph as G
from ..operators import mentions as M
from ..operators.fulltext import Index, entity_docs, provenance_docs
from ..sources.stored import shared_dir

#: Every entity's pattern against every brief.
_NAMED = """forms AS (SELECT var_name AS target, list(s ORDER BY place) AS all_forms, string_agg(regexp_escape(s), '|' ORDER BY place) AS alts
  FROM (SELECT var_name, trim(name) AS s, 0 AS place FROM entities UNION SELECT var_name, trim(alias), 1 FROM entities) WHERE strlen(s) BETWEEN 6 AND 60 GROUP BY 1),
named AS (SELECT DISTINCT b.var_name AS entity, target, regexp_extract(brief, '\\b(?:' || alts || ')\\b') AS surface FROM briefs b JOIN forms f
  ON b.var_name <> target AND (contains(brief, all_forms[1]) OR coalesce(contains(brief, all_forms[2]), false)) WHERE surface <> '')"""
_ADJ = "adj AS (SELECT subject AS u, object AS v FROM claims WHERE object IS NOT NULL UNION SELECT object, subject FROM claims WHERE object IS NOT NULL)"
_NEAR = "near AS (SELECT entity, target FROM named JOIN adj ON u = entity AND v = target UNION SELECT entity, target FROM named JOIN adj x ON x.u = entity JOIN adj y ON y.u = x.v AND y.v = target)"
_DRIFT = f"{_NAMED}, {_ADJ}, {_NEAR}, drift AS (SELECT n.entity, n.target, surface, m.entity IS NOT NULL AS exempted FROM named n ANTI JOIN near USING (entity, target) LEFT JOIN marks m ON m.entity = n.entity AND m.target = n.target)"

#: Pairs to compare: a theory's supplier and part, and each customer with the next.
_PAIRS = "SELECT subject AS a, object AS b FROM {claims} WHERE predicate = 'TheoryOf' UNION SELECT 'C' || c_custkey, 'C' || (c_custkey + 1) FROM {customer}"
_AFFINE = f"""{_ADJ}, pair AS ({re.sub("[{}]", "", _PAIRS)}), asked AS (SELECT a AS x FROM pair UNION SELECT b FROM pair),
hop AS (SELECT x, v AS y FROM asked JOIN adj ON u = x UNION SELECT x, n.v FROM asked JOIN adj m ON m.u = x JOIN adj n ON n.u = m.v WHERE n.v <> x),
pred AS (SELECT DISTINCT x, predicate AS y FROM asked JOIN claims ON x = subject OR x = object),
word AS (SELECT DISTINCT x, y FROM (SELECT x, unnest(regexp_extract_all(lower(brief), '[a-z0-9]+')) AS y FROM asked JOIN entities ON var_name = x) WHERE strlen(y) >= 4),
lists AS (SELECT x, k, list(y) AS l FROM (SELECT x, y, 1 AS k FROM hop UNION ALL SELECT x, y, 2 FROM pred UNION ALL SELECT x, y, 3 FROM word) GROUP BY x, k),
j AS (SELECT a, b, w.k, CASE WHEN p.l IS NULL OR q.l IS NULL THEN 0 ELSE len(list_intersect(p.l, q.l)) * w // (len(p.l) + len(q.l) - len(list_intersect(p.l, q.l))) END AS s
  FROM pair, (VALUES (1, 300), (2, 400), (3, 300)) w(k, w) LEFT JOIN lists p ON p.x = a AND p.k = w.k LEFT JOIN lists q ON q.x = b AND q.k = w.k)"""
#: Orders support their customers here, beside the usual grounds.
_GROUNDS = {"subject_grounds": (*C.SUBJECT_GROUNDS, "InvestigatedBy")}
_CLOSURE = f"""up AS (SELECT DISTINCT subject AS u, object AS v FROM claims JOIN closed x ON x.var_name = subject JOIN closed y ON y.var_name = object WHERE predicate IN {_GROUNDS['subject_grounds']}
  UNION SELECT object, subject FROM claims JOIN closed x ON x.var_name = subject JOIN closed y ON y.var_name = object WHERE predicate IN {C.OBJECT_GROUNDS}),
refs AS (SELECT k.var_name AS e, count(c.subject) AS n FROM closed k LEFT JOIN (SELECT subject FROM claims UNION ALL SELECT object FROM claims) c ON c.subject = k.var_name GROUP BY 1),
state AS (SELECT var_name AS entity, brief, var_name NOT IN (SELECT u FROM up) AS leaf, (SELECT count(*) FROM up WHERE v = var_name) AS n_upstream, (SELECT count(*) FROM up WHERE u = var_name) AS n_downstream,
  var_name IN (SELECT v FROM up JOIN refs ON e = u WHERE n <= 2) OR var_name IN (SELECT b.v FROM up a JOIN up b ON b.u = a.v JOIN refs ON e = a.u WHERE n <= 2) AS weak_upstream,
  CASE WHEN len(list_filter({list(C.REOPENED)}, lambda p: contains(lower(brief), p))) > 0 THEN '' ELSE coalesce(list_filter({list(C.PHRASES)}, lambda p: contains(lower(brief), p))[1], '') END AS phrase FROM closed),
found AS (SELECT entity, phrase, leaf, weak_upstream, CASE WHEN phrase <> '' AND leaf AND weak_upstream THEN 'warning' ELSE 'info' END AS severity FROM state WHERE brief <> '' AND (phrase <> '' OR leaf AND weak_upstream))"""
_INDEXED = """doc AS (SELECT 'entity' AS kind, var_name AS doc, coalesce(name, '') || ' ' || coalesce(brief, '') || ' ' || alias AS text FROM entities
  UNION ALL SELECT 'provenance', var_name, coalesce(origin, '') || ' ' || coalesce(quote, '') FROM provenance),
t AS (SELECT kind, doc, list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) >= 2) AS w FROM doc), st AS (SELECT count(*) AS n, avg(len(w)) AS av FROM t WHERE len(w) > 0),
tf AS (SELECT kind, doc, len(w) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
_ASKED = ["red", "widget", "red", "building", "10", "origin"]


def _index(v) -> Index:
    """Entities in two batches, the second of which replaces a part of the first, and provenance."""
    index = Index(v.spark, f"{shared_dir(v.spark)}/index-{uuid.uuid4().hex}")
    docs = entity_docs(v.entities.select("var_name", "name", "brief", F.array("alias").alias("aliases")))
    index.add(docs.where("doc not like 'O%'").withColumn("text", F.when(F.col("doc").like("%7"), "red widget to be replaced").otherwise(F.col("text"))))
    index.add(docs.where("doc like 'O%' or doc like '%7'").unionByName(provenance_docs(v.provenance)))
    return index


def register(add: Callable, more: Callable, both: Callable) -> None:
    texts = lambda v: v.briefs.select(F.col("var_name").alias("id"), F.col("brief").alias("text"))
    known = lambda v: v.entities.select("var_name", "name", F.array("alias").alias("aliases"))
    drift = lambda v: M.drift(texts(v), known(v), v.claims, v.marks)
    add("i13_mentions", lambda v: M.mentions(texts(v), M.surfaces(known(v))).select(F.col("id").alias("entity"), "target", "surface"), more(_NAMED, "SELECT * FROM named"))
    add("i8_brief_drift", drift, more(_DRIFT, "SELECT * FROM drift"))
    add("i8_drift_report", lambda v: M.drift_report(texts(v), known(v), v.claims, v.marks), more(_DRIFT, "SELECT entity, count(*) FILTER (NOT exempted) AS n_open, count(*) FILTER (exempted) AS n_exempted, coalesce(string_agg(target, ',' ORDER BY target) FILTER (NOT exempted), '') AS targets FROM drift GROUP BY 1"))

    stems = ", ".join(f"'{s}'" for s in X.DOMAIN_STEMS)
    screen = f"SELECT doc_id, text = '' OR len(list_filter([{stems}], lambda s: contains(lower(text || ' ' || source), s))) > 0 OR len(list_filter(regexp_split_to_array(lower(coalesce(item, '')), '\\s+'), lambda w: strlen(w) >= 5 AND contains(lower(text || ' ' || source), w))) > 0 AS out FROM asked"
    asked = "asked AS (SELECT doc_id, d.text, source, b.text AS item FROM {documents} d LEFT JOIN {benchmark} b ON item_id = doc_id % 40)"
    add("q27_relevant", lambda v: v.sql(f"WITH {asked} SELECT * FROM asked").select("doc_id", X.relevant(F.col("text"), F.col("source"), F.col("item")).alias("out")), more(asked.replace("{", "").replace("}", ""), screen))
    excuses = {"ment": ("mentur", "amento"), "tion": ("ationen",)}
    held = "contains(text, 'ment') AND NOT contains(text, 'mentur') AND NOT contains(text, 'amento')"
    add("s26_contains_term", lambda v: v.table("documents").select("doc_id", X.contains_term(F.col("text"), "ment", excuses).alias("ment"), X.contains_term(F.col("text"), "tion", excuses).alias("tion"), X.contains_term(F.col("text"), "der", excuses).alias("der")), f"SELECT doc_id, {held} AS ment, contains(text, 'tion') AND NOT contains(text, 'ationen') AS tion, contains(text, 'der') AS der FROM documents")

    scored = "SELECT kind, doc, round(sum(len(list_filter({}, lambda x: x = term)) * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY 1, 2 HAVING score > 0"
    ranked = scored.format(_ASKED)
    add("r1_index_terms", lambda v: _index(v).terms(), more(_INDEXED, "SELECT term, count(*) AS docs, sum(tf)::BIGINT AS occurrences FROM tf GROUP BY 1"))
    add("r9_fulltext", lambda v: _index(v).search(_ASKED), more(_INDEXED, f"SELECT * FROM ({ranked}) ORDER BY score DESC, kind, doc LIMIT 15"))
    add("r9_fulltext_entities", lambda v: _index(v).search(_ASKED, None, "entity"), more(_INDEXED, f"SELECT * FROM ({ranked}) WHERE kind = 'entity'"))

    add("d9_pair_affinity", lambda v: A.affinity(v.sql(_PAIRS), v.entities, v.claims), more(_AFFINE, "SELECT a, b, (max(s) FILTER (k = 1))::BIGINT AS two_hop, (max(s) FILTER (k = 2))::BIGINT AS predicates, (max(s) FILTER (k = 3))::BIGINT AS brief, sum(s)::BIGINT AS affinity FROM j GROUP BY a, b"))
    places = lambda v: v.claims.where("predicate = 'LocatedIn'")
    # Clusters are regions here: what is claimed of places alone joins the entities of each.
    trip = lambda v: A.trip_entities(v.entities, places(v), ["orders"])
    add("g15_trip_entities", lambda v: trip(v).select("entity", "role_type", "cluster", "bridge", F.array_join("predicates", ",").alias("predicates"), F.array_join("tokens", ",").alias("tokens")), None)
    refuted = lambda v: v.claims.where("predicate = 'Disputes'").select(F.col("subject").alias("a"), F.col("object").alias("b"))
    add("r16_trip_pairs", lambda v: A.pair_across(trip(v), refuted(v), 50), None)

    found = lambda v: C.findings(v.claims, v.closed, **_GROUNDS)
    add("g21_footing", lambda v: C.footing(v.claims, v.closed, **_GROUNDS), more(_CLOSURE, "SELECT entity, n_upstream, n_downstream, leaf, weak_upstream FROM state"))
    add("w9_closure_findings", found, more(_CLOSURE, "SELECT * FROM found"))
    add("w9_premature_closure", lambda v: C.audit(found(v)), more(_CLOSURE, "SELECT 'PrematureClosure' AS bias, (count(*) FILTER (severity = 'warning'))::DOUBLE AS value, count(*) AS n_findings, count(*) FILTER (severity = 'warning') >= 1 AS triggered FROM found"))
    add("g18_walks", lambda v: G.walks(v.claims, v.entities.where("role_type = 'Person'").select(F.col("var_name").alias("start"))), None)
