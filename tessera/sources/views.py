"""Knowledge-base relations, projected from the test tables.

The text of a view is plain SQL over ``{table}`` names, so that an oracle can use
the same definition; Spark binds the names to parquet scans and prunes columns.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_ENTITIES = """
SELECT 'R' || r_regionkey AS var_name, 'Place' AS role_type, 'region-' || r_regionkey AS id, r_name AS name, '' AS brief, '' AS alias, 'regions' AS file FROM {region}
UNION ALL SELECT 'N' || n_nationkey, 'Place', 'nation-' || n_nationkey, n_name, '', '', 'nations' FROM {nation}
UNION ALL SELECT 'C' || c_custkey, 'Person', 'customer-' || c_custkey, c_name, c_mktsegment, '', lower(c_mktsegment) FROM {customer}
UNION ALL SELECT 'S' || s_suppkey, 'Organization', 'supplier-' || s_suppkey, s_name, '', '', 'suppliers' FROM {supplier}
UNION ALL SELECT 'P' || p_partkey, 'Concept', 'part-' || p_partkey, p_name, p_type, p_brand, p_brand FROM {part}
UNION ALL SELECT 'O' || o_orderkey, 'Event', 'order-' || o_orderkey, 'order-' || o_orderkey, '', '', 'orders' FROM {orders}
"""
_LINKS = """
SELECT 'LocatedIn' AS predicate, 'N' || n_nationkey AS subject, 'R' || n_regionkey AS object, n_nationkey AS k FROM {nation}
UNION ALL SELECT 'LocatedIn', 'C' || c_custkey, 'N' || c_nationkey, c_custkey FROM {customer}
UNION ALL SELECT 'LocatedIn', 'S' || s_suppkey, 'N' || s_nationkey, s_suppkey FROM {supplier}
UNION ALL SELECT 'InvestigatedBy', 'O' || o_orderkey, 'C' || o_custkey, o_orderkey FROM {orders}
UNION ALL SELECT DISTINCT kind, 'S' || l_suppkey, 'P' || l_partkey, l_partkey FROM (
  SELECT l_suppkey, l_partkey, KINDS AS kind FROM {lineitem}
) WHERE kind IS NOT NULL
UNION ALL SELECT DISTINCT 'FormedAt', 'C' || o_custkey, 'T' || o_orderpriority, o_custkey FROM {orders}
UNION ALL SELECT 'IsCognitiveBias', 'P' || p_partkey, NULL, p_partkey FROM {part} WHERE p_size <= 5
"""
_CLAIMS = f"""
SELECT predicate || '_' || subject || coalesce('_' || object, '') AS var_name, predicate, subject, object, 'D' || (k % (SELECT greatest(count(*), 1) FROM {{documents}})) AS prov_ref, 'file' || (k % 7) AS file
FROM ({_LINKS}) l
"""
_PROVENANCE = "SELECT 'D' || doc_id AS var_name, source AS origin, text AS quote, lang AS file FROM {documents}"
_CYCLES = """
SELECT event_id AS pos, ts, 'user_' || user_id AS hypothesis,
  CASE event_type WHEN 'purchase' THEN 'corroborated' WHEN 'error' THEN 'challenged' WHEN 'view' THEN 'irrelevant' WHEN 'signup' THEN 'no_signal' ELSE '' END AS resolution,
  event_id % 4 AS papers_found,
  CASE event_id % 4 WHEN 0 THEN 'arxiv' WHEN 1 THEN 'zim' WHEN 2 THEN 'kagi' ELSE '' END AS backend,
  CASE event_id % 3 WHEN 0 THEN 'structural_fragility' WHEN 1 THEN 'functional' ELSE '' END AS prediction_type,
  value FROM {events}
"""
_NOTES = "SELECT doc_id, text, lang AS dir, source FROM {documents}"
#: Literal fields, one row a field: what the relations above are pivots of.
_FIELDS = f"""
SELECT var_name AS def_name, role_type AS type_name, 'Name' AS field_name, name AS field_value, file AS source_file, 1 AS line FROM ({_ENTITIES}) a
UNION ALL SELECT var_name, role_type, 'Brief', brief, file, 2 FROM ({_ENTITIES}) b
UNION ALL SELECT var_name, role_type, 'ID', id, file, 3 FROM ({_ENTITIES}) c
UNION ALL SELECT var_name, predicate, 'Subject', subject, file, 1 FROM ({_CLAIMS}) d
UNION ALL SELECT var_name, predicate, 'Object', object, file, 2 FROM ({_CLAIMS}) e WHERE object IS NOT NULL
UNION ALL SELECT var_name, predicate, 'Prov', prov_ref, file, 3 FROM ({_CLAIMS}) f
UNION ALL SELECT var_name, 'Provenance', 'Origin', origin, file, 1 FROM ({_PROVENANCE}) g
UNION ALL SELECT var_name, 'Provenance', 'Quote', quote, file, 2 FROM ({_PROVENANCE}) h
"""
#: What the schema says of each predicate: roles of its two slots, and its pragma.
_PREDICATES = """
SELECT * FROM (VALUES ('LocatedIn', 'Entity', 'Place', ''), ('InvestigatedBy', 'Event', 'Person', ''), ('TheoryOf', 'Organization', 'Concept', 'contested'),
  ('Disputes', 'Organization', 'Concept', ''), ('Proposes', 'Organization', 'Concept', ''), ('FormedAt', 'Person', 'Term', 'functional'), ('IsCognitiveBias', 'Concept', '', '')) AS p(predicate, subject_slot, object_slot, pragma)
"""
#: Notes of a vault: a title, an alias and a path each, and three links by different keys; some lead nowhere.
_VAULT = "SELECT doc_id, 'Note ' || (doc_id % 400) AS title, 'n' || doc_id AS alias, lang || '/note-' || doc_id AS path, source AS section FROM {documents}"
_LINKS_OF = """
SELECT doc_id AS from_doc, 'Note ' || (doc_id * 7 % 450) AS target, source AS section FROM {documents}
UNION ALL SELECT doc_id, 'N' || (doc_id * 3 % 1200), source FROM {documents}
UNION ALL SELECT doc_id, lang || '/Note_' || (doc_id + 1), source FROM {documents} WHERE doc_id % 4 <> 0
"""
#: Decisions, each of which may supersede the one before.
_SUPERSEDES = "SELECT 'V' || doc_id AS newer, 'V' || (doc_id - 1) AS older FROM {documents} WHERE doc_id % 5 <> 0 AND doc_id % 23 <> 3"
#: Briefs that name other entities: an order its customer and supplier, a supplier a part's name and brand.
_BRIEFS = """
SELECT 'O' || o_orderkey AS var_name, 'Placed by ' || c_name || ', delivered by ' || s_name || '.' AS brief FROM {orders} JOIN {customer} ON c_custkey = o_custkey
  JOIN {lineitem} ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN {supplier} ON s_suppkey = l_suppkey
UNION ALL SELECT 'S' || s_suppkey, 'Sells the ' || p_name || ' of ' || p_brand || ' in ' || n_name FROM {supplier} JOIN {part} ON p_partkey = s_suppkey JOIN {nation} ON n_nationkey = s_nationkey
"""
#: Mentions that are marked as such: those of suppliers by closed orders of every seventh customer.
_MARKS = """
SELECT DISTINCT 'O' || o_orderkey AS entity, 'S' || l_suppkey AS target FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_custkey % 7 = 0
"""
#: Briefs of customers and parts, some of which end a question by a phrase and some of which reopen it.
_CLOSED = """
SELECT 'C' || c_custkey AS var_name, CASE c_custkey % 4 WHEN 0 THEN 'Obviously one of ' || c_mktsegment WHEN 1 THEN 'It is well known in ' || c_mktsegment || ', however' ELSE c_mktsegment END AS brief FROM {customer}
UNION ALL SELECT 'P' || p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Of course a ' || p_name || ', self-evident' WHEN 1 THEN '' ELSE p_type END FROM {part}
UNION ALL SELECT 'O' || o_orderkey, '' FROM {orders} UNION ALL SELECT 'S' || s_suppkey, 'Widely RECOGNIZED' FROM {supplier}
"""
VIEWS = {"closed": _CLOSED, "briefs": _BRIEFS, "marks": _MARKS, "fields": _FIELDS, "predicates": _PREDICATES, "vault": _VAULT, "links": _LINKS_OF, "supersedes": _SUPERSEDES, "entities": _ENTITIES, "claims": _CLAIMS, "provenance": _PROVENANCE, "cycles": _CYCLES, "notes": _NOTES}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: What a line says of supplier and part: up to three claims, made in one pass over the lines.
_KINDS = "unnest([CASE WHEN l_quantity >= 49 AND l_linenumber = 1 THEN 'TheoryOf' END, CASE WHEN l_returnflag = 'R' THEN 'Disputes' END, CASE WHEN l_linenumber = 2 THEN 'Proposes' END])"
_SPARK_KINDS = _KINDS.replace("unnest([", "explode(array(").replace("])", "))")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One relation as a DataFrame; unary claims have a null object."""
    sql = VIEWS[name].replace("KINDS", _SPARK_KINDS)
    used = [t for t in TABLES if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle_ctes(sql: str = "") -> str:
    """The views that sql names (all, without it) as common table expressions of another engine, where tables have their plain names."""
    parts = []
    wanted = sql
    for name, sql in VIEWS.items():
        if wanted and not re.search(rf"\b{name}\b", wanted):
            continue
        for t in TABLES:
            sql = sql.replace("{" + t + "}", t)
        sql = sql.replace("KINDS", _KINDS)
        parts.append(f"{name} AS ({sql})")
    return "WITH RECURSIVE " + ", ".join(parts) if parts else ""
