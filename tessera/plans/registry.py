"""All queries of the engine by name, and their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..operators import integrity as I
from ..operators import logs as L
from ..operators import lookup as Q
from ..operators import retrieval as R
from ..operators import similarity as D
from ..sources.views import TABLES, oracle_ctes, table, view
from . import knowledge, relations, texts

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

_LOWER_TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 2)"
_ENDS = "SELECT subject AS entity, var_name AS claim, CASE WHEN object IS NULL THEN 'unary' ELSE 'subject' END AS role FROM claims UNION ALL SELECT object, var_name, 'object' FROM claims WHERE object IS NOT NULL"
_ADJ = "SELECT subject AS u, object AS v FROM claims WHERE object IS NOT NULL UNION SELECT object, subject FROM claims WHERE object IS NOT NULL"
_HUBS = ("TheoryOf", "Disputes", "Proposes")
_TERMS = ["the", "of", "la", "de", "the"]


class _Views:
    """Relations of one input, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **own: DataFrame) -> DataFrame:
        """A statement over {relations} and {tables}, some of which may be given."""
        names = set(re.findall(r"\{(\w+)\}", text)) - set(own)
        return self.spark.sql(text, **own, **{n: self.table(n) if n in TABLES else getattr(self, n) for n in names})


def _add(name: str, plan: Callable[[_Views], DataFrame], sql: str | None) -> None:
    _QUERIES[name] = lambda spark, sf_dir: plan(_Views(spark, sf_dir))
    if sql is not None:
        _ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else f"{oracle_ctes(sql)} {sql}"


def _more(ctes: str, sql: str) -> str:
    own = oracle_ctes(f"{ctes} {sql}")
    return f"{own + ',' if own else 'WITH RECURSIVE'} {ctes} {sql}"


def _both(name: str, sql: str, ctes: str = "") -> None:
    """A query in SQL that both engines read, over {relations}; its CTEs may refer to relations and to each other."""
    plain = lambda x: re.sub(r"\{(\w+)\}", r"\1", x)
    _add(name, lambda v: v.sql(f"WITH RECURSIVE {ctes} {sql}" if "RECURSIVE" in name or "recursive" in ctes else f"WITH {ctes} {sql}" if ctes else sql), _more(plain(ctes), plain(sql)) if ctes else plain(sql))


def _cols(df: DataFrame) -> DataFrame:
    return df.select("var_name", "predicate", "subject", "object")


# Scans and projections
_add("a1_entities", lambda v: v.entities, "SELECT * FROM entities")
_add("a2_claims", lambda v: v.claims, "SELECT * FROM claims")
_add("a4_predicates", lambda v: v.claims.select("predicate").distinct(), "SELECT DISTINCT predicate FROM claims")
_add("a5_schema", lambda v: v.claims.groupBy("predicate").agg(F.when(F.count("object") > 0, "binary").otherwise("unary").alias("kind")), "SELECT predicate, CASE WHEN count(object) > 0 THEN 'binary' ELSE 'unary' END AS kind FROM claims GROUP BY 1")
_add("a8_type_scan", lambda v: _cols(v.claims.where(F.col("predicate").contains("Of"))), "SELECT var_name, predicate, subject, object FROM claims WHERE predicate LIKE '%Of%'")
_add("a9_value_prefix", lambda v: _cols(v.claims.where(F.col("subject").startswith("S1"))), "SELECT var_name, predicate, subject, object FROM claims WHERE subject LIKE 'S1%'")
_add("a10_def_set", lambda v: v.claims.join(v.entities.where("role_type = 'Organization'").select(F.col("var_name").alias("subject")), "subject", "left_semi").select("var_name", "subject"), "SELECT var_name, subject FROM claims WHERE subject IN (SELECT var_name FROM entities WHERE role_type = 'Organization')")
_add("a14_roles", lambda v: v.entities.select("role_type").distinct(), "SELECT DISTINCT role_type FROM entities")
_add("a19_pivot_entities", lambda v: v.entities.select("var_name", F.explode(F.map_from_arrays(F.array(F.lit("Name"), F.lit("Brief")), F.array("name", "brief"))).alias("field", "value")).groupBy("var_name").agg(F.max(F.when(F.col("field") == "Name", F.col("value"))).alias("name"), F.max(F.when(F.col("field") == "Brief", F.col("value"))).alias("brief")), "SELECT var_name, name, brief FROM entities")
_add("a22_edges", lambda v: v.claims.where("object is not null").select("predicate", "subject", "object"), "SELECT predicate, subject, object FROM claims WHERE object IS NOT NULL")
_add("a23_provenance_by_file", lambda v: v.provenance.groupBy("file").agg(F.bool_or(F.length("quote") > 0).alias("has_quote"), F.max_by("origin", F.when(F.col("origin") != "", F.substring("var_name", 2, 20).cast("long"))).alias("origin")), "SELECT file, bool_or(length(quote) > 0) AS has_quote, max_by(origin, var_name[2:]::BIGINT) FILTER (origin <> '') AS origin FROM provenance GROUP BY file")
_add("a28_recent_events", lambda v: v.cycles.orderBy(F.desc("ts"), F.desc("pos")).limit(25).select("pos", "hypothesis"), "SELECT pos, hypothesis FROM cycles ORDER BY ts DESC, pos DESC LIMIT 25")
_add("a29_quota", lambda v: R.quota(v.cycles, "resolution", ["pos"], 5).select("pos", "resolution"), "SELECT pos, resolution FROM cycles QUALIFY row_number() OVER (PARTITION BY resolution ORDER BY pos) <= 5")
_add("a41_metadata", lambda v: v.entities.groupBy("role_type").agg(F.count("*").alias("n"), F.count_if(F.col("brief") != "").alias("n_briefs")), "SELECT role_type, count(*) AS n, count(*) FILTER (brief <> '') AS n_briefs FROM entities GROUP BY 1")
_add("a45_unary_subjects", lambda v: v.claims.where("object is null").select("subject"), "SELECT subject FROM claims WHERE object IS NULL")

# Lookups
_NAMED = "(contains(lower(var_name), '{0}') OR contains(lower(name), '{0}') OR contains(lower(brief), '{0}') OR contains(lower(id), '{0}') OR contains(lower(alias), '{0}'))"
_add("q1_match", lambda v: v.entities.where(Q.matches("steel")).select("var_name"), f"SELECT var_name FROM entities WHERE {_NAMED.format('steel')}")
_add("q2_search", lambda v: Q.search(v.entities, v.claims, "Brand#1"), f"SELECT e.var_name, e.role_type, e.name, count(DISTINCT x.claim) AS n_claims FROM entities e LEFT JOIN ({_ENDS}) x ON x.entity = e.var_name WHERE {_NAMED.format('brand#1')} GROUP BY 1, 2, 3")
_add("q4_claims_involving", lambda v: _cols(v.claims.where("subject = 'N1' or object = 'N1'")), "SELECT var_name, predicate, subject, object FROM claims WHERE subject = 'N1' OR object = 'N1'")
_add("q6_claims_of_entity", lambda v: Q.claims_of(v.entities, v.claims, "nation-1"), f"SELECT var_name, predicate, subject, object, CASE WHEN object IS NULL THEN 'unary' WHEN subject = t THEN 'subject' ELSE 'object' END AS role FROM claims, (SELECT coalesce(min(var_name), 'nation-1') AS t FROM entities WHERE {_NAMED.format('nation-1')}) WHERE subject = t OR object = t")
_add("q7_theories", lambda v: Q.theories(v.claims, v.entities, "p1"), "SELECT c.var_name, c.subject, c.object, e.name AS subject_name FROM claims c LEFT JOIN entities e ON e.var_name = c.subject WHERE predicate = 'TheoryOf' AND (object = 'p1' OR contains(lower(object), 'p1'))")
_add("q11_provenance", lambda v: Q.provenance(v.provenance, v.claims, "src1"), "SELECT p.var_name, p.origin, count(c.var_name) AS n_used FROM (SELECT DISTINCT var_name, origin FROM provenance) p LEFT JOIN claims c ON c.prov_ref = p.var_name WHERE contains(lower(p.origin), 'src1') OR contains(lower(p.var_name), 'src1') GROUP BY 1, 2")
_add("q13_disputes", lambda v: Q.by_predicates(v.claims, "Disputes", "DisputesOrg"), "SELECT var_name, predicate, subject, object FROM claims WHERE predicate IN ('Disputes', 'DisputesOrg')")
_add("q16_canonical_role", lambda v: v.entities.where(F.lower("role_type") == "person").select("role_type").distinct(), "SELECT DISTINCT role_type FROM entities WHERE lower(role_type) = 'person'")
_add("q17_neighborhood", lambda v: Q.neighborhood(v.claims, v.entities, "S1"), "SELECT predicate, other, arrow, role_type FROM (SELECT predicate, object AS other, CASE WHEN object IS NULL THEN 'unary' ELSE '->' END AS arrow FROM claims WHERE subject = 'S1' UNION ALL SELECT predicate, subject, '<-' FROM claims WHERE object = 'S1') n LEFT JOIN entities e ON e.var_name = n.other")
_add("q19_nearest_tokens", lambda v: Q.nearest_by_tokens(v.entities, "small red steel", 20), "SELECT var_name, len(list_intersect(list_distinct(string_split(lower(name), ' ')), ['small', 'red', 'steel']))::INT AS shared FROM entities WHERE shared > 0 ORDER BY shared DESC, var_name LIMIT 20")
_add("q21_connected", lambda v: v.entities.join(Q.involvement(v.claims).select(F.col("entity").alias("var_name")), "var_name", "left_semi").select("var_name"), f"SELECT var_name FROM entities WHERE var_name IN (SELECT entity FROM ({_ENDS}))")
_add("q25_new_only", lambda v: v.cycles.where("papers_found >= 1").join(v.cycles.where("resolution = 'no_signal'").select("hypothesis"), "hypothesis", "left_anti").select("pos"), "SELECT pos FROM cycles WHERE papers_found >= 1 AND hypothesis NOT IN (SELECT hypothesis FROM cycles WHERE resolution = 'no_signal')")
_add("q28_name_class", lambda v: v.entities.select("var_name", F.when(F.col("name") == "", "empty").when(F.length("name") > 80, "too_long").when(F.lower("name").contains("et al"), "et_al").otherwise("ok").alias("kind")), "SELECT var_name, CASE WHEN name = '' THEN 'empty' WHEN length(name) > 80 THEN 'too_long' WHEN contains(lower(name), 'et al') THEN 'et_al' ELSE 'ok' END AS kind FROM entities")
_add("q31_valid_groups", lambda v: v.claims.groupBy("predicate").agg(F.count("*").alias("n")).where("n >= 20"), "SELECT predicate, count(*) AS n FROM claims GROUP BY 1 HAVING count(*) >= 20")

# Aggregates
_add("h1_stats", lambda v: I.stats(v.entities, v.claims, v.provenance), "SELECT 'entities' AS stat, count(*) AS n FROM entities UNION ALL SELECT 'claims', count(*) FROM claims UNION ALL SELECT 'provenance', count(*) FROM provenance UNION ALL SELECT 'files', count(DISTINCT file) FROM (SELECT file FROM entities UNION ALL SELECT file FROM claims) UNION ALL SELECT 'disputes', count(*) FROM claims WHERE predicate = 'Disputes' UNION ALL SELECT 'contested', count(*) FROM (SELECT object FROM claims WHERE predicate = 'TheoryOf' GROUP BY 1 HAVING count(*) >= 2)")
_add("h2_by_role", lambda v: I.counts(v.entities, "role_type"), "SELECT role_type, count(*) AS n FROM entities GROUP BY 1")
_add("h15_by_predicate", lambda v: I.counts(v.claims, "predicate"), "SELECT predicate, count(*) AS n FROM claims GROUP BY 1")
_add("h3_contested", lambda v: I.contested(v.claims, "TheoryOf", 2), "SELECT object, count(DISTINCT subject) AS n_subjects FROM claims WHERE predicate = 'TheoryOf' GROUP BY 1 HAVING n_subjects >= 2")
_add("h4_file_balance", lambda v: I.file_balance(v.entities), "SELECT file, n, m AS median, CASE WHEN n <= 2 AND m > 5 THEN 'small' WHEN n > 3 * m AND n > 20 THEN 'large' ELSE 'ok' END AS kind FROM (SELECT file, count(*) AS n FROM entities GROUP BY 1), (SELECT list_sort(list(n))[(count(*) // 2 + 1)::BIGINT] AS m FROM (SELECT count(*) AS n FROM entities GROUP BY file))")
_add("h5_provenance_split", lambda v: I.provenance_split(v.claims, v.provenance), "SELECT lower(trim(origin)) AS origin, count(DISTINCT c.file) AS n_files FROM claims c JOIN provenance p ON p.var_name = c.prov_ref GROUP BY 1 HAVING n_files > 1")
_add("h6_brief_quality", lambda v: I.brief_quality(v.entities), "SELECT var_name, CASE WHEN strlen(brief) = 0 THEN 'missing' WHEN strlen(brief) < 20 THEN 'short' WHEN strlen(brief) > 300 THEN 'long' ELSE 'ok' END AS kind FROM entities")
_add("h11_sources", lambda v: v.provenance.agg(F.countDistinct("origin").alias("n")), "SELECT count(DISTINCT origin) AS n FROM provenance")
_add("h14_claims_by_predicate", lambda v: v.claims.groupBy("subject", "predicate").agg(F.array_join(F.array_sort(F.collect_list("var_name")), ",").alias("names")), "SELECT subject, predicate, string_agg(var_name, ',' ORDER BY var_name) AS names FROM claims GROUP BY 1, 2")
_add("h16_accuracy", lambda v: v.table("labels").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg(F.col("toxic").cast("double")), 6).alias("accuracy")), "SELECT quality, count(*) AS n, round(avg(toxic), 6) AS accuracy FROM labels GROUP BY 1")
_add("h17_starved", lambda v: v.cycles.groupBy("hypothesis").agg(F.count_if(F.col("papers_found") == 0).alias("starved"), F.count_if(F.col("resolution") == "").alias("open")), "SELECT hypothesis, count(*) FILTER (papers_found = 0) AS starved, count(*) FILTER (resolution = '') AS open FROM cycles GROUP BY 1")

# Integrity
_add("i2_orphans", lambda v: I.orphans(v.entities, v.claims), f"SELECT var_name, role_type FROM entities WHERE var_name NOT IN (SELECT entity FROM ({_ENDS}))")
_add("i3_value_conflict", lambda v: I.value_conflicts(v.claims, "FormedAt"), "SELECT predicate, subject, count(*) AS n_claims, count(DISTINCT object) AS n_objects FROM claims WHERE predicate = 'FormedAt' GROUP BY 1, 2 HAVING n_claims >= 2 AND n_objects >= 2")
_add("i4_contested_concept", lambda v: I.contested_concepts(v.claims, "TheoryOf"), "SELECT object, string_agg(DISTINCT subject, ',' ORDER BY subject) AS subjects FROM claims WHERE predicate = 'TheoryOf' GROUP BY 1 HAVING count(DISTINCT subject) >= 2")
_add("i10_lexicon_fence", lambda v: I.lexicon_fence(v.provenance, "(?i)\\blex-[0-9]{3,4}\\b|\\blexicon:"), "SELECT var_name, origin FROM provenance WHERE regexp_matches(quote, '(?i)\\blex-[0-9]{3,4}\\b|\\blexicon:') OR regexp_matches(origin, '(?i)\\blex-[0-9]{3,4}\\b|\\blexicon:')")
_add("i15_missing_brief", lambda v: v.entities.where("brief = ''").select("var_name"), "SELECT var_name FROM entities WHERE brief = ''")
_add("i16_duplicate_ids", lambda v: I.duplicate_ids(v.entities), "SELECT id, count(*) AS n FROM entities GROUP BY 1 HAVING count(*) > 1")
_add("i18_dangling", lambda v: I.dangling(v.claims, v.entities), f"SELECT claim, entity, role FROM ({_ENDS}) WHERE entity NOT IN (SELECT var_name FROM entities)")
_add("i20_slots", lambda v: I.slot_mismatch(v.claims, v.entities, {"LocatedIn": ("Organization", "Place"), "TheoryOf": ("Organization", "Entity")}), "SELECT c.var_name, s.role_type AS rs, o.role_type AS ro FROM claims c JOIN entities s ON s.var_name = c.subject JOIN entities o ON o.var_name = c.object WHERE (predicate = 'LocatedIn' AND (s.role_type <> 'Organization' OR o.role_type <> 'Place')) OR (predicate = 'TheoryOf' AND s.role_type <> 'Organization')")

# Dedup
_SIG = "sig AS (SELECT entity, edge, count(*) AS n FROM (SELECT subject AS entity, predicate || '|out|' || coalesce(object, '') AS edge FROM claims UNION ALL SELECT object, predicate || '|in|' || subject FROM claims WHERE object IS NOT NULL) GROUP BY 1, 2), size AS (SELECT entity, count(*) AS size FROM sig GROUP BY 1), w AS (SELECT edge, count(*) AS df, ln(1 + (SELECT count(*) FROM size) / count(*)) AS idf FROM sig GROUP BY 1)"
_add("d1_signatures", lambda v: D.signatures(v.claims), _more(_SIG, "SELECT entity, edge, n FROM sig"))
_add("d2_edge_idf", lambda v: D.edge_weights(D.signatures(v.claims)).select("edge", F.round("idf", 6).alias("idf")), _more(_SIG, "SELECT edge, round(idf, 6) AS idf FROM w"))
_add("d5_candidates", lambda v: D.candidates(v.claims, v.entities, 2, 0.6, 8.0), _more(_SIG, "SELECT x.entity AS a, y.entity AS b, count(*) AS shared, round(count(*) / greatest(any_value(sx.size), any_value(sy.size)), 6) AS coefficient, round(sum(idf), 6) AS weight FROM sig x JOIN sig y ON x.edge = y.edge AND x.entity < y.entity JOIN w ON w.edge = x.edge JOIN size sx ON sx.entity = x.entity JOIN size sy ON sy.entity = y.entity JOIN entities ex ON ex.var_name = x.entity JOIN entities ey ON ey.var_name = y.entity WHERE ex.role_type = ey.role_type GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) / greatest(any_value(sx.size), any_value(sy.size)) >= 0.6 AND sum(idf) >= 8.0"))
_add("d11_pair_key", lambda v: v.claims.where("object is not null").select(F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct(), "SELECT DISTINCT least(subject, object) AS a, greatest(subject, object) AS b FROM claims WHERE object IS NOT NULL")
_add("d12_first_of_key", lambda v: R.quota(v.cycles, "hypothesis", ["ts", "pos"], 1).select("pos", "hypothesis"), "SELECT pos, hypothesis FROM cycles QUALIFY row_number() OVER (PARTITION BY hypothesis ORDER BY ts, pos) = 1")

# Retrieval
_docs = lambda v: v.table("documents").select(F.col("doc_id").alias("doc"), "text")
_BM25 = f"tok AS (SELECT doc_id AS doc, {_LOWER_TOKENS.format('text')} AS t FROM documents), d AS (SELECT doc, t, len(t) AS dl FROM tok WHERE len(t) > 0), st AS (SELECT count(*) AS n, avg(dl) AS av FROM d), q AS (SELECT term, count(*) AS times FROM (SELECT unnest(['the', 'of', 'la', 'de', 'the']) AS term) GROUP BY 1), tf AS (SELECT doc, dl, term, count(*) AS tf FROM (SELECT doc, dl, unnest(t) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"
for _name, _clamped, _idf in (("r2_bm25", False, "ln(1 + (n - df + 0.5) / (df + 0.5))"), ("r12_bm25_clamped", True, "greatest(0, ln((n - df + 0.5) / (df + 0.5)))")):
    _add(_name, lambda v, c=_clamped: R.bm25(_docs(v), _TERMS, clamped=c), _more(_BM25, f"SELECT doc, round(sum(times * {_idf} * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY doc HAVING score > 0 ORDER BY score DESC, doc LIMIT 15"))
_vec = lambda v: v.table("embeddings").select("vec_id", F.col("label").alias("owner"), F.col("embedding").alias("vector"))
_COS = "e AS (SELECT vec_id, label AS owner, embedding::DOUBLE[] AS x FROM embeddings), q AS (SELECT x AS y FROM e WHERE vec_id = 0)"
_add("r3_semantic", lambda v: R.semantic(_vec(v).where("vec_id > 0"), _vec(v).where("vec_id = 0")), _more(_COS, "SELECT owner, round(max(list_cosine_similarity(x, y)), 6) AS score FROM e, q WHERE vec_id > 0 GROUP BY 1"))
_add("r4_best_segments", lambda v: R.semantic(_vec(v).where("vec_id > 0").withColumn("owner", F.col("vec_id")), _vec(v).where("vec_id = 0"), 20), _more(_COS, "SELECT vec_id AS owner, round(list_cosine_similarity(x, y), 6) AS score FROM e, q WHERE vec_id > 0 ORDER BY score DESC, owner LIMIT 20"))
_SIMILAR = "sim AS (SELECT a.vec_id AS doc, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0 AND a.vec_id > 0)"
_LEX = "lex AS (SELECT doc, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av))), 6) AS score FROM tf JOIN q USING (term) JOIN df USING (term), st GROUP BY doc HAVING score > 0)"
_FUSED = "a AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM lex), b AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS r FROM sim), fused AS (SELECT coalesce(a.doc, b.doc) AS doc, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS score FROM a FULL JOIN b ON a.doc = b.doc)"
# A document's vector is the one of its id; the role filter is its language, and its neighborhood the documents of its source.
_add("r8_hybrid", lambda v: R.hybrid(R.bm25(_docs(v), _TERMS, None), R.semantic(_vec(v).where("vec_id > 0").withColumn("owner", F.col("vec_id")), _vec(v).where("vec_id = 0")).withColumnRenamed("owner", "doc"), v.table("documents").select(F.col("doc_id").alias("doc"), F.col("lang").alias("role"), F.col("source").alias("other")), "en", 15), _more(f"{_BM25}, {_SIMILAR}, {_LEX}, {_FUSED}", "SELECT doc, score, source AS other FROM fused JOIN documents ON doc_id = doc WHERE lang = 'en' ORDER BY score DESC, doc LIMIT 15"))
_add("r11_keyword", lambda v: R.keyword(_docs(v), ["que", "der", "the"], 20).select("doc", "hits", F.col("total").cast("long").alias("total")), "SELECT doc_id AS doc, (len(string_split(lower(text), 'que')) > 1)::INT + (len(string_split(lower(text), 'der')) > 1)::INT + (len(string_split(lower(text), 'the')) > 1)::INT AS hits, (len(string_split(lower(text), 'que')) + len(string_split(lower(text), 'der')) + len(string_split(lower(text), 'the')) - 3)::BIGINT AS total FROM documents WHERE hits > 0 ORDER BY hits DESC, total DESC, doc LIMIT 20")
_add("r13_facts", lambda v: R.rank_facts(v.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "text"), ["que", "des", "nicht", "thou"], 30).select("pos", F.col("score").cast("long").alias("score")), "SELECT conv_id * 1000 + turn AS pos, len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda t: length(t) >= 3), ['que', 'des', 'nicht', 'thou']))::BIGINT AS score FROM conversations ORDER BY score DESC, pos LIMIT 30")
_add("r15_history_bucket", lambda v: L.best_resolution(v.cycles).select("hypothesis", (X.resolution_rank(F.col("best")) + 1).alias("bucket")), "SELECT hypothesis, max(CASE resolution WHEN 'corroborated' THEN 3 WHEN 'irrelevant' THEN 2 WHEN 'challenged' THEN 2 WHEN 'no_signal' THEN 1 ELSE 0 END) + 1 AS bucket FROM cycles WHERE resolution <> '' GROUP BY 1")
_add("r20_seeded_sample", lambda v: v.entities.orderBy(F.md5("var_name"), "var_name").limit(40).select("var_name"), "SELECT var_name FROM entities ORDER BY md5(var_name), var_name LIMIT 40")

# Graph
_HADJ = f"h AS ({_ADJ}), comp(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM h UNION (SELECT DISTINCT ON (a.node) a.node, b.component FROM recurring.comp a JOIN h ON h.u = a.node JOIN comp b ON b.node = h.v WHERE b.component < a.component ORDER BY a.node, b.component))"
_add("g1_adjacency", lambda v: G.adjacency(v.claims), f"SELECT u, v FROM ({_ADJ})")
_add("g2_edges", lambda v: G.edge_count(v.claims), f"SELECT count(*) // 2 AS n_edges FROM ({_ADJ})")
_add("g3_components", lambda v: G.components(v.claims), _more(_HADJ, "SELECT node, component FROM comp"))
_add("g4_component_sizes", lambda v: G.component_sizes(v.claims), _more(_HADJ, "SELECT component, count(*) AS size FROM comp GROUP BY 1"))
_add("g5_single_source", lambda v: I.single_source(v.claims, "Proposes"), "SELECT object FROM claims WHERE predicate = 'Proposes' GROUP BY 1 HAVING count(*) = 1")
_add("g6_uncontested", lambda v: I.uncontested(v.claims), "SELECT object FROM claims WHERE predicate = 'Proposes' EXCEPT SELECT object FROM claims WHERE predicate = 'Disputes'")
_add("g7_thin_provenance", lambda v: I.thin_files(v.claims, v.provenance), "SELECT file, count(*) AS n_claims FROM claims c LEFT JOIN (SELECT DISTINCT var_name FROM provenance WHERE length(quote) > 0) p ON p.var_name = c.prov_ref GROUP BY 1 HAVING count(p.var_name) = 0")
_add("g8_bridges", lambda v: G.articulation(v.claims, count_singletons=False), None)
_add("g9_concentration", lambda v: I.degree_outliers(v.claims), f"SELECT entity, degree FROM (SELECT entity, count(*) AS degree FROM ({_ENDS}) GROUP BY 1) WHERE degree >= (SELECT greatest(5, avg(d) + 2 * stddev_pop(d)) FROM (SELECT count(*) AS d FROM ({_ENDS}) GROUP BY entity))")
_add("g10_thin_contested", lambda v: I.contested(v.claims, "TheoryOf", 2).where("n_subjects = 2").select("object"), "SELECT object FROM claims WHERE predicate = 'TheoryOf' GROUP BY 1 HAVING count(DISTINCT subject) = 2")
_add("g11_support", lambda v: G.support_edges(v.claims), "SELECT object, CASE WHEN predicate IN ('Proposes', 'TheoryOf') THEN 'supports' WHEN predicate = 'Disputes' THEN 'challenges' ELSE 'related' END AS kind, count(*) AS n FROM claims WHERE object IS NOT NULL GROUP BY 1, 2")
_add("g14_label_propagation", lambda v: G.label_propagation(v.claims), None)
_add("g16_articulation", lambda v: G.articulation(v.claims), None)
_add("g18_walk", lambda v: G.walk(v.claims, "S1"), None)
_add("g20_two_hops", lambda v: G.two_hop_sizes(v.claims), _more(_HADJ, "SELECT u, count(DISTINCT v) AS n_two_hop FROM (SELECT u, v FROM h UNION ALL SELECT a.u, b.v FROM h a JOIN h b ON a.v = b.u) WHERE u <> v GROUP BY 1"))
_add("g26_merge", lambda v: G.merge_entity(v.claims, "S1", "S2"), "SELECT predicate, CASE WHEN subject = 'S1' THEN 'S2' ELSE subject END AS subject, CASE WHEN object = 'S1' THEN 'S2' ELSE object END AS object FROM claims UNION ALL SELECT 'AbsorbedAlternate', 'S2', NULL")
_add("g28_union_stores", lambda v: G.union_stores({"left": v.claims, "right": v.claims.where("predicate = 'Disputes'")}), "SELECT 'left.' || subject AS subject, predicate, 'left.' || object AS object FROM claims UNION ALL SELECT 'right.' || subject, predicate, 'right.' || object FROM claims WHERE predicate = 'Disputes'")
_add("hop3_disputers", lambda v: Q.two_hop(v.claims, "Disputes", "TheoryOf"), "SELECT DISTINCT a.subject AS who, b.subject AS what FROM claims a JOIN claims b ON a.object = b.object AND a.predicate = 'Disputes' AND b.predicate = 'TheoryOf' WHERE a.subject <> b.subject")
_add("hop5_proposers", lambda v: Q.two_hop(v.claims, "Proposes", "TheoryOf"), "SELECT DISTINCT a.subject AS who, b.subject AS what FROM claims a JOIN claims b ON a.object = b.object AND a.predicate = 'Proposes' AND b.predicate = 'TheoryOf' WHERE a.subject <> b.subject")
_add("b4_paths", lambda v: I.collision_names(v.entities), "SELECT var_name, role_type || '/' || base || CASE WHEN i > 1 THEN '-' || i ELSE '' END AS path FROM (SELECT var_name, role_type, base, row_number() OVER (PARTITION BY role_type, base ORDER BY var_name) AS i FROM (SELECT var_name, role_type, lower(regexp_replace(name, '[^A-Za-z]+', '-', 'g')) AS base FROM entities))")
_add("b2_export", lambda v: v.claims.join(v.provenance.select(F.col("var_name").alias("prov_ref"), "origin"), "prov_ref", "left").select("var_name", "predicate", "origin"), "SELECT c.var_name, c.predicate, p.origin FROM claims c LEFT JOIN provenance p ON p.var_name = c.prov_ref")
_add("b3_dot", lambda v: v.claims.where("object is not null").select(F.format_string('"%s" -> "%s" [label="%s"]', "subject", "object", "predicate").alias("line")), "SELECT '\"' || subject || '\" -> \"' || object || '\" [label=\"' || predicate || '\"]' AS line FROM claims WHERE object IS NOT NULL")

# Scalar functions
_DOC = "SELECT doc_id, {} FROM documents"
_add("s1_tokens", lambda v: v.table("documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")), _DOC.format(f"len({_LOWER_TOKENS.format('text')})::INT AS n"))
_add("s2_ascii_tokens", lambda v: v.table("documents").select("doc_id", F.size(X.ascii_tokens(F.col("text"))).alias("n")), _DOC.format("len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda t: length(t) >= 2))::INT AS n"))
_add("s4_brief_tokens", lambda v: v.entities.select("var_name", F.array_join(F.array_sort(X.brief_tokens(F.col("brief"))), ",").alias("t")), "SELECT var_name, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(brief), '[a-z0-9]+'), lambda t: length(t) >= 4))), ',') AS t FROM entities")
_add("s7_camel", lambda v: v.claims.select("predicate", X.split_camel(F.col("predicate")).alias("words")).distinct(), "SELECT DISTINCT predicate, regexp_replace(predicate, '([a-z0-9])([A-Z])', '\\1 \\2', 'g') AS words FROM claims")
_add("s15_first_sentence", lambda v: v.table("documents").select("doc_id", X.first_sentence(F.col("text")).alias("s")), _DOC.format("CASE WHEN regexp_extract(text, '(?s)^(.*?[.!?])(\\s|$)', 1) = '' THEN text ELSE regexp_extract(text, '(?s)^(.*?[.!?])(\\s|$)', 1) END AS s"))
_add("s21_slug", lambda v: v.entities.select("var_name", X.slug(F.col("name")).alias("slug")), "SELECT var_name, trim(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{Nd}]+', '-', 'g'), '-') AS slug FROM entities")
_CLASS = "SELECT var_name, CASE WHEN contains(lower(origin), 'wikipedia') OR contains(lower(origin), 'zim') THEN 'wikipedia' WHEN contains(lower(origin), 'arxiv') THEN 'arxiv' WHEN contains(lower(origin), 'doi.org') OR contains(lower(origin), 'doi:') THEN 'doi' WHEN contains(lower(origin), 'isbn') THEN 'book' WHEN contains(lower(origin), 'manual') OR contains(lower(origin), 'direct') THEN 'manual' ELSE 'other' END AS c FROM provenance"
_add("s25_origin_class", lambda v: v.provenance.select("var_name", X.classify_origin(F.col("origin")).alias("c")), _CLASS)
_add("s31_strip_html", lambda v: v.table("pages").select("page_id", X.strip_html(F.col("html")).alias("text")), "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
_add("s37_resolution", lambda v: v.cycles.select("pos", X.map_resolution(F.col("resolution")).alias("r")), "SELECT pos, CASE WHEN resolution IN ('corroborated', 'challenged') THEN 'confirmed' WHEN resolution = 'irrelevant' THEN 'ambiguous' WHEN resolution = 'no_signal' THEN 'refuted' ELSE 'unresolved' END AS r FROM cycles")
_add("s41_digest", lambda v: v.table("documents").select("doc_id", X.digest(F.col("text")).alias("d")), _DOC.format("sha256(text)[1:32] AS d"))
_add("s51_spearman", lambda v: L.spearman(v.cycles.groupBy("hypothesis").agg(F.count("*").alias("x"), F.sum("papers_found").alias("y")), "x", "y"), "SELECT round(1 - 6 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1)), 6) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM (SELECT count(*) AS x, sum(papers_found) AS y FROM cycles GROUP BY hypothesis))")

# Logs and audits
_add("l1_hypotheses", lambda v: L.score_hypotheses(v.cycles), "SELECT *, CASE WHEN corroborated + challenged + irrelevant = 0 THEN CASE WHEN n_cycles > n_signal THEN 'pending' ELSE 'no_signal' END WHEN challenged > corroborated AND challenged >= irrelevant THEN 'challenged' WHEN corroborated > irrelevant THEN 'corroborated' WHEN irrelevant > 0 THEN 'irrelevant' WHEN challenged > 0 THEN 'challenged' ELSE 'pending' END AS verdict, round(CASE WHEN corroborated + challenged + irrelevant + no_signal = 0 THEN 0 ELSE 100 * ((corroborated + challenged) / (corroborated + challenged + irrelevant + no_signal)) END, 6) AS precision FROM (SELECT hypothesis, CASE WHEN prediction_type = '' THEN 'structural_fragility' ELSE prediction_type END AS prediction_type, count(*) AS n_cycles, count(*) FILTER (resolution = 'corroborated') AS corroborated, count(*) FILTER (resolution = 'challenged') AS challenged, count(*) FILTER (resolution = 'irrelevant') AS irrelevant, count(*) FILTER (resolution = 'no_signal') AS no_signal, count(*) FILTER (resolution <> '') AS n_signal FROM cycles GROUP BY 1, 2)")
_add("l5_calibrate", lambda v: L.calibrate(v.cycles), "SELECT CASE WHEN backend = '' THEN 'arxiv' ELSE backend END AS backend, count(*) AS n, sum(papers_found)::BIGINT AS papers, round(count(*) FILTER (papers_found > 0) / count(*), 6) AS signal_rate, round(count(*) FILTER (resolution IN ('corroborated', 'challenged')) / count(*) FILTER (resolution <> ''), 6) AS hit_rate FROM cycles GROUP BY 1")
_add("l7_trend", lambda v: L.trend(v.cycles), "SELECT day, round(v, 6) AS v, round(v - lag(v) OVER (ORDER BY day), 6) AS delta FROM (SELECT ts::DATE::VARCHAR AS day, avg(value) AS v FROM cycles GROUP BY 1)")
_add("l9_latest", lambda v: L.latest(v.cycles, "hypothesis"), "SELECT hypothesis, pos, resolution FROM cycles QUALIFY row_number() OVER (PARTITION BY hypothesis ORDER BY ts DESC, pos) = 1")
_add("l17_best", lambda v: L.best_resolution(v.cycles), "SELECT hypothesis, resolution AS best FROM cycles WHERE resolution <> '' QUALIFY row_number() OVER (PARTITION BY hypothesis ORDER BY CASE resolution WHEN 'corroborated' THEN 3 WHEN 'irrelevant' THEN 2 WHEN 'challenged' THEN 2 ELSE 1 END DESC, resolution DESC) = 1")
_add("l18_auto_resolve", lambda v: L.auto_resolve(v.cycles), "SELECT hypothesis, count(*) FILTER (papers_found > 0) AS signal, count(*) FILTER (resolution = '') AS open FROM cycles GROUP BY 1 HAVING signal >= 3 AND open >= 1 AND count(*) FILTER (resolution IN ('corroborated', 'challenged')) = 0")
_add("l22_gate", lambda v: L.phase_gate(v.cycles, 10), "SELECT count(*) FILTER (n >= 10) AS n_ready FROM (SELECT count(*) AS n FROM cycles WHERE resolution = '' GROUP BY hypothesis)")
_add("l24_spend", lambda v: L.spend(v.cycles, 60), "SELECT month, hypothesis, sum(papers_found)::BIGINT AS total, count(*) FILTER (spent <= 60) AS allowed FROM (SELECT strftime(ts, '%Y-%m') AS month, hypothesis, papers_found, sum(papers_found) OVER (PARTITION BY strftime(ts, '%Y-%m'), hypothesis ORDER BY ts, pos ROWS UNBOUNDED PRECEDING) AS spent FROM cycles) GROUP BY 1, 2")
_add("l26_agreement", lambda v: L.agreement(v.table("labels")), "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
_RATIO = "SELECT '{}' AS bias, round(x, 6) AS value, x {} AS triggered FROM (SELECT {} AS x FROM {})"
_add("w1_confirmation", lambda v: L.confirmation(v.cycles), _RATIO.format("ConfirmationBias", "> 0.75", "count(*) FILTER (resolution = 'corroborated') / count(*) FILTER (resolution IN ('corroborated', 'challenged', 'irrelevant'))", "cycles"))
_add("w4_availability", lambda v: L.availability(v.provenance), _RATIO.format("AvailabilityHeuristic", "> 0.25", "sum((n / t) * (n / t))", "(SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM (" + _CLASS + ") GROUP BY c))"))
_add("w5_survivorship", lambda v: L.survivorship(v.cycles), _RATIO.format("SurvivorshipBias", "> 5", "count(*) FILTER (resolution = 'irrelevant') / count(*) FILTER (resolution = 'challenged')", "cycles"))
_add("w3_clustering", lambda v: L.clustering_illusion(v.entities, G.components(v.claims)), _more(_HADJ, "SELECT 'ClusteringIllusion' AS bias, round(b / (f + c - b), 6) AS value, b / (f + c - b) > 0.7 AS triggered FROM (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM comp JOIN entities e ON e.var_name = node GROUP BY file)) AS f, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM comp JOIN entities e ON e.var_name = node GROUP BY component)) AS c, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM comp JOIN entities e ON e.var_name = node GROUP BY file, component)) AS b)"))
_add("w7_overconfidence", lambda v: L.overconfidence(v.claims, v.claims.where("predicate = 'Disputes'")), f"SELECT 'DunningKrugerEffect' AS bias, round(x, 6) AS value, x > 0.9 AS triggered FROM (SELECT count(*) FILTER (entity NOT IN (SELECT object FROM claims WHERE predicate = 'Disputes')) / count(*) AS x FROM (SELECT entity, count(*) AS refs FROM ({_ENDS}) GROUP BY 1) WHERE refs <= 2)")
_add("w8_base_rate", lambda v: L.base_rate(v.claims), _RATIO.format("BaseRateNeglect", "< 3.0", "-sum(n / t * log2(n / t))", "(SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM claims GROUP BY predicate))"))


for _part in (texts, knowledge, relations):
    _part.register(_add, _more, _both)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
