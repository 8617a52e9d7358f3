"""DuckDB statements of the results that SQL can express."""

_OP3 = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(w[s:s + 9], ' '))) AS g
  FROM item WHERE len(w) > 0
), sizes AS (SELECT DISTINCT k FROM win),
start AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
  FROM doc, sizes WHERE len(w) >= k
), met AS (
  SELECT DISTINCT start.doc_id, start.s, start.k, win.item_id FROM start JOIN win ON start.g = win.g AND start.k = win.k
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + k)) AS i FROM met) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM met GROUP BY doc_id
)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

#: crc32 of a list of bytes, with its table made by the polynomial's rule.
_CRC = """
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc_table
)"""
_CRC_OF = "xor(list_reduce({0}, lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"
_BYTES = "flatten(list_transform(string_split({0}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 | (unicode(x) >> 6))::BIGINT, (128 | (unicode(x) & 63))::BIGINT] END))"

_OP11 = rf"""
WITH RECURSIVE {_CRC}, seen AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
  SELECT run, times, {_CRC_OF.format(_BYTES.format("doc_id::VARCHAR || ':' || run"))} AS h FROM seen, crc
), word AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM word WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), gap AS (
  SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT gap.word, words.word FROM gap JOIN words ON gap.rest = words.word
  UNION SELECT words.word, gap.word FROM gap JOIN words ON gap.rest = words.word
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-o.n, encode(other))) AS form, max(o.n) AS form_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word
), formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * words.n THEN form END AS form, CASE WHEN form_n >= 10 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS depth FROM formed
  UNION ALL SELECT chain.word, f.form, depth + 1 FROM chain JOIN formed f ON f.word = chain.root WHERE f.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, depth) AS root FROM chain GROUP BY word) USING (word)
"""

_OP12 = rf"""
WITH {_CRC}, doc AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC_OF.format(_BYTES.format("doc_id::VARCHAR"))} AS h FROM documents, crc)
), shape AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a FROM doc
), pos AS (
  SELECT doc_id, i, w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM shape)
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM pos x JOIN pos y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), stretch AS (
  SELECT doc_id, p, min(i) AS start, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM same)
  GROUP BY doc_id, p, island HAVING count(*) >= p AND count(*) + p >= 12
), run AS (
  SELECT doc_id, start, len + p AS length, min(p) AS period FROM stretch GROUP BY ALL
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_min(run, (-length, start, period)) AS best FROM run GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS words FROM pos ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM doc LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS "rank", vec_id, score FROM scored) WHERE "rank" <= 5
"""

ORACLES: dict[str, str] = {"op3_decontamination": _OP3, "op11_spelling_variants": _OP11, "op12_periodic_runs": _OP12, "op13_exact_topk": _OP13}
