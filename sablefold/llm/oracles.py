"""DuckDB statements for the operators that SQL can express, as plain as possible: all pairs, all variants."""

from __future__ import annotations

from .licences import oracle as op4

# Rows that reach each other over ``links(a, b)``, by the smallest of them.
_REACH = """reach(node, other) AS (
    SELECT a, b FROM links UNION SELECT b, a FROM links
    UNION SELECT r.node, l.other FROM reach r JOIN (SELECT a AS node, b AS other FROM links UNION SELECT b, a FROM links) l ON l.node = r.other),
  lead AS (SELECT node, least(node, min(other)) AS component_id FROM reach GROUP BY node)"""

OP1 = f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
  links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
  {_REACH},
  n AS (SELECT node, count(*) AS n_links FROM (SELECT a AS node FROM links UNION ALL SELECT b FROM links) s GROUP BY node)
  SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
  FROM e LEFT JOIN lead ON lead.node = vec_id LEFT JOIN n ON n.node = vec_id"""

OP3 = r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
  e AS (SELECT doc_id, line_no, doc_id * 10000000 + line_no AS p, norm FROM (SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')) AS norm FROM l) s WHERE norm <> ''),
  f AS (SELECT norm, string_split(norm, ' ') AS w, first FROM (SELECT norm, min(p) AS first FROM e GROUP BY norm) s),
  v AS (SELECT norm, len(w) AS n, first, i, hash(list_concat(w[1:i - 1], w[i + 1:])) AS h FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= 2) s),
  whole AS (SELECT norm, len(w) AS n, first, hash(w) AS h FROM f),
  near AS (SELECT norm FROM (SELECT norm, n, first, min(first) OVER (PARTITION BY h, i) AS m FROM v) s WHERE m < first AND n >= 3
    UNION SELECT whole.norm FROM whole JOIN v ON v.h = whole.h AND v.first < whole.first WHERE whole.n >= 3
    UNION SELECT v.norm FROM v JOIN whole ON whole.h = v.h AND whole.first < v.first WHERE v.n >= 3),
  gone AS (SELECT doc_id, line_no, e.p = f.first AS near FROM e JOIN f USING (norm) WHERE e.p <> f.first OR e.norm IN (SELECT norm FROM near)),
  g AS (SELECT doc_id, count(*) AS n_gone, count(*) FILTER (WHERE near) AS near_gone, string_agg(CAST(line_no AS varchar), ',' ORDER BY line_no) AS lines_gone FROM gone GROUP BY doc_id)
  SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n_gone, 0) AS n_gone, coalesce(near_gone, 0) AS near_gone, coalesce(lines_gone, '') AS lines_gone FROM documents LEFT JOIN g USING (doc_id)"""

OP6 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s FROM w),
  n AS (SELECT doc_id, len(s) AS n_shingles FROM sets),
  x AS (SELECT doc_id, unnest(s) AS s FROM sets),
  c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM x p JOIN x q ON p.s = q.s AND p.doc_id < q.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c.n >= 75 * (na.n_shingles + nb.n_shingles - c.n)),
  {_REACH}
  SELECT n.doc_id, n_shingles, coalesce(component_id, n.doc_id) AS component_id FROM n LEFT JOIN lead ON lead.node = n.doc_id"""

ORACLES = {"op1_embedding_dedup": OP1, "op3_line_dedup": OP3, "op4_license_scan": op4(), "op6_ngram_jaccard": OP6}
