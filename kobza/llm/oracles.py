"""SQL of the corpus operators that SQL can express, for DuckDB on the same tables."""

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

REACH = """
reach(id, least) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.id
)"""

JACCARD = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), nodes AS (
  SELECT doc_id AS id FROM documents
),{REACH}
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(least) FROM reach WHERE reach.id = sets.doc_id) AS component_id FROM sets"""

COVER_TREE = rf"""
WITH RECURSIVE nodes AS (
  SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), links AS (
  SELECT x.id AS a, y.id AS b FROM nodes x JOIN nodes y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.95
),{REACH}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, (SELECT min(least) FROM reach WHERE reach.id = nodes.id) AS component_id, (SELECT min(least) FROM reach WHERE reach.id = nodes.id) = id AS kept FROM nodes"""

VANTAGE_TREE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM near
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

SQL = {"op4_jaccard_join": JACCARD, "op5_cover_tree_dedup": COVER_TREE, "op6_vantage_tree_search": VANTAGE_TREE}
