"""Registered queries: near-duplicate documents and repeated passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .minhash import near_duplicates
from .suffixes import remove_repeats


def op6_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_array_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x.e - x.s)")
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_minhash_near_dedup": op6_minhash_near_dedup,
           "op10_suffix_array_dedup": op10_suffix_array_dedup}

ORACLE = {
    "op6_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
c AS (SELECT list_sort(sh) AS k, min(doc_id) AS id, len(any_value(sh)) AS n FROM s WHERE len(sh) > 0 GROUP BY 1),
e AS (SELECT id, n, unnest(k) AS x FROM c),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS cut, any_value(a.n) + any_value(b.n) - count(*) AS whole
      FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * cut >= 85 * whole UNION ALL
      SELECT b, a FROM p WHERE 100 * cut >= 85 * whole),
r AS (SELECT id AS node, id AS reach FROM c UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
m AS (SELECT node, min(reach) AS comp FROM r GROUP BY 1)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, coalesce(m.comp, s.doc_id) AS component_id,
       s.doc_id = coalesce(m.comp, s.doc_id) AS kept
FROM s LEFT JOIN c ON list_sort(s.sh) = c.k LEFT JOIN m ON m.node = c.id
"""}
