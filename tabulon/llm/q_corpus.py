"""Registered queries: byte-level tokens, filter audit and phrases of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import audit, byte_bpe, collocations
from .common import table


def op11_byte_bpe(spark, sf_dir):
    out = byte_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("tokens").cast("array<string>"), " ")
    return out.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_filter_audit(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"),
                       table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op13_collocations(spark, sf_dir):
    return collocations.phrases(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {"op11_byte_bpe": op11_byte_bpe, "op12_filter_audit": op12_filter_audit,
           "op13_collocations": op13_collocations}

ORACLE = {
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM t),
m AS (SELECT doc_id AS id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
    100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN m ON doc_id = id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM f GROUP BY ALL),
k AS (SELECT i, chr((64 + i)::INT) AS name FROM range(1, 6) r(i)),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS seq
  FROM k a JOIN k b ON b.i <> a.i JOIN k c ON c.i NOT IN (a.i, b.i) JOIN k d ON d.i NOT IN (a.i, b.i, c.i)
  JOIN k e ON e.i NOT IN (a.i, b.i, c.i, d.i)),
s AS (SELECT filter_order, step::INT AS step, seq[step] AS own, seq[1:step - 1] AS earlier FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, own, fails[own] AS hit, n, g, x,
    len(list_filter(earlier, lambda i: fails[i])) = 0 AS reached, len(list_filter(fails, lambda v: v)) = 1 AS alone FROM c, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE reached AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE reached AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE NOT reached AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE hit AND alone), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (WHERE reached AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (WHERE reached AND hit), 0)::BIGINT AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, chr((64 + own)::INT) AS filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 4) r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT c.lang, c.phrase, c.a, i AS cut, x.f AS l, y.f AS r,
    ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c, range(1, 3) r(i)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:i], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(ws[i + 1:c.k], ' ') WHERE i < c.k),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(a) AS longer FROM c, range(1, 3) r(i) WHERE k = 3 GROUP BY ALL),
t AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN d ON b.lang = d.lang AND b.phrase = d.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false))
SELECT t.lang, rank, phrase, a, l, r, n, score FROM t JOIN n ON t.lang = n.lang WHERE rank <= 2000
"""}
