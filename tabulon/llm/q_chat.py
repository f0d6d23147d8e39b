"""Registered query: formatted conversations."""

from __future__ import annotations

from .chat import BUDGET, HISTORY, MARKS, digest, windows
from .common import stage, table

PROBE = "</s>[INST] ok [/INST]"


def op5_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn",
                                                             "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return digest(stage(windows(turns.union(probe))))


QUERIES = {"op5_chat_format": op5_chat_format}

_SIZE = ("length(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;'))")
ORACLE = {
    "op5_chat_format": rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}')),
p AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARKS} AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
  {_SIZE.format("role")} + {_SIZE.format("text")} + 11 AS size FROM t),
h AS (SELECT *, pos = 1 AND role = 'system' AS head, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE tokens END AS own FROM p),
b AS (SELECT *, sum(own) OVER (PARTITION BY conv_id ORDER BY pos) - own AS before,
  {BUDGET - HISTORY} - max(CASE WHEN head THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS room FROM h),
g AS (SELECT *, NOT head AND 2 * own > room AS long FROM b),
i AS (SELECT *, greatest(1, room - max(CASE WHEN long THEN 0 ELSE own END) OVER (PARTITION BY conv_id)) AS stride,
  sum(CASE WHEN long THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS section,
  max(CASE WHEN long THEN before + own ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS base FROM g),
w AS (SELECT *, [2 * section - long::INT, CASE WHEN long THEN 0 ELSE (before - base) // stride END]::BIGINT[] AS win FROM i),
s AS (SELECT conv_id, win, min(before) AS start FROM w WHERE NOT head GROUP BY ALL UNION ALL
  SELECT conv_id, [0, 0]::BIGINT[], 0 FROM w GROUP BY conv_id HAVING max(own) = 0),
f AS (
  SELECT conv_id, size FROM w WHERE NOT head
  UNION ALL SELECT w.conv_id, w.size FROM w JOIN s ON w.conv_id = s.conv_id AND NOT w.head AND w.win < s.win
    AND s.start - w.before <= {HISTORY}
  UNION ALL SELECT w.conv_id, w.size FROM w JOIN s ON w.conv_id = s.conv_id AND w.head),
c AS (SELECT conv_id, sum(size)::BIGINT AS formatted_chars FROM f GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS said FROM p GROUP BY 1)
SELECT d.conv_id, n_turns, turns_sha256, length(said)::BIGINT AS loss_chars, sha256(said) AS loss_sha256, formatted_chars
FROM d JOIN c ON d.conv_id = c.conv_id
"""}
