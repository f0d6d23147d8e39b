"""Registered queries for the text-feature operators (F1–F17, S11) and
their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import stopwords, token_array
from ..operators import textfeat as tf
from .fixtures import conversation_parts, document_parts, table

R = 6  # decimals kept in float outputs (both engines)


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


def q_tokenize(spark, sf):
    t = tf.tokenize(_docs(spark, sf))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def q_stopword_list(spark, sf):
    raw = _docs(spark, sf).select("doc_id", F.explode(token_array(F.col("text"))).alias("term"))
    stop = tf.stopword_frame(spark)
    hits = raw.join(F.broadcast(stop), raw.term == stop.word, "left_semi")
    return hits.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n_removed"))


def q_term_counts(spark, sf):
    return tf.counted_terms(_docs(spark, sf))


def q_df_filter(spark, sf):
    docs = _docs(spark, sf)
    return tf.df_filter(tf.counted_terms(docs), tf.n_documents(docs)).select("doc_id", "term", "count")


def q_normalize_rows(spark, sf):
    docs = _docs(spark, sf)
    n = tf.n_documents(docs)
    scaled, _ = tf.normalize_rows(tf.df_filter(tf.counted_terms(docs), n), n)
    return scaled.select("doc_id", "term", F.round("value", R).alias("value"))


def q_tfidf(spark, sf):
    docs = _docs(spark, sf)
    n = tf.n_documents(docs)
    counts = tf.df_filter(tf.counted_terms(docs), n)
    return tf.tfidf(counts, n, "count", df_col="df").select("doc_id", "term", F.round("weight", R).alias("weight"))


def q_text_part_content(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.length(tf.text_part_content(F.col("text"), 1)).cast("long").alias("n_chars"),
                    F.md5(tf.text_part_content(F.col("text"), 1)).alias("md5"))


def q_text_part_header(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tf.text_part_header(F.col("text")).alias("header"))


def q_text_part_extradata(spark, sf):
    p = conversation_parts(spark, sf)
    return p.select("doc_id", F.md5(tf.text_part_extradata(F.col("extradata"))).alias("md5"))


def q_text_part_content_header(spark, sf):
    p = conversation_parts(spark, sf)
    text = tf.select_text(p, content=True, header=True, extradata=False)
    return text.select("doc_id", F.md5("text").alias("md5"))


def q_text_part_full(spark, sf):
    p = conversation_parts(spark, sf)
    text = tf.select_text(p, content=True, header=True, extradata=True)
    return text.select("doc_id", F.md5("text").alias("md5"))


def q_mix_parts(spark, sf):
    p = conversation_parts(spark, sf)
    n = tf.n_documents(p)
    mats = {name: tf.count_part(p.select("doc_id", F.coalesce(F.col(name), F.lit("")).alias("text")), n)
            for name in ("content", "header", "extradata")}
    return tf.mix_parts(mats).select("doc_id", "term", F.round("value", R).alias("value"),
                                     F.col("first_part").cast("long").alias("first_part"))


def _stem_input(spark, sf):
    docs = _docs(spark, sf)
    n = tf.n_documents(docs)
    counts = tf.df_filter(tf.counted_terms(docs), n)
    return counts.select("doc_id", "term", F.col("count").cast("double").alias("value"))


def q_stem_merge(spark, sf):
    m = tf.stem_merge(_stem_input(spark, sf), "first")
    return m.select("doc_id", "term", F.round("value", R).alias("value"))


def q_unstem_first(spark, sf):
    return tf.representatives(tf.stemmed_vocabulary(_stem_input(spark, sf)), "first")


def q_unstem_heaviest(spark, sf):
    m = tf.stem_merge(_stem_input(spark, sf), "heaviest")
    return m.select("term").distinct().select(F.col("term").alias("word"))


def q_extract_features(spark, sf):
    p = document_parts(spark, sf)
    out = tf.extract_features(p, content=True, header=True, extradata=False)
    return out.select("doc_id", "term", F.round("weight", R).alias("weight"))


def q_save_vocabulary(spark, sf):
    return tf.vocabulary(q_df_filter(spark, sf))


QUERIES = {
    "text_part_content": q_text_part_content,
    "text_part_extradata": q_text_part_extradata,
    "text_part_header": q_text_part_header,
    "text_part_content_header": q_text_part_content_header,
    "text_part_full": q_text_part_full,
    "tokenize": q_tokenize,
    "stopword_list": q_stopword_list,
    "term_counts": q_term_counts,
    "df_filter": q_df_filter,
    "normalize_rows": q_normalize_rows,
    "mix_parts": q_mix_parts,
    "stem_merge": q_stem_merge,
    "unstem_first": q_unstem_first,
    "unstem_heaviest": q_unstem_heaviest,
    "tfidf": q_tfidf,
    "extract_features": q_extract_features,
    "save_vocabulary": q_save_vocabulary,
}

# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in stopwords()) + "]"


def tokens_sql(text: str, with_stop: bool = True) -> str:
    raw = (f"regexp_extract_all(replace(strip_accents(lower(coalesce({text}, ''))), 'ß', '_'), "
           f"'\\b[a-z]{{3,}}\\b')")
    if not with_stop:
        return raw
    return f"list_filter({raw}, lambda t: NOT list_contains({STOP_SQL}, t))"


def stem_sql(term: str) -> str:
    from ..functions.text import _stem_sql
    return _stem_sql(term)


NL = "chr(10)"
HEADER_SQL = f"split_part(text, {NL}, 1)"
CONTENT_SQL = f"CASE WHEN strpos(text, {NL}) > 0 THEN substr(text, strpos(text, {NL}) + 1) ELSE '' END"

CONV_PARTS = f"""
conv_parts AS (
  SELECT conv_id AS doc_id,
    nullif(string_agg(CASE WHEN role = 'system' THEN text END, {NL} ORDER BY turn), '') AS header,
    nullif(string_agg(CASE WHEN role = 'user' THEN text END, {NL} ORDER BY turn), '') AS content,
    nullif(string_agg(CASE WHEN role = 'assistant' THEN text END, {NL} ORDER BY turn), '') AS extradata
  FROM conversations GROUP BY conv_id)"""

COUNTS = f"""
n AS (SELECT count(*) AS n FROM documents),
tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
cnt AS (SELECT doc_id, term, count(*) AS count FROM tok GROUP BY doc_id, term),
keep AS (SELECT term FROM cnt GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)),
kept AS (SELECT * FROM cnt WHERE term IN (SELECT term FROM keep))"""


def _parts_pipeline(parts_cte: str, parts: list[tuple[int, str, float]], n_sql: str) -> str:
    """CTEs from a (doc_id, header, content, extradata) CTE named ``parts`` to
    the mixed matrix ``mixed(doc_id, term, v, fp)``."""
    toks = " UNION ALL ".join(
        f"SELECT {i} AS part, doc_id, unnest({tokens_sql(col)}) AS term FROM parts"
        for i, col, _ in parts)
    weight = "CASE part " + " ".join(f"WHEN {i} THEN {w}" for i, _, w in parts) + " END"
    return f"""{parts_cte},
n AS (SELECT {n_sql} AS n),
ptok AS ({toks}),
pcnt AS (SELECT part, doc_id, term, count(*) AS c FROM ptok GROUP BY ALL),
pkeep AS (SELECT part, term FROM pcnt GROUP BY part, term
          HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)),
pkept AS (SELECT c.* FROM pcnt c SEMI JOIN pkeep k ON c.part = k.part AND c.term = k.term),
prs AS (SELECT part, doc_id, sum(c) AS s FROM pkept GROUP BY ALL),
pmean AS (SELECT part, sum(s) / (SELECT n FROM n) AS m FROM prs GROUP BY part),
pnorm AS (SELECT k.part, k.doc_id, k.term, k.c * (pm.m / r.s) AS v
          FROM pkept k JOIN prs r USING (part, doc_id) JOIN pmean pm USING (part)),
firstp AS (SELECT term, min(part) AS fp FROM pnorm GROUP BY term),
mixed AS (SELECT doc_id, term, sum(v * {weight}) AS v FROM pnorm GROUP BY ALL)"""


DOC_PARTS = f"parts AS (SELECT doc_id, {HEADER_SQL} AS header, {CONTENT_SQL} AS content FROM documents)"

EXTRACT_FEATURES_SQL = "WITH " + _parts_pipeline(
    DOC_PARTS, [(0, "content", 0.5), (1, "header", 0.25)], "(SELECT count(*) FROM documents)") + f""",
stemmed AS (SELECT m.doc_id, m.term, m.v, f.fp, {stem_sql('m.term')} AS stem
            FROM mixed m JOIN firstp f USING (term)),
rep AS (SELECT stem, first(term ORDER BY fp, term) AS word FROM (SELECT DISTINCT stem, term, fp FROM stemmed) GROUP BY stem),
st AS (SELECT doc_id, stem, sum(v) AS v FROM stemmed GROUP BY ALL),
named AS (SELECT st.doc_id, rep.word AS term, st.v FROM st JOIN rep USING (stem)),
dfs AS (SELECT term, count(*) AS df FROM named WHERE v <> 0 GROUP BY term),
w AS (SELECT doc_id, term, v * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w
      FROM named JOIN dfs USING (term) WHERE v <> 0),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY doc_id)
SELECT doc_id, term, round(w / nr, {R}) AS weight FROM w JOIN nrm USING (doc_id)"""

MIX_PARTS_SQL = "WITH " + _parts_pipeline(
    CONV_PARTS.replace("conv_parts AS", "parts AS"),
    [(0, "content", 0.5), (1, "header", 0.25), (2, "extradata", 0.25)],
    "(SELECT count(DISTINCT conv_id) FROM conversations)") + f"""
SELECT m.doc_id, m.term, round(m.v, {R}) AS value, CAST(f.fp AS BIGINT) AS first_part
FROM mixed m JOIN firstp f USING (term)"""

ORACLE = {
    "tokenize": f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
        FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)""",
    "stopword_list": f"""SELECT doc_id, term, count(*) AS n_removed
        FROM (SELECT doc_id, unnest({tokens_sql('text', False)}) AS term FROM documents)
        WHERE list_contains({STOP_SQL}, term) GROUP BY doc_id, term""",
    "term_counts": f"WITH {COUNTS} SELECT * FROM cnt",
    "df_filter": f"WITH {COUNTS} SELECT * FROM kept",
    "normalize_rows": f"""WITH {COUNTS},
        rs AS (SELECT doc_id, sum(count) AS s FROM kept GROUP BY doc_id),
        m AS (SELECT sum(s) / (SELECT n FROM n) AS m FROM rs)
        SELECT doc_id, term, round(count * ((SELECT m FROM m) / s), {R}) AS value FROM kept JOIN rs USING (doc_id)""",
    "tfidf": f"""WITH {COUNTS},
        dfs AS (SELECT term, count(*) AS df FROM kept GROUP BY term),
        w AS (SELECT doc_id, term, count * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM kept JOIN dfs USING (term)),
        nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY doc_id)
        SELECT doc_id, term, round(w / nr, {R}) AS weight FROM w JOIN nrm USING (doc_id)""",
    "text_part_content": f"""SELECT doc_id, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS md5
        FROM (SELECT doc_id, {CONTENT_SQL} AS c FROM documents)""",
    "text_part_header": f"SELECT doc_id, {HEADER_SQL} AS header FROM documents",
    "text_part_extradata": f"WITH {CONV_PARTS} SELECT doc_id, md5(coalesce(extradata, '')) AS md5 FROM conv_parts",
    "text_part_content_header": f"""WITH {CONV_PARTS}
        SELECT doc_id, md5(concat_ws({NL}, header, content)) AS md5 FROM conv_parts""",
    "text_part_full": f"""WITH {CONV_PARTS}
        SELECT doc_id, md5(concat_ws({NL}, header, content) || ' ' || coalesce(extradata, '')) AS md5 FROM conv_parts""",
    "mix_parts": MIX_PARTS_SQL,
    "stem_merge": f"""WITH {COUNTS},
        s AS (SELECT doc_id, term, count, {stem_sql('term')} AS stem FROM kept),
        rep AS (SELECT stem, min(term) AS word FROM s GROUP BY stem)
        SELECT doc_id, word AS term, round(sum(count), {R}) AS value FROM s JOIN rep USING (stem) GROUP BY doc_id, word""",
    "unstem_first": f"""WITH {COUNTS}
        SELECT {stem_sql('term')} AS stem, min(term) AS word FROM kept GROUP BY 1""",
    "unstem_heaviest": f"""WITH {COUNTS},
        s AS (SELECT term, {stem_sql('term')} AS stem, sum(count) AS total FROM kept GROUP BY term)
        SELECT first(term ORDER BY total DESC, term) AS word FROM s GROUP BY stem""",
    "extract_features": EXTRACT_FEATURES_SQL,
    "save_vocabulary": f"""WITH {COUNTS}
        SELECT term AS word, CAST(dense_rank() OVER (ORDER BY term) - 1 AS BIGINT) AS index
        FROM (SELECT DISTINCT term FROM kept)""",
}
