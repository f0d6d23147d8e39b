"""Registered queries for neighbourhoods (N1–N10), distance distributions
(D1–D5) and topic profiles (R1–R9, M5), with DuckDB oracles.

Topic space W: ``embeddings`` (file = vec_id, page = label).  Reuses of a
file: orders of ``lineitem`` lines with ``l_partkey = vec_id``.  Producer /
extension of a file: ``documents.source`` / ``documents.lang`` of
``doc_id = vec_id``; tags: words of ``part.p_name`` of ``p_partkey = vec_id``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import md5_rank_sql
from ..operators import distances as D
from ..operators import neighbors as N
from ..operators import pairs as P
from ..operators import profiles as Rp
from ..operators import textfeat as tf
from ..session import cut_lineage
from .fixtures import table, topic_space
from .q_pairs import fixed_L
from .q_text import COUNTS

R = 6
RADIUS = 1.2
K = 5
SEED = 0
PARTNERS = 100
TOP = 5


def _space(spark, sf):
    s = topic_space(spark, sf)
    return s


def _pages(spark, sf):
    return _space(spark, sf).select("file", F.col("page").cast("string").alias("page"))


def _edges_reuse(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("file"),
                                             F.col("l_orderkey").alias("reuse"))
    return li.join(_space(spark, sf).select("file"), "file", "left_semi")


def _radius(spark, sf):
    return N.radius_neighbors(_space(spark, sf), RADIUS)


def _radius_pages(spark, sf):
    """Edges that carry the pages of both files from the search."""
    return N.radius_neighbors(_space(spark, sf).withColumn("page", F.col("page").cast("string")), RADIUS, keep=["page"])


def _with_reuses(spark, sf, space):
    held = _edges_reuse(spark, sf).groupBy("file").agg(F.collect_set("reuse").alias("reuses"))
    return space.join(held, "file", "left").withColumn(
        "reuses", F.coalesce("reuses", F.array().cast("array<bigint>")))


def _radius_reuses(spark, sf, keep=()):
    """Edges that carry from the search whether both files share a reuse."""
    space = _space(spark, sf).withColumn("page", F.col("page").cast("string"))
    return N.radius_neighbors(_with_reuses(spark, sf, space), RADIUS, keep=keep, shared="reuses")


def q_knn(spark, sf):
    k = N.knn(_space(spark, sf), K)
    return k.select("a", "b", "rank", F.round("distance", R).alias("distance"))


def q_radius_neighbors(spark, sf):
    return _radius(spark, sf).select("a", "b", F.round("distance", R).alias("distance"))


def q_drop_clones(spark, sf):
    return N.drop_clones(_radius(spark, sf)).select("a", "b")


def q_drop_same_page(spark, sf):
    e = N.with_pages(N.drop_clones(_radius_pages(spark, sf)), _pages(spark, sf))
    return N.drop_same_page(e).select("a", "b")


def q_neighbor_counts(spark, sf):
    c = N.neighbor_counts(_radius_pages(spark, sf), _pages(spark, sf))
    return c.withColumn("mean_distance", F.round("mean_distance", R))


def q_reuse_pairs_in_neighborhood(spark, sf):
    return N.reuse_pairs_in_neighborhood(_radius_pages(spark, sf), _pages(spark, sf), _edges_reuse(spark, sf))


def q_target_reuses(spark, sf):
    return N.target_reuses(_radius_reuses(spark, sf, ["page"]), _pages(spark, sf), _edges_reuse(spark, sf))


def q_describe_neighbors(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "source", "lang")
    d = N.describe_neighbors(_radius_reuses(spark, sf), docs, _edges_reuse(spark, sf))
    return d.select("a", "b", "rank", F.round("distance", R).alias("distance"), "source", "lang",
                    "common_reuse")


def q_reuse_edges_local(spark, sf):
    return N.reuse_edges_local(_radius(spark, sf), _edges_reuse(spark, sf))


def q_neighbors_by_page(spark, sf):
    g = N.neighbors_by_page(_radius_pages(spark, sf), _pages(spark, sf))
    return g.select("a", "page_b", "n", F.array_join(F.col("neighbors").cast("array<string>"), " ")
                    .alias("neighbors"))


def _sampled(spark, sf):
    return D.sampled_pair_distances(_space(spark, sf), PARTNERS, SEED)


def q_sampled_pair_distances(spark, sf):
    return _sampled(spark, sf).select("file", "partner", F.round("distance", R).alias("distance"))


def _described(spark, sf):
    """Sampled pairs with their distance and what both files have in common."""
    space = _space(spark, sf)
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("producer"),
                                                F.col("lang").alias("extension"))
    tags = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.split("p_name", " ").alias("tag"))
    facts = _with_reuses(spark, sf, space.select("file", "page").join(docs, "file", "left").join(tags, "file", "left"))
    return D.sampled_pair_distances(space, PARTNERS, SEED, facts=facts.withColumnRenamed("reuses", "reuse"),
                                    same=["page", "producer", "extension"], overlap=["tag", "reuse"])


def _categorized(spark, sf):
    """Category and distance of every pair, read more than once."""
    return D.categorize_pairs(cut_lineage(_described(spark, sf).drop("file", "partner")))


def q_categorize_pairs(spark, sf):
    return D.categorize_pairs(_described(spark, sf)).select("file", "partner", "category")


def q_normalize_distances(spark, sf):
    n = D.normalize_distances(_categorized(spark, sf))
    return n.select("category", "n_pairs", F.round("share", 2).alias("share"),
                    F.round("min_distance", R).alias("min_distance"),
                    F.round("max_distance", R).alias("max_distance"))


def q_distance_distribution(spark, sf):
    q = D.distance_distribution(_categorized(spark, sf))
    return q.select("category", *[F.round(c, R).alias(c) for c in ("q0", "q25", "q50", "q75", "q100")])


def q_compare_embeddings(spark, sf):
    space = _space(spark, sf)
    c = D.compare_embeddings(_sampled(spark, sf), space, P.transform_space(space, fixed_L(64)))
    return c.select("file", "partner", F.round("distance_a", R).alias("distance_a"),
                    F.round("distance_b", R).alias("distance_b"), "change")


def _tags(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("tags"))
    return Rp.count_tags(p)


def _reuse_titles(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id_reuse"),
                                        F.col("p_name").alias("title_reuse"))
    return Rp.unique_reuse_titles(p)


def _reuse_counts(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"),
                                             F.col("l_partkey").alias("reuse"))
    return Rp.count_reuses(li, _reuse_titles(spark, sf))


def _producers(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "source")
    return Rp.count_attribute(d, "source")


def _extensions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "lang")
    return Rp.count_attribute(d, "lang")


def _profile(spark, sf, inc):
    p = Rp.topic_profile(_space(spark, sf), inc)
    return p.select(F.col("topic").cast("long").alias("topic"), "object",
                    F.round("weight", R).alias("weight"))


def _H(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    n = tf.n_documents(docs)
    t = tf.tfidf(tf.df_filter(tf.counted_terms(docs), n), n, "count", df_col="df")
    return t.join(docs.select("doc_id", "lang"), "doc_id").groupBy(
        F.col("lang").alias("topic"), F.col("term").alias("object")).agg(F.sum("weight").alias("weight"))


QUERIES = {
    "knn": q_knn,
    "radius_neighbors": q_radius_neighbors,
    "drop_clones": q_drop_clones,
    "drop_same_page": q_drop_same_page,
    "neighbor_counts": q_neighbor_counts,
    "reuse_pairs_in_neighborhood": q_reuse_pairs_in_neighborhood,
    "target_reuses": q_target_reuses,
    "describe_neighbors": q_describe_neighbors,
    "reuse_edges_local": q_reuse_edges_local,
    "neighbors_by_page": q_neighbors_by_page,
    "sampled_pair_distances": q_sampled_pair_distances,
    "categorize_pairs": q_categorize_pairs,
    "normalize_distances": q_normalize_distances,
    "distance_distribution": q_distance_distribution,
    "compare_embeddings": q_compare_embeddings,
    "count_tags": lambda spark, sf: _tags(spark, sf),
    "unique_reuse_titles": lambda spark, sf: _reuse_titles(spark, sf),
    "count_reuses": lambda spark, sf: _reuse_counts(spark, sf),
    "count_producers": lambda spark, sf: _producers(spark, sf),
    "count_extensions": lambda spark, sf: _extensions(spark, sf),
    "topic_tag": lambda spark, sf: _profile(spark, sf, _tags(spark, sf)),
    "topic_reuse": lambda spark, sf: _profile(spark, sf, _reuse_counts(spark, sf)),
    "topic_producer": lambda spark, sf: _profile(spark, sf, _producers(spark, sf)),
    "topic_extension": lambda spark, sf: _profile(spark, sf, _extensions(spark, sf)),
    "top_objects": lambda spark, sf: Rp.top_objects(
        Rp.topic_profile(_space(spark, sf), _producers(spark, sf)), TOP).select(
        F.col("topic").cast("long").alias("topic"), "object", "rank"),
    "object_cloud_weights": lambda spark, sf: Rp.object_cloud_weights(
        _profile(spark, sf, _tags(spark, sf)), ["bolt"]),
    "word_cloud_weights": lambda spark, sf: Rp.word_cloud_weights(_H(spark, sf)).select(
        "topic", "object", F.round("weight", R).alias("weight")),
    "top_words": lambda spark, sf: Rp.top_objects(_H(spark, sf), 10).select("topic", "object", "rank"),
}

# ---------------------------------------------------------------------------
# DuckDB oracles
# ---------------------------------------------------------------------------

W = "CAST(embedding AS DOUBLE[])"
BASE = f"""
sp AS (SELECT vec_id AS file, CAST(label AS VARCHAR) AS page, {W} AS w FROM embeddings),
ed AS (SELECT DISTINCT l_partkey AS file, l_orderkey AS reuse FROM lineitem WHERE l_partkey IN (SELECT file FROM sp)),
pr AS (SELECT DISTINCT a.file AS x1, b.file AS x2 FROM ed a JOIN ed b ON a.reuse = b.reuse AND a.file < b.file),
edges AS (SELECT a.file AS a, b.file AS b, list_distance(a.w, b.w) AS distance
          FROM sp a JOIN sp b ON list_distance(a.w, b.w) <= {RADIUS}),
el AS (SELECT e.*, pa.page AS page_a, pb.page AS page_b, distance <> 0 AS s, distance <> 0 AND pa.page <> pb.page AS r
       FROM edges e JOIN sp pa ON pa.file = e.a JOIN sp pb ON pb.file = e.b)"""

SAMPLED = f"""
sp AS (SELECT vec_id AS file, CAST(label AS VARCHAR) AS page, {W} AS w FROM embeddings),
ix AS (SELECT file, w, row_number() OVER (ORDER BY file) - 1 AS i FROM sp),
m AS (SELECT count(*) - 1 AS m FROM ix),
dr AS (SELECT file, i, t, ({md5_rank_sql(str(SEED), 'file', 't')}) % (SELECT m FROM m) AS p0
       FROM ix, range(0, {2 * PARTNERS}) r(t)),
dr2 AS (SELECT file, CASE WHEN p0 >= i THEN p0 + 1 ELSE p0 END AS p, t FROM dr),
firsts AS (SELECT file, p, min(t) AS t FROM dr2 GROUP BY file, p),
picked AS (SELECT file, p FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY t) AS rn FROM firsts) WHERE rn <= {PARTNERS}),
sampled AS (SELECT pk.file, b.file AS partner, list_distance(a.w, b.w) AS distance
            FROM picked pk JOIN ix a ON a.file = pk.file JOIN ix b ON b.i = pk.p)"""

CATEGORIZED = SAMPLED + f""",
ed AS (SELECT DISTINCT l_partkey AS file, l_orderkey AS reuse FROM lineitem WHERE l_partkey IN (SELECT file FROM sp)),
pr AS (SELECT DISTINCT a.file AS x1, b.file AS x2 FROM ed a JOIN ed b ON a.reuse = b.reuse AND a.file < b.file),
fl AS (SELECT s.file, s.partner, s.distance, pa.page = pb.page AS same_page,
         coalesce(list_has_any(string_split(ta.p_name, ' '), string_split(tb.p_name, ' ')), false) AS same_tag,
         coalesce(da.source = db.source, false) AS same_producer,
         (least(s.file, s.partner), greatest(s.file, s.partner)) IN (SELECT (x1, x2) FROM pr) AS same_reuse,
         coalesce(da.lang = db.lang, false) AS same_extension
       FROM sampled s JOIN sp pa ON pa.file = s.file JOIN sp pb ON pb.file = s.partner
       LEFT JOIN documents da ON da.doc_id = s.file LEFT JOIN documents db ON db.doc_id = s.partner
       LEFT JOIN part ta ON ta.p_partkey = s.file LEFT JOIN part tb ON tb.p_partkey = s.partner),
cats AS (SELECT file, partner, distance, 'same_page' AS category FROM fl WHERE same_page
   UNION ALL SELECT file, partner, distance, 'same_tag' FROM fl WHERE NOT same_page AND same_tag
   UNION ALL SELECT file, partner, distance, 'same_producer' FROM fl WHERE NOT same_page AND same_producer
   UNION ALL SELECT file, partner, distance, 'same_reuse' FROM fl WHERE NOT same_page AND same_reuse
   UNION ALL SELECT file, partner, distance, 'same_extension' FROM fl WHERE NOT same_page AND same_extension
   UNION ALL SELECT file, partner, distance, 'other' FROM fl
        WHERE NOT same_page AND NOT (same_tag OR same_producer OR same_reuse OR same_extension)
   UNION ALL SELECT file, partner, distance, 'all' FROM fl),
mx AS (SELECT max(distance) AS mx, count(*) AS n FROM cats WHERE category = 'all')"""

TITLES = """titles AS (
  SELECT id_reuse, title AS original_title,
         CASE WHEN n > 1 THEN title || '_' || CAST(rk AS VARCHAR) ELSE title END AS title_reuse
  FROM (SELECT p_partkey AS id_reuse, p_name AS title,
          count(*) OVER (PARTITION BY p_name) AS n,
          dense_rank() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS rk
        FROM (SELECT DISTINCT p_partkey, p_name FROM part)))"""

INC = {
    "tags": "SELECT p_partkey AS file, t AS object, count(*) AS count FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) WHERE t <> '' GROUP BY ALL",
    "reuses": f"""SELECT l_suppkey AS file, replace(title_reuse, ';', '') AS object, count(*) AS count
        FROM lineitem JOIN titles ON l_partkey = id_reuse GROUP BY ALL""",
    "producers": "SELECT doc_id AS file, source AS object, count(*) AS count FROM documents WHERE source IS NOT NULL GROUP BY ALL",
    "extensions": "SELECT doc_id AS file, lang AS object, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY ALL",
}


def _profile_sql(inc: str) -> str:
    return f"""WITH {TITLES}, inc AS ({inc}),
      wl AS (SELECT vec_id AS file, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS topic,
                    CAST(unnest(embedding) AS DOUBLE) AS wt FROM embeddings),
      prof AS (SELECT topic, object, sum(wt * count) AS weight FROM wl JOIN inc USING (file) GROUP BY ALL)"""


H_SQL = f"""{COUNTS},
        dfs AS (SELECT term, count(*) AS df FROM kept GROUP BY term),
        w AS (SELECT doc_id, term, count * (ln((1 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM kept JOIN dfs USING (term)),
        nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nr FROM w GROUP BY doc_id),
        t AS (SELECT doc_id, term, w / nr AS weight FROM w JOIN nrm USING (doc_id)),
        H AS (SELECT lang AS topic, term AS object, sum(weight) AS weight FROM t JOIN documents USING (doc_id) GROUP BY ALL)"""

ORACLE = {
    "knn": f"""WITH sp AS (SELECT vec_id AS file, {W} AS w FROM embeddings),
        d AS (SELECT a.file AS a, b.file AS b, list_distance(a.w, b.w) AS distance FROM sp a JOIN sp b ON a.file <> b.file),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM d)
        SELECT a, b, rank, round(distance, {R}) AS distance FROM r WHERE rank <= {K}""",
    "radius_neighbors": f"WITH {BASE} SELECT a, b, round(distance, {R}) AS distance FROM edges",
    "drop_clones": f"WITH {BASE} SELECT a, b FROM edges WHERE distance <> 0",
    "drop_same_page": f"WITH {BASE} SELECT a, b FROM el WHERE r",
    "neighbor_counts": f"""WITH {BASE},
        per AS (SELECT a, count(*) AS n_neighbors_clone, count(DISTINCT page_b) AS n_pages_clone,
                  count_if(s) AS n_neighbors_same_page, count_if(r) AS n_neighbors,
                  count(DISTINCT CASE WHEN r THEN page_b END) AS n_pages,
                  avg(CASE WHEN r THEN distance END) AS mean_distance FROM el GROUP BY a)
        SELECT sp.file AS a, sp.page AS id_page, coalesce(n_neighbors_clone, 0) AS n_neighbors_clone,
          coalesce(n_pages_clone, 0) AS n_pages_clone, coalesce(n_neighbors_same_page, 0) AS n_neighbors_same_page,
          coalesce(n_neighbors, 0) AS n_neighbors, coalesce(n_pages, 0) AS n_pages,
          round(mean_distance, {R}) AS mean_distance
        FROM sp LEFT JOIN per ON per.a = sp.file""",
    "reuse_pairs_in_neighborhood": f"""WITH {BASE},
        j AS (SELECT e1.a AS t, e1.s AND e2.s AS s, e1.r AND e2.r AS r
              FROM el e1 JOIN pr ON pr.x1 = e1.b JOIN el e2 ON e2.a = e1.a AND e2.b = pr.x2),
        per AS (SELECT t, count(*) AS c, count_if(s) AS cs, count_if(r) AS cr FROM j GROUP BY t)
        SELECT sp.file AS a, coalesce(c, 0) AS n_reuses_clone, coalesce(cs, 0) AS n_reuse_same_page,
               coalesce(cr, 0) AS n_reuses FROM sp LEFT JOIN per ON per.t = sp.file""",
    "target_reuses": f"""WITH {BASE},
        j AS (SELECT el.*, CASE WHEN a = b THEN a IN (SELECT file FROM ed)
                               ELSE (least(a, b), greatest(a, b)) IN (SELECT (x1, x2) FROM pr) END AS share FROM el),
        per AS (SELECT a, count_if(share) AS c, count_if(share AND s) AS cs, count_if(share AND r) AS cr FROM j GROUP BY a)
        SELECT sp.file AS a, coalesce(c, 0) AS n_reuses_target_clone, coalesce(cs, 0) AS n_reuses_target_same_page,
               coalesce(cr, 0) AS n_reuses_target FROM sp LEFT JOIN per ON per.a = sp.file""",
    "describe_neighbors": f"""WITH {BASE},
        e AS (SELECT a, b, distance, (least(a, b), greatest(a, b)) IN (SELECT (x1, x2) FROM pr) AS common_reuse
              FROM edges WHERE distance <> 0)
        SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank, round(distance, {R}) AS distance,
               source, lang, common_reuse FROM e LEFT JOIN documents ON doc_id = b""",
    "reuse_edges_local": f"""WITH {BASE}
        SELECT e1.a AS target, pr.x1, pr.x2 FROM edges e1 JOIN pr ON pr.x1 = e1.b
        JOIN edges e2 ON e2.a = e1.a AND e2.b = pr.x2""",
    "neighbors_by_page": f"""WITH {BASE}
        SELECT a, page_b, count(*) AS n, array_to_string(list_sort(list(CAST(b AS VARCHAR))), ' ') AS neighbors
        FROM el WHERE s GROUP BY a, page_b""".replace("list_sort(list(CAST(b AS VARCHAR)))",
                                                      "list(CAST(b AS VARCHAR) ORDER BY b)"),
    "sampled_pair_distances": f"WITH {SAMPLED} SELECT file, partner, round(distance, {R}) AS distance FROM sampled",
    "categorize_pairs": f"WITH {CATEGORIZED} SELECT file, partner, category FROM cats",
    "normalize_distances": f"""WITH {CATEGORIZED}
        SELECT category, count(*) AS n_pairs, round(count(*) * 100 / (SELECT n FROM mx), 2) AS share,
          round(min(distance / (SELECT mx FROM mx)), {R}) AS min_distance,
          round(max(distance / (SELECT mx FROM mx)), {R}) AS max_distance FROM cats GROUP BY category""",
    "distance_distribution": f"""WITH {CATEGORIZED},
        nd AS (SELECT category, distance / (SELECT mx FROM mx) AS d FROM cats)
        SELECT category, round(quantile_cont(d, 0.0), {R}) AS q0, round(quantile_cont(d, 0.25), {R}) AS q25,
          round(quantile_cont(d, 0.5), {R}) AS q50, round(quantile_cont(d, 0.75), {R}) AS q75,
          round(quantile_cont(d, 1.0), {R}) AS q100 FROM nd GROUP BY category""",
    "compare_embeddings": f"""WITH {SAMPLED},
        tw AS (SELECT file, list_transform(range(1, 65), lambda i: w[i] + 0.1 * coalesce(w[i + 1], 0.0)) AS w FROM sp),
        j AS (SELECT s.file, s.partner, list_distance(a.w, b.w) AS da, list_distance(ta.w, tb.w) AS db
              FROM sampled s JOIN sp a ON a.file = s.file JOIN sp b ON b.file = s.partner
              JOIN tw ta ON ta.file = s.file JOIN tw tb ON tb.file = s.partner),
        mx AS (SELECT max(da) AS ma, max(db) AS mb FROM j)
        SELECT file, partner, round(da / ma, {R}) AS distance_a, round(db / mb, {R}) AS distance_b,
          CASE WHEN db / mb < da / ma THEN 'closer' WHEN db / mb > da / ma THEN 'farther' ELSE 'same' END AS change
        FROM j, mx""",
    "count_tags": INC["tags"],
    "unique_reuse_titles": f"WITH {TITLES} SELECT id_reuse, original_title, title_reuse FROM titles",
    "count_reuses": f"WITH {TITLES} {INC['reuses']}",
    "count_producers": INC["producers"],
    "count_extensions": INC["extensions"],
    "topic_tag": _profile_sql(INC["tags"]) + f" SELECT topic, object, round(weight, {R}) AS weight FROM prof",
    "topic_reuse": _profile_sql(INC["reuses"]) + f" SELECT topic, object, round(weight, {R}) AS weight FROM prof",
    "topic_producer": _profile_sql(INC["producers"]) + f" SELECT topic, object, round(weight, {R}) AS weight FROM prof",
    "topic_extension": _profile_sql(INC["extensions"]) + f" SELECT topic, object, round(weight, {R}) AS weight FROM prof",
    "top_objects": _profile_sql(INC["producers"]) + f""" SELECT topic, object, rank FROM (
        SELECT topic, object, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, object) AS rank FROM prof)
        WHERE rank <= {TOP}""",
    "object_cloud_weights": _profile_sql(INC["tags"]) + f""" SELECT topic, object, round(weight, {R}) AS weight
        FROM prof WHERE round(weight, {R}) > 0 AND object <> 'bolt'""",
    "word_cloud_weights": f"WITH {H_SQL} SELECT topic, object, round(weight, {R}) AS weight FROM H WHERE weight > 0",
    "top_words": f"""WITH {H_SQL} SELECT topic, object, rank FROM (
        SELECT topic, object, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, object) AS rank FROM H)
        WHERE rank <= 10""",
}
