"""Registered queries of embedding and descriptor retrieval, and of saved results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilequarry.functions.geometry import rootsift as rootsift_of
from tilequarry.functions.geometry import rounded
from tilequarry.functions.geometry import unit_deviation as unit_deviation_of
from tilequarry.operators import memory as M
from tilequarry.operators import retrieval as R
from tilequarry.operators.nms import written
from tilequarry.plans.registry import query
from tilequarry.sources.derived import SAVED_SQL, saved, table

_VECTORS = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_COS = "list_dot_product(a.e, b.e) / nullif(sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)), 0)"


def _queries(spark, sf, where):
    return table(spark, sf, "embeddings").where(where).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@query("semantic_topk", f"WITH {_VECTORS} SELECT a.vec_id, round({_COS}, 9) AS cos FROM v a, v b WHERE b.vec_id = 0 ORDER BY cos DESC, a.vec_id LIMIT 128")
def semantic_topk(spark, sf):
    """The 128 windows nearest to one query."""
    found = R.score_queries(table(spark, sf, "embeddings"), _queries(spark, sf, "vec_id = 0"))
    return found.select("vec_id", F.round("cos", 9).alias("cos")).orderBy(F.col("cos").desc(), "vec_id").limit(128)


@query("semantic_max_queries", f"WITH {_VECTORS}, s AS (SELECT a.vec_id, b.vec_id AS q, round({_COS}, 9) AS cos FROM v a, v b WHERE b.vec_id % 100 = 0), m AS (SELECT vec_id, max(cos) AS cos FROM s GROUP BY vec_id) SELECT m.vec_id, min(q) AS query, least(greatest(m.cos, 0.0), 1.0) AS score FROM m JOIN s ON m.vec_id = s.vec_id AND m.cos = s.cos WHERE m.cos >= 0.1 GROUP BY m.vec_id, m.cos")
def semantic_max_queries(spark, sf):
    """Windows by the best of the queries (ids divisible by 100)."""
    return R.best_query(table(spark, sf, "embeddings"), _queries(spark, sf, "vec_id % 100 = 0"), "vec_id", 0.1)


@query("semantic_exemplars", f"""WITH {_VECTORS}, s AS (SELECT a.vec_id, b.vec_id AS q, round({_COS}, 9) AS cos FROM v a, v b WHERE b.vec_id % 100 = 0)
SELECT vec_id, max(cos) FILTER (q % 200 = 0) AS positive, max(cos) FILTER (q % 200 <> 0) AS negative, max(cos) FILTER (q % 200 = 0) >= max(cos) FILTER (q % 200 <> 0) AS kept FROM s GROUP BY vec_id""")
def semantic_exemplars(spark, sf):
    kinds = _queries(spark, sf, "vec_id % 100 = 0").withColumn("kind", F.when(F.col("query") % 200 == 0, "positive").otherwise("negative"))
    return R.exemplars(table(spark, sf, "embeddings"), kinds, "vec_id")


query("nearest_exemplar", f"""WITH {_VECTORS}, s AS (SELECT a.vec_id, b.vec_id AS q, round({_COS}, 9) AS cos FROM v a, v b WHERE b.vec_id % 100 = 0),
k AS (SELECT vec_id, max(cos) FILTER (q % 200 = 0) AS p, max(cos) FILTER (q % 200 <> 0) AS n FROM s GROUP BY vec_id) SELECT vec_id, p AS score FROM k WHERE p >= n""")(
    lambda spark, sf: semantic_exemplars(spark, sf).where("kept").select("vec_id", F.col("positive").alias("score"))
)


def _halves(spark, sf):
    """Template descriptors (the stated query set: ids divisible by 100) and image descriptors (all others)."""
    every = table(spark, sf, "embeddings")
    template = every.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"))
    return template, every.where("vec_id % 100 <> 0").select(F.col("vec_id").alias("t"), F.col("embedding").alias("tv"))


_DIST = "round(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 9)"
_KNN = f"{_VECTORS}, d AS (SELECT a.vec_id AS q, b.vec_id AS t, {_DIST} AS distance FROM v a, v b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, t) AS rank FROM d)"


@query("knn_good_matches", f"WITH {_KNN} SELECT q, t, distance, rank::INT AS rank FROM k WHERE rank <= 16 AND distance <= 1.3")
def knn_good_matches(spark, sf):
    return R.nearest(*_halves(spark, sf), 16).where("distance <= 1.3")


_ROOT = "list_transform(embedding::DOUBLE[], lambda x: sqrt(abs(x) / greatest(list_sum(list_transform(embedding::DOUBLE[], lambda z: abs(z))), 1e-12)))"


@query("rootsift", f"SELECT vec_id, list_transform({_ROOT}, lambda x: round(x, 6)) AS vector FROM embeddings")
def rootsift(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(rootsift_of(F.transform("embedding", lambda x: x.cast("double"))), lambda x: F.round(x, 6)).alias("vector"))


@query("ratio_test", f"""WITH r AS (SELECT vec_id, label, {_ROOT} AS e FROM embeddings), d AS (SELECT a.vec_id AS q, b.vec_id AS t, {_DIST} AS d FROM r a, r b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0),
k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY d, q) AS n FROM d), two AS (SELECT x.t, x.q, x.d AS d1, y.d AS d2 FROM k x JOIN k y ON x.t = y.t AND x.n = 1 AND y.n = 2)
SELECT * FROM two WHERE d1 <= 0.65 AND (d1 < 0.9 * d2 OR d1 < 0.18)""")
def ratio_test(spark, sf):
    root = lambda c: rootsift_of(F.transform(c, lambda x: x.cast("double")))
    template, image = _halves(spark, sf)
    return R.ratio_matches(template.withColumn("qv", root("qv")), image.withColumn("tv", root("tv")))


def _votes(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        ((c("l_partkey") * 37) % 997 + c("l_quantity") / 64).alias("cx"), ((c("l_suppkey") * 53) % 613 + c("l_linenumber") / 8.0).alias("cy"), (1 + c("l_discount")).alias("scale"), (c("l_tax") * 100).alias("angle"),
        F.when(c("l_linenumber") % 2 == 0, "R0").otherwise("MX").alias("orientation"),
    )


_VOTES = "vt AS (SELECT (l_partkey * 37) % 997 + l_quantity / 64 AS cx, (l_suppkey * 53) % 613 + l_linenumber / 8.0::DOUBLE AS cy, 1 + l_discount AS scale, l_tax * 100 AS angle, CASE WHEN l_linenumber % 2 = 0 THEN 'R0' ELSE 'MX' END AS orientation FROM lineitem)"
_BINS = f"{_VOTES}, bn AS (SELECT floor(cx / 12)::BIGINT AS bx, floor(cy / 12)::BIGINT AS by_, count(*)::BIGINT AS votes, median(cx) AS cx, median(cy) AS cy, median(scale) AS scale, median(angle) AS angle FROM vt GROUP BY bx, by_)"


@query("centre_votes", f"""WITH {_BINS} SELECT bx, by_ AS "by", votes, round(cx, 6) AS cx, round(cy, 6) AS cy, round(scale, 6) AS scale, round(angle, 6) AS angle FROM bn WHERE votes >= 4""")
def centre_votes(spark, sf):
    return R.centre_votes(_votes(spark, sf), 12, 4).select("bx", "by", "votes", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "scale", "angle")])


@query("vote_neighbourhood", f"""WITH {_BINS} SELECT a.bx, a.by_ AS "by", sum(b.votes)::BIGINT AS support FROM bn a JOIN bn b ON b.bx BETWEEN a.bx - 1 AND a.bx + 1 AND b.by_ BETWEEN a.by_ - 1 AND a.by_ + 1 GROUP BY a.bx, a.by_""")
def vote_neighbourhood(spark, sf):
    return R.neighbourhood(R.centre_votes(_votes(spark, sf), 12, 1))


@query("proposal_dedupe", f"""WITH {_VOTES}, bn AS (SELECT orientation, floor(cx / 12) AS bx, floor(cy / 12) AS by_, count(*)::BIGINT AS votes, min(cx) AS cx, min(cy) AS cy FROM vt GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY orientation, floor(cx / 25), floor(cy / 25) ORDER BY votes DESC, cx, cy) AS k FROM bn) SELECT orientation, votes, cx, cy FROM r WHERE k = 1""")
def proposal_dedupe(spark, sf):
    bins = _votes(spark, sf).groupBy("orientation", F.floor(F.col("cx") / 12), F.floor(F.col("cy") / 12)).agg(F.count(F.lit(1)).alias("votes"), F.min("cx").alias("cx"), F.min("cy").alias("cy"))
    return R.dedupe(bins.select("orientation", "votes", "cx", "cy"), 25)


_PTS = "pt AS (SELECT o_orderkey AS id, o_custkey % 7 AS word, (o_orderkey * 7919) % 3001 AS x, (o_custkey * 104729 + o_orderkey * 31) % 2003 AS y FROM orders)"
_TPL = "tp AS (SELECT id, word, x - 700 AS x, y - 500 AS y FROM pt WHERE x BETWEEN 700 AND 899 AND y BETWEEN 500 AND 699)"


def _pair_sql(name: str, points: str) -> str:
    return f"""{name}n AS (SELECT a.id AS i, b.id AS j, a.word AS wi, b.word AS wj, a.x AS xi, a.y AS yi, b.x - a.x AS dx, b.y - a.y AS dy, row_number() OVER (PARTITION BY a.id ORDER BY (b.x - a.x) ** 2 + (b.y - a.y) ** 2, b.id) AS k
FROM {points} a JOIN {points} b ON a.id <> b.id AND b.x BETWEEN a.x - 40 AND a.x + 40 AND b.y BETWEEN a.y - 40 AND a.y + 40 WHERE (b.x - a.x) ** 2 + (b.y - a.y) ** 2 <= 1600),
{name}h AS (SELECT wi, wj, round_even(dx / 6.0::DOUBLE, 0)::BIGINT AS qx, round_even(dy / 6.0::DOUBLE, 0)::BIGINT AS qy, xi, yi FROM {name}n WHERE k <= 12)"""


@query("pair_hash_votes", f"""WITH {_PTS}, {_TPL}, {_pair_sql('p', 'pt')}, {_pair_sql('t', 'tp')},
o AS (SELECT p.xi - t.xi AS ox, p.yi - t.yi AS oy FROM ph p JOIN th t USING (wi, wj, qx, qy))
SELECT median(ox)::DOUBLE AS ox, median(oy)::DOUBLE AS oy, count(*)::BIGINT AS votes, least(1.0, count(*) / 6.0::DOUBLE) AS score FROM o GROUP BY round_even(ox / 8.0::DOUBLE, 0), round_even(oy / 8.0::DOUBLE, 0) HAVING count(*) >= 3""")
def pair_hash_votes(spark, sf):
    c = F.col
    points = table(spark, sf, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 7).alias("word"), ((c("o_orderkey") * 7919) % 3001).alias("x"), ((c("o_custkey") * 104729 + c("o_orderkey") * 31) % 2003).alias("y"))
    template = points.where("x between 700 and 899 and y between 500 and 699").select("id", "word", (c("x") - 700).alias("x"), (c("y") - 500).alias("y"))
    return R.pair_votes(template, points, 40, 12, 6, 8, 3)


@query("memory_json_roundtrip", f"WITH {SAVED_SQL} SELECT entry AS saved_entry, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h, score, scale, orientation, 'ncc' AS method, 0.85::DOUBLE AS threshold FROM saved")
def memory_json_roundtrip(spark, sf):
    """Every saved match written to its order's JSON document and read back from it."""
    documents = M.entries_json(saved(spark, sf), "entry").withColumnRenamed("entry", "saved_entry")
    return M.matches_of(M.parse(documents), "saved_entry").drop("entry")


_DETECTORS = ("orb", "akaze", "sift")


@query("memory_params", """SELECT o_orderkey AS saved_entry, 0.5::DOUBLE + (o_orderkey % 50) / 100.0::DOUBLE AS threshold, 0.5::DOUBLE AS threshold_floor, CASE WHEN o_orderkey % 3 = 0 THEN [1.0::DOUBLE] ELSE [0.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE] END AS scales,
CASE WHEN o_orderkey % 5 = 0 THEN [0.0::DOUBLE, 90.0::DOUBLE] END AS rotations, CASE WHEN o_orderkey % 7 = 0 THEN 500 ELSE (o_orderkey % 900)::INT END AS max_results, 0.3::DOUBLE AS nms_iou, 0.25::DOUBLE AS exclude_iou, 'auto' AS device, 'float32' AS compute_dtype,
CASE WHEN o_orderkey % 2 = 0 THEN 'rgb' ELSE 'luminance' END AS channel_mode, [0.5::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE] AS rgb_weights, round(1 / 3.0::DOUBLE, 9) AS ycbcr_weight, CASE o_orderkey % 3 WHEN 0 THEN 'ncc' WHEN 1 THEN 'ssd' ELSE 'fuzzy' END AS method,
o_orderkey % 4 = 0 AS enable_rotation, FALSE AS enable_flipping, (['orb', 'akaze', 'sift'])[o_orderkey % 3 + 1] AS feature_detector, 0.75::DOUBLE AS feature_ratio, (4 + o_orderkey % 9)::INT AS feature_min_inliers, 100 AS feature_max_instances
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def memory_params(spark, sf):
    """All nineteen parameters of each order's saved search, some left out, written as JSON and read back."""
    k = F.col("o_orderkey")
    some = lambda values: F.array(*[F.lit(float(v)) for v in values])
    params = F.struct(
        (0.5 + (k % 50) / 100).alias("threshold"), F.when(k % 3 != 0, some((0.5, 1, 2))).alias("scales"), F.when(k % 5 == 0, some((0, 90))).alias("rotations"), F.when(k % 7 != 0, (k % 900).cast("int")).alias("max_results"),
        F.lit(0.25).alias("exclude_iou"), F.when(k % 2 == 0, "rgb").alias("channel_mode"), some((0.5, 0.25, 0.25)).alias("rgb_weights"), F.when(k % 3 == 1, "ssd").when(k % 3 == 2, "fuzzy").alias("method"),
        F.when(k % 4 == 0, True).alias("enable_rotation"), F.element_at(F.array(*map(F.lit, _DETECTORS)), (k % 3 + 1).cast("int")).alias("feature_detector"), (4 + k % 9).cast("int").alias("feature_min_inliers"),
    )
    documents = M.entries_json(saved(spark, sf), "entry", table(spark, sf, "orders").select(k.alias("entry"), params.alias("params"))).withColumnRenamed("entry", "saved_entry")
    return M.params_of(M.parse(documents), "saved_entry").drop("entry").withColumn("ycbcr_weight", F.round(F.col("ycbcr_weights")[0], 9)).drop("ycbcr_weights")


@query("unit_deviation", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT vec_id, list_transform(e, lambda x: x - list_sum(e) / len(e)) AS c FROM v)
SELECT vec_id, list_transform(c, lambda x: round(x / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-6), 6)) AS vector FROM d""")
def unit_deviation(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform(unit_deviation_of(F.col("embedding")), lambda x: rounded(x, 6)).alias("vector"))


@query("top_proposals", f"""WITH {_VOTES}, bn AS (SELECT orientation, floor(cx / 12) AS bx, floor(cy / 12) AS by_, count(*)::BIGINT AS votes, min(cx) AS cx, min(cy) AS cy FROM vt GROUP BY ALL)
SELECT orientation, votes, cx, cy FROM bn ORDER BY votes DESC, cx, cy, orientation LIMIT 3000""")
def top_proposals(spark, sf):
    """The 3,000 proposals with most votes."""
    bins = _votes(spark, sf).groupBy("orientation", F.floor(F.col("cx") / 12), F.floor(F.col("cy") / 12)).agg(F.count(F.lit(1)).alias("votes"), F.min("cx").alias("cx"), F.min("cy").alias("cy"))
    return R.top_proposals(bins.select("orientation", "votes", "cx", "cy"))


_NEAR = f"""{_BINS}, hd AS (SELECT bx, by_, cx, cy FROM bn WHERE votes >= 4),
nr AS (SELECT h.bx, h.by_, v.cx AS x, v.cy AS y FROM hd h JOIN vt v ON v.cx > h.cx - 18 AND v.cx < h.cx + 18 AND v.cy > h.cy - 18 AND v.cy < h.cy + 18),
rk AS (SELECT *, row_number() OVER (PARTITION BY bx, by_ ORDER BY y, x) - 1 AS r, count(*) OVER (PARTITION BY bx, by_) AS m FROM nr)"""


@query("cluster_points", f"""WITH {_NEAR} SELECT bx, by_ AS "by", max(m)::BIGINT AS n, count(*)::BIGINT AS kept, round(sum(x), 3) AS sum_x, round(sum(y), 3) AS sum_y FROM rk
WHERE m <= 140 OR (((r * 139 + m - 2) // (m - 1)) * (m - 1)) // 139 = r GROUP BY bx, by_""")
def cluster_points(spark, sf):
    """The correspondences about each proposal, 140 of them at even steps where there are more."""
    heads = R.centre_votes(_votes(spark, sf), 12, 4).select("bx", "by", "cx", "cy")
    points = _votes(spark, sf).select(F.col("cx").alias("x"), F.col("cy").alias("y"))
    near = written(R.near_points(heads, points, 18), "near-points")
    kept = R.spread_evenly(near, ["bx", "by"], ["y", "x"], 140).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("kept"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y"))
    return near.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n")).join(kept, ["bx", "by"])
