"""Registered queries on box relations: predicates, overlap joins, suppression, ranking, statistics, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilequarry.functions import geometry as G
from tilequarry.operators import examples as X
from tilequarry.operators import memory as M
from tilequarry.operators import nms as N
from tilequarry.operators import tail as T
from tilequarry.plans.registry import query
from tilequarry.sources.derived import BOXES_SQL, LINE_ID_SQL, SAVED_SQL, boxes, line_id, saved, table

SRC = (4000, 6000, 400, 300)
_SRC_SQL = "SELECT 4000 AS sx, 6000 AS sy, 400 AS sw, 300 AS sh"
_INTER = "(greatest(0, least(x + w, sx + sw) - greatest(x, sx)) * greatest(0, least(y + h, sy + sh) - greatest(y, sy)))::DOUBLE"
_IOU = f"({_INTER} / greatest((w * h + sw * sh)::DOUBLE - {_INTER}, 1e-9))"
_INSIDE = "(x + w / 2.0 >= sx AND x + w / 2.0 < sx + sw AND y + h / 2.0 >= sy AND y + h / 2.0 < sy + sh)"


def _lit(b):
    return tuple(F.lit(v) for v in b)


@query("live_threshold", f"WITH {BOXES_SQL} SELECT id, score FROM boxes WHERE score >= 0.85")
def live_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return T.at_least(boxes(spark, sf), 0.85).select("id", "score")


@query("source_exclusion", f"WITH {BOXES_SQL}, src AS ({_SRC_SQL}) SELECT id, x, y, w, h FROM boxes, src WHERE NOT ({_IOU} > 0.3 OR {_INSIDE})")
def source_exclusion(spark, sf):
    return boxes(spark, sf).where(~G.excluded(G.box(), _lit(SRC), 0.3)).select("id", "x", "y", "w", "h")


@query("center_inside", f"WITH {BOXES_SQL}, src AS ({_SRC_SQL}) SELECT id, x, y FROM boxes, src WHERE {_INSIDE}")
def center_inside(spark, sf):
    return boxes(spark, sf).where(G.centre_inside(G.box(), _lit(SRC))).select("id", "x", "y")


@query("semantic_exclusion", f"WITH {BOXES_SQL}, src AS ({_SRC_SQL}) SELECT id FROM boxes, src WHERE NOT ({_IOU} > 0.3 OR {_INSIDE} OR {_INTER} / least(w * h, sw * sh) > 0.3)")
def semantic_exclusion(spark, sf):
    return boxes(spark, sf).where(~G.excluded_semantic(G.box(), _lit(SRC), 0.3)).select("id")


_PAIRS_SQL = f"""{BOXES_SQL},
c AS (SELECT *, (x // 68)::INT AS cx, (y // 68)::INT AS cy FROM boxes),
n AS (SELECT c.*, cx + dx AS kx, cy + dy AS ky FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy)),
p AS (SELECT a.id AS ai, b.id AS bi, a.score AS sa, b.score AS sb, a.y AS ya, b.y AS yb, a.x AS xa, b.x AS xb, a.orientation AS oa, b.orientation AS ob,
        greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter, a.w * a.h + b.w * b.h AS areas
      FROM n a JOIN c b ON a.kx = b.cx AND a.ky = b.cy AND a.id <> b.id),
iou AS (SELECT *, inter / greatest((areas - inter)::DOUBLE, 1e-9) AS iou FROM p WHERE inter > 0)"""


@query("iou_pairs", f"WITH {_PAIRS_SQL} SELECT least(ai, bi) AS a, greatest(ai, bi) AS b, round(iou, 6) AS iou FROM iou WHERE iou > 0.3 AND ai < bi")
def iou_pairs(spark, sf):
    found = N.pairs(boxes(spark, sf), 0.3)
    return found.select(F.least("hi", "lo").alias("a"), F.greatest("hi", "lo").alias("b"), F.round("iou", 6).alias("iou"))


def _nms_sql(p: str, edges: str) -> str:
    """CTEs of greedy suppression along edges (a query of ranks hi, lo): {p}out has the ranks that go. Components are found by reach, then walked in order of rank."""
    return f"""{p}e AS ({edges}),
{p}r AS (SELECT hi AS n, hi AS c FROM {p}e UNION SELECT lo AS n, lo AS c FROM {p}e UNION
         SELECT CASE WHEN e.hi = r.n THEN e.lo ELSE e.hi END AS n, r.c FROM {p}r r JOIN {p}e e ON e.hi = r.n OR e.lo = r.n),
{p}c AS (SELECT comp, list(n ORDER BY n) AS members FROM (SELECT n, min(c) AS comp FROM {p}r GROUP BY n) GROUP BY comp),
{p}h AS (SELECT lo, list(hi) AS his FROM {p}e GROUP BY lo),
{p}s AS (SELECT comp, 0::BIGINT AS k, []::BIGINT[] AS kept FROM {p}c UNION ALL
         SELECT s.comp, s.k + 1, CASE WHEN len(list_intersect(s.kept, coalesce(h.his, []))) > 0 THEN s.kept ELSE list_append(s.kept, c.members[s.k + 1]) END
         FROM {p}s s JOIN {p}c c ON c.comp = s.comp LEFT JOIN {p}h h ON h.lo = c.members[s.k + 1] WHERE s.k < len(c.members)),
{p}kept AS (SELECT unnest(s.kept) AS r FROM {p}s s JOIN {p}c c ON c.comp = s.comp WHERE s.k = len(c.members)),
{p}out AS (SELECT n AS r FROM (SELECT unnest(members) AS n FROM {p}c) WHERE n NOT IN (SELECT r FROM {p}kept))"""


_RANKED_SQL = f"""{_PAIRS_SQL},
rk AS (SELECT id, row_number() OVER (ORDER BY score DESC, y, x, w, h, id) AS r FROM boxes),
ov AS (SELECT least(a.r, b.r) AS hi, greatest(a.r, b.r) AS lo, oa = ob AS same FROM iou JOIN rk a ON a.id = ai JOIN rk b ON b.id = bi WHERE iou > 0.3 AND ai < bi)"""


@query("nms_greedy", f"WITH RECURSIVE {_RANKED_SQL}, {_nms_sql('nms_', 'SELECT hi, lo FROM ov')} SELECT id, x, y, w, h, score FROM boxes JOIN rk USING (id) WHERE r NOT IN (SELECT r FROM nms_out)")
def nms_greedy(spark, sf):
    return N.nms(boxes(spark, sf).select("id", "x", "y", "w", "h", "score"), 0.3)


@query(
    "nms_cross_orientation",
    f"""WITH RECURSIVE {_RANKED_SQL}, {_nms_sql('own_', 'SELECT hi, lo FROM ov WHERE same')},
{_nms_sql('all_', 'SELECT hi, lo FROM ov WHERE hi NOT IN (SELECT r FROM own_out) AND lo NOT IN (SELECT r FROM own_out)')}
SELECT id, orientation, score FROM boxes JOIN rk USING (id) WHERE r NOT IN (SELECT r FROM own_out) AND r NOT IN (SELECT r FROM all_out)""",
)
def nms_cross_orientation(spark, sf):
    """Suppression within each orientation, then over all that is left."""
    own = N.nms(boxes(spark, sf).select("id", "x", "y", "w", "h", "score", "orientation"), 0.3, by=("orientation",))
    return N.nms(N.written(own, "pooled"), 0.3).select("id", "orientation", "score")


@query("topk_matches", f"WITH {BOXES_SQL} SELECT id, x, y, w, h, score, scale, orientation FROM boxes ORDER BY score DESC, y, x, w, h, id LIMIT 500")
def topk_matches(spark, sf):
    return N.top(boxes(spark, sf).drop("entry"), 500)


@query("score_histogram", f"WITH {BOXES_SQL} SELECT least(floor(least(greatest(score, 0), 1) * 100), 99)::BIGINT AS bin, count(*)::BIGINT AS n FROM boxes GROUP BY bin")
def score_histogram(spark, sf):
    return T.histogram(boxes(spark, sf), 100)


@query("orientation_counts", f"WITH {BOXES_SQL} SELECT orientation, count(*)::BIGINT AS n, list_position(['R0', 'R90', 'R180', 'R270', 'MX', 'MY', 'MXR90', 'MYR90'], orientation)::INT AS place FROM boxes GROUP BY orientation")
def orientation_counts(spark, sf):
    return T.orientation_counts(boxes(spark, sf))


@query("orientation_topk", f"WITH {BOXES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY orientation ORDER BY score DESC, y, x, w, h, id) AS rank FROM boxes) SELECT orientation, rank::INT AS rank, id, score FROM r WHERE rank <= 20")
def orientation_topk(spark, sf):
    """The best 20 of each orientation."""
    return T.best_of_each(boxes(spark, sf), ["orientation"], 20).select("orientation", "rank", "id", "score")


@query(
    "phantom_drop",
    f"""WITH {_PAIRS_SQL},
q AS (SELECT a.id AS ai FROM n a JOIN c b ON a.kx = b.cx AND a.ky = b.cy AND a.id <> b.id WHERE b.x + b.w / 2.0 >= a.x AND b.x + b.w / 2.0 < a.x + a.w AND b.y + b.h / 2.0 >= a.y AND b.y + b.h / 2.0 < a.y + a.h AND a.w * a.h > 1.5 * (b.w * b.h))
SELECT id FROM boxes WHERE id NOT IN (SELECT ai FROM q GROUP BY ai HAVING count(*) >= 2)""",
)
def phantom_drop(spark, sf):
    return T.drop_phantoms(boxes(spark, sf).select("id", "x", "y", "w", "h")).select("id")


_NEG = "neg AS (SELECT * FROM boxes WHERE id % 97 = 0), pos AS (SELECT * FROM boxes WHERE id % 101 = 0)"


@query(
    "negatives_anti",
    f"""WITH {_PAIRS_SQL} SELECT id FROM boxes WHERE id % 97 <> 0 AND id NOT IN (SELECT ai FROM iou WHERE bi % 97 = 0 AND iou > 0.3)""",
)
def negatives_anti(spark, sf):
    """Candidates that overlap no negative example; every 97th box is one."""
    every = boxes(spark, sf)
    return T.without_overlap(every.where("id % 97 <> 0"), every.where("id % 97 = 0"), 0.3).select("id")


@query("negative_hits", f"""WITH {_PAIRS_SQL} SELECT id FROM boxes WHERE id % 97 <> 0 AND id NOT IN (SELECT ai FROM iou WHERE bi % 97 = 0 AND iou > 0.1 AND sb >= sa)""")
def negative_hits(spark, sf):
    """Candidates that no overlapping negative hit reaches in score."""
    every = boxes(spark, sf)
    return T.without_overlap(every.where("id % 97 <> 0"), every.where("id % 97 = 0"), 0.1, by_score=True).select("id")


@query(
    "positives_append",
    f"""WITH {_PAIRS_SQL}, res AS (SELECT * FROM boxes WHERE score >= 0.5 AND id % 101 <> 0)
SELECT id, score FROM res UNION ALL SELECT id, 1.0 AS score FROM boxes WHERE id % 101 = 0 AND id NOT IN (SELECT ai FROM iou WHERE bi IN (SELECT id FROM res) AND iou > 0.3)""",
)
def positives_append(spark, sf):
    """Results, and the positive examples (every 101st box) that none of them covers, with score 1."""
    every = boxes(spark, sf)
    found = every.where("score >= 0.5 and id % 101 <> 0")
    return T.append_uncovered(found, every.where("id % 101 = 0"), 0.3).select("id", "score")


@query(
    "example_under_point",
    f"""WITH {BOXES_SQL}, pt AS (SELECT o_orderkey AS pid, (o_orderkey * 7919 + o_custkey * 31) % 20000 AS px, (o_custkey * 104729 + o_orderkey * 17) % 20000 AS py FROM orders),
c AS (SELECT *, unnest([0, 1]) AS ix FROM boxes), d AS (SELECT *, unnest([0, 1]) AS iy FROM c)
SELECT pid, id FROM d JOIN pt ON d.x // 68 + ix = px // 68 AND d.y // 68 + iy = py // 68 WHERE px >= x AND px < x + w AND py >= y AND py < y + h
QUALIFY row_number() OVER (PARTITION BY pid ORDER BY w * h, id) = 1""",
)
def example_under_point(spark, sf):
    """The smallest box under each point; a point for each order."""
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pid"), ((F.col("o_orderkey") * 7919 + F.col("o_custkey") * 31) % 20000).alias("px"), ((F.col("o_custkey") * 104729 + F.col("o_orderkey") * 17) % 20000).alias("py"))
    return T.smallest_under(boxes(spark, sf), points)


@query("memory_stats", f"WITH {SAVED_SQL} SELECT entry, count(*)::BIGINT AS n, count(*)::BIGINT + 1 AS occurrences, min(score) AS low, max(score) AS high, sum(round_even(score * 10000, 0)::BIGINT)::BIGINT / count(*)::DOUBLE / 10000 AS mean FROM saved GROUP BY entry")
def memory_stats(spark, sf):
    return T.statistics(saved(spark, sf), ["entry"])


@query(
    "memory_summary",
    f"""WITH {SAVED_SQL}, o AS (SELECT entry, orientation, count(*) AS n, list_position(['R0', 'R90', 'R180', 'R270', 'MX', 'MY', 'MXR90', 'MYR90'], orientation) AS p FROM saved GROUP BY ALL)
SELECT entry, string_agg(orientation || ':' || n, ' ' ORDER BY p) AS summary FROM o GROUP BY entry""",
)
def memory_summary(spark, sf):
    return T.orientation_summary(saved(spark, sf), ["entry"])


@query("selection_reject", f"""WITH {BOXES_SQL}, s AS (SELECT id, w * (id % 3) AS w, h - 4 * (id % 5) AS h FROM boxes)
SELECT id, CASE WHEN w <= 0 OR h <= 0 THEN 'empty' WHEN w < 8 OR h < 8 THEN 'too small' WHEN w >= 96 AND h >= 24 THEN 'whole image' WHEN greatest(w, h)::DOUBLE / least(w, h) > 10 THEN 'too narrow' END AS reason FROM s""")
def selection_reject(spark, sf):
    s = boxes(spark, sf).select("id", "x", "y", (F.col("w") * (F.col("id") % 3)).alias("w"), (F.col("h") - 4 * (F.col("id") % 5)).alias("h"))
    return s.select("id", G.rejection(G.box(), 96, 24, aspect=10.0).alias("reason"))


@query("box_rounding", """WITH e AS (SELECT o_orderkey AS id, o_totalprice / 97.0 % 1200 - 100 AS x0, o_totalprice / 89.0 % 900 - 50 AS y0, o_totalprice / 83.0 % 1200 - 100 AS x1, o_totalprice / 79.0 % 900 - 50 AS y1 FROM orders),
r AS (SELECT id, least(greatest(floor(least(x0, x1)), 0), 1000)::INT AS x, least(greatest(floor(least(y0, y1)), 0), 700)::INT AS y, least(greatest(ceil(greatest(x0, x1)), 0), 1000)::INT AS x2, least(greatest(ceil(greatest(y0, y1)), 0), 700)::INT AS y2 FROM e)
SELECT id, x, y, x2 - x AS w, y2 - y AS h FROM r""")
def box_rounding(spark, sf):
    p = F.col("o_totalprice")
    x, y, w, h = G.round_out(p / 97.0 % 1200 - 100, p / 89.0 % 900 - 50, p / 83.0 % 1200 - 100, p / 79.0 % 900 - 50, 1000, 700)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


@query("clip_boxes", f"WITH {BOXES_SQL}, b AS (SELECT id, greatest(0, least(x, 14999)) AS x, greatest(0, least(y, 9999)) AS y, x + w AS x2, y + h AS y2 FROM boxes) SELECT id, x, y, greatest(1, least(x2, 15000) - x) AS w, greatest(1, least(y2, 10000) - y) AS h FROM b")
def clip_boxes(spark, sf):
    return T.clip(boxes(spark, sf), 15000, 10000).select("id", "x", "y", "w", "h")


@query("recentre_boxes", f"WITH {BOXES_SQL} SELECT id, greatest(0, least(round_even(x + w / 2.0 - 15.0, 0), 19970))::BIGINT AS x, greatest(0, least(round_even(y + h / 2.0 - 10.0, 0), 19980))::BIGINT AS y FROM boxes")
def recentre_boxes(spark, sf):
    """Boxes of 30 x 20 about the same centres, within the image."""
    return T.recentre(boxes(spark, sf), 30, 20, 20000, 20000).select("id", "x", "y")


@query("window_positions", """WITH p AS (SELECT p_partkey AS id, 30 + (p_partkey % 211)::INT AS len, (p_size + 8)::INT AS win, greatest(1, (p_size + 8) // 2)::INT AS stride FROM part)
SELECT id, CASE WHEN win > len THEN [] ELSE list_sort(list_distinct(list_append(range(0, len - win + 1, stride), len - win))) END::INT[] AS starts FROM p""")
def window_positions(spark, sf):
    length, window = (30 + F.col("p_partkey") % 211).cast("int"), (F.col("p_size") + 8).cast("int")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), G.window_positions(length, window, F.floor(window / 2).cast("int")).alias("starts"))


@query("orient_classify", f"""WITH m AS (SELECT {LINE_ID_SQL} AS id, cos(radians(l_quantity * 7 + 0.5)) * (1 + l_discount) AS a, sin(radians(l_quantity * 7 + 0.5)) * (1 + l_discount) AS b,
  CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * -sin(radians(l_quantity * 7 + 0.5)) * (1 + l_discount) AS c, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END * cos(radians(l_quantity * 7 + 0.5)) * (1 + l_discount) AS d FROM lineitem),
o AS (SELECT unnest(['R0', 'R90', 'R180', 'R270', 'MX', 'MY', 'MXR90', 'MYR90']) AS code, unnest(range(8)) AS i, unnest([1, 0, -1, 0, 1, -1, 0, 0]) AS ma, unnest([0, 1, 0, -1, 0, 0, -1, 1]) AS mb, unnest([0, -1, 0, 1, 0, 0, -1, 1]) AS mc, unnest([1, 0, -1, 0, -1, 1, 0, 0]) AS md),
s AS (SELECT *, sqrt(abs(a * d - b * c)) AS s FROM m),
r AS (SELECT id, code, round((a / s - ma) ** 2 + (b / s - mb) ** 2 + (c / s - mc) ** 2 + (d / s - md) ** 2, 9) AS d2, i FROM s, o)
SELECT id, arg_min(code, d2 * 1000000000 + i * 0.01) AS code FROM r GROUP BY id""")
def orient_classify(spark, sf):
    angle, size = F.radians(F.col("l_quantity") * 7 + 0.5), 1 + F.col("l_discount")
    flip = F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(1)
    code = G.classify_orientation(F.cos(angle) * size, F.sin(angle) * size, flip * -F.sin(angle) * size, flip * F.cos(angle) * size)
    return table(spark, sf, "lineitem").select(line_id().alias("id"), code.alias("code"))


@query("homography_guards", f"""WITH h AS (SELECT {LINE_ID_SQL} AS id, 1 + l_discount AS h0, (l_quantity - 25) / 50.0 AS h1, l_suppkey::DOUBLE AS h2, (25 - l_quantity) / 80.0 AS h3, 1 - l_tax AS h4, l_partkey::DOUBLE AS h5,
  (l_linenumber - 3) / 250.0 AS h6, (l_discount - 0.05) / 5 AS h7 FROM lineitem),
q AS (SELECT *, h2 AS x0, h5 AS y0, (h0 * 40 + h2) / (h6 * 40 + 1) AS x1, (h3 * 40 + h5) / (h6 * 40 + 1) AS y1, (h0 * 40 + h1 * 30 + h2) / (h6 * 40 + h7 * 30 + 1) AS x2, (h3 * 40 + h4 * 30 + h5) / (h6 * 40 + h7 * 30 + 1) AS y2,
  (h1 * 30 + h2) / (h7 * 30 + 1) AS x3, (h4 * 30 + h5) / (h7 * 30 + 1) AS y3 FROM h),
t AS (SELECT *, (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) AS c0, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) AS c1, (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) AS c2, (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) AS c3,
  x0 * y1 - y0 * x1 + x1 * y2 - y1 * x2 + x2 * y3 - y2 * x3 + x3 * y0 - y3 * x0 AS area2 FROM q)
SELECT id, (abs(h6) <= 0.01 AND abs(h7) <= 0.01 AND h0 * h4 - h1 * h3 > 1e-6 AND sqrt(abs(h0 * h4 - h1 * h3)) BETWEEN 1e-3 AND 1e3 AND area2 > 0 AND (least(c0, c1, c2, c3) > 0 OR greatest(c0, c1, c2, c3) < 0)) AS sound FROM t""")
def homography_guards(spark, sf):
    c = F.col
    h = [1 + c("l_discount"), (c("l_quantity") - 25) / 50.0, c("l_suppkey").cast("double"), (25 - c("l_quantity")) / 80.0, 1 - c("l_tax"), c("l_partkey").cast("double"), (c("l_linenumber") - 3) / 250.0, (c("l_discount") - 0.05) / 5, F.lit(1.0)]
    quad = [G.project(h, x, y) for x, y in ((0, 0), (40, 0), (40, 30), (0, 30))]
    return table(spark, sf, "lineitem").select(line_id().alias("id"), T.sound_homography(h, quad).alias("sound"))


@query("calibration_measure", f"""WITH {BOXES_SQL} SELECT id, (x - 10) * 0.125::DOUBLE AS px, (y - 20) * 0.125::DOUBLE AS py, sqrt(w * w + h * h) * 0.125::DOUBLE AS diagonal, w * h * (0.125::DOUBLE * 0.125::DOUBLE) AS area FROM boxes""")
def calibration_measure(spark, sf):
    """Physical places and sizes under a calibration of 80 px for 10 mm."""
    own = T.Calibration.from_two_points((10, 20), (90, 50), 10.0, "mm")
    c = F.col
    px, py = own.point(c("x"), c("y"))
    return boxes(spark, sf).select("id", px.alias("px"), py.alias("py"), own.length(F.sqrt(c("w") * c("w") + c("h") * c("h"))).alias("diagonal"), own.area(c("w"), c("h")).alias("area"))


@query("parse_length", r"""WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' 12.5 mm' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '.5e1cm' WHEN 3 THEN 'mm' ELSE p_size || '  µm ' END AS s FROM part),
m AS (SELECT id, regexp_extract(trim(s), '^((\d+(\.\d+)?|\.\d+)(e[+-]?\d+)?)', 1, 'i') AS n, trim(s) AS whole FROM t),
v AS (SELECT id, n, trim(whole[length(n) + 1 :]) AS u FROM m)
SELECT id, CASE WHEN n <> '' THEN n::DOUBLE END AS value, CASE WHEN n = '' OR u = '' THEN 'px' ELSE u END AS unit FROM v""")
def parse_length(spark, sf):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, " 12.5 mm").when(F.col("p_partkey") % 5 == 1, size).when(F.col("p_partkey") % 5 == 2, ".5e1cm").when(F.col("p_partkey") % 5 == 3, "mm").otherwise(F.concat(size, F.lit("  µm ")))
    value, unit = G.parse_length(text, "px")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), value.alias("value"), unit.alias("unit"))


@query("normalize_weights", f"""WITH w AS (SELECT {LINE_ID_SQL} AS id, [l_quantity - 25, l_discount * 100, 0.0] AS w FROM lineitem), p AS (SELECT id, list_transform(w, lambda v: greatest(v, 0.0)::DOUBLE) AS w FROM w)
SELECT id, list_transform(w, lambda v: round(CASE WHEN list_sum(w) > 0 THEN v / list_sum(w) ELSE 1.0 / 3 END, 9)) AS weights FROM p""")
def normalize_weights(spark, sf):
    own = G.normalised_weights(F.array(F.col("l_quantity") - 25, F.col("l_discount") * 100))
    return table(spark, sf, "lineitem").select(line_id().alias("id"), F.transform(own, lambda v: F.round(v, 9)).alias("weights"))


@query("eval_grouping_sets", f"""WITH {SAVED_SQL} SELECT (w // 10)::BIGINT AS scale_bin, orientation, count(*)::BIGINT AS n, sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END)::BIGINT AS hits FROM saved GROUP BY GROUPING SETS ((scale_bin), (orientation), ())""")
def eval_grouping_sets(spark, sf):
    return T.recall_report(saved(spark, sf).withColumn("scale_bin", F.floor(F.col("w") / 10)), "score >= 0.7", "scale_bin", "orientation")


@query("bench_rollup", """WITH r AS (SELECT l_returnflag AS method, l_linestatus AS config, l_linenumber AS run, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL), m AS (SELECT method, config, min(s) AS best FROM r GROUP BY ALL)
SELECT method, config, round(sum(best), 2) AS best FROM m GROUP BY ROLLUP (method, config)""")
def bench_rollup(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("config"), "l_linenumber").agg(F.sum("l_extendedprice").alias("s"))
    return runs.groupBy("method", "config").agg(F.min("s").alias("best")).rollup("method", "config").agg(F.round(F.sum("best"), 2).alias("best"))


@query("recall_pairs", f"""WITH {_PAIRS_SQL}, m AS (SELECT ai AS t, bi AS d, iou, row_number() OVER (PARTITION BY ai ORDER BY round(iou, 9) DESC, bi) AS rt, row_number() OVER (PARTITION BY bi ORDER BY round(iou, 9) DESC, ai) AS rd FROM iou WHERE ai % 3 = 0 AND bi % 3 <> 0 AND iou > 0.3)
SELECT t, d, round(iou, 6) AS iou FROM m WHERE rt = 1 AND rd = 1""")
def recall_pairs(spark, sf):
    """Truth (every third box) and detections that are each other's best overlap."""
    every = boxes(spark, sf)
    return T.mutual_best(N.pairs(every, 0.3, apart=F.col("id") % 3 == 0)).select("t", "d", F.round("iou", 6).alias("iou"))


@query("debounce_latest", "WITH g AS (SELECT user_id AS session, event_id AS request, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT session, request FROM g WHERE nxt IS NULL OR nxt - ts >= INTERVAL 2 HOUR")
def debounce_latest(spark, sf):
    from tilequarry.streaming.requests import debounced

    return debounced(table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("request"), "ts"), "2 hours").select("session", "request")


@query("stale_drop", "SELECT user_id AS session, arg_max(event_id, event_id) AS request, count(*)::BIGINT - 1 AS stale FROM events GROUP BY user_id")
def stale_drop(spark, sf):
    from tilequarry.streaming.requests import latest

    return latest(table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("request"), "ts"))


@query("example_numbering", f"WITH {BOXES_SQL} SELECT id, orientation AS kind, row_number() OVER (PARTITION BY orientation, x // 2000, y // 2000 ORDER BY id)::INT AS number FROM boxes")
def example_numbering(spark, sf):
    by = Window.partitionBy("orientation", F.floor(F.col("x") / 2000), F.floor(F.col("y") / 2000)).orderBy("id")
    return boxes(spark, sf).select("id", F.col("orientation").alias("kind"), F.row_number().over(by).alias("number"))


_PAIRED = f"""{_PAIRS_SQL}, e AS (SELECT ai AS t, bi AS d, iou FROM iou WHERE iou > 0.3 AND ai % 3 = 0 AND bi % 3 <> 0)"""


@query("recall_greedy", f"""WITH RECURSIVE {_PAIRED}, tl AS (SELECT t, row_number() OVER (ORDER BY t) AS k, list({{'d': d, 'iou': iou}} ORDER BY iou DESC, d) AS wishes FROM e GROUP BY t),
r AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS t, []::BIGINT[] AS used, NULL::STRUCT(d BIGINT, iou DOUBLE) AS got
UNION ALL SELECT n.k, n.t, CASE WHEN n.got IS NULL THEN n.used ELSE list_append(n.used, n.got.d) END, n.got FROM (SELECT tl.k, tl.t, r.used, list_filter(tl.wishes, lambda w: NOT list_contains(r.used, w.d))[1] AS got FROM r JOIN tl ON tl.k = r.k + 1) n)
SELECT t, got.d AS d, round(got.iou, 6) AS iou FROM r WHERE got IS NOT NULL""")
def recall_greedy(spark, sf):
    """Truths (ids divisible by 3) in order, each with the best detection left to it."""
    return T.greedy_pairs(T.truths(N.pairs(boxes(spark, sf), 0.3, apart=F.col("id") % 3 == 0)), 0.3).withColumn("iou", F.round("iou", 6))


@query("orientations_allowed", f"WITH {BOXES_SQL} SELECT id, orientation FROM boxes WHERE orientation IN ('R0', 'MX', 'MY')")
def orientations_allowed(spark, sf):
    return T.allowed(boxes(spark, sf), False, True).select("id", "orientation")


#: The form that is the first one, then turned by 0 to 3 quarters.
_NET = """
('R0', 0, 'R0'), ('R0', 1, 'R90'), ('R0', 2, 'R180'), ('R0', 3, 'R270'),
('R90', 0, 'R90'), ('R90', 1, 'R180'), ('R90', 2, 'R270'), ('R90', 3, 'R0'),
('R180', 0, 'R180'), ('R180', 1, 'R270'), ('R180', 2, 'R0'), ('R180', 3, 'R90'),
('R270', 0, 'R270'), ('R270', 1, 'R0'), ('R270', 2, 'R90'), ('R270', 3, 'R180'),
('MX', 0, 'MX'), ('MX', 1, 'MXR90'), ('MX', 2, 'MY'), ('MX', 3, 'MYR90'),
('MY', 0, 'MY'), ('MY', 1, 'MYR90'), ('MY', 2, 'MX'), ('MY', 3, 'MXR90'),
('MXR90', 0, 'MXR90'), ('MXR90', 1, 'MY'), ('MXR90', 2, 'MYR90'), ('MXR90', 3, 'MX'),
('MYR90', 0, 'MYR90'), ('MYR90', 1, 'MX'), ('MYR90', 2, 'MXR90'), ('MYR90', 3, 'MY')
"""


@query("net_orientation", f"""WITH {BOXES_SQL}, a AS (SELECT id, orientation, (x % 1440) / 2.0::DOUBLE - 360 AS deg FROM boxes), m(o, k, net) AS (VALUES {_NET}),
q AS (SELECT *, round_even(deg / 90, 0)::BIGINT AS k FROM a) SELECT id, CASE WHEN abs(deg - 90 * q.k) <= 12 THEN net END AS net FROM q JOIN m ON m.o = q.orientation AND m.k = ((q.k % 4) + 4) % 4""")
def net_orientation(spark, sf):
    degrees = (F.col("x") % 1440) / F.lit(2.0) - 360
    return boxes(spark, sf).select("id", G.net_orientation(F.col("orientation"), degrees).alias("net"))


@query("level_of_detail", f"""WITH {BOXES_SQL}, v AS (SELECT id, 8.0::DOUBLE / h AS s, (w % 4)::INT AS cur FROM boxes), i AS (SELECT id, cur, greatest(0.0, log2(1 / s)) AS ideal FROM v)
SELECT id, CASE WHEN abs(ideal - cur) < 0.75 THEN cur ELSE least(round_even(ideal, 0), 3)::INT END AS level FROM i""")
def level_of_detail(spark, sf):
    current = (F.col("w") % 4).cast("int")
    return boxes(spark, sf).select("id", G.level_of_detail(F.lit(8.0) / F.col("h"), 4, current).alias("level"))


_SHAPE_SQL = "SELECT c_custkey AS polygon, c_custkey % 7 AS x0, c_custkey % 5 AS y0, 9 + c_custkey % 11 AS w, 8 + c_custkey % 9 AS h, 2 + c_custkey % 3 AS nw, 3 + c_custkey % 4 AS nh FROM customer"


@query(
    "polygon_mask",
    f"""WITH s AS ({_SHAPE_SQL}), g AS (SELECT s.*, unnest(range(y0, y0 + h)) AS y FROM s)
SELECT polygon, y, (CASE WHEN y >= y0 + h - nh THEN w - nw ELSE w END)::BIGINT AS n, x0 AS first_x, (CASE WHEN y >= y0 + h - nh THEN x0 + w - nw - 1 ELSE x0 + w - 1 END)::BIGINT AS last_x FROM g""",
)
def polygon_mask(spark, sf):
    """The pixels of each row of right-angled polygons, one a customer, drawn by six unsteady clicks with a corner cut out; the last one is closed along its column."""
    key = F.col("c_custkey")
    x0, y0, w, h, nw, nh = key % 7, key % 5, 9 + key % 11, 8 + key % 9, 2 + key % 3, 3 + key % 4
    click = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    clicks = F.array(click(x0 + 0.2, y0 + 0.1), click(x0 + w + 0.4, y0 + 1.3), click(x0 + w - 0.9, y0 + h - nh + 0.3), click(x0 + w - nw - 0.4, y0 + h - nh + 1.2), click(x0 + w - nw + 0.6, y0 + h - 0.3), click(x0 - 0.4, y0 + h - 0.6))
    # A key of 8 bytes becomes some 200 pixels, so keys are dealt before they are drawn, and the rows of a polygon meet where they are.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    drawn = table(spark, sf, "customer").select("c_custkey").repartition(parts, "c_custkey").select(key.alias("polygon"), G.right_angled(clicks).alias("corners"))
    box = drawn.select("*", F.explode(F.sequence(F.array_min(F.transform("corners", lambda c: c["y"])), F.array_max(F.transform("corners", lambda c: c["y"])))).alias("y"))
    grid = box.select("*", F.explode(F.sequence(F.array_min(F.transform("corners", lambda c: c["x"])), F.array_max(F.transform("corners", lambda c: c["x"])))).alias("x"))
    inside = grid.where(G.in_polygon(F.col("x"), F.col("y"), F.col("corners")))
    return inside.groupBy("polygon", "y").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))


@query("memory_sources", """WITH d AS (SELECT o_orderkey AS entry, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'image-' || o_custkey END AS source_image FROM orders), i AS (SELECT DISTINCT 'image-' || c_custkey AS image_id FROM customer WHERE c_custkey % 3 = 0)
SELECT entry, CASE WHEN coalesce(source_image, '') = '' THEN 'unnamed' WHEN source_image = 'image-7' THEN 'shown' WHEN image_id IS NOT NULL THEN 'openable' ELSE 'missing' END AS state FROM d LEFT JOIN i ON source_image = image_id""")
def memory_sources(spark, sf):
    c = F.col
    documents = table(spark, sf, "orders").select(c("o_orderkey").alias("entry"), F.when(c("o_orderkey") % 11 != 0, F.concat(F.lit("image-"), c("o_custkey").cast("string"))).alias("source_image"))
    images = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("image-"), c("c_custkey").cast("string")).alias("image_id"))
    return M.source_state(documents, images, "image-7").select("entry", "state")


_EXAMPLES_SQL = """ex AS (SELECT l_orderkey AS selection, CASE WHEN l_partkey % 3 = 0 THEN 'neg' ELSE 'pos' END AS kind, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 = 0 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, l_quantity < 20 AS gone FROM lineitem)"""


@query("example_removal", f"""WITH {_EXAMPLES_SQL}, l AS (SELECT * FROM ex WHERE NOT gone), a AS (SELECT DISTINCT selection FROM l WHERE kind = 'pos')
SELECT selection, kind, line, row_number() OVER (PARTITION BY selection, kind ORDER BY n)::INT AS n FROM l JOIN a USING (selection)""")
def example_removal(spark, sf):
    """Examples (an order's lines) less removed ones; the first positive left is the selection, none left ends it."""
    c = F.col
    negative = c("l_partkey") % 3 == 0
    number = F.row_number().over(Window.partitionBy("l_orderkey", negative).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    examples = table(spark, sf, "lineitem").select(c("l_orderkey").alias("selection"), F.when(negative, "neg").otherwise("pos").alias("kind"), c("l_linenumber").alias("line"), number.alias("n"), (c("l_quantity") < 20).alias("gone"))
    return X.without_examples(examples.drop("gone"), examples.where("gone")).select("selection", "kind", "line", "n")
