"""Registered queries on rasters: planes, pyramids, sliding windows and dense template searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.functions import geometry as G
from tilequarry.operators import dense as D
from tilequarry.operators import nms as N
from tilequarry.plans.registry import query
from tilequarry.sources.derived import RASTER_SQL, SOURCE, raster

SX, SY, SW, SH = SOURCE
_YCBCR = "round_even(least(greatest({v}, 0.0), 255.0), 0)::INT"
_Y, _CB, _CR = (_YCBCR.format(v=v) for v in ("0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b", "-0.168736::DOUBLE * r - 0.331264::DOUBLE * g + 0.5::DOUBLE * b + 128.0", "0.5::DOUBLE * r - 0.418688::DOUBLE * g - 0.081312::DOUBLE * b + 128.0"))


@query("luminance", f"WITH {RASTER_SQL} SELECT x, y, (0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255.0::DOUBLE AS lum FROM raster")
def luminance(spark: SparkSession, sf: str) -> DataFrame:
    return raster(spark, sf).select("x", "y", D.luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"))


@query("ycbcr_planes", f"WITH {RASTER_SQL} SELECT x, y, {_Y} AS yy, {_CB} AS cb, {_CR} AS cr FROM raster")
def ycbcr_planes(spark, sf):
    y, cb, cr = D.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return raster(spark, sf).select("x", "y", y.alias("yy"), cb.alias("cb"), cr.alias("cr"))


@query("gray_display", f"WITH {RASTER_SQL} SELECT x, y, floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5)::INT AS gray FROM raster")
def gray_display(spark, sf):
    return raster(spark, sf).select("x", "y", F.floor(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b") + 0.5).cast("int").alias("gray"))


@query("block_mean_pyramid", f"""WITH {RASTER_SQL}, l1 AS (SELECT x // 2 AS x, y // 2 AS y, (sum(r)::BIGINT + 2) >> 2 AS v FROM raster GROUP BY ALL HAVING count(*) = 4),
l2 AS (SELECT x // 2 AS x, y // 2 AS y, (sum(v)::BIGINT + 2) >> 2 AS v FROM l1 GROUP BY ALL HAVING count(*) = 4)
SELECT 1 AS level, x, y, v FROM l1 UNION ALL SELECT 2 AS level, x, y, v FROM l2""")
def block_mean_pyramid(spark, sf):
    one = D.pooled(raster(spark, sf).select("x", "y", F.col("r").alias("v")))
    return one.withColumn("level", F.lit(1)).unionByName(D.pooled(one).withColumn("level", F.lit(2)))


@query("box_filter", f"WITH {RASTER_SQL}, win AS (SELECT a.x, a.y, sum(b.r)::BIGINT AS total FROM raster a JOIN raster b ON b.x BETWEEN a.x AND a.x + 8 AND b.y BETWEEN a.y AND a.y + 6 WHERE a.x <= 96 - 9 AND a.y <= 64 - 7 GROUP BY a.x, a.y) SELECT * FROM win")
def box_filter(spark, sf):
    return D.box_sums(raster(spark, sf).select("x", "y", F.col("r").alias("v")), 9, 7)


@query("local_max", f"WITH {RASTER_SQL} SELECT a.x, a.y, a.r AS score FROM raster a JOIN raster b ON b.x BETWEEN a.x - 4 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 WHERE a.r >= 100 GROUP BY a.x, a.y, a.r HAVING a.r >= max(b.r)")
def local_max(spark, sf):
    return D.local_maxima(raster(spark, sf).select("x", "y", F.col("r").alias("score")), 8, 7, 100)


def _channels(pixels: DataFrame, mode: str) -> DataFrame:
    """x, y, c, v of the channels of a mode."""
    if mode == "red":
        return pixels.select("x", "y", F.lit("r").alias("c"), F.col("r").cast("long").alias("v"))
    values = dict(zip("rgb", (F.col("r"), F.col("g"), F.col("b")), strict=True)) if mode == "rgb" else dict(zip(("yy", "cb", "cr"), D.ycbcr(F.col("r"), F.col("g"), F.col("b")), strict=True))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), v.cast("long").alias("v")) for c, v in values.items()]))
    return pixels.select("x", "y", rows.alias("p")).select("x", "y", "p.c", "p.v")


def _template(channels: DataFrame, variant: str = "R0") -> DataFrame:
    inside = F.col("x").between(SX, SX + SW - 1) & F.col("y").between(SY, SY + SH - 1)
    return channels.where(inside).select(F.lit(variant).alias("variant"), (F.col("x") - SX).alias("tx"), (F.col("y") - SY).alias("ty"), "c", F.col("v").alias("t"))


_MODES = {
    "red": "SELECT x, y, 'r' AS c, r::BIGINT AS v FROM raster",
    "rgb": "SELECT x, y, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b])::BIGINT AS v FROM raster",
    "ycbcr": f"SELECT x, y, unnest(['yy', 'cb', 'cr']) AS c, unnest([{_Y}, {_CB}, {_CR}])::BIGINT AS v FROM raster",
}
_PLAIN = f"SELECT 'R0' AS variant, x - {SX} AS tx, y - {SY} AS ty, c, v AS t FROM ch WHERE x BETWEEN {SX} AND {SX + SW - 1} AND y BETWEEN {SY} AND {SY + SH - 1}"
_SCORE = {
    "ncc": "CASE WHEN max(CASE WHEN spread < 1e-3 * n THEN 0 ELSE 1 END) = 0 THEN 0.0 ELSE sum(wt * crs) / (sum(wt * sqrt(greatest(spread, 0.0)) * sqrt(greatest(own, 0.0))) + 1e-6) END",
    "ccorr": "sum(wt * st / 65025.0::DOUBLE) / (sqrt(sum(wt * s2 / 65025.0::DOUBLE)) * sqrt(sum(wt * t2 / 65025.0::DOUBLE)) + 1e-6)",
    "ssd": "1.0 - sqrt(sum(wt * greatest(s2 - 2 * st + t2, 0) / 65025.0::DOUBLE) / sum(wt * n))",
}


def _scores_sql(mode: str, method: str, template: str = _PLAIN, weights: str = "1.0::DOUBLE") -> str:
    return f"""{RASTER_SQL}, ch AS ({_MODES[mode]}), tpl AS ({template}),
tn AS (SELECT variant, c, count(*)::BIGINT AS n, sum(t)::BIGINT AS t1, sum(t * t)::BIGINT AS t2 FROM tpl GROUP BY ALL),
sm AS (SELECT variant, ch.c, x - tx AS x, y - ty AS y, count(*)::BIGINT AS seen, sum(v)::BIGINT AS s1, sum(v * v)::BIGINT AS s2, sum(v * t)::BIGINT AS st FROM ch JOIN tpl ON ch.c = tpl.c GROUP BY ALL),
tm AS (SELECT sm.*, n::DOUBLE AS n, t1, t2, {weights} AS wt, (n::DOUBLE * st - s1 * t1) / n / 65025.0::DOUBLE AS crs, (n::DOUBLE * s2 - s1 * s1) / n / 65025.0::DOUBLE AS spread, (n::DOUBLE * t2 - t1 * t1) / n / 65025.0::DOUBLE AS own
       FROM sm JOIN tn ON sm.variant = tn.variant AND sm.c = tn.c WHERE seen = n),
scored AS (SELECT variant, x, y, least(greatest({_SCORE[method]}, 0.0), 1.0) AS score FROM tm GROUP BY variant, x, y)"""


def _rounded(scored: DataFrame) -> DataFrame:
    return scored.select("variant", "x", "y", F.round("score", 6).alias("score"))


_OUT = "SELECT variant, x, y, round(score, 6) AS score FROM scored"


def _dense(mode: str, method: str, weights: dict[str, float] | None = None):
    def run(spark, sf):
        channels = _channels(raster(spark, sf), mode)
        return _rounded(D.scores(channels, _template(channels), method, weights))

    return run


query("ssd_search", f"WITH {_scores_sql('red', 'ssd')} {_OUT}")(_dense("red", "ssd"))
query("ccorr_search", f"WITH {_scores_sql('red', 'ccorr')} {_OUT}")(_dense("red", "ccorr"))
query("ncc_scores", f"WITH {_scores_sql('red', 'ncc')} {_OUT}")(_dense("red", "ncc"))
query("ncc_rgb_weighted", f"WITH {_scores_sql('rgb', 'ncc', weights="CASE sm.c WHEN 'r' THEN 0.5 WHEN 'g' THEN 0.3 ELSE 0.2 END")} {_OUT}")(_dense("rgb", "ncc", {"r": 0.5, "g": 0.3, "b": 0.2}))
query("ncc_ycbcr_chroma", f"WITH {_scores_sql('ycbcr', 'ncc', weights="CASE sm.c WHEN 'yy' THEN 0.0 ELSE 0.5 END::DOUBLE")} {_OUT}")(_dense("ycbcr", "ncc", {"yy": 0.0, "cb": 0.5, "cr": 0.5}))


@query("ncc_masked", f"WITH {_scores_sql('red', 'ncc', _PLAIN + f' AND (x - {SX}) + (y - {SY}) < 14')} {_OUT}")
def ncc_masked(spark, sf):
    """Only the template's pixels above a diagonal count."""
    channels = _channels(raster(spark, sf), "red")
    return _rounded(D.scores(channels, _template(channels).where("tx + ty < 14")))


_TURN_X = f"CASE o WHEN 'R0' THEN tx WHEN 'R90' THEN ty WHEN 'R180' THEN {SW - 1} - tx WHEN 'R270' THEN {SH - 1} - ty WHEN 'MX' THEN tx WHEN 'MY' THEN {SW - 1} - tx WHEN 'MXR90' THEN {SH - 1} - ty ELSE ty END"
_TURN_Y = f"CASE o WHEN 'R0' THEN ty WHEN 'R90' THEN {SW - 1} - tx WHEN 'R180' THEN {SH - 1} - ty WHEN 'R270' THEN tx WHEN 'MX' THEN {SH - 1} - ty WHEN 'MY' THEN ty WHEN 'MXR90' THEN {SW - 1} - tx ELSE tx END"
_TURNED = f"SELECT o AS variant, {_TURN_X} AS tx, {_TURN_Y} AS ty, c, t FROM ({_PLAIN}), (SELECT unnest(['R0', 'R90', 'R180', 'R270', 'MX', 'MY', 'MXR90', 'MYR90']) AS o)"


def oriented_templates(template: DataFrame, w: int, h: int, rotation: bool = True, flipping: bool = True) -> DataFrame:
    codes = F.array(*[F.lit(o) for o in G.active_orientations(rotation, flipping)])
    turned = template.withColumn("variant", F.explode(codes))
    tx, ty = G.oriented(F.col("variant"), F.col("tx"), F.col("ty"), F.lit(w), F.lit(h))
    return turned.select("variant", tx.alias("tx"), ty.alias("ty"), "c", "t")


@query("ncc_orientations", f"WITH {_scores_sql('red', 'ncc', _TURNED)} {_OUT}")
def ncc_orientations(spark, sf):
    channels = _channels(raster(spark, sf), "red")
    return _rounded(D.scores(channels, oriented_templates(_template(channels), SW, SH)))


_SCALES = ((0.8, 10, 8), (1.0, 12, 10), (1.25, 15, 12))
_SCALED = " UNION ALL ".join(
    f"""SELECT '{s}' AS variant, g.tx, g.ty, p.c, (2 * sum(p.t * greatest(0, {2 * w} - abs(g.px - p.tx * {2 * w})) * greatest(0, {2 * h} - abs(g.py - p.ty * {2 * h})))::BIGINT + {4 * w * h}) // {8 * w * h} AS t
FROM (SELECT gx.i AS tx, gy.i AS ty, greatest(0, least((2 * gx.i + 1) * {SW} - {w}, {(SW - 1) * 2 * w})) AS px, greatest(0, least((2 * gy.i + 1) * {SH} - {h}, {(SH - 1) * 2 * h})) AS py
      FROM (SELECT unnest(range({w})) AS i) gx, (SELECT unnest(range({h})) AS i) gy) g, ({_PLAIN}) p GROUP BY g.tx, g.ty, p.c"""
    for s, w, h in _SCALES
)


@query("ncc_multiscale", f"WITH {_scores_sql('red', 'ncc', _SCALED)} {_OUT}")
def ncc_multiscale(spark, sf):
    """Bilinear templates of three scales; sides round half to even and are 8 at least."""
    channels = _channels(raster(spark, sf), "red")
    plain = _template(channels)
    parts = [D.resampled(plain, SW, SH, max(8, round(SW * s)), max(8, round(SH * s))).select(F.lit(str(s)).alias("variant"), "tx", "ty", "c", "t") for s, _, _ in _SCALES]
    return _rounded(D.scores(channels, parts[0].unionByName(parts[1]).unionByName(parts[2])))


_NCC_TAIL = f"""
cand AS (SELECT x, y, {SW} AS w, {SH} AS h, score FROM scored WHERE score >= 0.5),
src AS (SELECT {SX} AS sx, {SY} AS sy, {SW} AS sw, {SH} AS sh),
inter AS (SELECT *, (greatest(0, least(x + w, sx + sw) - greatest(x, sx)) * greatest(0, least(y + h, sy + sh) - greatest(y, sy)))::DOUBLE AS i FROM cand, src),
left_ AS (SELECT x, y, w, h, score FROM inter WHERE NOT (i / greatest(w * h + sw * sh - i, 1e-9) > 0.3 OR (x + w / 2.0 >= sx AND x + w / 2.0 < sx + sw AND y + h / 2.0 >= sy AND y + h / 2.0 < sy + sh))),
rk AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, y, x) AS r FROM left_),
ov AS (SELECT a.r AS hi, b.r AS lo FROM rk a JOIN rk b ON a.r < b.r WHERE
  greatest(0, least(a.x, b.x) + {SW} - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + {SH} - greatest(a.y, b.y)) > 0.3 * (2 * {SW * SH} - greatest(0, least(a.x, b.x) + {SW} - greatest(a.x, b.x)) * greatest(0, least(a.y, b.y) + {SH} - greatest(a.y, b.y)))),
so AS (SELECT lo, list(hi) AS his FROM ov GROUP BY lo),
nm AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS kept UNION ALL
  SELECT nm.r + 1, CASE WHEN len(list_intersect(nm.kept, coalesce((SELECT his FROM so WHERE lo = nm.r + 1), []))) = 0 THEN list_append(nm.kept, nm.r + 1) ELSE nm.kept END FROM nm WHERE nm.r < (SELECT count(*) FROM rk)),
kp AS (SELECT unnest(kept) AS r FROM nm WHERE nm.r = (SELECT count(*) FROM rk))
SELECT x, y, w, h, round(score, 6) AS score FROM rk JOIN kp USING (r) ORDER BY score DESC, y, x LIMIT 500"""


@query("ncc_search", f"WITH RECURSIVE {_scores_sql('red', 'ncc')}, {_NCC_TAIL}")
def ncc_search(spark, sf):
    """A box searched end to end: scores, floor, source exclusion, suppression, top 500."""
    channels = _channels(raster(spark, sf), "red")
    found = D.scores(channels, _template(channels)).where("score >= 0.5").select(F.monotonically_increasing_id().alias("id"), "x", "y", F.lit(SW).alias("w"), F.lit(SH).alias("h"), F.round("score", 9).alias("score"))
    found = N.written(found.where(~G.excluded(G.box(), tuple(F.lit(v) for v in SOURCE), 0.3)), "candidates")
    return N.top(N.nms(found, 0.3), 500).select("x", "y", "w", "h", F.round("score", 6).alias("score"))


@query("gray_bytes", f"WITH {RASTER_SQL} SELECT x, y, least(greatest(round_even(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE, 0), 0), 255)::INT AS gray FROM raster")
def gray_bytes(spark, sf):
    return raster(spark, sf).select("x", "y", G.gray_byte(*[F.col(c).cast("double") for c in "rgb"]).alias("gray"))
