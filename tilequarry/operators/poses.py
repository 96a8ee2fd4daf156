"""Strict keypoint search on a tile store: proposals from votes, pixels under a batch of poses, homographies of what is left.

Votes are binned by image, form and centre; a bin's medians are a proposal. The crop around a proposal comes from the tile it
lies in, and all poses of a proposal are weighed in one gather: shifts of SHIFT pixels for copies along the axes, a grid of
turns and sizes for others. A proposal that no pose verifies, but that has votes, gets the matches around its centre (a range
join), a homography by samples of four, or a similarity, and the support of that as an aggregate over those matches. Whatever is found has a
zero-mean correlation of ACCEPT or more with the template, and that is its score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions import features as V
from tilequarry.functions import geometry as G
from tilequarry.functions import kernels as K
from tilequarry.operators import keypoints as P
from tilequarry.operators import nms as N
from tilequarry.operators import retrieval as R
from tilequarry.operators import tail
from tilequarry.operators import tilescan as S
from tilequarry.operators import tilestore as T

#: The correlation that accepts, those that a first look must reach along the axes and elsewhere, degrees from a
#: quarter turn and sizes that count as along the axes, pixels of shift, points of a cluster, its reach in the template's
#: longer side, least support of a homography.
ACCEPT, LOOK_AXIS, LOOK_POSE, AXIS_DEGREES, AXIS_SIZES, SHIFT = 0.70, 0.40, 0.30, 12.0, (0.7, 1.4), 2
CLUSTER, CLUSTER_REACH, SUPPORT = 140, 1.2, 8
#: Least support of a similarity.
SIMILAR = 6
#: The 49 poses around a proposal's: turns in degrees and factors of its size.
TURNS = (-6.0, -4.0, -2.0, 0.0, 2.0, 4.0, 6.0)
SIZES = (0.88, 0.92, 0.96, 1.0, 1.04, 1.08, 1.12)
#: Points of a side of the lattices of the first look and of the verdict.
COARSE, FINE = 24, 96
PLACED = "id long, x int, y int, w int, h int, score double, scale double, orientation string"


def proposals(found: DataFrame, short: int, *, least: int = 4, most: int | None = None) -> DataFrame:
    """id, image_id, orientation, cx, cy, scale, angle (degrees), votes of bins of a quarter of the template's shorter side.

    A bin's votes and those around it must be `least`, and no bin around it may have more. All such bins are proposals, as their number grows with the image; most: so many with most votes.
    """
    side = max(8, short // 4)
    placed = found.withColumns({"bx": F.floor(F.col("cx") / side), "by": F.floor(F.col("cy") / side)})
    keys = ["image_id", "orientation", "bx", "by"]
    turn = F.radians("angle")
    bins = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"), *[F.median(c).alias(c) for c in ("cx", "cy", "scale")], F.degrees(F.atan2(F.median(F.sin(turn)), F.median(F.cos(turn)))).alias("angle"))
    near = F.explode(F.array(*[F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = bins.select("image_id", "orientation", near.alias("n"), "votes").groupBy("image_id", "orientation", F.col("n.bx").alias("bx"), F.col("n.by").alias("by")).agg(F.max("votes").alias("top"), F.sum("votes").alias("support"))
    heads = bins.join(around, keys).where((F.col("votes") >= F.col("top")) & (F.col("support") >= least))
    best = heads if most is None else heads.orderBy(F.col("support").desc(), "image_id", "orientation", "cy", "cx").limit(most)
    return best.select(F.xxhash64(*keys).alias("id"), "image_id", "orientation", "cx", "cy", "scale", "angle", F.col("support").alias("votes"))


def pose_maps(cx, cy, sizes, turns, w: int, h: int) -> np.ndarray:
    """The similarities (n x 3 x 3) that put the centre of a w x h template at (cx, cy); turns in degrees. Arguments broadcast."""
    cx, cy, sizes, turns = np.broadcast_arrays(*np.atleast_1d(cx, cy, sizes, turns))
    c, s = sizes * np.cos(np.radians(turns)), sizes * np.sin(np.radians(turns))
    out = np.zeros((len(c), 3, 3))
    out[:, 0, 0], out[:, 0, 1], out[:, 0, 2] = c, -s, cx - (c * w - s * h) / 2
    out[:, 1, 0], out[:, 1, 1], out[:, 1, 2] = s, c, cy - (s * w + c * h) / 2
    out[:, 2, 2] = 1
    return out


def lattice(w: int, h: int, n: int) -> np.ndarray:
    """(x, y) of about n x n pixels of a w x h template, its edges included; all of a smaller one."""
    xs, ys = np.unique(np.linspace(0, w - 1, min(n, w)).astype(int)), np.unique(np.linspace(0, h - 1, min(n, h)).astype(int))
    return np.stack(np.meshgrid(xs, ys), axis=-1).reshape(-1, 2).astype(float)


class Template:
    """A template's planes by form, with their lattices."""

    def __init__(self, template: np.ndarray, mode: str, weights, forms):
        self.planes = {code: K.planes_of(K.orient(template, code), mode) for code in forms}
        self.mode = mode if template.ndim == 3 else "luminance"
        self.shares = K.shares(weights if self.mode != "luminance" else None, len(next(iter(self.planes.values()))))
        self.coarse = {code: lattice(p[0].shape[1], p[0].shape[0], COARSE) for code, p in self.planes.items()}
        self.fine = {code: lattice(p[0].shape[1], p[0].shape[0], FINE) for code, p in self.planes.items()}

    def scores(self, planes, code: str, maps: np.ndarray, fine: bool = False) -> np.ndarray:
        return V.warp_scores(planes, self.planes[code], self.shares, maps, (self.fine if fine else self.coarse)[code])


def along_axes(scale: float, angle: float) -> bool:
    return abs((angle + 45) % 90 - 45) <= AXIS_DEGREES and AXIS_SIZES[0] <= scale <= AXIS_SIZES[1]


def best_pose(t: Template, planes, code: str, cx: float, cy: float, scale: float, angle: float) -> tuple[float, np.ndarray] | None:
    """(score, map) of the best pose around a proposal, or None if none reaches ACCEPT."""
    h, w = t.planes[code][0].shape
    step = np.arange(-SHIFT, SHIFT + 1)
    dy, dx = (a.ravel() for a in np.meshgrid(step, step, indexing="ij"))
    axis = along_axes(scale, angle)
    tries = []
    if axis:  # whole pixels and quarter turns; size 1 if it is close to that
        quarter, size = round(angle / 90) * 90.0, 1.0 if abs(scale - 1) < 0.1 else scale
        wide, tall = (h, w) if round(angle / 90) % 2 else (w, h)
        x, y = round(cx - wide * size / 2) + wide * size / 2, round(cy - tall * size / 2) + tall * size / 2
        x, y = (x - 0.5, y - 0.5) if size == 1.0 else (x, y)  # a pixel's place is its centre
        tries.append((LOOK_AXIS, pose_maps(x + dx, y + dy, size, quarter, w - 1 if size == 1.0 else w, h - 1 if size == 1.0 else h)))
    turns, sizes = (a.ravel() for a in np.meshgrid(np.array(TURNS) + angle, np.array(SIZES) * scale))
    tries.append((LOOK_POSE, pose_maps(cx, cy, sizes, turns, w, h)))
    for look, maps in tries:
        scores = t.scores(planes, code, maps)
        if scores[len(scores) // 2] < look and scores.max() < ACCEPT:
            continue
        best = maps[int(scores.argmax())]
        # Shifts of the best pose, then finer turns and sizes of it.
        moved = np.repeat(best[None], len(dx), axis=0)
        moved[:, 0, 2] += dx
        moved[:, 1, 2] += dy
        best = moved[int(t.scores(planes, code, moved).argmax())]
        if look == LOOK_POSE:
            middle = V.transform(best, np.array([[w / 2, h / 2]]))[0]
            size, turn = np.hypot(best[0, 0], best[1, 0]), np.degrees(np.arctan2(best[1, 0], best[0, 0]))
            finer_turns, finer_sizes = (a.ravel() for a in np.meshgrid(turn + np.array(TURNS) / 4, size * (1 + (np.array(SIZES) - 1) / 4)))
            finer = pose_maps(*middle, finer_sizes, finer_turns, w, h)
            best = finer[int(t.scores(planes, code, finer).argmax())]
        score = float(t.scores(planes, code, best[None], fine=True)[0])
        if score >= ACCEPT:
            return min(1.0, score), best
    return None


def placed_row(ident: int, m: np.ndarray, code: str, w: int, h: int, score: float):
    """A PLACED row of a map between places of pixels, or None if it is no sound view of the template. Boxes go by the pixels' edges."""
    edge = np.array([[1, 0, 0.5], [0, 1, 0.5], [0, 0, 1]])
    quad = V.sound_quad(edge @ m @ np.linalg.inv(edge), w, h)
    if quad is None:
        return None
    low, high = np.floor(quad.min(axis=0) + 1e-6), np.ceil(quad.max(axis=0) - 1e-6)
    return (ident, int(low[0]), int(low[1]), int(high[0] - low[0]), int(high[1] - low[1]), score, float(np.sqrt(abs(V.shoelace(quad)) / (w * h))), P.named_orientation(m, code, w, h))


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame([r for r in rows if r is not None], columns=[c.split()[0] for c in PLACED.split(", ")])


def verify_poses(store: T.TileStore, proposed: DataFrame, template: np.ndarray, *, mode: str = "luminance", weights=None, forms=("R0", "MX")) -> DataFrame:
    """PLACED rows of the proposals that a pose verifies."""
    shared = store.spark.sparkContext.broadcast((template, weights))
    half = F.ceil(F.hypot(F.lit(template.shape[0]), F.lit(template.shape[1])) * F.col("scale") * max(SIZES) / 2) + SHIFT + 2
    boxes = proposed.select("image_id", "id", (F.floor("cx") - half).cast("int").alias("x"), (F.floor("cy") - half).cast("int").alias("y"), (2 * half).cast("int").alias("w"), (2 * half).cast("int").alias("h"))
    cut = T.crops(store, boxes).select("id", F.col("x").alias("left"), F.col("y").alias("top"), "w", "h", "nc", "data")
    rows = proposed.join(cut, "id").select("id", "orientation", "cx", "cy", "scale", "angle", "left", "top", "w", "h", "nc", "data")

    def check(frames):
        own, share = shared.value
        ready: dict[str, Template] = {}
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                colour = mode if p.nc >= 3 and own.ndim == 3 else "luminance"
                t = ready.setdefault(colour, Template(own, colour, share, forms))
                got = best_pose(t, K.planes_of(S.unpack(p.data, p.h, p.w, p.nc), colour), p.orientation, p.cx - p.left, p.cy - p.top, p.scale, p.angle)
                if got is not None:
                    h, w = t.planes[p.orientation][0].shape
                    out.append(placed_row(p.id, np.array([[1, 0, p.left], [0, 1, p.top], [0, 0, 1]]) @ got[1], p.orientation, w, h, got[0]))
            yield _frame(out)

    return rows.mapInPandas(check, PLACED)


def cluster_maps(proposed: DataFrame, found: DataFrame, longer: int, *, limit: float = 4.0) -> DataFrame:
    """id, view, matrix array<double>, support, points, error: maps of the matches around each proposal.

    view: a homography, by samples of four; else a similarity, by samples of two, for copies with few matches.
    The matches come by a range join, CLUSTER of a proposal at even steps of their likeness; support counts the template's
    keypoints that agree, points their different places, and error is their median distance: aggregates over those matches.
    """
    # Crossed coordinates: the join is on the image's points.
    points = found.select("image_id", "orientation", "sx", "sy", F.col("dx").alias("x"), F.col("dy").alias("y"), "distance", "q")
    near = R.near_points(proposed.select("id", "image_id", "orientation", "cx", "cy"), points, max(1, int(CLUSTER_REACH * longer)), by=("image_id", "orientation"))
    some = N.written(R.spread_evenly(near.select("id", "sx", "sy", "x", "y", "distance", "q"), ["id"], ["distance", "y", "x", "q"], CLUSTER), "clusters")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["distance", "y", "x", "q"])
        src, dst = frame[["sx", "sy"]].to_numpy(), frame[["x", "y"]].to_numpy()
        similar = V.consensus(src, dst, limit)
        maps = [(V.homography_consensus(src, dst, limit=limit), True), (None if similar is None else similar[0], False)]
        return pd.DataFrame([(frame["id"].iloc[0], m.ravel().tolist(), view) for m, view in maps if m is not None], columns=["id", "matrix", "view"])

    maps = some.groupBy("id").applyInPandas(fit, "id long, matrix array<double>, view boolean")  # CLUSTER rows a group
    h = [F.col("matrix")[i] for i in range(9)]
    depth = h[6] * F.col("sx") + h[7] * F.col("sy") + h[8]
    off = F.hypot((h[0] * F.col("sx") + h[1] * F.col("sy") + h[2]) / depth - F.col("x"), (h[3] * F.col("sx") + h[4] * F.col("sy") + h[5]) / depth - F.col("y"))
    agreeing = some.join(maps, "id").withColumn("off", off).where(F.col("off") <= limit)
    return agreeing.groupBy("id", "view").agg(F.first("matrix").alias("matrix"), F.count_distinct("q").alias("support"), F.count_distinct(F.round("sx"), F.round("sy")).alias("points"), F.median("off").alias("error"))


def _corners(w: Column, h: Column) -> list[tuple[Column, Column]]:
    m = [F.col("matrix")[i] for i in range(9)]
    at = lambda x, y: ((m[0] * x + m[1] * y + m[2]) / (m[6] * x + m[7] * y + m[8]), (m[3] * x + m[4] * y + m[5]) / (m[6] * x + m[7] * y + m[8]))
    zero = F.lit(0.0)
    return [at(zero, zero), at(w, zero), at(w, h), at(zero, h)]


def verify_clusters(store: T.TileStore, proposed: DataFrame, found: DataFrame, template: np.ndarray, *, mode: str = "luminance", weights=None, forms=("R0", "MX")) -> DataFrame:
    """PLACED rows of proposals whose matches agree on a sound homography under which the pixels correlate."""
    h, w = template.shape[:2]
    swapped = F.col("orientation").isin(*G.TURNED)
    wide, tall = F.when(swapped, h).otherwise(w).cast("double"), F.when(swapped, w).otherwise(h).cast("double")
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in _corners(wide, tall)]).alias("quad")
    maps = N.written(cluster_maps(proposed, found, max(h, w)).join(proposed.select("id", "image_id", "orientation"), "id").select("*", corners), "cluster-maps")
    quad = [(F.col("quad")[i]["x"], F.col("quad")[i]["y"]) for i in range(4)]
    guards = tail.sound_homography([F.col("matrix")[i] for i in range(9)], quad, scales=(V.LEAST_SCALE, V.MOST_SCALE))
    sound = maps.where((F.col("points") >= F.when(F.col("view"), SUPPORT).otherwise(SIMILAR)) & guards).withColumns({"of": F.col("id"), "id": F.xxhash64("id", "view")})
    low, high = [F.least(*[p[i] for p in quad]) for i in (0, 1)], [F.greatest(*[p[i] for p in quad]) for i in (0, 1)]
    pad = SHIFT + 2
    boxes = sound.select("image_id", "of", "id", "orientation", "matrix", (F.floor(low[0]) - pad).cast("int").alias("x"), (F.floor(low[1]) - pad).cast("int").alias("y"), (F.ceil(high[0] - low[0]) + 2 * pad).cast("int").alias("w"), (F.ceil(high[1] - low[1]) + 2 * pad).cast("int").alias("h"))
    boxes = N.written(boxes, "cluster-boxes")
    cut = T.crops(store, boxes.select("image_id", "id", "x", "y", "w", "h")).select("id", F.col("x").alias("left"), F.col("y").alias("top"), "w", "h", "nc", "data")
    shared = store.spark.sparkContext.broadcast((template, weights))
    step = np.arange(-SHIFT, SHIFT + 1)
    dy, dx = (a.ravel() for a in np.meshgrid(step, step, indexing="ij"))

    def check(frames):
        own, share = shared.value
        ready: dict[str, Template] = {}
        for frame in frames:
            out = []
            for p in frame.itertuples(index=False):
                colour = mode if p.nc >= 3 and own.ndim == 3 else "luminance"
                t = ready.setdefault(colour, Template(own, colour, share, forms))
                m = np.array(p.matrix).reshape(3, 3)
                shifts = np.zeros((len(dx), 3, 3))
                shifts[:, 0, 0] = shifts[:, 1, 1] = shifts[:, 2, 2] = 1
                shifts[:, 0, 2], shifts[:, 1, 2] = dx - p.left, dy - p.top
                scores = t.scores(K.planes_of(S.unpack(p.data, p.h, p.w, p.nc), colour), p.orientation, shifts @ m, fine=True)
                k = int(scores.argmax())
                if scores[k] >= ACCEPT:
                    high, wide = t.planes[p.orientation][0].shape
                    out.append(placed_row(p.of, np.array([[1, 0, dx[k]], [0, 1, dy[k]], [0, 0, 1]]) @ m, p.orientation, wide, high, float(min(1.0, scores[k]))))
            yield _frame(out)

    return boxes.select("of", "id", "orientation", "matrix").join(cut, "id").select("of", "orientation", "matrix", "left", "top", "w", "h", "nc", "data").mapInPandas(check, PLACED)


def search(store: T.TileStore, template: np.ndarray, *, detector: str = "corners", forms=("R0", "MX"), least: int = 4, floor: float = ACCEPT, orientations: list[str] | None = None, exclude_box=None, nms_iou: float = 0.3, max_results: int = 100, mode: str = "luminance", weights=None) -> DataFrame:
    """Ranked matches: image_id, x, y, w, h, score, scale, orientation, by (what verified it: pose or homography)."""
    found = N.written(P.votes(P.detect(store, store.side, detector), template, orientations=forms, detector=detector), "votes")
    proposed = N.written(proposals(found, min(template.shape[:2]), least=least), "proposals")
    posed = N.written(verify_poses(store, proposed, template, mode=mode, weights=weights, forms=forms), "posed")
    # What a pose verified needs no homography.
    left = proposed.join(posed.select("id"), "id", "left_anti").where(F.col("votes") >= SIMILAR)
    views = verify_clusters(store, N.written(left, "unposed"), found, template, mode=mode, weights=weights, forms=forms)
    both = posed.withColumn("by", F.lit("pose")).unionByName(views.withColumn("by", F.lit("homography"))).join(proposed.select("id", "image_id"), "id").where(F.col("score") >= floor)
    both = P.inside(store, both)
    if orientations is not None:
        both = both.where(F.col("orientation").isin(list(orientations)))
    if exclude_box:
        both = both.where(~G.excluded(G.box(), tuple(F.lit(v) for v in exclude_box), 0.3))
    same = Window.partitionBy("image_id", "x", "y", "w", "h", "orientation").orderBy(F.col("score").desc(), "id")
    both = N.written(both.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n").withColumn("id", F.xxhash64("image_id", "x", "y", "w", "h", "orientation")), "verified")
    return N.top(N.nms(both, nms_iou, by=("image_id",)), max_results).select("image_id", "x", "y", "w", "h", "score", "scale", "orientation", "by")
