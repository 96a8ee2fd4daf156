"""Search by window embeddings: a grid of windows is encoded and compared with the template's orientations, then refined."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.functions import geometry as G
from tilequarry.functions import kernels as K
from tilequarry.functions.registry import ENCODERS
from tilequarry.operators import nms as N
from tilequarry.operators import tilescan as S
from tilequarry.operators import tilestore as T

#: What masked pixels of a template become.
MASKED = (124, 116, 104)
FOUND = "image_id string, x int, y int, w int, h int, score double, scale double, orientation string"


def starts(length: int, window: int, stride: int) -> list[int]:
    """Starts at each stride and one that ends at the end; none if the window is longer."""
    return [] if window > length else sorted({*range(0, length - window + 1, max(1, stride)), length - window})


def queries(template: np.ndarray, encoder: str, orientations, mask: np.ndarray | None = None) -> list[tuple[str, np.ndarray]]:
    own = template.copy()
    if mask is not None:
        own[~mask] = MASKED
    turned = [(o, np.stack([K.orient(own[..., c], o) for c in range(3)], axis=-1)) for o in orientations]
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    return [(o, unit(ENCODERS[encoder](t[None])[0].astype(float))) for o, t in turned]


def _score(windows: np.ndarray, encode, shared) -> list[tuple[float, str]]:
    v = encode(windows).astype(float)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    cos = v @ np.stack([q for _, q in shared]).T
    best = cos.argmax(axis=1)
    return [(float(c), shared[k][0]) for c, k in zip(cos[np.arange(len(v)), best], best, strict=True)]


def scan(tiles: DataFrame | T.TileStore, template: np.ndarray, size: tuple[int, int], *, side: int, encoder: str, scales=(1.0,), orientations=("R0",), floor: float = 0.5, mask: np.ndarray | None = None, steps: int = 2) -> DataFrame:
    """FOUND rows of grid windows at or above the floor. size: the image's height and width. steps: windows start that many times a window's side."""
    if not all(np.isfinite(s) and s > 0 for s in scales):
        raise ValueError("scales must be finite and positive")
    th, tw = template.shape[:2]
    shapes = sorted({(max(8, round(th * s)), max(8, round(tw * s))) for s in scales} | {(max(8, round(tw * s)), max(8, round(th * s))) for s in scales if any(o in G.TURNED for o in orientations)})
    grids = {(h, w): (starts(size[0], h, h // steps), starts(size[1], w, w // steps)) for h, w in shapes}
    shared, encode = queries(template, encoder, orientations, mask), ENCODERS[encoder]

    def run(t, pixels, top, left):
        out = []
        for (h, w), (ys, xs) in grids.items():
            places = [(y, x) for y in ys if t.y0 <= y < t.y0 + t.h for x in xs if t.x0 <= x < t.x0 + t.w]
            for at in range(0, len(places), 256):
                part = places[at : at + 256]
                scored = _score(np.stack([pixels[y - top : y - top + h, x - left : x - left + w] for y, x in part]), encode, shared)
                out += [(t.image_id, x, y, w, h, s, float(np.sqrt(w * h / (tw * th))), o) for (y, x), (s, o) in zip(part, scored, strict=True) if s >= floor]
        return pd.DataFrame(out, columns=["image_id", "x", "y", "w", "h", "score", "scale", "orientation"])

    return T.each(tiles, run, FOUND, reach=max(max(s) for s in shapes), side=side)


#: The scan's floor lies this far below what the template's own windows reach that lie half a step of the grid off, as a copy's surroundings count too.
SLACK = 0.05


def scan_floor(template: np.ndarray, shared, encoder: str, orientations, steps: int) -> float:
    """What the grid's best window of a copy reaches at least, by the template's own windows half a step off, in a margin of its mean."""
    worst = 1.0
    for code, (_, q) in zip(orientations, shared, strict=True):
        own = np.stack([K.orient(template[..., c], code) for c in range(3)], axis=-1)
        h, w = own.shape[:2]
        dy, dx = -(-(h // steps) // 2), -(-(w // steps) // 2)
        wide = np.broadcast_to(np.rint(own.reshape(-1, 3).mean(axis=0)).astype(own.dtype), (h + 2 * dy, w + 2 * dx, 3)).copy()
        wide[dy : dy + h, dx : dx + w] = own
        near = _score(np.stack([wide[y : y + h, x : x + w] for y in (0, 2 * dy) for x in (0, 2 * dx)]), ENCODERS[encoder], [(code, q)])
        worst = min(worst, max(s for s, _ in near))
    return worst - SLACK


def search(tiles: DataFrame | T.TileStore, template: np.ndarray, size: tuple[int, int], *, side: int, encoder: str = "layout", scales=(1.0,), orientations=("R0",), floor: float = 0.5, exclude_box=None, exclude_iou: float = 0.3, nms_iou: float = 0.3, max_results: int = 500, mask: np.ndarray | None = None, steps: int = 2, margin: float = 0.0, verify: float | None = None) -> DataFrame:
    """Ranked matches: grid scan (down to floor - margin, or to what a copy between the grid's windows reaches), exclusion, windows moved by half a step of the grid,
    the best of these by ever smaller steps to a pixel, suppression, top.

    Suppression waits until windows are moved: a window of the grid says too little about the place near it. verify: the least zero-mean
    correlation of a match's pixels with the oriented template, as embeddings of a few means don't tell a copy from a like view of it.
    """
    shared, encode = queries(template, encoder, orientations, mask), ENCODERS[encoder]
    least = max(0.0, min(floor - margin, scan_floor(template, shared, encoder, orientations, steps)))
    found = scan(tiles, template, size, side=side, encoder=encoder, scales=scales, orientations=orientations, floor=least, mask=mask, steps=steps)
    ident = F.xxhash64("image_id", "x", "y", "w", "h")
    keep = lambda df: df.where(~G.excluded_semantic(G.box(), tuple(F.lit(v) for v in exclude_box), exclude_iou)) if exclude_box else df
    coarse = N.written(keep(found).withColumn("id", ident).dropDuplicates(["id"]), "coarse")  # all of them: their number grows with the image
    height, width = size
    # A window is cut with all places around it that it may be moved to.
    reach = lambda side: 2 * F.floor(F.col(side) / (2 * steps)) + 2
    left, top = F.greatest(F.lit(0), F.col("x") - reach("w")), F.greatest(F.lit(0), F.col("y") - reach("h"))
    around = coarse.select("image_id", "id", left.cast("int").alias("x"), top.cast("int").alias("y"), (F.least(F.lit(width), F.col("x") + F.col("w") + reach("w")) - left).cast("int").alias("w"), (F.least(F.lit(height), F.col("y") + F.col("h") + reach("h")) - top).cast("int").alias("h"))
    longest = max(round(max(template.shape[:2]) * max(scales)), 8)
    cut = T.cut(tiles, around, side, longest + 2 * (2 * (longest // (2 * steps)) + 2)).select("id", F.col("x").alias("left"), F.col("y").alias("top"), F.col("h").alias("oh"), F.col("w").alias("ow"), "nc", "data")

    def run(frames):
        for frame in frames:
            rows = []
            for t in frame.itertuples(index=False):
                pixels = S.unpack(t.data, t.oh, t.ow, t.nc)
                seen: dict[tuple[int, int], tuple[float, str]] = {}
                window = lambda y, x: pixels[y - t.top : y - t.top + t.h, x - t.left : x - t.left + t.w]  # noqa: B023, E731

                def look(y, x, dy, dx):
                    """The best of the nine windows around (y, x) at these steps; the place itself of equal ones."""
                    at = dict.fromkeys([(y, x), *((min(max(y + i * dy, 0), height - t.h), min(max(x + j * dx, 0), width - t.w)) for i in (-1, 0, 1) for j in (-1, 0, 1))])  # noqa: B023
                    at = [p for p in at if abs(p[0] - t.y) <= 2 * (t.h // (2 * steps)) + 2 and abs(p[1] - t.x) <= 2 * (t.w // (2 * steps)) + 2]  # noqa: B023  what was cut
                    new = [p for p in at if p not in seen]  # noqa: B023
                    if new:
                        seen.update(zip(new, _score(np.stack([window(*p) for p in new]), encode, shared), strict=True))  # noqa: B023
                    return max(at, key=lambda p: seen[p][0])  # noqa: B023

                dy, dx = t.h // (2 * steps), t.w // (2 * steps)
                best = look(t.y, t.x, dy, dx)
                if seen[best][0] >= least:
                    while dy > 1 or dx > 1:
                        dy, dx = max(1, dy // 2), max(1, dx // 2)
                        best = look(*best, dy, dx)
                    while (after := look(*best, 1, 1)) != best:
                        best = after
                for (y, x), (score, code) in seen.items():
                    if score >= floor and (verify is None or likeness(window(y, x), template, code, mask) >= verify):
                        rows.append((t.image_id, x, y, t.w, t.h, score, t.scale, code))
            yield pd.DataFrame(rows, columns=["image_id", "x", "y", "w", "h", "score", "scale", "orientation"])

    scored = coarse.select("image_id", "id", "x", "y", "w", "h", "scale").join(cut, "id").mapInPandas(run, FOUND)
    fine = keep(scored.withColumn("id", ident).dropDuplicates(["id"])).withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    return N.top(N.nms(N.written(fine, "fine"), nms_iou, by=("image_id",)), max_results).select("image_id", "x", "y", "w", "h", "score", "scale", "orientation")


def likeness(window: np.ndarray, template: np.ndarray, code: str, mask: np.ndarray | None = None) -> float:
    """Zero-mean correlation of a window with the oriented template at the window's size, where the mask is set."""
    own = K.luminance(np.stack([K.orient(template[..., c], code) for c in range(3)], axis=-1))
    chosen = None if mask is None else K.orient(mask.astype(float), code)
    if own.shape != window.shape[:2]:
        own = K.resample(own, *window.shape[:2])
        chosen = None if chosen is None else K.resample(chosen, *window.shape[:2])
    seen = K.luminance(window)
    return float(K.zncc(seen, own) if chosen is None else K.zncc(seen[chosen >= 0.5], own[chosen >= 0.5]))
