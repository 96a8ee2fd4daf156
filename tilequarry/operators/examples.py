"""Searches by several examples: aligned mean of the positives, then a check of each candidate against every example."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions import geometry as G
from tilequarry.functions import kernels as K
from tilequarry.functions.registry import ENCODERS
from tilequarry.operators import nms as N
from tilequarry.operators import tail as T
from tilequarry.operators import tilescan as S
from tilequarry.operators import tilestore as TS

Box = tuple[int, int, int, int]


def crops(tiles: DataFrame | TS.TileStore, boxes: list[Box], side: int, pad: int = 0) -> list[np.ndarray]:
    """The pixels of a few boxes, with a margin."""
    rows = [("", i, x - pad, y - pad, w + 2 * pad, h + 2 * pad) for i, (x, y, w, h) in enumerate(boxes)]
    keys = TS.keys_of(tiles)
    ids = keys.select("image_id").distinct().limit(2).collect()
    if len(ids) != 1:
        raise ValueError("examples are boxes of one image")
    ids = ids[0]
    frame = keys.sparkSession.createDataFrame([(ids[0], *r[1:]) for r in rows], "image_id string, id long, x int, y int, w int, h int")
    reach = max(max(r[4:]) for r in rows)
    found = {r["id"]: S.unpack(r["data"], r["h"], r["w"], r["nc"]) for r in TS.cut(tiles, frame, side, reach).collect()}  # the examples
    return [found[i] for i in range(len(boxes))]


def snap(reference: np.ndarray, wide: np.ndarray, pad: int) -> tuple[int, int]:
    """The shift up to `pad` at which the reference fits best; the first in row order of equal ones."""
    h, w = reference.shape
    scores = [(K.zncc(wide[dy : dy + h, dx : dx + w], reference), dy - pad, dx - pad) for dy in range(2 * pad + 1) for dx in range(2 * pad + 1)]
    best = max(scores, key=lambda s: s[0])
    return best[1], best[2]


def prepare(tiles: DataFrame | TS.TileStore, positives: list[Box], negatives: list[Box], side: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Mean of the positives (each moved to fit the first one) and the patches of both kinds in its size."""
    _, _, w, h = positives[0]
    pad = max(2, min(w, h) // 4)
    centred = [(x + (bw - w) // 2, y + (bh - h) // 2, w, h) for x, y, bw, bh in [*positives, *negatives]]
    wide = [K.luminance(c) for c in crops(tiles, centred, side, pad)]
    first = wide[0][pad : pad + h, pad : pad + w]
    aligned = []
    for patch in wide[: len(positives)]:
        dy, dx = snap(first, patch, pad)
        aligned.append(patch[pad + dy : pad + dy + h, pad + dx : pad + dx + w])
    mean = np.clip(np.rint(np.mean(aligned, axis=0) * 255), 0, 255).astype(np.uint8)
    return mean, aligned, [p[pad : pad + h, pad : pad + w] for p in wide[len(positives) :]]


def without_examples(examples: DataFrame, removed: DataFrame) -> DataFrame:
    """examples (selection, kind, n, ...) less the removed ones, numbered anew by kind.

    The first positive that is left becomes the selection's own box (number 1); a selection without positives goes as a whole.
    """
    left = examples.join(removed.select("selection", "kind", "n"), ["selection", "kind", "n"], "left_anti")
    alive = left.where(F.col("kind") == "pos").select("selection").distinct()
    renumbered = F.row_number().over(Window.partitionBy("selection", "kind").orderBy("n"))
    return left.join(alive, "selection", "left_semi").withColumn("n", renumbered)


def match_examples(tiles: DataFrame | TS.TileStore, positives: list[Box], negatives: list[Box], *, side: int, floor: float = 0.5, nms_iou: float = 0.3, exclude_iou: float = 0.3, max_results: int = 500) -> DataFrame:
    """Ranked matches of a search by examples; max_results 0: all of them.

    A candidate stays if it overlaps no negative and some positive fits it at least as well as every negative. Positives
    that no result covers are results with score 1.
    """
    spark = TS.keys_of(tiles).sparkSession
    mean, good, bad = prepare(tiles, positives, negatives, side)
    found = TS.hits(tiles, S.prepare(mean), side=side, floor=floor).withColumn("id", F.xxhash64("image_id", "x", "y", "w", "h")).dropDuplicates(["id"])
    kept = N.nms(N.written(found, "candidates"), nms_iou, by=("image_id",))
    as_boxes = lambda boxes: spark.createDataFrame([(-i - 1, *b, 1.0) for i, b in enumerate(boxes)], "id long, x int, y int, w int, h int, score double")
    if negatives:
        kept = T.without_overlap(N.written(kept, "suppressed"), as_boxes(negatives), exclude_iou)
    shared = spark.sparkContext.broadcast((good, bad))  # the examples' patches

    def verify(frames):
        positive, negative = shared.value
        for frame in frames:
            out = []
            for t in frame.itertuples(index=False):
                patch = K.luminance(S.unpack(t.data, t.h, t.w, t.nc))
                best = max(K.zncc(patch, p) for p in positive)
                if not negative or best >= max(K.zncc(patch, p) for p in negative):
                    out.append((t.id,))
            yield pd.DataFrame(out, columns=["id"])

    h, w = mean.shape
    kept = N.written(kept, "verified")
    passed = TS.cut(tiles, kept.select("image_id", "id", "x", "y", "w", "h"), side, max(h, w)).mapInPandas(verify, "id long")
    found = kept.join(passed, "id", "left_semi").select("id", "x", "y", "w", "h", "score")
    found = T.append_uncovered(N.written(found, "found"), as_boxes(positives), exclude_iou)
    return N.top(found, max_results) if max_results else found.orderBy(*N.rank_key())


def match_retrieval(tiles: DataFrame | TS.TileStore, find: Callable[[np.ndarray], DataFrame], positives: list[Box], negatives: list[Box], *, side: int, encoder: str | None = None, exclude_iou: float = 0.3, nms_iou: float = 0.3, max_results: int = 500) -> DataFrame:
    """Ranked matches of a search (find: a template to its uncapped matches) made for each positive apart; max_results 0: all.

    The results are pooled and suppressed, and those near a negative go. Then, with an encoder, a result goes that resembles a
    negative more than every positive; without one, the negatives are searched for too, and a result goes that overlaps
    one of theirs with as high a score. Positives that no result covers are results with score 1.
    """
    spark = TS.keys_of(tiles).sparkSession
    patches = crops(tiles, [*positives, *negatives], side)
    good, bad = patches[: len(positives)], patches[len(positives) :]

    def pooled(templates: list[np.ndarray], name: str) -> DataFrame:
        every = None
        for t in templates:
            one = find(t).select("image_id", "x", "y", "w", "h", "score")
            every = one if every is None else every.unionByName(one)
        best = every.groupBy("image_id", "x", "y", "w", "h").agg(F.max("score").alias("score"))
        return N.written(best.withColumn("id", F.xxhash64("image_id", "x", "y", "w", "h")), name)

    kept = N.nms(pooled(good, "pooled"), nms_iou, by=("image_id",))
    for box in negatives:
        kept = kept.where(~G.excluded(G.box(), tuple(F.lit(v) for v in box), exclude_iou))
    kept = N.written(kept, "pooled-kept")
    if negatives and encoder is None:
        kept = T.without_overlap(kept, pooled(bad, "negative-hits"), nms_iou, by_score=True)
    elif negatives:
        encode = ENCODERS[encoder]
        unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast(tuple(unit(np.concatenate([encode(p[None]) for p in kind]).astype(float)) for kind in (good, bad)))  # the examples'

        def compare(frames):
            for frame in frames:
                ids = []
                for t in frame.itertuples(index=False):
                    v = unit(encode(S.unpack(t.data, t.h, t.w, t.nc)[None]).astype(float))[0]
                    if (shared.value[0] @ v).max() >= (shared.value[1] @ v).max():
                        ids.append(t.id)
                yield pd.DataFrame({"id": np.array(ids, dtype=np.int64)})

        reach = kept.agg(F.greatest(F.max("w"), F.max("h"))).first()[0] or 8
        passed = TS.cut(tiles, kept.select("image_id", "id", "x", "y", "w", "h"), side, int(reach)).mapInPandas(compare, "id long")
        kept = kept.join(passed, "id", "left_semi")
    own = spark.createDataFrame([(-i - 1, *b, 1.0) for i, b in enumerate(positives)], "id long, x int, y int, w int, h int, score double")
    found = T.append_uncovered(N.written(kept.select("id", "x", "y", "w", "h", "score"), "found"), own, nms_iou)
    return N.top(found, max_results) if max_results else found.orderBy(*N.rank_key())
