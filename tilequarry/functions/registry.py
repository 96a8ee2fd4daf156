"""Extension points: encoders of image windows, keypoint detectors, and SQL functions for a session."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tilequarry.functions import features, kernels

Encoder = Callable[[np.ndarray], np.ndarray]
#: A detector takes a gray plane of 0..1 to its points (n rows of x, y, size, angle) and their descriptors (n rows).
Detector = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
ENCODERS: dict[str, Encoder] = {}


def register_encoder(name: str, encode: Encoder) -> None:
    """encode: (n, h, w, 3) uint8 windows to (n, d) numbers. It is shipped to executors with the search that names it."""
    ENCODERS[name] = encode


DETECTORS: dict[str, Detector] = {"corners": features.detect}


def register_detector(name: str, detect: Detector) -> None:
    DETECTORS[name] = detect


def mean_colour(windows: np.ndarray) -> np.ndarray:
    return windows.reshape(len(windows), -1, windows.shape[-1]).mean(axis=1) - 128.0


def colour_histogram(windows: np.ndarray) -> np.ndarray:
    """Sixteen bins a channel, rooted."""
    bins = windows.reshape(len(windows), -1, windows.shape[-1]) // 16
    return np.stack([np.sqrt(np.concatenate([np.bincount(w[:, c], minlength=16) for c in range(w.shape[1])]) / len(w)) for w in bins])


def layout(windows: np.ndarray) -> np.ndarray:
    """Means of a grid of 4 x 4 cells, less the mean of all."""
    h, w = windows.shape[1] // 4 * 4, windows.shape[2] // 4 * 4
    cells = windows[:, :h, :w].astype(np.float64).reshape(len(windows), 4, h // 4, 4, w // 4, -1).mean(axis=(2, 4)).reshape(len(windows), -1)
    return cells - cells.mean(axis=1, keepdims=True)


for _name, _f in (("mean_colour", mean_colour), ("histogram", colour_histogram), ("layout", layout)):
    register_encoder(_name, _f)

#: SQL functions on boxes; Catalyst inlines them.
SQL_FUNCTIONS = {
    "box_intersection": ("ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by_ DOUBLE, bw DOUBLE, bh DOUBLE", "DOUBLE", "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_))"),
    "box_iou": (
        "ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by_ DOUBLE, bw DOUBLE, bh DOUBLE", "DOUBLE",
        "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) / greatest(aw * ah + bw * bh - greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)), 1e-9)",
    ),
    "zncc": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) - aggregate(a, 0D, (s, x) -> s + x) * aggregate(b, 0D, (s, x) -> s + x) / size(a)) / nullif(sqrt((aggregate(a, 0D, (s, x) -> s + x * x) - power(aggregate(a, 0D, (s, x) -> s + x), 2) / size(a)) * (aggregate(b, 0D, (s, x) -> s + x * x) - power(aggregate(b, 0D, (s, x) -> s + x), 2) / size(b))), 0D)",
    ),
    "gray": ("r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", "(0.299D * r + 0.587D * g + 0.114D * b) / 255"),
}



class MatchTemplate:
    """Local maxima at or above floor of a template's scores over one image or tile: x, y, score. Smaller images have none."""

    def eval(self, data, h: int, w: int, nc: int, template, th: int, tw: int, method: str, floor: float):
        if data is None or template is None or h < th or w < tw:
            return
        planes = [kernels.luminance(np.frombuffer(bytes(b), dtype=np.uint8).reshape((rows, columns, nc) if nc > 1 else (rows, columns))) for b, rows, columns in ((data, h, w), (template, th, tw))]
        scores = kernels.score_map(planes[:1], planes[1:], [1.0], method)
        for y, x in zip(*kernels.peaks(scores, th, tw, floor), strict=True):
            yield int(x), int(y), float(scores[y, x])


def register_sql(spark: SparkSession) -> None:
    """box_intersection, box_iou, zncc and gray as temporary functions of the session, and the table function match_template."""
    spark.udtf.register("match_template", udtf(MatchTemplate, returnType="x int, y int, score double"))
    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
