"""Boxes that lie densely: work grows with their number, not with its square."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_boxes import SCHEMA, greedy, iou, make
from tilequarry.operators import nms as N
from tilequarry.operators import tail as T


@pytest.mark.parametrize("limit", [0.0, 0.4])
def test_suppression_by_batches_is_the_greedy_one(spark, monkeypatch, limit):
    """Boxes of all sizes in batches, with equal scores and scores that are missing."""
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "LOAD", 4)
    rng = random.Random(5)
    side = lambda: int(2 ** rng.uniform(0, 9))
    rows = [(i, rng.randrange(-50, 400), rng.randrange(-50, 400), side(), side(), round(rng.random(), 1)) for i in range(200)]
    rows += [(200 + i, x, y, w, h, s) for i, x, y, w, h, s in make(200, 6, 150)]
    assert {r["id"] for r in N.nms(spark.createDataFrame(rows, SCHEMA), limit).collect()} == greedy(rows, limit)
    odd = [(1000, 10, 10, 20, 20, None), (1001, 11, 10, 20, 20, None), (1002, None, 10, 20, 20, 0.5)]
    kept = {r["id"] for r in N.nms(spark.createDataFrame(rows + odd, SCHEMA), limit).collect()}
    left = [r for r in rows if iou(r, odd[0]) <= limit]
    assert kept == greedy(left, limit) | {1000, 1002}


def test_suppression_by_group_goes_by_batches(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "LOAD", 4)
    rows = make(400, 9, 200)
    frame = spark.createDataFrame([(*r, "ab"[r[0] % 2]) for r in rows], SCHEMA + ", kind string")
    want = greedy([r for r in rows if r[0] % 2], 0.3) | greedy([r for r in rows if r[0] % 2 == 0], 0.3)
    assert {r["id"] for r in N.nms(frame, 0.3, by=("kind",)).collect()} == want


def test_suppression_does_not_pair_all_of_a_dense_place(spark, monkeypatch):
    monkeypatch.setattr(N, "FEW", 0)
    rng = random.Random(3)
    rows = [(i, rng.randrange(60), rng.randrange(60), rng.randrange(30, 40), rng.randrange(30, 40), rng.random()) for i in range(3000)]
    paired, whole = [], N.suppressed
    monkeypatch.setattr(N, "suppressed", lambda edges, *a: paired.append(edges.count()) or whole(edges, *a))
    assert {r["id"] for r in N.nms(spark.createDataFrame(rows, SCHEMA), 0.3).collect()} == greedy(rows, 0.3)
    assert sum(paired) < 10 * len(rows)  # all pairs: 1.6 million


@pytest.mark.parametrize("sides", [(8, 40), (20, 22), (1, 300)])
def test_phantoms_by_batches(spark, monkeypatch, sides):
    """Of all sizes, and of few different areas; a box twice in the table stays twice. No batch compares all boxes."""
    monkeypatch.setattr(N, "FEW", 0)
    monkeypatch.setattr(N, "LOAD", 8)
    rng = random.Random(sides[0])
    rows = [(i, rng.randrange(150), rng.randrange(150), rng.choice(range(*sides, 5)) if sides[0] < 20 else sides[0], rng.randrange(*sides), 0.5) for i in range(400)]
    rows += [(400, 5000, 0, 9, 9, 0.5)] * 2 + [(401, None, 0, 9, 9, 0.5)]
    real = [r for r in rows if r[1] is not None]
    holds = lambda r, o: r[1] <= o[1] + o[3] / 2 < r[1] + r[3] and r[2] <= o[2] + o[4] / 2 < r[2] + r[4] and r[3] * r[4] > 1.5 * o[3] * o[4]
    want = sorted([r[0] for r in real if sum(r[0] != o[0] and holds(r, o) for o in real) < 2] + [401])
    looked, whole = [], T._held
    monkeypatch.setattr(T, "_held", lambda boxes, others, sizes: looked.append(boxes.count() * others.count()) or whole(boxes, others, sizes))
    assert sorted(r["id"] for r in T.drop_phantoms(spark.createDataFrame(rows, SCHEMA)).collect()) == want
    assert len(looked) > 1 and sum(looked) < len(rows) ** 2


def test_pairs_compare_only_boxes_within_reach(spark, monkeypatch):
    """Flat boxes meet those that start within 1 - limit of their width and height, not all within their longest side; classes may be flat in different ways."""
    rng = random.Random(11)
    flat = lambda i, w, h: (i, rng.randrange(400), rng.randrange(400), w + rng.randrange(4), h + rng.randrange(3), rng.random())
    rows = [flat(i, 55, 12) for i in range(500)] + [flat(500 + i, 3, 70) for i in range(100)] + [flat(600 + i, 6, 60) for i in range(100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    laid, inner = [], N.grid_cells
    monkeypatch.setattr(N, "grid_cells", lambda *a, **k: laid.append(inner(*a, **k)) or laid[-1])
    for limit in (0.0, 0.3, 0.7):
        got = [(r.hi, r.lo) for r in N.pairs(frame, limit).collect()]
        assert len(got) == len(set(got)) and {frozenset(p) for p in got} == {frozenset((a[0], b[0])) for i, a in enumerate(rows) for b in rows[:i] if iou(a, b) > limit}
    sizes = N.Sizes.of(frame)
    at = lambda cells: frame.withColumn("class", sizes.size_class()).select(F.explode(cells).alias("c")).select("c.cx", "c.cy")
    met = [at(probes).join(at(stored), ["cx", "cy"]).count() for probes, stored in (*laid, inner(sizes, N.class_span(0.3), half=True))]
    assert met[1] * 2 < met[3] and met[2] < met[1] < met[0]
