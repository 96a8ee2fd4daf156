"""Box relations against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.functions import geometry as G
from tilequarry.operators import nms as N
from tilequarry.operators import tail as T
from tilequarry.streaming.requests import debounced, latest

SCHEMA = "id long, x int, y int, w int, h int, score double"


def make(n, seed, span=300):
    rng = random.Random(seed)
    return [(i, rng.randrange(span), rng.randrange(span), rng.randrange(8, 40), rng.randrange(8, 40), round(rng.random(), 2)) for i in range(n)]


def iou(a, b):
    w = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    i = max(w, 0) * max(h, 0)
    return i / max(a[3] * a[4] + b[3] * b[4] - i, 1e-9)


def greedy(rows, limit):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[2], r[1], r[3], r[4], r[0])):
        if all(iou(r, k) <= limit for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


@pytest.mark.parametrize(("seed", "limit"), [(0, 0.3), (1, 0.0), (2, 0.6), (3, -1.0)])
def test_suppression_is_the_greedy_one(spark, seed, limit):
    rows = make(150, seed)
    if limit < 0:  # every box suppresses those after it
        rows = make(12, seed, 20)
    assert {r["id"] for r in N.nms(spark.createDataFrame(rows, SCHEMA), limit).collect()} == greedy(rows, limit)


def test_suppression_chain(spark):
    rows = [(i, 4 * i, 0, 10, 10, 1 - i / 100) for i in range(12)]
    assert {r["id"] for r in N.nms(spark.createDataFrame(rows, SCHEMA), 0.3).collect()} == greedy(rows, 0.3)


def plain_pairs(rows, limit):
    order = lambda r: (-r[5], r[2], r[1], r[3], r[4], r[0])
    return {(min(a, b, key=order)[0], max(a, b, key=order)[0]) for i, a in enumerate(rows) for b in rows[:i] if iou(a, b) > limit}


@pytest.mark.parametrize("limit", [0.0, 0.05, 0.3, 0.7])
def test_pairs_of_all_sizes(spark, limit):
    """Boxes from 1 to 20,000 pixels a side, some of them thin: every pair once, the better one first."""
    rng = random.Random(17)
    side = lambda: int(2 ** rng.uniform(0, 14.3))
    rows = [(i, rng.randrange(-50, 900), rng.randrange(-50, 900), side(), side(), round(rng.random(), 1)) for i in range(260)]
    rows += [(1000 + i, x + rng.randrange(3), y, w + rng.randrange(3), h, s) for i, (_, x, y, w, h, s) in enumerate(rows[:60])]
    got = [(r.hi, r.lo) for r in N.pairs(spark.createDataFrame(rows, SCHEMA), limit).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_pairs(rows, limit)


def test_one_large_box_shares_no_cells_with_small_ones(spark):
    rows = [(i, 40 * (i % 100), 40 * (i // 100), 10, 10, 0.5) for i in range(3000)] + [(9999, 0, 0, 4000, 4000, 0.9)]
    frame = spark.createDataFrame(rows, SCHEMA)
    sizes = N.Sizes.of(frame)
    assert sizes.sides == {1: 10.0, 5: 4000.0} and sizes.counts == {1: 3000, 5: 1} and N.class_span(0.3) == 1
    probes, stored = N.grid_cells(sizes, N.class_span(0.3), half=True)
    laid = lambda cells, name: frame.select("id", sizes.size_class()).join(frame.drop("score"), "id").select("id", F.explode(cells).alias("c")).select(F.col("id").alias(name), "c.cx", "c.cy")
    met = laid(probes, "i").join(laid(stored, "j"), ["cx", "cy"])
    assert met.where("(i = 9999) <> (j = 9999)").count() == 0 and N.pairs(frame, 0.3).count() == 0 and N.pairs(frame, 0.0).count() == 3000


def test_long_chains_end_by_component(spark):
    rows = [(i, 4 * i, 0, 10, 10, 1 - i / 5000) for i in range(3000)] + [(10_000 + i, 4 * i, 500, 10, 10, (i * 7919 % 1000) / 1000) for i in range(1000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = greedy_on(plain_neighbours(rows), rows)
    assert {r["id"] for r in N.nms(frame, 0.3).collect()} == want
    edges = N.written(N.pairs(frame, 0.3).select("hi", "lo"), "edges")
    for rounds, largest in ((0, 10**9), (1, 1500)):  # all by component; the longer chain by rounds after the shorter ones went by component
        short = edges.where("hi >= 10000 OR hi < 40")
        gone = {r["id"] for r in N.suppressed(short if largest < 10**9 else edges, rounds, largest if largest == 10**9 else 20).collect()}
        own = {x for r in short.collect() for x in (r.hi, r.lo)} if largest < 10**9 else {r[0] for r in rows}
        left = greedy_on({(a, b) for a, b in plain_neighbours(rows) if largest == 10**9 or (a >= 10000 or a < 40)}, [r for r in rows if r[0] in own])
        assert own - gone == left


def plain_neighbours(rows):
    """(better, other) of boxes in a line that overlap by more than 0.3: near ones only."""
    order = lambda r: (-r[5], r[2], r[1], r[3], r[4], r[0])
    out = set()
    for lane in ([r for r in rows if r[0] < 10_000], [r for r in rows if r[0] >= 10_000]):
        for i, a in enumerate(lane):
            for b in lane[i + 1 : i + 4]:
                if iou(a, b) > 0.3:
                    out.add((min(a, b, key=order)[0], max(a, b, key=order)[0]))
    return out


def greedy_on(edges, rows):
    above = {}
    for hi, lo in edges:
        above.setdefault(lo, []).append(hi)
    kept = set()
    for r in sorted(rows, key=lambda r: (-r[5], r[2], r[1], r[3], r[4], r[0])):
        if not kept & set(above.get(r[0], ())):
            kept.add(r[0])
    return kept


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5001), (5001, 5002), (5002, 5000)]
    got = {r.id: r.component for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{k: 1000 for k in range(1000, 1100)}, **{k: 5000 for k in (5000, 5001, 5002)}}


def test_suppression_of_nothing(spark):
    assert N.nms(spark.createDataFrame([], SCHEMA), 0.3).count() == 0


def test_anti_joins_and_phantoms(spark):
    rows = make(120, 5)
    a, b = rows[:80], rows[80:]
    fa, fb = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    assert {r["id"] for r in T.without_overlap(fa, fb, 0.1).collect()} == {r[0] for r in a if all(iou(r, o) <= 0.1 for o in b)}
    assert {r["id"] for r in T.without_overlap(fa, fb, 0.1, by_score=True).collect()} == {r[0] for r in a if all(iou(r, o) <= 0.1 or o[5] < r[5] for o in b)}
    found = {r["id"]: r["score"] for r in T.append_uncovered(fa, fb, 0.1).collect()}
    assert {i for i in found if i >= 80} == {r[0] for r in b if all(iou(r, o) <= 0.1 for o in a)} and all(s == 1.0 for i, s in found.items() if i >= 80)

    def inside(o, r):
        cx, cy = o[1] + o[3] / 2, o[2] + o[4] / 2
        return r[1] <= cx < r[1] + r[3] and r[2] <= cy < r[2] + r[4]

    real = {r[0] for r in a if sum(o is not r and inside(o, r) and r[3] * r[4] > 1.5 * o[3] * o[4] for o in a) < 2}
    assert {r["id"] for r in T.drop_phantoms(fa).collect()} == real


def test_orientations_match_numpy(spark):
    from tilequarry.functions.kernels import orient

    a = np.arange(12).reshape(3, 4)
    rows = [(o, x, y, int(a[y, x])) for o in G.ORIENTATIONS for y in range(3) for x in range(4)]
    tx, ty = G.oriented(F.col("o"), F.col("x"), F.col("y"), F.lit(4), F.lit(3))
    got = {}
    for r in spark.createDataFrame(rows, "o string, x int, y int, v int").select("o", tx.alias("nx"), ty.alias("ny"), "v").collect():
        got.setdefault(r["o"], {})[r["ny"], r["nx"]] = r["v"]
    for o, cells in got.items():
        want = orient(a, o)
        assert cells == {(y, x): int(want[y, x]) for y in range(want.shape[0]) for x in range(want.shape[1])}
    assert len({orient(a, o).tobytes() + bytes(orient(a, o).shape) for o in G.ORIENTATIONS}) == 8


@pytest.mark.parametrize(("rotation", "flipping", "n"), [(False, False, 1), (True, False, 4), (False, True, 3), (True, True, 8)])
def test_active_orientations(rotation, flipping, n):
    assert len(G.active_orientations(rotation, flipping)) == n


def test_rejection_reasons(spark):
    rows = [(0, 0, 0, 0, 5), (1, 0, 0, 7, 50), (2, 0, 0, 100, 80), (3, 0, 0, 99, 8), (4, 0, 0, 30, 20)]
    got = {r["id"]: r["why"] for r in spark.createDataFrame(rows, "id int, x int, y int, w int, h int").select("id", G.rejection(G.box(), 100, 80, aspect=10).alias("why")).collect()}
    assert got == {0: "empty", 1: "too small", 2: "whole image", 3: "too narrow", 4: None}


def test_window_positions(spark):
    got = spark.range(1).select(G.window_positions(F.lit(100), F.lit(32), F.lit(16)).alias("a"), G.window_positions(F.lit(20), F.lit(32), F.lit(16)).alias("b")).first()
    assert got["a"] == [0, 16, 32, 48, 64, 68] and got["b"] == []


def test_calibration():
    own = T.Calibration.from_two_points((10, 10), (60, 30), 5.0, "mm")
    assert own.scale == 0.1 and own.point(20, 30) == (1.0, 2.0) and own.text(own.length(53.6)) == "5.36 mm" and own.area(10, 20) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        T.Calibration.from_two_points((1, 1), (1, 1), 5.0, "mm")


def test_requests(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:01"), ("a", 3, "2024-01-01 01:00:00"), ("b", 4, "2024-01-01 00:00:00")]
    requests = spark.createDataFrame(rows, "session string, request long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert {r["request"] for r in debounced(requests, "1 minute").collect()} == {2, 3, 4}
    assert {(r["session"], r["request"], r["stale"]) for r in latest(requests).collect()} == {("a", 3, 2), ("b", 4, 0)}


def test_forms_compose_as_pixels_do():
    from tilequarry.functions import kernels as K

    a = np.arange(12).reshape(3, 4)
    for code in G.ORIENTATIONS:
        for turn in ("R0", "R90", "R180", "R270"):
            assert (K.orient(K.orient(a, code), turn) == K.orient(a, G._composed(turn, code))).all()


def test_right_angled_polygons(spark):
    shape = "array<struct<x:double,y:double>>"
    rows = [("l", [(10.2, 6.1), (70.4, 8.0), (69.0, 40.3), (44.6, 42.0), (45.0, 55.2), (12.0, 54.0)]), ("two", [(0.0, 0.0), (5.0, 5.0)]), ("square", [(0.0, 0.0), (4.0, 1.0), (4.2, 4.0), (0.1, 4.4)]), ("none", None)]
    got = {r["n"]: r["c"] and [tuple(p) for p in r["c"]] for r in spark.createDataFrame(rows, f"n string, p {shape}").select("n", G.right_angled(F.col("p")).alias("c")).collect()}
    assert got == {"l": [(10, 6), (70, 6), (70, 40), (45, 40), (45, 55), (12, 55), (12, 6)], "two": None, "square": [(0, 0), (4, 0), (4, 4), (0, 4)], "none": None}


def test_truths_and_detections_meet_once(spark):
    """Pairs of a truth and a detection come from one join, and pairs of two truths or two detections are never made."""
    rows = [(i, 10 * (i // 4), 0, 30, 20, i / 50) for i in range(1, 40)]
    every = spark.createDataFrame(rows, "id long, x long, y long, w long, h long, score double")
    found = T.truths(N.pairs(every, 0.3, apart=F.col("id") % 3 == 0))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    kinds = {(r["t"], r["d"]) for r in found.collect()}
    whole = {(r["hi"], r["lo"]) for r in N.pairs(every, 0.3).collect()}
    assert kinds == {(t, d) for a, b in whole for t, d in ((a, b), (b, a)) if t % 3 == 0 and d % 3}


def test_the_smaller_table_looks_for_the_larger_one(spark, monkeypatch):
    from tilequarry.operators import tail

    rng = np.random.default_rng(8)
    rows = [(i, *map(int, rng.integers(0, 300, 2)), *map(int, rng.integers(4, 70, 2)), float(rng.integers(0, 9)) / 9) for i in range(300)]
    many, few = (spark.createDataFrame(x, "id long, x long, y long, w long, h long, score double") for x in (rows[:280], rows[280:]))
    meet = lambda a, b: a[1] < b[1] + b[3] and b[1] < a[1] + a[3] and a[2] < b[2] + b[4] and b[2] < a[2] + a[4]
    true = {(a[0], b[0]) for a in rows[:280] for b in rows[280:] if meet(a, b)}
    looking, inner = [], tail._near_pairs
    monkeypatch.setattr(tail, "_near_pairs", lambda left, right, sizes: looking.append(left.count()) or inner(left, right, sizes))
    found = [(r["i"], r["j"]) for r in tail.near_pairs(many, few).selectExpr("a.id AS i", "b.id AS j").collect()]
    back = [(r["j"], r["i"]) for r in tail.near_pairs(few, many).selectExpr("a.id AS i", "b.id AS j").collect()]
    assert looking == [20, 20] and true and true <= set(found) and true <= set(back)
    assert len(found) == len(set(found)) and len(back) == len(set(back))


def test_polygons_are_dealt_before_they_are_drawn(spark):
    from tilequarry.plans.box_queries import polygon_mask

    plan = polygon_mask(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("\n\n")[0]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_points_are_never_broadcast(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 9, 9), (2, 3, 3, 4, 4)], "id long, x long, y long, w long, h long")
    points = spark.createDataFrame([(7, 4, 4), (8, 8, 8), (9, 9, 9)], "pid long, px long, py long")
    found = T.smallest_under(boxes, points)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(7, 2), (8, 1)]
    few = spark.range(3).selectExpr("id AS pid", "id * 4 AS px", "id * 4 AS py")
    assert "BroadcastHashJoin" not in T.smallest_under(boxes, few)._jdf.queryExecution().executedPlan().toString()
