"""Nearest descriptors by blocks against every pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilequarry.operators import retrieval as R


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(2)
    own, image = rng.integers(0, 4, (90, 6)).astype(float), rng.integers(0, 4, (700, 6)).astype(float)  # many equal distances
    image[5], own[3] = own[2], own[2]
    template = spark.createDataFrame([(i * 7 % 1000, v.tolist()) for i, v in enumerate(own)] + [(5000, None), (None, own[0].tolist())], "q long, qv array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(image)] + [(9000, None)], "t long, tv array<double>").repartition(5)
    d = np.round(np.sqrt(((own[:, None] - image[None]) ** 2).sum(axis=2)), 9)
    return template, rows, d, [i * 7 % 1000 for i in range(90)]


@pytest.mark.parametrize("k", [1, 3, 700, 1000])
def test_nearest(sides, k, monkeypatch):
    template, image, d, ids = sides
    want = {(ids[i], t, rank + 1): d[i, t] for i in range(90) for rank, t in enumerate(np.lexsort((np.arange(700), d[i]))[:k])}
    for most in (65_536, 20):  # one pass, and several
        monkeypatch.setattr(R, "MAX_QUERIES", most)
        got = {(r.q, r.t, r["rank"]): r.distance for r in R.nearest(template, image, k).collect()}
        assert got == want


def test_nearest_of_nothing(sides):
    template, image, *_ = sides
    assert R.nearest(template.limit(0), image, 3).count() == 0 and R.nearest(template, image.limit(0), 3).count() == 0
    assert R.ratio_matches(template.limit(0), image).count() == 0 and R.ratio_matches(template, image.limit(0)).count() == 0


def test_ratio_matches(spark):
    rng = np.random.default_rng(4)
    own = rng.random((300, 8))
    image = np.concatenate((own[:120] + rng.normal(0, 0.03, (120, 8)), own[10:20], rng.random((200, 8))))
    own[150] = own[10]  # a tie: the smaller number is the nearest
    template = spark.createDataFrame([(299 - i, v.tolist()) for i, v in enumerate(own)], "q long, qv array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(image)], "t long, tv array<double>")
    want = {}
    for t, v in enumerate(image):
        d = np.round(np.sqrt(((own[::-1] - v) ** 2).sum(axis=1)), 9)  # by q
        first, second = np.lexsort((np.arange(300), d))[:2]
        if d[first] <= 0.65 and (d[first] < 0.9 * d[second] or d[first] < 0.18):
            want[t] = (int(first), d[first], d[second])
    assert {r.t: (r.q, r.d1, r.d2) for r in R.ratio_matches(template, rows).collect()} == want and len(want) > 100


def test_best_queries_come_from_block_products_and_equal_every_pair(spark):
    """Ties, equal queries, zero and null vectors give what all pairs give, and few rows leave a task."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8)).round(1)
    vectors = [*base.tolist(), *base[:10].tolist(), [0.0] * 8, None, (base[3] * 2).tolist()]
    windows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    queries = windows.where("vec_id % 3 = 0").selectExpr("vec_id as query", "embedding as vector", "if(vec_id % 2 = 0, 'positive', 'negative') as kind")
    pairs = R.score_queries(windows, queries.select("query", "vector")).join(queries.select("query", "kind"), "query").withColumn("cos", F.round("cos", 9))
    want = pairs.groupBy("vec_id").agg(F.max(F.struct("cos", (-F.col("query")).alias("m"))).alias("b")).where("b.cos >= 0.1").selectExpr("vec_id", "-b.m", "least(b.cos, 1.0)")
    got = R.best_query(windows, queries, "vec_id", 0.1).select("vec_id", "query", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plain = pairs.groupBy("vec_id").agg(F.max(F.when(F.col("kind") == "positive", F.col("cos"))), F.max(F.when(F.col("kind") == "negative", F.col("cos"))))
    assert sorted(map(str, (tuple(r)[:3] for r in R.exemplars(windows, queries, "vec_id").collect()))) == sorted(map(str, map(tuple, plain.collect())))
    assert R.leading(windows, queries, "vec_id").count() < windows.count() * 5


def test_neighbours_are_looked_for_as_far_as_the_density_asks(spark):
    """A thicket and a few far points: the k nearest within the radius, as brute force has them; votes are counted before medians."""
    rng = np.random.default_rng(9)
    points = [(i, int(x), int(y)) for i, (x, y) in enumerate([*rng.integers(0, 30, (300, 2)), (200, 200), (225, 200), (200, 230), (500, 500)])]
    got = {(r["i"], r["j"]) for r in R.neighbour_pairs(spark.createDataFrame(points, "id long, x long, y long"), 40, 6).collect()}
    want = set()
    for i, x, y in points:
        near = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, a, b in points if j != i and (a - x) ** 2 + (b - y) ** 2 <= 1600)
        want |= {(i, j) for _, j in near[:6]}
    assert got == want
    some = spark.createDataFrame([(i, i % 3, x, y) for i, x, y in points], "id long, word int, x long, y long")
    plan = R.pair_votes(some.where("x < 20"), some, 40, 6, 6, 8, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" in plan and "sum(n" in plan


def test_unit_deviation_keeps_what_its_sql_keeps(spark, tmp_path):
    """Small negative values round to -0.0, as in the SQL; components that are null add nothing."""
    import duckdb

    from tilequarry.plans.registry import ORACLE_SQL, QUERIES, load_all

    load_all()
    rng = np.random.default_rng(9)
    rows = [(0, [1.0, -1.0, -1e-7]), (1, [0.1, 0.1, 0.1]), (2, [1.0, None, 3.0]), (3, []), (4, None), (5, [None, None])]
    rows += [(i, rng.normal(0, 1, 8).astype(np.float32).tolist() + [-1e-7]) for i in range(6, 60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {i: repr(v) for i, v in con.execute(ORACLE_SQL["unit_deviation"]).fetchall()}
    assert "-0.0," in want[0] or "-0.0]" in want[0]
    assert {r.vec_id: repr(r.vector) for r in QUERIES["unit_deviation"](spark, str(tmp_path)).collect()} == want


def test_pair_votes_of_dense_whole_places_equal_the_join(spark, monkeypatch):
    """Votes counted by tiles are those of the join of all pairs, also across tiles, left of 0 and with several points a place."""
    rng = np.random.default_rng(8)
    rows = [(int(i), int(rng.integers(3)) if i % 50 else None, int(x), int(y)) for i, (x, y) in enumerate(rng.integers((-30, -20), (120, 40), (4000, 2)))]
    image = spark.createDataFrame(rows, "id long, word int, x long, y long")
    template = image.where("x between 10 and 24 and y between 0 and 14")
    some = lambda: {tuple(r) for r in R.pair_votes(template, image, 6, 5, 2, 8, 3).collect()}
    assert R._counted_offsets(template, image, 6, 5, 2, ()) is not None
    got = some()
    monkeypatch.setattr(R, "_counted_offsets", lambda *_: None)
    assert got == some() and len(got) > 20


def test_offsets_of_many_pairs_are_exact():
    rng = np.random.default_rng(9)
    rows = lambda n, high: R._counted(np.column_stack((np.repeat(rng.integers(0, 2, n)[:, None], 4, axis=1), rng.integers(0, high, (n, 2)))))
    (image, weights), (own, times) = rows(6000, 64), rows(3000, 40)
    image[:, 4] += 128  # the tile's left
    want: dict[tuple[int, int], int] = {}
    for word in (0, 1):
        a, b = image[:, 0] == word, own[:, 0] == word
        assert a.sum() * b.sum() > R.ONE_BY_ONE
        d = (image[a][:, None, 4:] - own[b][None, :, 4:]).reshape(-1, 2)
        n = (weights[a][:, None] * times[b][None]).ravel()
        places, at = np.unique(d, axis=0, return_inverse=True)
        for p, v in zip(places.tolist(), np.bincount(at.ravel(), n), strict=True):
            want[tuple(p)] = want.get(tuple(p), 0) + int(v)
    ox, oy, n = R._offsets(image, weights, own, times, 128, 0, 64)
    assert dict(zip(zip(ox.tolist(), oy.tolist(), strict=True), n.tolist(), strict=True)) == want
