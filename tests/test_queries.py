"""Registered queries against their SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from tilequarry.operators import examples as X
from tilequarry.operators import semantic as E
from tilequarry.operators.nms import written
from tilequarry.plans.registry import ORACLE_SQL
from tilequarry.plans.request import SearchParams, SearchRequest
from tilequarry.sources import images as I

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def same(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted("|".join(plain(v) for v in r) for r in df.select(*columns).collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted("|".join(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    same(spark, duck, name)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_generated_samples(spark):
    """Searches of a generated image of 1600 x 1200, against what was planted."""
    tiles, truth, own = I.sample(spark, 1600, 1200)
    tiles = written(tiles, "sample")
    found = SearchRequest(own, SearchParams(threshold_floor=0.85), exclude_box=truth[0]).run(tiles, 512).collect()
    assert len(found) == 7 and all(any(abs(r.x - x) <= 8 and abs(r.y - y) <= 8 for r in found) for x, y, _, _ in truth[1:])
    (x, y, w, h) = truth[1]
    found = X.match_examples(tiles, [truth[0], (x + 2, y - 1, w, h)], [(300, 300, w, h)], side=512).collect()
    assert sorted((r.x, r.y, r.w, r.h) for r in found) == sorted(truth)


def test_windows_of_a_finer_grid_find_every_copy(spark):
    """At every half template two of seven copies score as low as background; a grid of eighths finds all, and nothing else."""
    tiles, truth, own = I.sample(spark, 1600, 1200)
    best = E.search(written(tiles, "sample"), own, (1200, 1600), side=512, floor=0.9, margin=0.2, steps=8, exclude_box=truth[0]).collect()
    on_copy = [next((i for i, (x, y, _, _) in enumerate(truth) if abs(x - r.x) <= 16 and abs(y - r.y) <= 16), None) for r in best]
    assert set(on_copy) == set(range(1, 8))
