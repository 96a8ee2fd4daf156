"""Searches on planted scenes, kernels against direct sums, saved results."""

import json

import numpy as np
import pytest

from tilequarry.functions import features as V
from tilequarry.functions import kernels as K
from tilequarry.operators import memory as M
from tilequarry.plans.request import SearchParams, SearchRequest
from tilequarry.sources import images as I


def scene(seed=0, h=200, w=260):
    rng = np.random.default_rng(seed)
    a = I.background(0, 0, w, h, seed)
    own = rng.integers(0, 256, (24, 28, 3)).astype(np.uint8)
    places = [(20, 18), (200, 30), (60, 150), (115, 80)]
    for x, y in places:
        a[y : y + 24, x : x + 28] = own
    return a, own, places


def test_score_maps_against_direct_sums():
    rng = np.random.default_rng(1)
    a, t = rng.random((30, 33)), rng.random((9, 11))
    mask = rng.random((9, 11)) > 0.4
    for m in (None, mask):
        keep = np.ones_like(t, dtype=bool) if m is None else m
        windows = np.lib.stride_tricks.sliding_window_view(a, t.shape)[..., keep]
        tv = t[keep]
        wz, tz = windows - windows.mean(axis=-1, keepdims=True), tv - tv.mean()
        ncc = (wz @ tz) / (np.sqrt((wz * wz).sum(-1)) * np.sqrt(tz @ tz) + 1e-6)
        np.testing.assert_allclose(K.score_map([a], [t], [1.0], "ncc", m), np.clip(ncc, 0, 1), atol=1e-9)
        ssd = 1 - np.sqrt(((windows - tv) ** 2).sum(-1) / keep.sum())
        np.testing.assert_allclose(K.score_map([a], [t], [1.0], "ssd", m), np.clip(ssd, 0, 1), atol=1e-9)
        ccorr = (windows @ tv) / (np.sqrt((windows**2).sum(-1)) * np.sqrt(tv @ tv) + 1e-6)
        np.testing.assert_allclose(K.score_map([a], [t], [1.0], "ccorr", m), np.clip(ccorr, 0, 1), atol=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8])
def test_sliding_max(size):
    a = np.random.default_rng(size).random(20)
    want = [max(a[max(0, i - size // 2) : i + size - size // 2]) for i in range(20)]
    np.testing.assert_array_equal(K.sliding_max(a, size, 0), want)


@pytest.mark.parametrize("method", ["ncc", "ssd", "ccorr"])
def test_each_copy_once_whatever_the_tiling(spark, method):
    a, own, places = scene()
    results = []
    for side in (64, 512):
        found = SearchRequest(own, SearchParams(method=method, threshold_floor=0.97), exclude_box=(20, 18, 28, 24)).run(I.array_tiles(spark, a, side), side).collect()
        results.append({(r["x"], r["y"]) for r in found})
    assert results[0] == results[1] == set(places[1:])


def test_orientations_are_named(spark):
    a, own, _ = scene()
    truth = {"R90": (150, 140), "R180": (210, 100), "MY": (20, 80)}
    for code, (x, y) in truth.items():
        t = np.stack([K.orient(own[..., c], code) for c in range(3)], axis=-1)
        a[y : y + t.shape[0], x : x + t.shape[1]] = t
    found = SearchRequest(own, SearchParams(enable_rotation=True, enable_flipping=True, threshold_floor=0.95)).run(I.array_tiles(spark, a, 128), 128).collect()
    assert {r["orientation"]: (r["x"], r["y"]) for r in found if r["orientation"] != "R0"} == truth


def test_scales(spark):
    a, own, _ = scene()
    big = np.stack([np.clip(K.resample(own[..., c].astype(float), 30, 35), 0, 255) for c in range(3)], axis=-1).astype(np.uint8)
    a[150:180, 150:185] = big
    found = SearchRequest(own, SearchParams(scales=(1.0, 1.25), threshold_floor=0.9)).run(I.array_tiles(spark, a, 128), 128).collect()
    assert (150, 150, 35, 30, 1.25) in {(r["x"], r["y"], r["w"], r["h"], r["scale"]) for r in found}


def test_flat_template():
    with pytest.raises(ValueError):
        SearchRequest(np.full((20, 20), 200, dtype=np.uint8)).run(None, 64)


def test_masked_halves(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (100, 200)).astype(np.uint8)
    a[25:65, 125:145] = a[25:65, 25:45]
    mask = np.zeros((40, 40), dtype=bool)
    mask[:, :20] = True
    found = SearchRequest(a[25:65, 25:65], SearchParams(threshold_floor=0.95), exclude_box=(25, 25, 40, 40), mask=mask).run(I.array_tiles(spark, a, 64), 64).collect()
    assert [(r["x"], r["y"]) for r in found] == [(125, 25)]


def test_plan_text():
    text = SearchRequest(np.zeros((70, 70)), SearchParams(enable_rotation=True), exclude_box=(0, 0, 9, 9)).explain(512, 2_000_000)
    assert text.splitlines()[0] == "Top(500)" and "coarse to fine" in text and "4 orientations" in text


def test_saved_results(spark, tmp_path):
    store = {"source_image": "a.png", "image_size": [9, 9], "entries": [{"label": "", "selection": [1, 2, 8, 8], "params": {"method": "ssd"}, "matches": [{"x": 1, "y": 2, "w": 3, "h": 4, "score": 0.5, "scale": 1.0, "orientation": "MX"}]}]}
    M.save(spark, store, str(tmp_path / "s"))
    row = M.matches_of(M.load(spark, str(tmp_path / "s"))).first()
    assert (row["method"], row["threshold"], row["orientation"], row["score"]) == ("ssd", 0.85, "MX", 0.5)
    assert json.loads(M.dump(store))["entries"][0]["params"]["feature_min_inliers"] == 12

    def read(text):
        return M.matches_of(M.parse(spark.createDataFrame([(text,)], "document string"))).collect()

    assert read('{"entries":[{"method":"ccorr","threshold":0.7,"matches":[{"x":1,"y":1,"w":2,"h":2,"score":1}]}]}')[0]["method"] == "ccorr"
    for bad in ("{", '{"version":1}', '{"version":99,"entries":[]}'):
        with pytest.raises(Exception):  # noqa: B017, PT011
            read(bad)


def test_saved_searches_run_again(spark, tmp_path):
    store = {"entries": [{"params": {"method": "ssd", "scales": [1.0, 0.5], "channel_mode": "rgb", "rgb_weights": [0.6, 0.2, 0.2], "max_results": 7}, "matches": []}, {"method": "ccorr", "threshold": 0.7, "matches": []}]}
    M.save(spark, store, str(tmp_path / "s"))
    first, second = M.params_of(M.load(spark, str(tmp_path / "s"))).orderBy("entry").collect()
    assert {k: first[k] for k in M.DEFAULTS} == {**M.DEFAULTS, **store["entries"][0]["params"]} and {k: second[k] for k in M.DEFAULTS} == M.DEFAULTS
    old = M.params_of(M.parse(spark.createDataFrame([(json.dumps({"entries": [store["entries"][1]]}),)], "document string"))).first()
    assert (old["method"], old["threshold"], old["feature_ratio"]) == ("ccorr", 0.7, 0.75)
    assert SearchParams.saved(first) == SearchParams(method="ssd", scales=(1.0, 0.5), channel_mode="rgb", weights=(0.6, 0.2, 0.2), max_results=7)
    assert SearchParams.saved(second) == SearchParams()


def test_semantic_windows(spark):
    from tilequarry.operators import semantic

    a = np.full((96, 192, 3), 30, dtype=np.uint8)
    a[:32, :32] = (200, 40, 60)
    a[48:80, 128:160] = (190, 50, 70)
    found = semantic.search(I.array_tiles(spark, a, 64), a[:32, :32], (96, 192), side=64, encoder="mean_colour", floor=0.9, exclude_box=(0, 0, 32, 32)).collect()
    assert (found[0]["x"], found[0]["y"]) == (128, 48) and found[0]["score"] > 0.97
    assert semantic.starts(100, 32, 16) == [0, 16, 32, 48, 64, 68] and semantic.starts(10, 32, 16) == []
    with pytest.raises(ValueError):
        semantic.scan(I.array_tiles(spark, a, 64), a[:32, :32], (96, 192), side=64, encoder="layout", scales=(0.0,))


def test_semantic_windows_between_the_grids(spark):
    """Copies in the middle between windows of the grid are found; a view a quarter larger, near in its embedding, fails by its pixels."""
    from tilequarry.functions import kernels as K
    from tilequarry.operators import poses, semantic

    rng = np.random.default_rng(14)
    own = np.clip(K.resample(rng.integers(0, 256, (16, 18)).astype(float), 140, 160), 0, 255).astype(np.uint8)
    a = np.repeat(np.repeat(rng.integers(96, 122, (44, 60)), 16, axis=0), 16, axis=1).astype(np.uint8)
    copies = [(17 * 3 + 8, 20 * 12 + 10), (17 * 16 + 9, 20 * 3 + 10), (17 * 27 + 8, 20 * 20 + 10)]
    for y, x in copies:
        a[y : y + 140, x : x + 160] = own
    large = np.rint(K.resample(own.astype(float), 175, 200)).astype(np.uint8)
    a[20:195, 700:900] = large
    image, template = np.stack([a] * 3, axis=-1), np.stack([own] * 3, axis=-1)
    some = lambda verify: {(r.y, r.x) for r in semantic.search(I.array_tiles(spark, image, 352), template, a.shape, side=352, encoder="layout", floor=0.9, margin=0.2, steps=8, verify=verify).collect()}
    assert some(poses.ACCEPT) == set(copies)
    assert set(copies) <= some(None)


def turned_scene() -> tuple[np.ndarray, np.ndarray, tuple[int, int, int, int]]:
    """A scene with a motif, an upside-down mirrored copy, and one turned by 35 degrees at 1.15 times its size."""
    rng = np.random.default_rng(3)
    scene = I.background(0, 0, 900, 700, 3)
    gray = K.resample(rng.integers(0, 256, (16, 18)).astype(float), 160, 180)
    own = np.clip(np.stack([gray] * 3, axis=-1), 0, 255).astype(np.uint8)
    scene[60:220, 80:260] = own
    scene[450:610, 500:680] = own[::-1]
    turn, size = np.radians(35), 1.15
    ys, xs = np.mgrid[0:700, 0:900]
    u = ((xs - 640) * np.cos(turn) + (ys - 230) * np.sin(turn)) / size + 90
    v = (-(xs - 640) * np.sin(turn) + (ys - 230) * np.cos(turn)) / size + 80
    inside = (u >= 0) & (u < 179) & (v >= 0) & (v < 159)
    for c in range(3):
        scene[..., c][inside] = V._sample(own[..., c].astype(float), v[inside], u[inside])
    return scene, own, (80, 60, 180, 160)


def test_keypoints_find_turned_copies(spark):
    from tilequarry.operators import keypoints

    scene_, own, source = turned_scene()
    for strict in (False, True):
        found = {r["orientation"]: r for r in keypoints.search(I.array_tiles(spark, scene_, 512), own, side=512, strict=strict, exclude_box=source).collect()}
        assert len(found) == 2 and abs(found["MX"]["x"] - 500) <= 3 and abs(found["R0"]["scale"] - 1.15) < 0.05


def test_examples(spark):
    from tilequarry.operators import examples

    tiles, truth, _ = I.sample(spark, 700, 500, side=256, n_targets=5)
    x, y, w, h = truth[1]
    found = {(r["x"], r["y"]) for r in examples.match_examples(tiles, [truth[0], (x + 2, y - 1, w, h)], [(300, 300, w, h)], side=256).collect()}
    assert {t[:2] for t in truth} <= found and len(found) <= 6


def test_sql_functions(spark):
    from tilequarry.functions.registry import register_sql

    register_sql(spark)
    row = spark.sql("SELECT box_iou(0, 0, 10, 10, 5, 0, 10, 10) AS a, box_intersection(0, 0, 10, 10, 5, 0, 10, 10) AS b, gray(255, 255, 255) AS c").first()
    assert (row["a"], row["b"], row["c"]) == (pytest.approx(1 / 3), 50, pytest.approx(1.0))


def test_command_line(capsys):
    from tilequarry.__main__ import main

    assert main(["--doctor"]) == 0 and json.loads(capsys.readouterr().out)["ok"]


def test_views_of_levels(spark):
    a = I.background(0, 0, 230, 150, 5)
    tiles = I.array_tiles(spark, a, 64)
    np.testing.assert_array_equal(I.view(tiles, 0, 50, 40, 100, 70, side=64, size=(150, 230)), a[40:110, 50:150])
    half = a[:150, :230].astype(int)
    half = (half[::2, ::2] + half[1::2, ::2] + half[::2, 1::2] + half[1::2, 1::2] + 2) >> 2
    np.testing.assert_array_equal(I.view(tiles, 1, -5, 60, 200, 40, side=64, size=(150, 230)), half[60:75, 0:115])
    assert I.view(tiles, 1, 300, 0, 5, 5, side=64, size=(150, 230)).size == 0
    with pytest.raises(ValueError):
        I.view(tiles, 7, 0, 0, 1, 1, side=64, size=(150, 230))


def test_fingerprint_follows_the_pixels(spark):
    a, _, _ = scene(6)
    b = a.copy()
    b[77, 99, 1] ^= 1
    one, two, other = (I.fingerprint(I.array_tiles(spark, x, 64)).first()["fingerprint"] for x in (a, a.copy(), b))
    assert one == two != other


def test_progress_rises_and_cancel_stops(spark):
    from tilequarry.plans.request import Cancelled

    a, own, _ = scene()
    tiles, seen = I.array_tiles(spark, a, 128), []
    request = SearchRequest(own, SearchParams(threshold_floor=0.97))
    request.run(tiles, 128, progress=seen.append)
    assert seen == sorted(seen) and seen[0] == 0 and seen[-1] == 100
    with pytest.raises(Cancelled):
        request.run(tiles, 128, cancel=lambda: True)


def blocks(seed: int, h: int, w: int) -> np.ndarray:
    coarse = np.random.default_rng(seed).integers(0, 256, (h // 10, w // 10)).astype(float)
    return np.clip(np.stack([K.resample(coarse, h, w)] * 3, axis=-1), 0, 255).astype(np.uint8)


def planted():
    """Three copies of one motif and two of another."""
    a, own, other = I.background(0, 0, 640, 480, 2), blocks(1, 120, 140), blocks(9, 120, 140)
    for x, y in ((20, 30), (330, 60), (180, 310)):
        a[y : y + 120, x : x + 140] = own
    for x, y in ((480, 200), (480, 350)):
        a[y : y + 120, x : x + 140] = other
    return a, own


def test_pair_search(spark):
    from tilequarry.operators.keypoints import pair_search

    a, own = planted()
    found = pair_search(I.array_tiles(spark, a, 256), own, side=256, exclude_box=(20, 30, 140, 120)).collect()
    places = sorted((r["x"], r["y"]) for r in found)
    assert len(places) == 2 and all(abs(x - u) <= 2 and abs(y - v) <= 2 for (x, y), (u, v) in zip(places, [(180, 310), (330, 60)], strict=True))
    assert min(r["score"] for r in found) >= 0.7


def test_retrieval_by_examples(spark):
    from tilequarry.operators import examples as X
    from tilequarry.operators import keypoints as P

    a, _ = planted()
    tiles = I.array_tiles(spark, a, 256)
    find = lambda t: P.search(tiles, t, side=256, orientations=["R0"], max_results=10_000)
    one, two = (20, 30, 140, 120), (480, 200, 140, 120)
    for encoder in (None, "layout"):
        found = X.match_retrieval(tiles, find, [one], [two], side=256, encoder=encoder).collect()
        assert sorted((round(r["x"] / 10), round(r["y"] / 10)) for r in found) == [(2, 3), (18, 31), (33, 6)]
    both = X.match_retrieval(tiles, find, [one, two], [], side=256).collect()
    assert len(both) == 5


def test_zncc_in_sql(spark):
    from tilequarry.functions.registry import register_sql

    register_sql(spark)
    a, b = np.random.default_rng(4).random((2, 50))
    got = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>").selectExpr("zncc(a, b) AS s", "zncc(a, a) AS one").first()
    assert got["s"] == pytest.approx(np.corrcoef(a, b)[0, 1]) and got["one"] == pytest.approx(1)


def test_raw_images_are_read_by_rows(spark, tmp_path):
    a = np.random.default_rng(4).integers(0, 256, (150, 90, 3)).astype(np.uint8)
    (tmp_path / "image.raw").write_bytes(a.tobytes())
    tiles = I.read_raw(spark, f"file://{tmp_path}/image.raw", 90, side=64, image_id="image")
    key = lambda r: (r["ty"], r["tx"])
    assert sorted(map(tuple, tiles.collect())) == sorted(map(tuple, I.array_tiles(spark, a, 64).collect())) and len({key(r) for r in tiles.collect()}) == 6


def test_soundness_of_transforms():
    from tilequarry.functions import features as V

    assert V.hull_area(np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1]], dtype=float)) == 12 and V.hull_area(np.array([[0, 0], [1, 1], [2, 2.0]])) == 0
    np.testing.assert_allclose(V.sound_quad(np.array([[2.0, 0, 5], [0, 2, 7], [0, 0, 1]]), 10, 20), [[5, 7], [25, 7], [25, 47], [5, 47]])
    assert V.sound_quad(np.array([[1.0, 0, 0], [0, 1, 0], [-0.15, 0, 1]]), 10, 20) is None  # beyond the horizon
    assert V.sound_quad(np.array([[1.0, 0, 0], [0.99, 0.01, 0], [0, 0, 1]]), 100, 100) is None  # a sliver
    assert V.sound_quad(np.eye(3) * [[20], [20], [1]], 10, 10) is None
    m, e = np.array([[1.1, 0.2, 3], [-0.1, 0.9, 4], [0.001, 0.002, 1]]), 1e-6
    at = lambda x, y: V.transform(m, np.array([[x, y]]))[0]
    np.testing.assert_allclose(V.slope(m, 5, 6), np.column_stack(((at(5 + e, 6) - at(5 - e, 6)) / (2 * e), (at(5, 6 + e) - at(5, 6 - e)) / (2 * e))), atol=1e-6)
    a = np.array([[0, 0, 0], [255, 20, 0]])
    assert V.colour_likeness(a, a, [0.5, 0.25, 0.25]) == pytest.approx(1) and V.colour_likeness(a, 255 - a, [0.0, 0.0, 1.0]) == 0
    assert V.colour_likeness(a[:0], a[:0], [1, 0, 0]) == 0


def test_colours_lower_a_fuzzy_score(spark):
    from tilequarry.operators import keypoints

    scene_, own, source = turned_scene()
    tinted = scene_.copy()
    tinted[450:610, 500:680, 2] //= 4  # inverting it would leave the motif's even histogram as it is
    tiles = I.array_tiles(spark, tinted, 512)
    run = lambda **more: {r["orientation"]: r["score"] for r in keypoints.search(tiles, own, side=512, exclude_box=source, floor=0.3, **more).collect()}
    gray, colour, first = run(), run(mode="rgb"), run(mode="rgb", weights=(1, 0, 0))
    assert set(gray) == set(colour) == set(first) == {"R0", "MX"}
    assert colour["R0"] / gray["R0"] > 0.95 and first["MX"] / gray["MX"] > 0.95 and colour["MX"] / gray["MX"] < 0.9


def test_match_template_in_sql(spark):
    from tilequarry.functions.registry import register_sql

    register_sql(spark)
    a, own, places = scene()
    I.array_tiles(spark, a, 512).createOrReplaceTempView("whole")
    spark.createDataFrame([(bytearray(own.tobytes()), 24, 28)], "data binary, h int, w int").createOrReplaceTempView("pattern")
    found = spark.sql("SELECT m.* FROM whole t CROSS JOIN pattern p, LATERAL match_template(t.data, t.h, t.w, t.nc, p.data, p.h, p.w, 'ncc', 0.97D) m").collect()
    assert {(r["x"], r["y"]) for r in found} == set(places) and all(r["score"] > 0.99 for r in found)
    assert spark.sql("SELECT m.* FROM pattern p, LATERAL match_template(p.data, 2, 2, 3, p.data, p.h, p.w, 'ncc', 0.5D) m").count() == 0


def test_resampled_templates_equal_the_kernel(spark):
    from tilequarry.operators.dense import resampled

    rng = np.random.default_rng(6)
    a = rng.integers(0, 256, (10, 12))
    rows = spark.createDataFrame([(x, y, "r", int(a[y, x])) for y in range(10) for x in range(12)], "tx long, ty long, c string, t long")
    for w, h in ((12, 10), (10, 8), (15, 12), (24, 20)):
        got = np.zeros((h, w))
        for r in resampled(rows, 12, 10, w, h).collect():
            got[r.ty, r.tx] = r.t
        assert np.abs(got - K.resample(a.astype(float), h, w)).max() <= 0.5 + 1e-9
