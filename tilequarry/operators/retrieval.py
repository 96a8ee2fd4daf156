"""Retrieval by embeddings and descriptors: cosine search, k nearest neighbours, votes for places, pair hashes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilequarry.functions.geometry import dot
from tilequarry.operators.nms import written

#: Queries are few (a template's windows, orientations or descriptors); more than this are not broadcast but refused.
MAX_QUERIES = 65_536


def few(queries: DataFrame) -> DataFrame:
    """queries, marked for broadcasting after a check of their number."""
    if queries.limit(MAX_QUERIES + 1).count() > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; search in parts")
    return F.broadcast(queries)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null if either is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def score_queries(windows: DataFrame, queries: DataFrame) -> DataFrame:
    """Every window with every query (a stated, small set): columns of windows, query, cos."""
    q = few(queries.select(F.col("query"), F.col("vector").alias("query_vector")))
    return windows.join(q, F.lit(True)).withColumn("cos", cosine(F.col("embedding"), F.col("query_vector"))).drop("query_vector")


#: Cosines from matrix products that lie so close to a window's best are measured one by one: more than rounding to nine digits and the products' own error.
NEAR = 1e-8
#: Windows and queries of a matrix product.
WINDOWS, QUERIES = 1024, 4096


def leading(windows: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """key, query, kind, cos: of each window (key, embedding) the queries (query, kind, vector) whose cosine may be the best of their kind after rounding.

    A task multiplies blocks of windows and queries; cosines that may lead are summed in order, as cosine() does. A window without a
    cosine, as a zero vector, has one row without query. The queries are a stated, small set.
    """
    few(queries)
    rows = queries.where("query IS NOT NULL AND vector IS NOT NULL").orderBy("kind", "query").collect()  # MAX_QUERIES at most
    shared = windows.sparkSession.sparkContext.broadcast((np.array([r["query"] for r in rows], dtype=np.int64), [r["kind"] for r in rows], [np.array([np.nan if v is None else v for v in r["vector"]], dtype=np.float64) for r in rows]))

    def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Dot products of rows, summed from the first element on."""
        return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))

    def scan(frames):
        ids, kinds, vectors = shared.value
        # Vectors of another length have no cosine, as in cosine().
        groups: dict[tuple[str, int], list[int]] = {}
        seen: set[tuple[str, bytes]] = set()
        for i, (kind, v) in enumerate(zip(kinds, vectors, strict=True)):
            if np.isfinite(v).all() and (kind, v.tobytes()) not in seen:  # of equal vectors the first by query
                seen.add((kind, v.tobytes()))
                groups.setdefault((kind, len(v)), []).append(i)
        ready = []
        for (kind, size), of in groups.items():
            m = np.stack([vectors[i] for i in of])
            length = np.sqrt(dots(m, m))
            some = length > 0
            ready.append((kind, size, ids[of][some], m[some], length[some]))
        for frame in frames:
            own = [None if v is None else np.array([np.nan if x is None else x for x in v], dtype=np.float64) for v in frame["embedding"]]
            keys = frame["key"].to_numpy()
            yield pd.DataFrame({"key": keys, "query": pd.array([None] * len(keys), dtype="Int64"), "kind": None, "cos": np.nan})
            for kind, size, of, m, length in ready:
                at = [i for i, v in enumerate(own) if v is not None and len(v) == size and np.isfinite(v).all()]
                for first in range(0, len(at), WINDOWS):
                    part = np.array(at[first : first + WINDOWS])
                    x = np.stack([own[i] for i in part])
                    long = np.sqrt(dots(x, x))
                    part, x, long = part[long > 0], x[long > 0], long[long > 0]
                    if not len(part) or not len(of):
                        continue
                    unit, best = x / long[:, None], np.full(len(part), -np.inf)
                    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                    for start in range(0, len(of), QUERIES):
                        block = unit @ (m[start : start + QUERIES] / length[start : start + QUERIES, None]).T
                        best = np.maximum(best, block.max(axis=1))
                        i, j = np.nonzero(block >= (best - NEAR)[:, None])
                        held.append((i, j + start, block[i, j]))
                    i, j, rough = (np.concatenate(c) for c in zip(*held, strict=True))
                    lead = rough >= best[i] - NEAR
                    i, j = i[lead], j[lead]
                    for k in range(0, len(i), WINDOWS * 16):  # many where windows or queries are equal
                        a, b = i[k : k + WINDOWS * 16], j[k : k + WINDOWS * 16]
                        yield pd.DataFrame({"key": keys[part[a]], "query": pd.array(of[b], dtype="Int64"), "kind": kind, "cos": dots(x[a], m[b]) / (long[a] * length[b])})

    found = windows.select(F.col(key).alias("key"), "embedding").mapInPandas(scan, f"key {windows.schema[key].dataType.simpleString()}, query long, kind string, cos double")
    return found.select(F.col("key").alias(key), "query", "kind", F.when(F.col("query").isNotNull(), F.col("cos")).alias("cos"))


def best_query(windows: DataFrame, queries: DataFrame, key: str, floor: float) -> DataFrame:
    """key, query, score: of each window the best query; scores below the floor go, then they are clamped to 0..1."""
    one = leading(windows, queries.select("query", "vector", F.lit("query").alias("kind")), key).where("query IS NOT NULL")
    best = one.groupBy(key).agg(F.max(F.struct(F.round("cos", 9).alias("cos"), (-F.col("query")).alias("minus"))).alias("best"))
    return best.where(F.col("best.cos") >= floor).select(key, (-F.col("best.minus")).alias("query"), F.least(F.greatest(F.col("best.cos"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def exemplars(candidates: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """key, positive, negative, kept: best cosine with examples of each kind; a tie keeps, and so does no negative."""
    pairs = leading(candidates, examples.select("query", "vector", "kind"), key)
    best = pairs.groupBy(key).agg(F.max(F.when(F.col("kind") == "positive", F.round("cos", 9))).alias("positive"), F.max(F.when(F.col("kind") == "negative", F.round("cos", 9))).alias("negative"))
    return best.withColumn("kept", F.col("positive").isNotNull() & (F.col("negative").isNull() | (F.col("positive") >= F.col("negative"))))


#: Descriptors of the template that a task compares with at a time, and that one pass over the image takes.
BLOCK = 2048
#: Squared distances from matrix products are this exact; what lies closer to a limit is measured directly.
SLACK = 1e-6


def _matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 0))


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, to nine digits."""
    return np.round(np.sqrt(((a - b) ** 2).sum(axis=1)), 9)


def _squares(image: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Squared distances of every row of image and own, by a matrix product."""
    return (image * image).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None, :] - 2 * image @ own.T


def _passes(template: DataFrame):
    """The template's (q, qv) in parts of MAX_QUERIES rows or so, each sorted by q, on the driver: a part is bounded, their number is not."""
    parts = -(-template.count() // MAX_QUERIES) or 1
    for k in range(parts):
        rows = template.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == k).select("q", "qv").where("q IS NOT NULL AND qv IS NOT NULL").orderBy("q").collect()
        if rows:
            yield np.array([r["q"] for r in rows], dtype=np.int64), _matrix([r["qv"] for r in rows])


def nearest(template: DataFrame, image: DataFrame, k: int) -> DataFrame:
    """q, t, distance, rank: of each template descriptor (q, qv) its k nearest image descriptors (t, tv), Euclidean; equal distances by t.

    A task multiplies blocks and keeps k rows a query while it reads, so k rows a query and task are shuffled, not all pairs.
    Distances that decide are measured directly. A template of more than MAX_QUERIES descriptors takes as many passes.
    """
    spark, out = image.sparkSession, None
    for ids, own in _passes(template):
        shared = spark.sparkContext.broadcast((ids, own))  # MAX_QUERIES vectors or so

        def scan(frames, shared=shared):
            ids, own = shared.value
            held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(ids), BLOCK)]
            for frame in frames:
                frame = frame[frame["t"].notna() & frame["tv"].notna()]
                for first in range(0, len(frame), 1024):
                    part = frame.iloc[first : first + 1024]
                    t, vectors = part["t"].to_numpy(dtype=np.int64), _matrix(part["tv"].tolist())
                    for n, at in enumerate(range(0, len(ids), BLOCK)):
                        some = own[at : at + BLOCK]
                        squares = _squares(vectors, some)
                        q, old, d = held[n]
                        limit = np.full(len(some), np.inf)
                        if len(q):  # the k-th distance of queries that have k already
                            counts = np.bincount(q, minlength=len(some))
                            worst = np.zeros(len(some))
                            np.maximum.at(worst, q, d)
                            limit = np.where(counts >= k, worst * worst, np.inf)
                        if len(t) > k:
                            limit = np.minimum(limit, np.partition(squares, k - 1, axis=0)[k - 1])
                        i, j = np.nonzero(squares <= limit + SLACK * (1 + np.abs(np.where(np.isfinite(limit), limit, 0))))
                        q, old, d = np.concatenate((q, j)), np.concatenate((old, t[i])), np.concatenate((d, _direct(vectors[i], some[j])))
                        order = np.lexsort((old, d, q))
                        q, old, d = q[order], old[order], d[order]
                        rank = np.arange(len(q)) - np.searchsorted(q, q, side="left")
                        held[n] = q[rank < k], old[rank < k], d[rank < k]
            for n, at in enumerate(range(0, len(ids), BLOCK)):
                q, t, d = held[n]
                yield pd.DataFrame({"q": ids[at + q], "t": t, "distance": d})

        one = image.select(F.col("t").cast("long").alias("t"), "tv").mapInPandas(scan, "q long, t long, distance double")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "q long, t long, distance double")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "t"))).where(F.col("rank") <= k)


def good_limit(detector: str, ratio: float) -> float:
    """The largest distance of a good match. By detector, at ratio 0.75."""
    return {"orb": 64.0, "akaze": 90.0, "sift": 300.0}[detector] * max(0.25, ratio / 0.75)


def ratio_matches(template: DataFrame, image: DataFrame, ratio: float = 0.9) -> DataFrame:
    """t, q, d1, d2: image descriptors whose nearest template descriptor is near, and clearly nearer than the second one; equal distances by q.

    Each image descriptor is decided in the task that reads it, by matrix products with blocks of the template. Templates of more
    than MAX_QUERIES descriptors are refused.
    """
    few(template)
    parts = list(_passes(template))
    order = np.argsort(np.concatenate([i for i, _ in parts])) if parts else np.zeros(0, int)
    if len(order) < 2:
        return image.sparkSession.createDataFrame([], "t long, q long, d1 double, d2 double")
    shared = image.sparkSession.sparkContext.broadcast((np.concatenate([i for i, _ in parts])[order], np.concatenate([v for _, v in parts])[order]))

    def scan(frames):
        ids, own = shared.value
        for frame in frames:
            frame = frame[frame["t"].notna() & frame["tv"].notna()]
            for first in range(0, len(frame), 256):
                part = frame.iloc[first : first + 256]
                vectors = _matrix(part["tv"].tolist())
                rows, cols = [], []
                limit = np.full(len(part), np.inf)
                for at in range(0, len(ids), BLOCK):
                    squares = _squares(vectors, own[at : at + BLOCK])
                    if squares.shape[1] > 1:
                        limit = np.minimum(limit, np.partition(squares, 1, axis=1)[:, 1])
                    i, j = np.nonzero(squares <= (limit + SLACK * (1 + np.abs(np.where(np.isfinite(limit), limit, 0))))[:, None])
                    rows.append(i)
                    cols.append(j + at)
                i, j = np.concatenate(rows), np.concatenate(cols)
                d = _direct(vectors[i], own[j])
                sort = np.lexsort((j, d, i))
                i, j, d = i[sort], j[sort], d[sort]
                lead = np.searchsorted(i, np.arange(len(part)), side="left")
                yield pd.DataFrame({"t": part["t"].to_numpy(dtype=np.int64), "q": ids[j[lead]], "d1": d[lead], "d2": d[lead + 1]})

    out = image.select(F.col("t").cast("long").alias("t"), "tv").mapInPandas(scan, "t long, q long, d1 double, d2 double")
    return out.where((F.col("d1") <= 0.65) & ((F.col("d1") < ratio * F.col("d2")) | (F.col("d1") < 0.18)))


def centre_votes(votes: DataFrame, side: int, floor: int) -> DataFrame:
    """bx, by, votes and exact medians of cx, cy, scale, angle of bins with `floor` votes or more."""
    bins = votes.groupBy(F.floor(F.col("cx") / side).alias("bx"), F.floor(F.col("cy") / side).alias("by"))
    return bins.agg(F.count(F.lit(1)).alias("votes"), *[F.median(c).alias(c) for c in ("cx", "cy", "scale", "angle")]).where(F.col("votes") >= floor)


def neighbourhood(bins: DataFrame) -> DataFrame:
    """bx, by, support: the votes of each bin and the eight around it."""
    near = F.explode(F.array(*[F.struct((F.col("bx") + i).alias("bx"), (F.col("by") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = bins.select(near.alias("b"), "votes").select("b.bx", "b.by", "votes").groupBy("bx", "by").agg(F.sum("votes").alias("support"))
    return bins.select("bx", "by").join(around, ["bx", "by"])


def dedupe(proposals: DataFrame, cell: int) -> DataFrame:
    """Of the proposals of an orientation and cell the one with most votes, the first by place of equal ones."""
    rank = F.row_number().over(Window.partitionBy("orientation", F.floor(F.col("cx") / cell), F.floor(F.col("cy") / cell)).orderBy(F.col("votes").desc(), "cx", "cy"))
    return proposals.withColumn("rank", rank).where("rank = 1").drop("rank")


def top_proposals(proposals: DataFrame, k: int = 3000) -> DataFrame:
    """The k proposals with most votes, the first by place of equal ones."""
    return proposals.orderBy(F.col("votes").desc(), "cx", "cy", "orientation").limit(k)


def near_points(proposals: DataFrame, points: DataFrame, radius: int, by: tuple[str, ...] = ()) -> DataFrame:
    """proposals (cx, cy) with the points (x, y) of the same `by` values that lie less than `radius` off on both axes, by a grid join."""
    near = F.explode(F.array(*[F.struct((F.floor(F.col("cx") / radius) + i).alias("gx"), (F.floor(F.col("cy") / radius) + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = proposals.withColumn("g__", near).withColumns({"gx__": F.col("g__.gx"), "gy__": F.col("g__.gy")}).drop("g__")
    b = points.withColumns({"gx__": F.floor(F.col("x") / radius), "gy__": F.floor(F.col("y") / radius)})
    inside = (F.abs(F.col("x") - F.col("cx")) < radius) & (F.abs(F.col("y") - F.col("cy")) < radius)
    return a.join(b, [*by, "gx__", "gy__"]).where(inside).drop("gx__", "gy__")


def spread_evenly(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Of each group k rows at even steps of its order, both ends among them; smaller groups stay whole. k: 2 or more."""
    whole = Window.partitionBy(*by)
    ranked = rows.withColumns({"r__": (F.row_number().over(whole.orderBy(*order)) - 1).cast("long"), "of__": F.count(F.lit(1)).over(whole)})
    # Row r is a step if the first step at or beyond it, i, falls on it.
    kept = f"of__ <= {k} or (((r__ * {k - 1} + of__ - 2) div (of__ - 1)) * (of__ - 1)) div {k - 1} = r__"
    return ranked.where(kept).drop("r__", "of__")


def _within(centres: DataFrame, points: DataFrame, radius: int, k: int, carry: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, xi, yi, dx, dy, the carried columns with suffixes _i and _j, rank: of each centre its k nearest points."""
    near = F.explode(F.array(*[F.struct((F.floor(F.col("x") / radius) + i).alias("cx"), (F.floor(F.col("y") / radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    mine, theirs = [F.col(c).alias(f"{c}_i") for c in carry], [F.col(c).alias(f"{c}_j") for c in carry]
    a = centres.select(*by, F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), *mine, near.alias("c")).select(*by, "i", "xi", "yi", *[f"{c}_i" for c in carry], "c.cx", "c.cy")
    b = points.select(*by, F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), *theirs, F.floor(F.col("x") / radius).alias("cx"), F.floor(F.col("y") / radius).alias("cy"))
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    pairs = a.join(b.hint("merge"), [*by, "cx", "cy"]).where((F.col("i") != F.col("j")) & (dx * dx + dy * dy <= radius * radius))
    pairs = pairs.select(*by, "i", "j", "xi", "yi", dx.alias("dx"), dy.alias("dy"), *[f"{c}_{s}" for s in "ij" for c in carry])
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"), "j"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def neighbour_pairs(points: DataFrame, radius: int, k: int, carry: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """i, j, xi, yi, dx, dy: of each point (id, x, y) its k nearest others of the same `by` values within the radius, by grid joins.

    The first look goes as far as about 3 * k points lie, by the density of the points, and the next ones twice as far each. A point that
    has k others within a look is done with these; only the rest look further, so comparisons grow with the points, not with their density.
    """
    area = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    dense = points.groupBy(*by).agg((F.count(F.lit(1)) / area).alias("d")).agg(F.max("d")).first()[0] or 1.0
    near, rest, out = max(1, math.ceil(math.sqrt(3 * k / (math.pi * dense)))), points, None
    while 2 * near <= radius:
        found = written(_within(rest, points, near, k, carry, by), "neighbours")
        done = written(found.where(F.col("rank") == k).select(F.col("i").alias("done")), "neighbours-done")
        first = found.join(done, found["i"] == done["done"], "left_semi")
        out = first if out is None else out.unionByName(first)
        rest = written(rest.join(done, rest["id"] == done["done"], "left_anti"), "neighbours-rest")
        near *= 2
    last = _within(rest, points, radius, k, carry, by)
    return (last if out is None else out.unionByName(last)).drop("rank")


#: Points of a tile about which pairs are made at a time, the longest sides of a tile and of a template that is correlated, rows of a template's counted
#: pairs that are sent to tasks, and products of counts up to which these are added one by one.
TILE_POINTS, TILE_SIDE, TEMPLATE_SIDE, TEMPLATE_ROWS, ONE_BY_ONE = 100_000, 512, 1024, 4_000_000, 200_000


def _tile_side(points: DataFrame, radius: int, k: int, by: tuple[str, ...]) -> int | None:
    """The side of tiles of about TILE_POINTS points; None where places aren't whole numbers or points lie so far apart that a grid join finds neighbours sooner."""
    whole = ("tinyint", "smallint", "int", "bigint")
    if any(dict(points.dtypes)[c] not in whole for c in ("id", "word", "x", "y")):
        return None
    area = (F.max("x") - F.min("x") + 1).cast("double") * (F.max("y") - F.min("y") + 1)
    dense = points.groupBy(*by).agg((F.count(F.lit(1)) / area).alias("d")).agg(F.max("d")).first()[0]
    if not dense or dense * math.pi * radius * radius < k:
        return None
    return int(min(TILE_SIDE, max(64, math.sqrt(TILE_POINTS / dense))))


def _tiled(points: DataFrame, side: int, radius: int, by: tuple[str, ...]) -> DataFrame:
    """points with tx, ty of each tile that they lie in or less than the radius off."""
    rows = points.where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    rows = rows.select(*by, *[F.col(c).cast("long").alias(c) for c in ("id", "x", "y")], F.coalesce(F.col("word").cast("long"), F.lit(0)).alias("word"), F.col("word").isNotNull().alias("named"))
    for c in ("x", "y"):
        rows = rows.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(c) - radius) / side), F.floor((F.col(c) + radius) / side))))
    return rows


def _rings(radius: int) -> list[tuple[int, np.ndarray]]:
    """(squared distance, offsets dy, dx) of whole numbers within the radius, the nearest first."""
    dy, dx = (a.ravel() for a in np.mgrid[-radius : radius + 1, -radius : radius + 1])
    far = dy * dy + dx * dx
    return [(int(d), np.column_stack((dy, dx))[far == d]) for d in np.unique(far[far <= radius * radius])]


def _tile_pairs(frame: pd.DataFrame, left: int, top: int, side: int, radius: int, k: int, quantum: int) -> np.ndarray:
    """wi, wj, qx, qy, x, y (columns) of the pairs of a tile's points with their k nearest within the radius, equal distances by id; frame has those around it too."""
    order = np.lexsort((frame["id"], frame["x"], frame["y"]))
    ids, word, named, x, y = (frame[c].to_numpy()[order] for c in ("id", "word", "named", "x", "y"))
    wide = side + 2 * radius
    at = (y - top + radius) * wide + (x - left + radius)
    place, first, count = np.unique(at, return_index=True, return_counts=True)
    starts, counts = np.zeros(wide * wide, np.int64), np.zeros(wide * wide, np.int64)
    starts[place], counts[place] = first, count
    py, px = place // wide - radius, place % wide - radius
    core = np.nonzero((py >= 0) & (py < side) & (px >= 0) & (px < side))[0]
    # A place's k + 1 nearest points, itself included, are those of all its points.
    active, found, parts = core, np.zeros(len(core), np.int64), []
    slot = np.arange(len(core))
    for far, offsets in _rings(radius):
        if not len(active):
            break
        for dy, dx in offsets:
            there = place[active] + dy * wide + dx
            some = np.nonzero(counts[there])[0]
            parts.append((slot[some], np.full(len(some), far), starts[there[some]], np.minimum(counts[there[some]], k + 1)))
            found[slot[some]] += counts[there[some]]
        more = found[slot] <= k
        active, slot = active[more], slot[more]
    if not parts:
        return np.zeros((0, 6), np.int64)
    who, far, start, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    rows = np.repeat(np.arange(len(n)), n)
    point = start[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    who, far = who[rows], far[rows]
    sort = np.lexsort((ids[point], far, who))
    who, point = who[sort], point[sort]
    rank = np.arange(len(who)) - np.searchsorted(who, who, side="left")
    near = np.full((len(core), k + 1), -1, np.int64)
    near[who[rank <= k], rank[rank <= k]] = point[rank <= k]
    # Each point takes its place's list less itself, k of it.
    of = np.repeat(np.arange(len(core)), count[core])
    own = first[core][of] + np.arange(len(of)) - np.repeat(np.cumsum(count[core]) - count[core], count[core])
    others = near[of]
    good = (others >= 0) & (others != own[:, None])
    good &= np.cumsum(good, axis=1) <= k
    good &= named[own][:, None]
    i, j = np.nonzero(good)
    a, b = own[i], others[i, j]
    a, b = a[named[b]], b[named[b]]
    q = lambda d: np.rint(d / quantum).astype(np.int64)
    return np.column_stack((word[a], word[b], q(x[b] - x[a]), q(y[b] - y[a]), x[a], y[a]))


def _counted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows, sorted, and how often each occurs."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return rows[new], np.diff(np.append(np.nonzero(new)[0], len(rows)))


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key starts in sorted rows of keys, and all ends."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    starts = np.nonzero(new)[0]
    return starts, np.append(starts[1:], len(keys))[: len(starts)]


def _offsets(image: np.ndarray, weights: np.ndarray, own: np.ndarray, times: np.ndarray, left: int, top: int, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ox, oy, n: how many pairs of an image's tile and the template, of one key, lie that far apart. Rows: key of four, x, y, sorted.

    Keys of few products add them one by one; of many, by a correlation of their counts (FFT), which is exact while rounding is far below a half.
    """
    tx, ty = own[:, 4].min(), own[:, 5].min()
    high, wide = side + int(own[:, 5].max() - ty), side + int(own[:, 4].max() - tx)
    # Place of an offset: oy - (top - last ty), ox - (left - last tx).
    total, spectrum, doubt = np.zeros(high * wide), None, 0.0
    starts, ends = _spans(own[:, :4])
    keys = {tuple(own[a, :4].tolist()): (a, b) for a, b in zip(starts, ends, strict=True)}
    for a, b in zip(*_spans(image[:, :4]), strict=True):
        c, d = keys.get(tuple(image[a, :4].tolist()), (0, 0))
        if c == d:
            continue
        ix, iy, jx, jy = image[a:b, 4] - left, image[a:b, 5] - top, own[c:d, 4] - tx, own[c:d, 5] - ty
        error = float(np.sqrt((weights[a:b].astype(float) ** 2).sum() * (times[c:d].astype(float) ** 2).sum())) * 1e-13
        if (b - a) * (d - c) > ONE_BY_ONE and doubt + error < 0.1:
            p, q = np.zeros((high, wide)), np.zeros((high, wide))
            p[iy, ix], q[high - side - jy, wide - side - jx] = weights[a:b], times[c:d]  # the template turned about
            product = np.fft.rfft2(p) * np.fft.rfft2(q)
            spectrum, doubt = product if spectrum is None else spectrum + product, doubt + error
            continue
        flat, back = iy * wide + ix, (high - side - jy) * wide + (wide - side - jx)
        step = max(1, 4_000_000 // (d - c))
        for s in range(0, b - a, step):
            total += np.bincount((flat[s : s + step, None] + back[None]).ravel(), (weights[a:b][s : s + step, None] * times[c:d][None]).ravel(), minlength=len(total))
    if spectrum is not None:
        total += np.rint(np.fft.irfft2(spectrum, (high, wide))).ravel()
    some = np.nonzero(total)[0]
    return some % wide - (wide - side) + left - tx, some // wide - (high - side) + top - ty, total[some].astype(np.int64)


def _counted_offsets(template: DataFrame, image: DataFrame, radius: int, k: int, quantum: int, by: tuple[str, ...]) -> DataFrame | None:
    """ox, oy, n, by columns: the votes of pair_votes, counted by offset, tile by tile; None where places are not whole numbers, or far apart, or the template is too large.

    A tile's points come with those around it, so their pairs are made, counted and compared in one task: pairs are never shuffled.
    """
    spark, side = image.sparkSession, _tile_side(image, radius, k, by)
    own_side = _tile_side(template, radius, k, ())
    if side is None or own_side is None:
        return None
    names = ["wi", "wj", "qx", "qy", "x", "y"]

    def pairs_of(key, frame: pd.DataFrame) -> pd.DataFrame:
        rows, n = _counted(_tile_pairs(frame, int(key[0]) * own_side, int(key[1]) * own_side, own_side, radius, k, quantum))
        return pd.DataFrame(rows, columns=names).assign(n=n)

    counted = written(_tiled(template, own_side, radius, ()).groupBy("tx", "ty").applyInPandas(pairs_of, ", ".join(f"{c} long" for c in [*names, "n"])), "template-pairs")
    size, width, height = counted.agg(F.count(F.lit(1)), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    if size > TEMPLATE_ROWS or size and max(width, height) > TEMPLATE_SIDE:
        return None
    schema = ", ".join([*[f"{c} {dict(image.dtypes)[c]}" for c in by], "ox long", "oy long", "n long"])
    if not size:
        return spark.createDataFrame([], schema)
    arrow = counted.orderBy(*names).toArrow()  # TEMPLATE_ROWS at most
    shared = spark.sparkContext.broadcast((np.column_stack([arrow[c].to_numpy() for c in names]), arrow["n"].to_numpy()))
    asked = len(by)

    def votes_of(key, frame: pd.DataFrame) -> pd.DataFrame:
        left, top = int(key[asked]) * side, int(key[asked + 1]) * side
        ox, oy, n = _offsets(*_counted(_tile_pairs(frame, left, top, side, radius, k, quantum)), *shared.value, left, top, side)
        return pd.DataFrame({**{c: [key[i]] * len(n) for i, c in enumerate(by)}, "ox": ox, "oy": oy, "n": n})

    return _tiled(image, side, radius, by).groupBy(*by, "tx", "ty").applyInPandas(votes_of, schema)


def pair_votes(template: DataFrame, image: DataFrame, radius: int, k: int, quantum: int, bin_side: int, floor: int, by: tuple[str, ...] = ()) -> DataFrame:
    """ox, oy, votes, score, by columns: places where template pairs recur in the image (by: columns of the image's points that tell images apart).

    Both tables: id, word, x, y. A pair is the words of two neighbours and their quantised offset; it votes for the offset of
    the image's point from the template's. Where points lie dense, at whole numbers, all of it is counted by tiles.
    """

    def hashed(points: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        q = lambda c: F.rint(F.col(c) / quantum).cast("long")
        pairs = neighbour_pairs(points, radius, k, ("word",), by)
        return pairs.select(*by, F.col("word_i").alias("wi"), F.col("word_j").alias("wj"), q("dx").alias("qx"), q("dy").alias("qy"), F.col("xi").alias(f"{name}x"), F.col("yi").alias(f"{name}y"))

    counted = _counted_offsets(template, image, radius, k, quantum, by)
    if counted is None:
        joined = hashed(image, "p", by).join(hashed(template, "t"), ["wi", "wj", "qx", "qy"])
        ox, oy = F.col("px") - F.col("tx"), F.col("py") - F.col("ty")
        counted = joined.select(*by, ox.alias("ox"), oy.alias("oy"), F.lit(1).cast("long").alias("n"))
    # Equal offsets are counted where they arise; exact medians then weigh a row an offset, not a row a vote.
    counted = counted.groupBy(*by, "ox", "oy").agg(F.sum("n").alias("n"))
    votes = counted.groupBy(*by, F.rint(F.col("ox") / bin_side).cast("long").alias("bx"), F.rint(F.col("oy") / bin_side).cast("long").alias("by"))
    found = votes.agg(F.sum("n").alias("votes"), F.percentile("ox", 0.5, F.col("n")).alias("ox"), F.percentile("oy", 0.5, F.col("n")).alias("oy")).where(F.col("votes") >= floor)
    return found.select(*by, "ox", "oy", "votes", F.least(F.lit(1.0), F.col("votes") / (2.0 * floor)).alias("score"))
