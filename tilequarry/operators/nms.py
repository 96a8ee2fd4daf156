"""Exact greedy non-maximum suppression over a box relation, and its building blocks.

A box stays if no box of higher rank that stays overlaps it by more than the limit. Pairs come from an equi-join on the cells
of grids by size class. Boxes are then decided in rounds: one that a kept box suppresses goes, one whose suppressors are all
gone stays. Each round is one pass over the undecided edges, written to the shared folder; what a few rounds leave is decided
by connected component.
"""

from __future__ import annotations

import atexit
import math
import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.functions.geometry import iou

LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the session's checkpoint folder; what is written there goes with the driver's process.

    LOCAL_CHECKPOINTS is used on one machine only.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = f"{(shared or LOCAL_CHECKPOINTS).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, where)
    return where


def written(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder."""
    where = folder(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def drop(*tables: DataFrame) -> None:
    """Delete tables that written() made."""
    for t in tables:
        for where in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            _remove(t.sparkSession, where)


def _remove(spark: SparkSession, where: str) -> None:
    try:
        if not spark._jsc.sc().isStopped():
            path = spark._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass


def rank_key() -> list[Column]:
    """The total order of matches: score, then place and size, then id."""
    return [F.col("score").desc(), F.col("y"), F.col("x"), F.col("w"), F.col("h"), F.col("id")]


def precedes(a: str, b: str) -> Column:
    """Whether box a ranks before box b."""
    order = lambda p: F.struct(-F.col(f"{p}.score"), F.col(f"{p}.y"), F.col(f"{p}.x"), F.col(f"{p}.w"), F.col(f"{p}.h"), F.col(f"{p}.id"))
    return order(a) < order(b)


#: Class k holds boxes whose longer side is BASE^k or more and under BASE^(k + 1); the last one, all larger ones.
BASE, LAST = 4, 24


@dataclass(frozen=True)
class Sizes:
    """The size classes that occur, with the longest side and the number of boxes of each, and the longest width and height."""

    sides: dict[int, float]
    counts: dict[int, int]
    spans: dict[int, tuple[float, float]] = field(default_factory=dict)

    @staticmethod
    def of(*tables: DataFrame) -> Sizes:
        """By one aggregate of each table; a class a row."""
        sides: dict[int, float] = {}
        counts: dict[int, int] = {}
        spans: dict[int, tuple[float, float]] = {}
        for t in tables:
            for r in t.groupBy(_class(0, LAST).alias("k")).agg(F.greatest(F.max("w"), F.max("h"), F.lit(1)).alias("side"), F.max("w").alias("w"), F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).collect():
                sides[r["k"]], counts[r["k"]] = max(sides.get(r["k"], 1.0), float(r["side"] or 1)), counts.get(r["k"], 0) + r["n"]
                spans[r["k"]] = _longest([spans.get(r["k"], (1.0, 1.0)), (float(r["w"] or 1), float(r["h"] or 1))])
        return Sizes(sides, counts, spans)

    def with_(self, other: Sizes) -> Sizes:
        """Of both tables' boxes."""
        every = self.sides.keys() | other.sides.keys()
        return Sizes({k: max(self.sides.get(k, 1.0), other.sides.get(k, 1.0)) for k in every}, {k: self.counts.get(k, 0) + other.counts.get(k, 0) for k in every}, {k: _longest([s.spans[k] for s in (self, other) if k in s.spans]) for k in self.spans.keys() | other.spans.keys()})

    def cell(self, k: int, span: int, limit: float | None) -> tuple[float, float]:
        """Width and height of the cells of a class's grid: its longest side or, for boxes that overlap by more than limit, less.

        Such boxes share more than limit of the longer width and of the longer height, so their corners are less than 1 - limit of these apart.
        """
        if limit is None:
            return self.sides[k], self.sides[k]
        w, h = _longest([self.spans[c] for c in self.spans if k - span <= c <= k])
        part = max(1 - limit, 0.01) * (1 + 1e-9)
        return w * part, h * part

    def size_class(self) -> Column:
        return _class(min(self.sides, default=0), max(self.sides, default=0)).alias("class")


def _longest(spans: list[tuple[float, float]]) -> tuple[float, float]:
    return max(w for w, _ in spans), max(h for _, h in spans)


def _class(first: int, last: int) -> Column:
    side = F.greatest("w", "h").cast("double")
    return sum((F.when(side >= float(BASE) ** k, 1).otherwise(0) for k in range(first + 1, last + 1)), F.lit(first))


def class_span(limit: float) -> int:
    """How many classes apart boxes can be that overlap above the limit: their longer sides differ by less than 1 / limit."""
    return LAST if limit <= 0 else math.ceil(math.log(1 / min(limit, 1.0), BASE) + 1 - 1e-9) - 1


def grid_cells(sizes: Sizes, span: int, *, half: bool, limit: float | None = None) -> tuple[Column, Column]:
    """(probes, stored): arrays of cells (cx, cy, own, apart) of a box, by its class. Two boxes that may meet share one of them.

    A class's grid has cells as large as its longest side or, if only overlaps above a limit count, as far as these reach (Sizes.cell). A box is stored in its class's grid under its class as tier, and looks
    there at its own cell and, with half, at half of those around it. Of two classes the one with fewer boxes looks at nine cells of the larger ones' grid; where that is the larger
    class, the smaller boxes are stored in that grid too. Boxes of classes further apart than `span` never meet. cx
    holds grid and tier in its last ten bits, so that two numbers are the key.
    """
    none = F.array().cast("array<struct<cx:long,cy:long,own:boolean,apart:boolean>>")
    probes, stored = none, none
    kind, around = F.col("class"), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]

    def cell(grid: int, tier: int, i: int, j: int, apart: bool = False) -> Column:
        width, height = sizes.cell(grid, span, limit)
        return F.struct(((F.floor(F.col("x") / width) + i) * 1024 + (grid * 32 + tier)).alias("cx"), (F.floor(F.col("y") / height) + j).alias("cy"), F.lit((i, j) == (0, 0) and not apart).alias("own"), F.lit(apart).alias("apart"))

    counts = sizes.counts
    near = [(k, c) for k in counts for c in counts if c < k <= c + span]  # larger, smaller
    larger_looks = {(k, c) for k, c in near if counts[k] <= counts[c]}
    for c in counts:
        looks = [cell(c, c, i, j) for i, j in (((0, 0), (0, 1), (1, -1), (1, 0), (1, 1)) if half else around)]
        looks += [cell(k, k, i, j, True) for k, small in near if small == c and (k, c) not in larger_looks for i, j in around]
        looks += [cell(c, small, i, j, True) for k, small in near if k == c and (c, small) in larger_looks for i, j in around]
        lies = [cell(c, c, 0, 0)] + [cell(k, c, 0, 0) for k, small in near if small == c and (k, c) in larger_looks]
        probes, stored = F.when(kind == c, F.array(*looks)).otherwise(probes), F.when(kind == c, F.array(*lies)).otherwise(stored)
    return probes, stored


def pairs(boxes: DataFrame, limit: float, by: tuple[str, ...] = (), apart: Column | None = None) -> DataFrame:
    """(hi, lo, iou) of overlaps above the limit (0 or more) within the same `by` values; hi ranks first. apart: only pairs that differ in it.

    Boxes meet by an equi-join on the cells of their size class's grid, so a few large boxes among many small ones share no
    cells with these: overlap above the limit needs like sides.
    """
    if limit < 0:
        raise ValueError("the limit of overlaps is 0 or more")
    sizes = Sizes.of(boxes)
    probes, stored = grid_cells(sizes, class_span(limit), half=True, limit=limit)
    boxes = boxes if apart is None else boxes.withColumn("apart__", apart)
    cols = ["id", "x", "y", "w", "h", "score", *by, *([] if apart is None else ["apart__"])]
    classed = boxes.select(*cols, sizes.size_class())
    keys = ["cx", "cy"]
    a = classed.select(*cols, F.explode(probes).alias("c")).select(*cols, "c.cx", "c.cy", "c.own").alias("a")
    b = classed.select(*cols, F.explode(stored).alias("c")).select(*cols, "c.cx", "c.cy").alias("b")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for k in by:
        cond = cond & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    if apart is not None:
        cond = cond & (F.col("a.apart__") != F.col("b.apart__"))
    # Of two boxes of one class in one cell the smaller id leads; in different cells one has the other ahead.
    cond = cond & (~F.col("a.own") | (F.col("a.id") < F.col("b.id")))
    for p, side in (("x", "w"), ("y", "h")):  # boxes that don't meet are told apart before areas are divided
        cond = cond & (F.col(f"a.{p}") < F.col(f"b.{p}") + F.col(f"b.{side}")) & (F.col(f"b.{p}") < F.col(f"a.{p}") + F.col(f"a.{side}"))
    side_of = lambda p: tuple(F.col(f"{p}.{n}") for n in "xywh")
    overlap = iou(side_of("a"), side_of("b"))
    first = F.when(F.col("a.score") != F.col("b.score"), F.col("a.score") > F.col("b.score")).otherwise(precedes("a", "b"))
    # Both sides are shuffled by cell, whatever their estimated size: one task of a broadcast join would do all comparisons of its file.
    met = a.join(b.hint("merge"), cond & (overlap > limit)).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), first.alias("first"), overlap.alias("iou"))
    return met.select(F.when(F.col("first"), F.col("i")).otherwise(F.col("j")).alias("hi"), F.when(F.col("first"), F.col("j")).otherwise(F.col("i")).alias("lo"), "iou")


#: Rounds before what is left is looked at by component, and edges of a component that one task resolves.
ROUNDS, COMPONENT = 4, 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of the ends of edges (a, b), by alternating stars: rounds grow with the logarithm of a component's size.

    In a round every node's larger neighbours are linked to its least one, then its smaller neighbours and itself. Each round is
    a written table, and the one before is deleted.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    before = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where(F.col("b") > F.col("n")).select(F.col("b").alias("b"), F.col("m").alias("a")).where("a <> b").distinct()
        lower = large.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("m"))
        small = large.join(lower, large["b"] == lower["n"]).select(F.explode(F.array("a", "b")).alias("b"), "m").where("b <> m").select(F.col("m").alias("a"), "b").distinct()
        after = written(small, "stars")
        drop(left)
        state = after.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        left = after
        if state == before:
            break
        before = state
    return left.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(left.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _resolve(frame: pd.DataFrame) -> pd.DataFrame:
    """The lo ends that go, of the edges of one component: a box stays once all that could suppress it are gone."""
    below: dict[int, list[int]] = {}
    waiting: dict[int, int] = {}
    for hi, lo in zip(frame["hi"].tolist(), frame["lo"].tolist(), strict=True):
        below.setdefault(hi, []).append(lo)
        waiting[lo] = waiting.get(lo, 0) + 1
    gone: set[int] = set()
    decided = [(k, True) for k in below if k not in waiting]
    while decided:
        box, stays = decided.pop()
        for lo in below.get(box, ()):
            if lo in gone:
                continue
            waiting[lo] -= 1
            if stays:
                gone.add(lo)
                decided.append((lo, False))
            elif not waiting[lo]:
                decided.append((lo, True))
    return pd.DataFrame({"id": np.fromiter(gone, dtype=np.int64, count=len(gone))})


def _round(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what goes, the edges left): of the boxes still in an edge, those that nothing suppresses stay; what they suppress goes."""
    heads = edges.select(F.col("hi").alias("id")).distinct().join(edges.select(F.col("lo").alias("id")), "id", "left_anti")
    out = written(edges.join(heads, edges.hi == heads.id, "left_semi").select(F.col("lo").alias("id")).distinct(), "nms-gone")
    ends = out.unionByName(heads)
    return out, written(edges.join(out, edges.lo == out.id, "left_anti").join(ends, edges.hi == ends.id, "left_anti"), "nms-edges")


def suppressed(edges: DataFrame, rounds: int = ROUNDS, largest: int = COMPONENT) -> DataFrame | None:
    """id of the boxes that greedy suppression along edges (hi, lo) removes; None if there are none.

    A few rounds decide ordinary data. Of what is left, chains and thickets, each connected component of up to `largest` edges is
    decided by one task; larger ones go on by rounds. Tables of a round are deleted after the next one.
    """
    gone, n = [], 0
    edges = written(edges.select("hi", "lo"), "nms-edges")
    while not edges.isEmpty():
        if n == rounds:
            named = written(components(edges.select(F.col("hi").alias("a"), F.col("lo").alias("b"))), "nms-components")
            placed = written(edges.join(named, edges.hi == named.id).select("hi", "lo", "component"), "nms-placed")
            few = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= largest).select("component")
            gone.append(written(placed.join(few, "component", "left_semi").groupBy("component").applyInPandas(_resolve, "id long"), "nms-gone"))
            rest = written(placed.join(few, "component", "left_anti").select("hi", "lo"), "nms-edges")
        else:
            out, rest = _round(edges)
            gone.append(out)
            if len(gone) > 16:  # fold: the plan stays small however many rounds there are
                whole = gone[0]
                for g in gone[1:]:
                    whole = whole.unionByName(g)
                folded = written(whole, "nms-gone")
                drop(*gone)
                gone = [folded]
        drop(edges)
        edges, n = rest, n + 1
    whole = None
    for g in gone:
        whole = g if whole is None else whole.unionByName(g)
    return whole


#: Boxes in a box's cell up to which all are taken at once, how many times as many the batches up to one hold as those before it, and
#: boxes of a table up to which its density is not looked at.
LOAD, GROWTH, FEW = 32, 4, 20_000


def load(boxes: DataFrame, sizes: Sizes, by: tuple[str, ...] = ()) -> float:
    """How many boxes a box finds in its cell of its size class's grid, itself included, on average."""
    side = _of_class({k: F.lit(v) for k, v in sizes.sides.items()})
    cells = boxes.groupBy(F.col("class"), F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy"), *by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def shares_of(whole: float) -> list[float]:
    """The shares of all boxes up to which batches go, but for the last one, where boxes find `whole` others in their cells."""
    shares, share = [], LOAD / max(whole, 1e-9)
    while share < 1:
        shares.append(share)
        share *= GROWTH
    return shares


def cuts(boxes: DataFrame, key: Column, shares: list[float]) -> list[float]:
    """About the values of a column below which these shares of the rows lie, ascending and different."""
    found = boxes.agg(F.percentile_approx(key.cast("double"), [float(s) for s in shares], int(min(1_000_000, max(10_000, 50 / shares[0]))))).first()[0] or []
    return sorted({v for v in found if not math.isnan(v)})


def _of_class(by_class: dict[int, Column]) -> Column:
    out = F.lit(None)
    for k, v in by_class.items():
        out = F.when(F.col("class") == k, v).otherwise(out)
    return out


def uncovered(boxes: DataFrame, kept: DataFrame, limit: float, sizes: Sizes, by: tuple[str, ...] = ()) -> DataFrame:
    """The boxes that none of `kept` overlaps above the limit within the same `by` values. sizes: of both tables' boxes.

    A box lies in one cell, so it is shuffled once; those of `kept`, which are few in any place, look at the cells around them.
    Boxes meet those of their class or a smaller one in their own grid, then, if they are left, those of larger classes in these' grids.
    """
    classes, span = sorted(sizes.sides), class_span(limit)
    for apart in range(min(span, classes[-1] - classes[0]) + 1 if classes else 0):
        met = [(c, k) for c in classes for k in classes if (k == c + apart if apart else 0 <= c - k <= span)]
        if not met:
            continue
        side = _of_class({c: F.lit(sizes.sides[c + apart]) for c in {c for c, _ in met}})
        grids = _of_class({k: F.array(*[F.struct(F.lit(sizes.sides[max(c, k)]).alias("side"), F.lit(c).alias("tier")) for c, other in met if other == k]) for k in {k for _, k in met}})
        lies = boxes.withColumn("class", sizes.size_class()).withColumns({"cx__": F.floor(F.col("x") / side), "cy__": F.floor(F.col("y") / side)}).alias("a")
        looks = kept.withColumn("class", sizes.size_class()).select("x", "y", "w", "h", *by, F.explode(grids).alias("g"))
        for p, size, cell in (("x", "w", "cx__"), ("y", "h", "cy__")):
            first = F.floor(F.col(p) / F.col("g.side"))
            looks = looks.withColumn(cell, F.explode(F.sequence(first - 1, F.greatest(first, F.floor((F.col(p) + F.col(size)) / F.col("g.side"))))))
        looks = looks.select("x", "y", "w", "h", *by, F.col("g.tier").alias("class"), "cx__", "cy__").alias("b")
        same = iou(tuple(F.col(f"a.{n}") for n in "xywh"), tuple(F.col(f"b.{n}") for n in "xywh")) > limit
        for k in ("class", "cx__", "cy__"):
            same = same & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        for k in by:
            same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        boxes = lies.join(looks.hint("merge"), same, "left_anti").drop("class", "cx__", "cy__")
    return boxes


def nms(boxes: DataFrame, limit: float, by: tuple[str, ...] = ()) -> DataFrame:
    """The boxes that stay, all columns. boxes: id (unique), x, y, w, h, score and more. A limit below 0 keeps the best box of a group.

    Where boxes are dense, pairs grow with the square of their number, but what stays does not. So boxes go by batches in order of
    score, each several times as large as those before it together: what earlier batches kept removes most of a batch, and only its
    rest is paired. Boxes of one score are never parted. boxes is read once a batch.
    """
    if limit < 0:
        best = boxes.groupBy(*by).agg(F.min_by("id", F.struct((-F.col("score")).alias("score"), "y", "x", "w", "h", "id")).alias("id"))
        return boxes.join(best.select("id"), "id", "left_semi")
    sizes = Sizes.of(boxes)
    shares = shares_of(load(boxes.select("x", "y", *by, sizes.size_class()), sizes, by)) if sum(sizes.counts.values()) > FEW else []
    scores = cuts(boxes, -F.col("score"), shares) if shares else []
    if not scores:
        gone = suppressed(pairs(boxes, limit, by))
        return boxes if gone is None else boxes.join(gone, "id", "left_anti")
    # A score that is null or no number ranks first, as in pairs().
    batch = sum((F.when(-F.col("score") > c, 1).otherwise(0) for c in scores), F.lit(0))
    batch = F.when(F.col("score").isNull() | F.isnan("score"), 0).otherwise(batch)
    kept = None
    for k in range(len(scores) + 1):
        own = boxes.where(batch == k)
        left = written(own if kept is None else uncovered(own, kept, limit, sizes, by), "nms-left")
        gone = suppressed(pairs(left, limit, by))
        if gone is not None:
            left = written(left.join(gone, "id", "left_anti"), "nms-kept")
        kept = left if kept is None else kept.unionByName(left)
    return kept


def top(boxes: DataFrame, k: int) -> DataFrame:
    """The k best matches in order."""
    return boxes.orderBy(*rank_key()).limit(k)
