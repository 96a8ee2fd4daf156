"""Dense template scores as relations: every window position joined with every template pixel, per variant and channel.

A variant is one template to search: an orientation, a scale or a masked form. Sums stay whole numbers of 0..255 units until
the last expression, so results don't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-6
FLAT = 1e-3
METHODS = ("ncc", "ssd", "ccorr")
#: A template beyond this many pixels goes by tiles (tilescan), not by this join.
MAX_TEMPLATE = 1 << 16


def luminance(r: Column, g: Column, b: Column) -> Column:
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255.0


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """BT.601 full range, clamped and rounded half to even."""
    whole = lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0))).cast("int")
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb = -0.168736 * r - 0.331264 * g + 0.5 * b + 128.0
    cr = 0.5 * r - 0.418688 * g - 0.081312 * b + 128.0
    return whole(y), whole(cb), whole(cr)


def scores(pixels: DataFrame, template: DataFrame, method: str = "ncc", weights: dict[str, float] | None = None) -> DataFrame:
    """variant, x, y, score of every full window.

    pixels: x, y, c (channel), v (0..255). template: variant, tx, ty, c, t. weights: by channel, their sum is 1.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if template.limit(MAX_TEMPLATE + 1).count() > MAX_TEMPLATE:
        raise ValueError("a template this large is searched by tiles")
    sized = template.groupBy("variant", "c").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t1"), F.sum(F.col("t") * F.col("t")).alias("t2"))
    sums = (
        pixels.join(F.broadcast(template), "c")
        .groupBy("variant", "c", (F.col("x") - F.col("tx")).alias("x"), (F.col("y") - F.col("ty")).alias("y"))
        .agg(F.count(F.lit(1)).alias("seen"), F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"), F.sum(F.col("v") * F.col("t")).alias("st"))
        .join(F.broadcast(sized), ["variant", "c"])
        .where("seen = n")
    )
    share = F.coalesce(*[F.when(F.col("c") == c, F.lit(float(w))) for c, w in (weights or {}).items()], F.lit(0.0 if weights else 1.0))
    n = F.col("n").cast("double")
    unit = 255.0 * 255.0
    cross = (n * F.col("st") - F.col("s1") * F.col("t1")) / n / unit
    spread = (n * F.col("s2") - F.col("s1") * F.col("s1")) / n / unit
    own = (n * F.col("t2") - F.col("t1") * F.col("t1")) / n / unit
    per_window = sums.groupBy("variant", "x", "y").agg(
        F.sum(share * cross).alias("cross"),
        F.sum(share * F.sqrt(F.greatest(spread, F.lit(0.0))) * F.sqrt(F.greatest(own, F.lit(0.0)))).alias("norms"),
        F.max(F.when(spread < FLAT * n, 0).otherwise(1)).alias("varied"),
        F.sum(share * F.col("st") / unit).alias("raw"),
        F.sum(share * F.col("s2") / unit).alias("image2"),
        F.sum(share * F.col("t2") / unit).alias("template2"),
        F.sum(share * F.greatest(F.col("s2") - 2 * F.col("st") + F.col("t2"), F.lit(0)) / unit).alias("squares"),
        F.sum(share * n).alias("cells"),
    )
    score = {
        "ncc": F.when(F.col("varied") == 0, F.lit(0.0)).otherwise(F.col("cross") / (F.col("norms") + EPSILON)),
        "ccorr": F.col("raw") / (F.sqrt("image2") * F.sqrt("template2") + EPSILON),
        "ssd": 1.0 - F.sqrt(F.col("squares") / F.col("cells")),
    }[method]
    return per_window.select("variant", "x", "y", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def box_sums(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """x, y, total of every full window, by a running sum over rows, then one over columns."""
    from pyspark.sql import Window

    rows = Window.partitionBy("y").orderBy("x").rangeBetween(0, width - 1)
    part = pixels.select("x", "y", F.sum("v").over(rows).alias("part"), F.count(F.lit(1)).over(rows).alias("n")).where(F.col("n") == width)
    columns = Window.partitionBy("x").orderBy("y").rangeBetween(0, height - 1)
    return part.select("x", "y", F.sum("part").over(columns).alias("total"), F.count(F.lit(1)).over(columns).alias("n")).where(F.col("n") == height).drop("n")


def local_maxima(scored: DataFrame, width: int, height: int, floor: float) -> DataFrame:
    """Cells at or above the floor that reach the largest score around them; an even side looks one cell further back."""
    from pyspark.sql import Window

    across = Window.partitionBy("y").orderBy("x").rangeBetween(-(width // 2), width - 1 - width // 2)
    down = Window.partitionBy("x").orderBy("y").rangeBetween(-(height // 2), height - 1 - height // 2)
    best = scored.withColumn("row_best", F.max("score").over(across)).withColumn("best", F.max("row_best").over(down))
    return best.where((F.col("score") >= floor) & (F.col("score") >= F.col("best"))).select(*scored.columns)


def pooled(pixels: DataFrame, whole: bool = True) -> DataFrame:
    """The next pyramid level: means of 2 x 2 cells, odd edges dropped; whole: (sum + 2) >> 2, else the plain mean."""
    v = F.shiftright(F.sum("v") + 2, 2) if whole else F.avg("v")
    return pixels.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(v.alias("v"), F.count(F.lit(1)).alias("n")).where("n = 4").drop("n")


def resampled(template: DataFrame, w: int, h: int, new_w: int, new_h: int) -> DataFrame:
    """tx, ty, c, t of a w x h template (tx, ty, c, t: whole numbers) at another size: bilinear, pixel centres aligned at the edges, rounded half up.

    Whole numbers only: a pixel's place is counted in halves of a new pixel, its four neighbours meet it by an equi-join.
    """
    tx, ty = (F.col("id") % new_w).alias("tx"), F.floor(F.col("id") / new_w).alias("ty")
    place = lambda at, size, new: F.greatest(F.lit(0), F.least((2 * F.col(at) + 1) * size - new, F.lit((size - 1) * 2 * new))).cast("long")
    grid = template.sparkSession.range(new_w * new_h).select(tx, ty).select("tx", "ty", place("tx", w, new_w).alias("px"), place("ty", h, new_h).alias("py"))
    near = lambda at, new: F.explode(F.array(*[F.floor(F.col(at) / (2 * new)).cast("long") + i for i in (0, 1)]))
    share = lambda at, own, new: 2 * new - F.abs(F.col(at) - F.col(own) * (2 * new))
    around = grid.withColumn("sx", near("px", new_w)).withColumn("sy", near("py", new_h)).withColumn("share", share("px", "sx", new_w) * share("py", "sy", new_h)).where("share > 0")
    source = template.select(F.col("tx").alias("sx"), F.col("ty").alias("sy"), "c", "t")
    whole = 4 * new_w * new_h
    return around.join(source, ["sx", "sy"]).groupBy("tx", "ty", "c").agg(F.floor((2 * F.sum(F.col("t") * F.col("share")) + whole) / (2 * whole)).cast("long").alias("t"))
