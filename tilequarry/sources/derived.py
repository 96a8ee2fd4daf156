"""Relations of the engine derived from the star-schema tables: rasters, boxes, saved results, requests.

Whole-number arithmetic only, so that any SQL engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 96, 64
#: The template's box, and the places where copies of it are planted.
SOURCE = (20, 30, 12, 10)
COPIES = ((60, 10), (5, 50), (75, 45))
SPREAD = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, r, g, b of a WIDTH x HEIGHT image summed up from lineitem, with planted copies of the template box."""
    cell = lambda v: F.pmod(F.sum(v).cast("long"), F.lit(256))
    sums = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.pmod("l_partkey", F.lit(WIDTH)).alias("x"), F.pmod("l_orderkey", F.lit(HEIGHT)).alias("y"))
        .agg(cell(F.col("l_quantity")).alias("r"), cell(F.round(F.col("l_discount") * 100)).alias("g"), cell(F.round(F.col("l_tax") * 100)).alias("b"))
    )
    grid = spark.range(WIDTH * HEIGHT).select((F.col("id") % WIDTH).alias("x"), F.floor(F.col("id") / WIDTH).alias("y"))
    plain = grid.join(sums, ["x", "y"], "left").select("x", "y", *[F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"])
    sx, sy, sw, sh = SOURCE
    box = plain.where(F.col("x").between(sx, sx + sw - 1) & F.col("y").between(sy, sy + sh - 1))
    places = F.explode(F.array(*[F.struct(F.lit(x - sx).alias("dx"), F.lit(y - sy).alias("dy")) for x, y in COPIES]))
    stamps = box.withColumn("p", places).select((F.col("x") + F.col("p.dx")).alias("x"), (F.col("y") + F.col("p.dy")).alias("y"), *[F.col(c).alias(f"{c}2") for c in "rgb"])
    # WIDTH * HEIGHT / 50 stamps at most.
    return plain.join(F.broadcast(stamps), ["x", "y"], "left").select("x", "y", *[F.coalesce(f"{c}2", c).alias(c) for c in "rgb"])


RASTER_SQL = f"""
s AS (SELECT l_partkey % {WIDTH} AS x, l_orderkey % {HEIGHT} AS y, trunc(sum(l_quantity))::BIGINT % 256 AS r,
             trunc(sum(round(l_discount * 100)))::BIGINT % 256 AS g, trunc(sum(round(l_tax * 100)))::BIGINT % 256 AS b FROM lineitem GROUP BY ALL),
grid AS (SELECT range % {WIDTH} AS x, range // {WIDTH} AS y FROM range({WIDTH * HEIGHT})),
plain AS (SELECT x, y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM grid LEFT JOIN s USING (x, y)),
places AS (SELECT unnest([{", ".join(str(x - SOURCE[0]) for x, _ in COPIES)}]) AS dx, unnest([{", ".join(str(y - SOURCE[1]) for _, y in COPIES)}]) AS dy),
stamps AS (SELECT x + dx AS x, y + dy AS y, r AS r2, g AS g2, b AS b2 FROM plain, places
           WHERE x BETWEEN {SOURCE[0]} AND {SOURCE[0] + SOURCE[2] - 1} AND y BETWEEN {SOURCE[1]} AND {SOURCE[1] + SOURCE[3] - 1}),
raster AS (SELECT x, y, coalesce(r2, r) AS r, coalesce(g2, g) AS g, coalesce(b2, b) AS b FROM plain LEFT JOIN stamps USING (x, y))
"""


def line_id() -> Column:
    """A number of each line item; only order, line, part, supplier and quantity together tell them apart."""
    return (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 200003 + F.col("l_partkey")) * 1009 + F.col("l_suppkey") % 1009) * 64 + F.col("l_quantity").cast("long")


LINE_ID_SQL = "((((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 1009 + l_suppkey % 1009) * 64 + trunc(l_quantity)::BIGINT)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x, y, w, h, score, scale, orientation, entry: a box for each line item."""
    from tilequarry.functions.geometry import ORIENTATIONS

    codes = F.array(*[F.lit(o) for o in ORIENTATIONS])
    ident = line_id()
    return table(spark, sf_dir, "lineitem").select(
        ident.alias("id"),
        ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % SPREAD).alias("x"),
        ((F.col("l_suppkey") * 104729 + F.col("l_orderkey") * 17) % SPREAD).alias("y"),
        (8 + F.col("l_quantity").cast("long")).alias("w"),
        (8 + F.col("l_linenumber").cast("long") * 4).alias("h"),
        ((ident % 10007 * 7919 % 10007) / F.lit(10007.0)).alias("score"),
        F.lit(1.0).alias("scale"),
        F.element_at(codes, (F.col("l_linenumber") % 8 + 1).cast("int")).alias("orientation"),
        F.col("l_orderkey").alias("entry"),
    )


BOXES_SQL = f"""
boxes AS (SELECT {LINE_ID_SQL} AS id, (l_partkey * 7919 + l_orderkey * 31) % {SPREAD} AS x, (l_suppkey * 104729 + l_orderkey * 17) % {SPREAD} AS y,
                 8 + trunc(l_quantity)::BIGINT AS w, 8 + l_linenumber::BIGINT * 4 AS h, ({LINE_ID_SQL} % 10007 * 7919 % 10007) / 10007.0::DOUBLE AS score,
                 1.0::DOUBLE AS scale, (['R0', 'R90', 'R180', 'R270', 'MX', 'MY', 'MXR90', 'MYR90'])[l_linenumber % 8 + 1] AS orientation, l_orderkey AS entry FROM lineitem)
"""


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry, x, y, w, h, score, scale, orientation: saved results, an entry for each order."""
    return boxes(spark, sf_dir).withColumn("score", F.rint(F.col("score") * 10000) / 10000)


SAVED_SQL = BOXES_SQL + ", saved AS (SELECT * REPLACE (round_even(score * 10000, 0) / 10000 AS score) FROM boxes)"
