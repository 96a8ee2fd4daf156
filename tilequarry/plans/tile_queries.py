"""Registered queries of the tile path on the small raster, image files and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.operators.nms import folder as new_folder
from tilequarry.operators.nms import written
from tilequarry.plans import dense_queries as Q
from tilequarry.plans.registry import query
from tilequarry.plans.request import SearchParams, SearchRequest
from tilequarry.sources import images as I
from tilequarry.sources.derived import HEIGHT, RASTER_SQL, SOURCE, WIDTH, raster, table
from tilequarry.streaming.requests import debounced_stream, staging_gate

TILE = 32
#: Events of all batches that a task writes a file of each for, about.
GATE_ROWS = 400_000


def raster_tiles(spark: SparkSession, sf: str, side: int = TILE) -> DataFrame:
    """The derived raster's first plane as tiles: pixels meet by tile, a bounded number each."""
    rows = raster(spark, sf).select(F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx"), "x", "y", F.col("r").cast("int").alias("v"))
    cells = rows.groupBy("ty", "tx").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("c"), F.min("y").cast("int").alias("y0"), F.min("x").cast("int").alias("x0"), (F.max("y") - F.min("y") + 1).cast("int").alias("h"), (F.max("x") - F.min("x") + 1).cast("int").alias("w"))
    data = F.unhex(F.array_join(F.transform("c", lambda c: F.lpad(F.hex(c["v"]), 2, "0")), ""))
    return cells.select(F.lit("image").alias("image_id"), "ty", "tx", "y0", "x0", "h", "w", F.lit(1).alias("nc"), data.alias("data"))


@query("tile_ncc_fft", f"WITH RECURSIVE {Q._scores_sql('red', 'ncc')}, {Q._NCC_TAIL}")
def tile_ncc_fft(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship search by tiles and Fourier transforms; the same matches as the relational one."""
    sx, sy, sw, sh = SOURCE
    box = raster(spark, sf).where(F.col("x").between(sx, sx + sw - 1) & F.col("y").between(sy, sy + sh - 1)).select("x", "y", "r").collect()  # the template
    template = np.zeros((sh, sw), dtype=np.uint8)
    for p in box:
        template[p["y"] - sy, p["x"] - sx] = p["r"]
    found = SearchRequest(template, SearchParams(), exclude_box=SOURCE).run(written(raster_tiles(spark, sf), "tiles"), TILE, WIDTH * HEIGHT)
    return found.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "w", "h", F.round("score", 6).alias("score"))


@query("image_roundtrip", f"WITH {RASTER_SQL} SELECT x, y, r, g, b FROM raster")
def image_roundtrip(spark, sf):
    """The pixels of the derived raster, written as a PNG file and read back by Spark's image source."""
    pixels = raster(spark, sf).collect()  # WIDTH x HEIGHT of them
    a = np.zeros((HEIGHT, WIDTH, 3), dtype=np.uint8)
    for p in pixels:
        a[p["y"], p["x"]] = (p["r"], p["g"], p["b"])
    folder = new_folder(spark, "png")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/image.png")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(I.png(a)))
    out.close()
    cells = I.to_tiles(I.read_images(spark, folder), 32).select("x0", "y0", "w", "data", F.explode(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)).alias("i"))
    byte = lambda k: F.conv(F.hex(F.substring("data", F.col("i") * 3 + (k + 1), F.lit(1))), 16, 10).cast("long")
    return cells.select((F.col("x0") + F.col("i") % F.col("w")).cast("long").alias("x"), (F.col("y0") + F.floor(F.col("i") / F.col("w"))).cast("long").alias("y"), *[byte(k).alias(c) for k, c in enumerate("rgb")])


@query("debounce_stream", "WITH g AS (SELECT user_id AS session, event_id AS request, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) SELECT session, request FROM g WHERE nxt IS NULL OR nxt - ts >= INTERVAL 2 HOUR")
def debounce_stream(spark, sf):
    """The debounced requests of `events` read as a stream; a far later event closes the last windows."""
    base = new_folder(spark, "stream")
    events = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{base}/in")
    closing = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("session"), F.lit(-1).cast("long").alias("request"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    closing.write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    started = debounced_stream(stream, "2 hours", "0 seconds").writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{base}/out").where("session >= 0").select("session", "request")


@query(
    "staging_gate",
    """WITH e AS (SELECT user_id AS session, event_id AS request, ts, event_type = 'error' AS staged FROM events),
s AS (SELECT session, min(struct_pack(ts := ts, request := request)) AS first FROM e WHERE staged GROUP BY session),
r AS (SELECT e.session, e.request, e.ts, s.first.ts AS open_ts, s.first.request AS open_request FROM e JOIN s ON s.session = e.session WHERE NOT e.staged),
w AS (SELECT *, (ts, request) < (open_ts, open_request) AS early FROM r)
SELECT session, request, ts AS at FROM w WHERE NOT early UNION ALL
SELECT session, arg_max(request, struct_pack(ts := ts, request := request)) AS request, any_value(open_ts) AS at FROM w WHERE early GROUP BY session""",
)
def staging_gate_stream(spark, sf):
    """The requests of `events`, read as a stream in four batches, that a session's first error lets pass."""
    base = new_folder(spark, "gate")
    events = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("request"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("staged"))
    cuts = events.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b"), F.count(F.lit(1)).alias("n")).first()
    files = -(-cuts["n"] // GATE_ROWS) or 1
    quarter = F.least(F.floor((F.col("ts").cast("double") - cuts["a"]) / max((cuts["b"] or 0) - (cuts["a"] or 0), 1e-6) * 4), F.lit(3)) if cuts["a"] is not None else F.lit(0)
    for k in range(4):  # older files first; a session's events of a batch are in one file, so that its order holds however files are dealt
        events.where(quarter == k).repartition(files, "session").write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    started = staging_gate(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{base}/out")
