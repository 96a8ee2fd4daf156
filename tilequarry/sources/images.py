"""Image sources and sinks: files to tiles, PNG writing, generated samples with known copies."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.functions.kernels import resample
from tilequarry.operators.tilescan import SCHEMA, unpack

#: The largest image, in bytes of pixels, that is read.
MAX_IMAGE_BYTES = 200_000_000_000


def png(a: np.ndarray) -> bytes:
    """A PNG file of a gray or RGB uint8 array."""
    h, w = a.shape[:2]
    rows = np.ascontiguousarray(a).reshape(h, -1)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_images(spark: SparkSession, path: str, *, max_image_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """image_id, height, width, nc, data (RGB or gray) of image files; larger ones raise an error."""
    read = spark.read.format("image").load(path).select("image.*")
    size = F.col("height").cast("long") * F.col("width") * F.col("nChannels")
    guarded = F.when(size > max_image_bytes, F.raise_error(F.concat(F.lit("image too large: "), F.col("origin")))).otherwise(F.col("data"))
    return read.select(F.col("origin").alias("image_id"), "height", "width", F.col("nChannels").alias("nc"), guarded.alias("data"))


def to_tiles(images: DataFrame, side: int = 512, bgr: bool = True) -> DataFrame:
    """Tiles of images; Spark's image source has the channels of colour images in the order B, G, R."""

    def cut_up(frames):
        for frame in frames:
            for i in frame.itertuples(index=False):
                a = np.frombuffer(i.data, dtype=np.uint8).reshape(i.height, i.width, i.nc)
                a = a[..., 2::-1] if bgr and i.nc >= 3 else a[..., 0]
                for y in range(0, i.height, side):
                    out = []
                    for x in range(0, i.width, side):
                        t = np.ascontiguousarray(a[y : y + side, x : x + side])
                        out.append((i.image_id, y // side, x // side, y, x, t.shape[0], t.shape[1], 3 if t.ndim == 3 else 1, t.tobytes()))
                    yield pd.DataFrame(out, columns=["image_id", "ty", "tx", "y0", "x0", "h", "w", "nc", "data"])

    return images.select("image_id", "height", "width", "nc", "data").mapInPandas(cut_up, SCHEMA)


#: Rows of a raw image that a task cuts at a time.
BAND = 64


def read_raw(spark: SparkSession, path: str, width: int, nc: int = 3, side: int = 512, image_id: str | None = None) -> DataFrame:
    """Tiles of an image of any size that is stored as rows of uint8 pixels without a header.

    A row of pixels is a record: Hadoop splits the file, tasks read their rows alone and cut bands of BAND rows into strips, and
    strips meet by tile. No task holds more than a band or a tile. A file that doesn't end with a whole row raises an error.
    """
    record = width * nc
    formats = ("org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable")
    rows = spark.sparkContext.newAPIHadoopFile(path, *formats, conf={"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)})
    name = image_id or path

    def strips(first, band):
        a = np.frombuffer(b"".join(band), dtype=np.uint8).reshape(len(band), width, nc)
        for x in range(0, width, side):
            part = np.ascontiguousarray(a[:, x : x + side])
            yield first // side, x // side, first, len(band), part.shape[1], bytearray(part.tobytes())

    def cut(records):
        first, band = 0, []
        for y, data in records:
            if band and (y != first + len(band) or y % side == 0 or len(band) == BAND):
                yield from strips(first, band)
                band = []
            if not band:
                first = y
            band.append(bytes(data))
        if band:
            yield from strips(first, band)

    parts = spark.createDataFrame(rows.mapPartitions(cut), "ty int, tx int, y int, n int, w int, data binary")
    met = parts.groupBy("ty", "tx").agg(F.array_sort(F.collect_list(F.struct("y", "n", "w", "data"))).alias("strips"))  # a tile's

    def join(frames):
        for frame in frames:
            out = [(name, t.ty, t.tx, t.ty * side, t.tx * side, sum(s["n"] for s in t.strips), t.strips[0]["w"], nc, b"".join(bytes(s["data"]) for s in t.strips)) for t in frame.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["image_id", "ty", "tx", "y0", "x0", "h", "w", "nc", "data"])

    return met.mapInPandas(join, SCHEMA)


def array_tiles(spark: SparkSession, a: np.ndarray, side: int = 512, image_id: str = "image") -> DataFrame:
    """Tiles of an array on the driver."""
    rows = []
    for y in range(0, a.shape[0], side):
        for x in range(0, a.shape[1], side):
            t = np.ascontiguousarray(a[y : y + side, x : x + side])
            rows.append((image_id, y // side, x // side, y, x, t.shape[0], t.shape[1], t.shape[2] if t.ndim == 3 else 1, t.tobytes()))
    return spark.createDataFrame(rows, SCHEMA)


def region(tiles: DataFrame, x: int, y: int, w: int, h: int, side: int) -> DataFrame:
    """The tiles that a rectangle touches; the filter is on the tile's key columns."""
    return tiles.where(F.col("tx").between(x // side, (x + w - 1) // side) & F.col("ty").between(y // side, (y + h - 1) // side))


#: The most pixels of a view that are brought to the driver.
MAX_VIEW = 64_000_000


def view(tiles: DataFrame, level: int, x: int, y: int, w: int, h: int, *, side: int, size: tuple[int, int]) -> np.ndarray:
    """The pixels of a rectangle of a pyramid level, cut to the level; an empty array beyond it.

    size: the image's height and width. Tiles are halved where they lie, (sum + 2) >> 2 of each 2 x 2 cell, and only their
    part of the view is collected. Places that odd edges leave open are zero.
    """
    step = 1 << level
    if side % step:
        raise ValueError(f"level {level} splits the cells of tiles of {side}")
    x0, y0, x1, y1 = max(0, x), max(0, y), min(size[1] // step, x + w), min(size[0] // step, y + h)
    if x1 <= x0 or y1 <= y0:
        return np.zeros((0, 0, 3), dtype=np.uint8)
    if (x1 - x0) * (y1 - y0) > MAX_VIEW:
        raise ValueError("the view is too large; take a higher level")

    def halve(frames):
        for frame in frames:
            out = []
            for t in frame.itertuples(index=False):
                a = unpack(t.data, t.h, t.w, t.nc).astype(np.uint16)
                for _ in range(level):
                    a = a[: a.shape[0] // 2 * 2, : a.shape[1] // 2 * 2]
                    a = (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2] + 2) >> 2
                top, left = t.y0 // step, t.x0 // step
                part = a[max(0, y0 - top) : max(0, y1 - top), max(0, x0 - left) : max(0, x1 - left)].astype(np.uint8)
                if part.size:
                    out.append((max(top, y0), max(left, x0), part.shape[0], part.shape[1], t.nc, np.ascontiguousarray(part).tobytes()))
            yield pd.DataFrame(out, columns=["y", "x", "h", "w", "nc", "data"])

    touched = region(tiles, x0 * step, y0 * step, (x1 - x0) * step, (y1 - y0) * step, side)
    parts = touched.mapInPandas(halve, "y int, x int, h int, w int, nc int, data binary").collect()  # MAX_VIEW pixels at most
    out = np.zeros((y1 - y0, x1 - x0, 3), dtype=np.uint8)
    for p in parts:
        own = unpack(p["data"], p["h"], p["w"], p["nc"])
        out[p["y"] - y0 : p["y"] - y0 + p["h"], p["x"] - x0 : p["x"] - x0 + p["w"]] = own if own.ndim == 3 else own[..., None]
    return out


def fingerprint(tiles: DataFrame) -> DataFrame:
    """image_id, fingerprint: a sum over the tiles' hashes, whatever their order; equal for equal pixels and tiling."""
    one = F.xxhash64("ty", "tx", "h", "w", "nc", "data")
    return tiles.groupBy("image_id").agg(F.hex(F.bit_xor(one)).alias("fingerprint"), F.count(F.lit(1)).alias("n_tiles"))


def motif(side: int, seed: int) -> np.ndarray:
    """An asymmetric coloured square."""
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 256, (5, 5, 3)).astype(np.float64)
    out = np.stack([resample(coarse[..., c], side, side) for c in range(3)], axis=-1)
    out[: side // 4, : side // 2] = rng.integers(0, 256, 3)
    out[side // 2 :, -side // 5 :] = rng.integers(0, 256, 3)
    return np.clip(out, 0, 255).astype(np.uint8)


def background(x0: int, y0: int, w: int, h: int, seed: int) -> np.ndarray:
    """Waves and noise; a pixel depends on its place and the seed only, so that tiles are made apart."""
    ys, xs = np.mgrid[y0 : y0 + h, x0 : x0 + w].astype(np.uint64)
    mixed = (xs * np.uint64(0x9E3779B97F4A7C15)) ^ (ys * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed * 0x165667B1 + 1)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    noise = (mixed >> np.uint64(40)).astype(np.float64) % 40
    wave = 12 * np.sin(xs / 37.0) + 9 * np.sin(ys / 23.0)
    return np.clip(np.stack([96 + noise + wave, 100 + noise - wave / 2, 98 + noise], axis=-1), 0, 255).astype(np.uint8)


def sample(spark: SparkSession, width: int, height: int, *, side: int = 512, motif_side: int = 64, n_targets: int = 8, seed: int = 7) -> tuple[DataFrame, list[tuple[int, int, int, int]], np.ndarray]:
    """Tiles of a generated image, the boxes of the motif's copies (every other one across a tile seam), and the motif."""
    rng, own, truth = np.random.default_rng(seed), motif(motif_side, seed), []
    for k in range(n_targets * 200):
        if len(truth) == n_targets:
            break
        x, y = int(rng.integers(0, width - motif_side)), int(rng.integers(0, height - motif_side))
        if len(truth) % 2 and width > side + motif_side:
            x = int(rng.integers(1, (width - motif_side) // side + 1)) * side - motif_side // 2
        if all(abs(x - a) > motif_side + 4 or abs(y - b) > motif_side + 4 for a, b, _, _ in truth):
            truth.append((x, y, motif_side, motif_side))
    columns = -(-width // side)
    keys = spark.range(columns * -(-height // side), numPartitions=max(1, min(256, columns)))

    def make(frames):
        for frame in frames:
            out = []
            for k in frame["id"]:
                ty, tx = int(k) // columns, int(k) % columns
                y0, x0 = ty * side, tx * side
                h, w = min(side, height - y0), min(side, width - x0)
                a = background(x0, y0, w, h, seed)
                for x, y, tw, th in truth:
                    top, left, bottom, right = max(y, y0), max(x, x0), min(y + th, y0 + h), min(x + tw, x0 + w)
                    if top < bottom and left < right:
                        a[top - y0 : bottom - y0, left - x0 : right - x0] = own[top - y : bottom - y, left - x : right - x]
                out.append(("sample", ty, tx, y0, x0, h, w, 3, a.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "ty", "tx", "y0", "x0", "h", "w", "nc", "data"])

    return keys.mapInPandas(make, SCHEMA), truth, own
