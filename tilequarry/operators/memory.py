"""Saved results: a versioned JSON document of a source image and entries (selection, params, matches)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
PARAMS = """threshold double, threshold_floor double, scales array<double>, rotations array<double>, max_results int, nms_iou double, exclude_iou double, device string,
compute_dtype string, channel_mode string, rgb_weights array<double>, ycbcr_weights array<double>, method string, enable_rotation boolean, enable_flipping boolean,
feature_detector string, feature_ratio double, feature_min_inliers int, feature_max_instances int"""
MATCH = "x int, y int, w int, h int, score double, scale double, orientation string"
PARAMS_STRUCT = "struct<" + ", ".join(" ".join(f.split()).replace(" ", ":", 1) for f in PARAMS.replace("\n", " ").split(",")) + ">"
#: Names of the parameters (PARAMS), and what one is where a document doesn't say.
DEFAULTS = {
    "threshold": 0.85, "threshold_floor": 0.5, "scales": [1.0], "rotations": None, "max_results": 500, "nms_iou": 0.3, "exclude_iou": 0.3, "device": "auto", "compute_dtype": "float32",
    "channel_mode": "luminance", "rgb_weights": [1 / 3] * 3, "ycbcr_weights": [1 / 3] * 3, "method": "ncc", "enable_rotation": False, "enable_flipping": False, "feature_detector": "orb",
    "feature_ratio": 0.75, "feature_min_inliers": 12, "feature_max_instances": 100,
}


def entries_json(matches: DataFrame, by: str, params: DataFrame | None = None) -> DataFrame:
    """by, document: each group's matches as a JSON document with one entry; matches by score, then place.

    params: by, params (a struct of PARAMS' names; null ones are left out). Groups without it get the default method and threshold.
    """
    one = F.struct(*[F.col(c) for c in ("x", "y", "w", "h", "score", "scale", "orientation")])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("id"), one.alias("m")))), lambda s: s["m"])
    grouped = matches.groupBy(by).agg(ordered.alias("matches"))
    plain = F.struct(F.lit(DEFAULTS["method"]).alias("method"), F.lit(DEFAULTS["threshold"]).alias("threshold"))
    text = F.to_json(plain)
    if params is not None:
        grouped = grouped.join(params.select(by, F.to_json("params").alias("params__")), by, "left")
        text = F.coalesce("params__", text)
    entry = F.struct(F.lit("").alias("label"), F.array(F.lit(0), F.lit(0), F.lit(8), F.lit(8)).alias("selection"), F.from_json(text, PARAMS_STRUCT).alias("params"), F.col("matches"))
    document = F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit("image").alias("source_image"), F.array(F.lit(20000), F.lit(20000)).alias("image_size"), F.array(entry).alias("entries")))
    return grouped.select(by, document.alias("document"))


def parse(documents: DataFrame, column: str = "document") -> DataFrame:
    """documents with doc: the parsed structure. Malformed JSON, missing entries and newer versions are errors."""
    schema = f"version int, source_image string, image_size array<int>, entries array<struct<label:string, selection:array<int>, params:{PARAMS_STRUCT}, method:string, threshold:double, matches:array<struct<x:int, y:int, w:int, h:int, score:double, scale:double, orientation:string>>>>"
    doc = F.from_json(column, schema, {"mode": "FAILFAST"})
    checked = F.when(F.col("doc.entries").isNull(), F.raise_error(F.lit("not a memory document: it has no entries"))).when(F.coalesce("doc.version", F.lit(1)) > VERSION, F.raise_error(F.lit("the document's version is newer"))).otherwise(F.col("doc"))
    return documents.withColumn("doc", doc).withColumn("doc", checked)


def matches_of(parsed: DataFrame, *keep: str) -> DataFrame:
    """keep, entry, method, threshold and the columns of a match: a row per saved match. Flat keys of old documents count."""
    rows = parsed.select(*keep, F.posexplode("doc.entries").alias("entry", "e"))
    method = F.coalesce("e.params.method", "e.method", F.lit(DEFAULTS["method"]))
    threshold = F.coalesce("e.params.threshold", "e.threshold", F.lit(DEFAULTS["threshold"]))
    one = rows.select(*keep, "entry", method.alias("method"), threshold.alias("threshold"), F.explode("e.matches").alias("m"))
    return one.select(*keep, "entry", "method", "threshold", "m.x", "m.y", "m.w", "m.h", "m.score", F.coalesce("m.scale", F.lit(1.0)).alias("scale"), F.coalesce("m.orientation", F.lit("R0")).alias("orientation"))


def params_of(parsed: DataFrame, *keep: str) -> DataFrame:
    """keep, entry and all of PARAMS: a row per saved entry, with defaults for what a document doesn't say. Flat keys of old documents count."""
    rows = parsed.select(*keep, F.posexplode("doc.entries").alias("entry", "e"))
    names = [f.split()[0] for f in PARAMS.replace("\n", " ").split(",")]
    flat = {"method": [F.col("e.method")], "threshold": [F.col("e.threshold")]}
    default = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    value = lambda n: F.coalesce(F.col(f"e.params.{n}"), *flat.get(n, []), *([] if DEFAULTS[n] is None else [default(DEFAULTS[n])]))
    return rows.select(*keep, "entry", *[value(n).alias(n) for n in names])


def source_state(documents: DataFrame, images: DataFrame, shown: str) -> DataFrame:
    """documents with state: whether the source image is the one shown, another that can be opened, missing, or not named.

    images: image_id of those that can be read; a name that stands twice counts once.
    """
    known = images.select(F.col("image_id").alias("known__")).distinct()
    joined = documents.join(known, documents["source_image"] == known["known__"], "left")
    state = F.when(F.coalesce("source_image", F.lit("")) == "", "unnamed").when(F.col("source_image") == shown, "shown").when(F.col("known__").isNotNull(), "openable").otherwise("missing")
    return joined.withColumn("state", state).drop("known__")


def load(spark: SparkSession, path: str) -> DataFrame:
    """doc of each JSON file at a path."""
    return parse(spark.read.text(path, wholetext=True).withColumnRenamed("value", "document"))


def dump(store: dict) -> str:
    """A store as pretty UTF-8 JSON; parameters it lacks are filled in."""
    entries = [{**e, "params": {**DEFAULTS, **e.get("params", {})}} for e in store["entries"]]
    return json.dumps({"version": VERSION, **store, "entries": entries}, indent=2, ensure_ascii=False)


def save(spark: SparkSession, store: dict, path: str) -> None:
    spark.createDataFrame([(dump(store),)], "value string").coalesce(1).write.mode("overwrite").text(path)
