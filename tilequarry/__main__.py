"""python -m tilequarry: generate a sample, search an image file, or check the installation."""

from __future__ import annotations

import argparse
import json
import platform

import numpy as np


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tilequarry", description=__doc__)
    parser.add_argument("--image", help="image file or folder that Spark reads")
    parser.add_argument("--box", type=int, nargs=4, metavar=("X", "Y", "W", "H"), help="the region to search for")
    parser.add_argument("--generate-sample", metavar="PNG", help="write a sample image and print its copies")
    parser.add_argument("--width", type=int, default=1600)
    parser.add_argument("--height", type=int, default=1200)
    parser.add_argument("--n-targets", type=int, default=8)
    parser.add_argument("--seed", type=int, default=7)
    parser.add_argument("--method", default="ncc", choices=["ncc", "ssd", "ccorr", "features", "fuzzy", "pairs", "semantic"])
    parser.add_argument("--side", type=int, default=512)
    parser.add_argument("--doctor", action="store_true", help="report versions as JSON")
    args = parser.parse_args(argv)
    if args.doctor:
        import pyspark

        print(json.dumps({"ok": True, "platform": platform.platform(), "pyspark": pyspark.__version__, "numpy": np.__version__}))
        return 0
    from pyspark.sql import SparkSession

    from tilequarry.operators import keypoints, semantic, tilescan
    from tilequarry.plans.request import SearchParams, SearchRequest
    from tilequarry.sources import images

    spark = SparkSession.builder.getOrCreate()
    if args.generate_sample:
        tiles, truth, _ = images.sample(spark, args.width, args.height, side=args.side, n_targets=args.n_targets, seed=args.seed)
        whole = np.zeros((args.height, args.width, 3), dtype=np.uint8)
        for t in tiles.toLocalIterator():
            whole[t["y0"] : t["y0"] + t["h"], t["x0"] : t["x0"] + t["w"]] = tilescan.unpack(t["data"], t["h"], t["w"], t["nc"])
        with open(args.generate_sample, "wb") as out:
            out.write(images.png(whole))
        print(json.dumps([{"x": x, "y": y, "w": w, "h": h} for x, y, w, h in truth]))
        return 0
    if not args.image or not args.box:
        parser.error("--image and --box, --generate-sample or --doctor")
    from tilequarry.operators.examples import crops

    read = images.read_images(spark, args.image)
    tiles = images.to_tiles(read, args.side)
    template = crops(tiles, [tuple(args.box)], args.side)[0]
    if args.method in ("features", "fuzzy"):
        found = keypoints.search(tiles, template, side=args.side, strict=args.method == "features", exclude_box=tuple(args.box))
    elif args.method == "pairs":
        found = keypoints.pair_search(tiles, template, side=args.side, exclude_box=tuple(args.box))
    elif args.method == "semantic":
        one = read.select("height", "width").first()
        found = semantic.search(tiles, template, (one["height"], one["width"]), side=args.side, exclude_box=tuple(args.box))
    else:
        found = SearchRequest(template, SearchParams(method=args.method), exclude_box=tuple(args.box)).run(tiles, args.side)
    for row in found.toJSON().toLocalIterator():
        print(row)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
