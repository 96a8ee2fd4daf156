"""Embedding near-duplicates by int8 tile products with proven error bounds.

Vectors are normalised in double precision and quantised to int8 with a scale of their own. For x = s q + e the product
of two vectors differs from s s' q.q' by at most |sq| |e'| + |e| |s'q'| + |e| |e'|, where the norms of the residuals e are
computed, not estimated. Whole tiles of int8 products come from one matrix product (exact in single precision: the
products stay below 2^24); only pairs whose product plus bound reaches the threshold are computed again in double
precision from the stored vectors.

Equal vectors of a label are one representative with a count. Representatives of a label are dealt into blocks of bounded
size by hash; a tile is a pair of blocks and is read by one task. A tile gives the number of links of each of its vectors
(copies counted) and a spanning forest of the links, never the pairs. Work within a label grows with the square of its
different vectors: the threshold is met exactly, for any data.

Defined results: a vector that is null, has no components, has null or non-finite components, or is zero links with
nothing, and neither does one without a label; vectors of different length don't link; rows with one vec_id are separate
vectors, told apart only in n_links, and share a component only by links; null vec_ids keep a row and take part in counts.
An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm.common import arrow_map, cut, documents
from tilequarry.llm.components import components

THRESHOLD = 0.98
#: Vectors of a block, about.
BLOCK = 1024
#: Slack for rounding in double precision, far above what sums of a few thousand products can lose.
SLACK = 1e-9
#: Components summed at a time, so that int8 products stay exact in single precision.
EXACT = 1024


class Quantised:
    """Normalised vectors as int8 with scale, norm of the quantised part and norm of the residual."""

    def __init__(self, vectors: np.ndarray):
        self.raw = vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        unit = vectors / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rebuilt = self.q * self.scale[:, None]
        self.kept = np.sqrt(np.einsum("ij,ij->i", rebuilt, rebuilt))
        rest = unit - rebuilt
        self.lost = np.sqrt(np.einsum("ij,ij->i", rest, rest))


def tile_links(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) whose cosine in double precision is at least the threshold."""
    product = np.zeros((len(a.q), len(b.q)))
    for at in range(0, a.q.shape[1], EXACT):
        product += a.q[:, at : at + EXACT].astype(np.float32) @ b.q[:, at : at + EXACT].astype(np.float32).T
    product *= a.scale[:, None]
    product *= b.scale
    # |error| <= kept lost' + lost kept' + lost lost' = (kept + lost)(kept' + lost') - kept kept'
    product += np.outer(a.kept + a.lost, b.kept + b.lost)
    product -= np.outer(a.kept, b.kept)
    i, j = np.nonzero(product >= threshold - SLACK)
    hit = np.empty(len(i), dtype=bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        hit[part] = np.einsum("ij,ij->i", a.raw[i[part]], b.raw[j[part]]) / (a.norm[i[part]] * b.norm[j[part]]) >= threshold
    return i[hit], j[hit]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(root, node) pairs that connect what the edges connect; root is the smallest index."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.nonzero(root != np.arange(n))[0]
    return list(zip(root[moved].tolist(), moved.tolist(), strict=True))


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(numbers, lambda x: x != 0)
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(sound, F.lit(False)), F.col("embedding")).alias("vector"))
    # A row without vec_id takes part; its representative's name is a hash, as that of every one.
    named = rows.withColumn("rep", F.when(F.col("vector").isNotNull(), F.xxhash64(F.col("label"), F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast("double")).otherwise(x.cast("double"))))))
    reps, _ = cut(named.where(F.col("rep").isNotNull()).groupBy("rep", "label").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"), F.any_value("vector").alias("vector")), "vectors")
    counts = reps.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    placed = reps.join(counts, "label").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    blocks = placed.groupBy("label", "own", "blocks").agg(F.collect_list(F.struct("rep", "copies", F.transform("vector", lambda x: x.cast("double")).alias("vector"))).alias("rows"))
    blocks, _ = cut(blocks, "blocks")
    pairs = blocks.select("label", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    left = blocks.select("label", F.col("own").alias("i"), F.col("rows").alias("left"))
    right = blocks.select("label", F.col("own").alias("j"), F.col("rows").alias("right"))
    tiles = pairs.join(left, ["label", "i"]).join(right, ["label", "j"]).select((F.col("i") == F.col("j")).alias("same"), "left", "right")

    def make():
        def unpack(rows: list[dict]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """By length of the vectors: names, copies, vectors."""
            out: dict[int, list] = {}
            for r in rows:
                out.setdefault(len(r["vector"]), []).append(r)
            return {n: (np.array([r["rep"] for r in x], dtype=np.int64), np.array([r["copies"] for r in x], dtype=np.int64), np.array([r["vector"] for r in x])) for n, x in out.items()}

        def f(batch: pa.RecordBatch) -> dict | None:
            reps, links, heads = [], [], []
            for k in range(batch.num_rows):
                same = batch.column("same")[k].as_py()
                a = unpack(batch.column("left")[k].as_py())
                b = a if same else unpack(batch.column("right")[k].as_py())
                for size in a.keys() & b.keys():
                    (name_a, copies_a, x), (name_b, copies_b, y) = a[size], b[size]
                    qa = Quantised(x)
                    qb = qa if same else Quantised(y)
                    i, j = tile_links(qa, qb, threshold)
                    if same:
                        i, j = i[i != j], j[i != j]
                        found = np.bincount(i, weights=copies_b[j], minlength=len(name_a)).astype(np.int64)
                        names, counts, edges = name_a, found, _forest(len(name_a), i, j)
                    else:
                        counts = np.concatenate((np.bincount(i, weights=copies_b[j], minlength=len(name_a)), np.bincount(j, weights=copies_a[i], minlength=len(name_b)))).astype(np.int64)
                        names, edges = np.concatenate((name_a, name_b)), _forest(len(name_a) + len(name_b), i, j + len(name_a))
                    head = {node: root for root, node in edges}
                    for n in np.nonzero(counts)[0].tolist():
                        reps.append(int(names[n]))
                        links.append(int(counts[n]))
                        heads.append(int(names[head.get(n, n)]))
            return {"rep": reps, "links": links, "head": heads} if reps else None

        return f

    found, _ = cut(arrow_map(tiles, make, "rep long, links long, head long"), "tile-links")
    group = components(found.select(F.col("rep").alias("a"), F.col("head").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tables = reps.select("rep", "copies", "first_id").join(counted, "rep", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = tables.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_rep = tables.join(smallest, "component").select("rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = named.select("vec_id", "rep").join(by_rep, "rep", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.98),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.t)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, min(r.t)::BIGINT AS component_id, e.vec_id = min(r.t) AS kept
FROM embeddings e JOIN r ON r.s = e.vec_id GROUP BY e.vec_id
"""
