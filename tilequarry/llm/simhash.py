"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments A (23 bits), B (23) and C (18). The perfect Golay code [23, 12, 7] decodes
any 23-bit word to the one codeword within 3 bits. The keys of a word are the codewords of all words within one bit of it
(one or six); two words that differ in at most two bits therefore share a key. At most three differing bits (a, b, c) over
the segments leave, by the pigeonhole principle, one of these equal in both fingerprints:

* a = 0: A and a key of B (b <= 2), or A and C (b = 3);
* b = 0: B and a key of A (a <= 2), or B and C (a = 3);
* c = 0, a and b at least 1: C and a key of A (a <= 2);
* a = b = c = 1: one half of each of A, B and C (eight choices).

Candidates that share one of these keys of 30 bits or more (about 26 a fingerprint) are verified by counting bits. Work is
on distinct fingerprints, so that copies cost nothing. A key's fingerprints are cut into blocks of bounded size whose
pairs are verified tile by tile, and a tile gives a spanning forest of its links, not the links.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; rows with the
same doc_id, or none, each keep a row; an empty table gives an empty one. Columns other than doc_id and text are ignored
(near_duplicates) or kept (keep_one). Texts of any length are hashed whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm.common import arrow_map, cut, documents, null_to_empty, without
from tilequarry.llm.components import components

BITS = 64
#: Fingerprints of one key that a block holds; a tile compares two blocks.
BLOCK = 512
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the binary Golay code.
GENERATOR = 0b110001110101
#: Shingles hashed before they are counted; bounds memory on very long texts.
CHUNK = 1 << 18

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_BYTE_AT = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, *, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles, repeats included: a bit is set if it is in over half of the XXH64 values.

    A-Z count as a-z, words end at space and U+0009 to U+000D. A text of fewer words is one shingle; without words: 0.
    """
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    digest, n = xxhash.xxh64_digest, max(1, len(found) - words + 1)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[words - 1 :] if len(found) >= words else ends[-1:]
    counts = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK].tolist(), stops[at : at + CHUNK].tolist(), strict=True)])
        values = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
        counts += np.bincount((values + _BYTE_AT).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BIT_OF_BYTE).ravel() * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def make():
        return lambda batch: {"doc_id": batch.column("doc_id"), "fp": np.array([fingerprint(t) for t in null_to_empty(batch.column("text"))], dtype=np.uint64).view(np.int64)}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


class Golay:
    """Decoding table of the perfect binary code [23, 12, 7]: the index of the codeword nearest to each 23-bit word."""

    def __init__(self):
        codewords = np.zeros(4096, dtype=np.int64)
        for bit in range(12):
            codewords ^= np.where(np.arange(4096) >> bit & 1, GENERATOR << bit, 0)
        ones = [1 << i for i in range(23)]
        errors = {0, *ones, *(a ^ b for a in ones for b in ones), *(a ^ b ^ c for a in ones for b in ones for c in ones)}
        self.index = np.full(1 << 23, -1, dtype=np.int16)
        for e in errors:
            self.index[codewords ^ e] = np.arange(4096)
        self.near = np.array([0, *ones], dtype=np.int64)

    def keys(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of each word's different keys."""
        found = np.sort(self.index[words[:, None] ^ self.near], axis=1)
        first = np.concatenate((np.ones((len(words), 1), dtype=bool), found[:, 1:] != found[:, :-1]), axis=1)
        return np.nonzero(first)[0], found[first].astype(np.int64)


def search_keys(golay: Golay, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint. A key's kind stands above its 41 bits."""
    x = fps.view(np.uint64)
    a, b, c = ((x >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((41, 0x7FFFFF), (18, 0x7FFFFF), (0, 0x3FFFF)))
    rows = np.arange(len(x))
    (row_a, key_a), (row_b, key_b) = golay.keys(a), golay.keys(b)
    out = [(row_b, a[row_b] << 12 | key_b), (row_a, b[row_a] << 12 | key_a), (rows, a << 18 | c), (rows, b << 18 | c), (row_a, c[row_a] << 12 | key_a)]
    halves = [((s & 0xFFF), (s >> 12)) for s in (a, b)] + [((c & 0x1FF), (c >> 9))]
    out += [(rows, halves[0][i] << 21 | halves[1][j] << 9 | halves[2][k]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    return np.concatenate([r for r, _ in out]), np.concatenate([k | (kind << 48) for kind, (_, k) in enumerate(out, 1)])


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect just what the links (at most `distance` differing bits) among these fingerprints connect."""
    x = np.unique(fps)
    u, left, edges = x.view(np.uint64), np.ones(len(x), dtype=bool), []
    while left.any():
        start = int(np.argmax(left))
        left[start] = False
        frontier = [start]
        while frontier:
            rest = np.nonzero(left)[0]
            if not len(rest):
                break
            near = (np.bitwise_count(u[frontier][:, None] ^ u[rest]) <= distance).any(axis=0)
            frontier = rest[near].tolist()
            left[frontier] = False
            edges += [(int(x[start]), int(x[i])) for i in frontier]
    return edges


def links(nodes: DataFrame, *, distance: int = 3, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints fp that connect what all links connect. distance: 3 at most."""
    if not 0 <= distance <= 3:
        raise ValueError("the keys find up to 3 differing bits")

    def make_keys():
        golay = Golay()

        def f(batch: pa.RecordBatch) -> dict:
            fps = batch.column("fp").to_numpy()
            row, key = search_keys(golay, fps)
            return {"key": key, "fp": fps[row]}

        return f

    keys = arrow_map(nodes.select("fp"), make_keys, "key long, fp long")
    # The planner takes keys for as small as the fingerprints they are made of (26 a row), so it is told not to send either side through the driver.
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tiles = (
        keys.join(shared.hint("merge"), "key")
        .select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def make_forest():
        def f(batch: pa.RecordBatch) -> dict | None:
            lists = batch.column("fps")
            values, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            size = np.diff(at)
            first, second = values[at[:-1][size == 2]], values[at[:-1][size == 2] + 1]
            hit = np.bitwise_count(first.view(np.uint64) ^ second.view(np.uint64)) <= distance
            edges = [*zip(first[hit].tolist(), second[hit].tolist(), strict=True)]
            for k in np.nonzero(size > 2)[0]:
                edges += forest(values[at[k] : at[k + 1]], distance)
            return {"a": [a for a, _ in edges], "b": [b for _, b in edges]} if edges else None

        return f

    return arrow_map(tiles, make_forest, "a long, b long")


def near_duplicates(docs: DataFrame, *, distance: int = 3) -> DataFrame:
    """A row per document: doc_id, fp (signed long), component_id: the smallest doc_id reachable by links."""
    fps, _ = cut(fingerprints(docs), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    group = components(links(nodes, distance=distance))
    placed = nodes.join(group, nodes.fp == group.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = placed.select("fp", "component").join(smallest, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, distance: int = 3) -> DataFrame:
    """The rows of docs that stay, all columns: of each group the one of smallest doc_id.

    Of rows with one doc_id in one group all stay if it is the smallest; rows without doc_id stay only in a group that has
    none with one.
    """
    return keep_smallest(docs, near_duplicates(docs, distance=distance))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group in found (doc_id, component_id), as in keep_one.

    Only the ids that go are joined with docs.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone, _ = cut(found.groupBy("doc_id").agg(F.max(stays).alias("stays")).where("not stays").select("doc_id"), "copies")
    return without(docs, gone)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
