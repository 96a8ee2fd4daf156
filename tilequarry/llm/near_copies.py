"""Near-copies by the Jaccard similarity of word shingles, joined with SimHash links.

Two texts are linked if their fingerprints differ in at most three bits (simhash.links) or if their sets of WORDS-word
shingles have Jaccard similarity 0.8 or more. Fingerprints of such texts mostly differ in more bits than Golay keys of a
useful length can bridge, so candidates of the second kind share one of BANDS keys, each of the smallest values of ROWS hash
functions over the set: texts of similarity 0.8 share a key with probability 0.9996, more similar ones with more. Candidates
are verified on the whole sets; nothing is linked that isn't similar.

Work is on distinct sets, so that copies cost nothing, and only between groups not linked yet. A key's sets are cut into
blocks of bounded size that meet tile by tile; two sets of a tile are candidates if their groups differ, and sizes and one
bit of each of the BANDS * ROWS minima allow the similarity (BIT_SLACK standard deviations of slack). First each set of a tile
is verified with its nearest candidate alone, by a join. After these links are drawn, the sets that still have candidates
are brought to their tiles, which verify every pair and give a spanning forest. No step emits all pairs of a key.

Defined results: words and null texts as in simhash; a text of fewer than WORDS words is one shingle; without words the set
is empty and equals other empty ones; null and repeated doc_ids keep a row each; an empty table gives an empty one; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, arrow_map, bounded, cut, null_to_empty
from tilequarry.llm.components import components
from tilequarry.llm.simhash import fingerprint, links

WORDS = 5
BANDS, ROWS = 26, 6
#: Sets of a key that a block holds; a tile compares two blocks.
BLOCK = 256
#: Differing bits that candidates may have: the mean at similarity 0.8 (a tenth) and five standard deviations.
BIT_SLACK = 5
MOST_BITS = int(BANDS * ROWS * 0.1 + BIT_SLACK * (BANDS * ROWS * 0.09) ** 0.5)
#: Shingles that meet all hash functions at a time.
PIECE = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_FACTORS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = _mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the text's different shingles."""
    import xxhash

    found = text.encode().lower().split()
    width = min(words, len(found))
    n = len(found) - width + 1 if found else 0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), dtype=np.uint64, count=len(found))
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return np.unique(_mix(out))


def set_id(found: np.ndarray) -> int:
    """A signed long that names the set."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), PIECE):
        np.minimum(out, (found[at : at + PIECE, None] * _FACTORS + _SHIFTS).min(axis=0), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A signed long for each band."""
    mixed = (_mix(least).reshape(BANDS, ROWS) * _FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return _mix(mixed + _SHIFTS[:BANDS]).view(np.int64)


def sketch(least: np.ndarray) -> np.ndarray:
    """One bit of each minimum, in signed longs. Of two sets of similarity s they differ in (1 - s) / 2 of the bits."""
    bits = np.zeros(-(-len(least) // 64) * 64, dtype=np.uint8)
    bits[: len(least)] = (least >> np.uint64(20)).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets (sorted) have Jaccard similarity 0.8 or more, in whole numbers."""
    return 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y))


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, tie (of the text), fp, sid, n, keys and bits of each row. A set without shingles has no keys."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            texts = null_to_empty(batch.column("text"))
            found = [shingles(t) for t in texts]
            least = [minima(s) for s in found]
            fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
            keys = [band_keys(m) if len(s) else [] for m, s in zip(least, found, strict=True)]
            longs = pa.list_(pa.int64())
            return {"doc_id": batch.column("doc_id"), "tie": batch.column("tie"), "fp": fps, "sid": [set_id(s) for s in found], "n": [len(s) for s in found], "keys": pa.array(keys, longs), "bits": pa.array([sketch(m) for m in least], longs)}

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return arrow_map(rows, make, "doc_id long, tie long, fp long, sid long, n int, keys array<long>, bits array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and found, the shingles, of the texts whose tie is in wanted, a written table."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            found = [shingles(t) for t in null_to_empty(batch.column("text"))]
            return {"sid": [set_id(s) for s in found], "found": pa.array([s.view(np.int64) for s in found], type=pa.list_(pa.int64()))}

        return f

    ties = bounded(wanted, 16).select(F.col("tie").alias("wanted__"))
    texts = docs.select("text").join(ties, F.xxhash64("text") == ties["wanted__"], "left_semi")
    return arrow_map(texts, make, "sid long, found array<long>").dropDuplicates(["sid"])


def _tiles(groups: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """key, i, j and ones (list of sid, c, n, bits): the tiles of keys that stand in different groups."""
    placed = groups.select("sid", "c", "n", "bits", F.explode("keys").alias("key"))
    several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi")
    open_ = scratch.cut(several.select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "open")
    own = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
    return (
        placed.join(open_.hint("merge"), "key")  # 26 rows a set: never broadcast, whatever the estimate
        .select("key", F.struct("sid", "c", "n", "bits").alias("one"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("one").alias("ones"))
        .where(F.size("ones") > 1)
    )


def _may(c: np.ndarray, n: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of a tile are candidates, and their differing bits."""
    differ = np.bitwise_count(bits[:, None] ^ bits).sum(axis=2, dtype=np.int64)
    small, large = np.minimum(n[:, None], n), np.maximum(n[:, None], n)
    return (c[:, None] != c) & (5 * small >= 4 * large) & (differ <= MOST_BITS), differ


def _unpacked(lists: pa.ListArray):
    """(sid, c, n, bits) of each tile of a batch."""
    flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    sid, c, n = (flat.field(k).to_numpy() for k in ("sid", "c", "n"))
    bits = flat.field("bits").flatten().to_numpy().reshape(len(sid), -1).view(np.uint64)
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        yield sid[a:b], c[a:b], n[a:b], bits[a:b]


def _nearest(tiles: DataFrame) -> DataFrame:
    """x, y, cx, cy: of each set of a tile the nearest candidate."""

    def make():
        def f(batch: pa.RecordBatch) -> dict | None:
            out = set()
            for sid, c, n, bits in _unpacked(batch.column("ones")):
                may, differ = _may(c, n, bits)
                near = np.where(may, differ, 1 << 20).argmin(axis=1)
                for i in np.nonzero(may.any(axis=1))[0].tolist():
                    out.add(min((sid[i], sid[near[i]], c[i], c[near[i]]), (sid[near[i]], sid[i], c[near[i]], c[i])))
            return dict(zip(("x", "y", "cx", "cy"), map(list, zip(*sorted(out), strict=True)), strict=True)) if out else None

        return f

    return arrow_map(tiles.select("ones"), make, "x long, y long, cx long, cy long")


def _members(tiles: DataFrame) -> DataFrame:
    """key, i, j, sid, c: the sets of a tile that have a candidate."""

    def make():
        def f(batch: pa.RecordBatch) -> dict | None:
            out: dict[str, list] = {k: [] for k in ("row", "sid", "c")}
            for row, (sid, c, n, bits) in enumerate(_unpacked(batch.column("ones"))):
                own = _may(c, n, bits)[0].any(axis=1)
                out["row"].append(np.full(own.sum(), row))
                out["sid"].append(sid[own])
                out["c"].append(c[own])
            row, sid, c = (np.concatenate(x) for x in out.values())
            return {k: batch.column(k).to_numpy()[row] for k in ("key", "i", "j")} | {"sid": sid, "c": c} if len(row) else None

        return f

    return arrow_map(tiles, make, "key long, i int, j int, sid long, c long")


def _forest(tiles: DataFrame) -> DataFrame:
    """a, b: edges between groups that connect what the similar sets of each tile connect."""

    def make():
        def f(batch: pa.RecordBatch) -> dict | None:
            edges = set()
            for row in batch.column("members"):
                c, found = row.values.field("c").to_pylist(), [x.values.to_numpy() for x in row.values.field("found")]
                root = {g: g for g in c}

                def head(g: int, root: dict[int, int] = root) -> int:
                    while root[g] != g:
                        g = root[g]
                    return g

                for i in range(len(c)):
                    for j in range(i):
                        a, b = head(c[i]), head(c[j])
                        if a != b and 5 * min(len(found[i]), len(found[j])) >= 4 * max(len(found[i]), len(found[j])) and similar(found[i], found[j]):
                            root[max(a, b)] = min(a, b)
                            edges.add((c[i], c[j]))
            return {"a": [a for a, _ in edges], "b": [b for _, b in edges]} if edges else None

        return f

    return arrow_map(tiles.select("members"), make, "a long, b long")


def _regroup(placed: DataFrame, group: DataFrame) -> DataFrame:
    """placed with its groups c merged as `group` (node, component) says."""
    return placed.join(group, placed.c == group.node, "left").withColumn("c", F.coalesce("component", "c")).drop("node", "component")


def near_copies(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id and component_id, the smallest doc_id reachable by links. The result is a written table."""
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.cut(_prints(docs), "prints")
        nodes = scratch.cut(prints.groupBy("sid").agg(F.min("fp").alias("c"), F.max("fp").alias("top"), F.min("tie").alias("tie"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")), "nodes")
        # Equal sets whose fingerprints differ, by repeats or order.
        several = scratch.cut(nodes.where("c < top").select("sid", F.col("c").alias("a")), "several")
        several = prints.select("sid", F.col("fp").alias("b")).join(several, "sid").select("a", "b").distinct()
        group = components(links(nodes.select(F.col("c").alias("fp")).union(several.select("b")).distinct()).unionByName(several))
        groups = scratch.cut(_regroup(nodes.drop("top"), group), "groups")

        pairs = scratch.cut(_nearest(_tiles(groups, scratch, block)).distinct(), "pairs")
        ties = groups.select("sid", "tie")
        wanted = pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct()
        sets = scratch.cut(_sets(docs, scratch.cut(wanted.join(ties, "sid").select("tie"), "wanted")), "sets")
        both = pairs.join(sets.select(F.col("sid").alias("x"), F.col("found").alias("fx")), "x").join(sets.select(F.col("sid").alias("y"), F.col("found").alias("fy")), "y")
        enough = 9 * F.size(F.array_intersect("fx", "fy")) >= 4 * (F.size("fx") + F.size("fy"))
        near = scratch.cut(both.where(enough).select(F.col("cx").alias("a"), F.col("cy").alias("b")).distinct(), "near")
        groups = scratch.cut(_regroup(groups, components(near)), "groups")

        members = scratch.cut(_members(_tiles(groups, scratch, block // 2)), "members")
        rest = members.select("sid").distinct()
        sets = scratch.cut(_sets(docs, scratch.cut(rest.join(ties, "sid").select("tie"), "wanted")), "sets")
        tiles = members.join(sets, "sid").groupBy("key", "i", "j").agg(F.collect_list(F.struct("c", "found")).alias("members"))
        groups = _regroup(groups.select("sid", "c"), components(scratch.cut(_forest(tiles).distinct(), "far")))

        found = scratch.cut(prints.select("doc_id", "sid").join(scratch.cut(groups, "placed"), "sid").select("doc_id", "c"), "found")
        smallest = scratch.cut(found.groupBy("c").agg(F.min("doc_id").alias("component_id")), "smallest")
        out, _ = cut(found.join(smallest, "c").select("doc_id", "component_id"), "near-copies")
    return out
