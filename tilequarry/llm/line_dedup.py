"""Line dedup by winnowing over line hashes.

A run of lines that holds MIN_WORDS words or more and stands earlier in the corpus is deleted where it comes later; earlier
means a smaller doc_id, or the same and a smaller position, without overlap. So the first copy always stays whole: of twelve
equal lines of ten words the first five stay. Blank lines are kept and don't interrupt a run.

Winnowing: of each shortest window of at least MIN_WORDS words that begins or ends with a line, the line of smallest hash is
the minimum, the first one of equal ones. Minima are the guaranteed fingerprints: a repeated run holds whole windows, and its
copies select the same minimum in each. Only the minima's positions are shipped at first, a row each, and joined by hash.
What stands at one position only goes no further (nearly all lines of a corpus without copies). A position that joined is
extended both ways, line by line: the windows that selected it reach back to the first line from which MIN_WORDS words still
cover it and forward to the last line up to which they do. Each step is compared by the hash of its lines with the first
position that agrees so far, so that a fingerprint which stands in many contexts meets the earliest copy of each, without
pairs. The steps that agree make up the repeated run from its first line to its last; they are merged and deleted.

Defined results: a null text stays null; documents without doc_id count as the last ones, in an order of their own by
text; rows with one doc_id are one document's copies, in order of text, equal rows being told apart by nothing (the same
lines are deleted in each); lines are compared without white space at the ends; a text of blank lines stays as it is; a
text can become empty (the row stays). An empty table gives an empty one. All columns of the input are kept, whatever their
names: names of working columns are chosen not to clash. Lines and texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, arrow_map, bounded, cut, documents, fresh

#: A repeated run of this many words is deleted; shorter ones stay.
MIN_WORDS = 50
_SPACE = " \t\n\r\x0b\x0c"


def line_arrays(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines that aren't blank: number of the line, 64-bit hash, words."""
    import xxhash

    digest, at, hashes, words = xxhash.xxh3_64_intdigest, [], [], []
    for i, line in enumerate(text.split("\n")):
        if line := line.strip(_SPACE):
            at.append(i)
            hashes.append(digest(line.encode()))
            words.append(len(line.encode().split()))
    return np.array(at, dtype=np.int64), np.array(hashes, dtype=np.uint64), np.array(words, dtype=np.int64)


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of each shortest window of at least `least` words that begins or ends with a line, each once."""
    upto = np.concatenate(([0], np.cumsum(words)))
    n = len(words)
    last = np.searchsorted(upto, upto[:-1] + least, side="left") - 1
    first = np.searchsorted(upto, upto[1:] - least, side="right") - 1
    lines = np.arange(n)
    whole, back = last < n, first >= 0
    pairs = np.unique(np.concatenate((lines[whole] * (n + 1) + last[whole], first[back] * (n + 1) + lines[back])))
    return pairs // (n + 1), pairs % (n + 1)


def _content(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lines of each window, in order."""
    import xxhash

    data = hashes.tobytes()
    return np.array([xxhash.xxh3_64_intdigest(data[8 * a : 8 * b + 8]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], dtype=np.uint64)


def _selected(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The line of smallest hash in each window, the first one of equal ones."""
    out = np.empty(len(first), dtype=np.int64)
    one = first == last
    out[one] = first[one]
    for k in np.nonzero(~one)[0]:
        out[k] = first[k] + int(np.argmin(hashes[first[k] : last[k] + 1]))
    return out


def _ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text and what orders documents: no__ (null ids last) and, for rows of one id, tie__ from the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("no"), F.xxhash64("text").alias("tie"))


def _anchors(docs: DataFrame, min_words: int) -> DataFrame:
    """A row per minimum: mark (its hash), no, tie, spot, and the windows that selected it as (first, last, content)."""

    def make():
        def f(batch: pa.RecordBatch) -> dict | None:
            out: dict[str, list] = {k: [] for k in ("no", "tie", "mark", "spot", "size", "first", "last", "content")}
            for no, tie, text in zip(batch.column("no").to_pylist(), batch.column("tie").to_pylist(), batch.column("text").to_pylist(), strict=True):
                at, hashes, words = line_arrays(text or "")
                if not len(at) or words.sum() < min_words:
                    continue
                first, last = windows(words, min_words)
                chosen = _selected(hashes, first, last)
                order = np.argsort(chosen, kind="stable")
                first, last = first[order], last[order]
                spots, size = np.unique(chosen, return_counts=True)
                out["no"].append(np.full(len(spots), no))
                out["tie"].append(np.full(len(spots), tie))
                out["mark"].append(hashes[spots].view(np.int64))
                out["spot"].append(at[spots])
                out["size"].append(size)
                out["first"].append(at[first])
                out["last"].append(at[last])
                out["content"].append(_content(hashes, first, last).view(np.int64))
            if not out["no"]:
                return None
            joined = {k: np.concatenate(v) for k, v in out.items()}
            ends = pa.array(np.concatenate(([0], np.cumsum(joined["size"]))), pa.int32())
            return {k: joined[k] for k in ("mark", "no", "tie")} | {"spot": joined["spot"].astype(np.int32)} | {k: pa.ListArray.from_arrays(ends, pa.array(joined[k], kind)) for k, kind in (("first", pa.int32()), ("last", pa.int32()), ("content", pa.int64()))}

        return f

    return arrow_map(_ordered(docs).select("no", "tie", "text"), make, "mark long, no long, tie long, spot int, first array<int>, last array<int>, content array<long>")


def _merged(ranges: DataFrame) -> DataFrame:
    """no, tie, starts and ends: a document's ranges of lines merged, in order."""

    def make():
        def f(batch: pa.RecordBatch) -> dict:
            starts, ends = [], []
            for first, last in zip(batch.column("first"), batch.column("last"), strict=True):
                a, b = first.values.to_numpy(), last.values.to_numpy()
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.nonzero(np.concatenate(([True], a[1:] > b[:-1] + 1)))[0]
                starts.append(a[new])
                ends.append(b[np.append(new[1:], len(a)) - 1])
            return {"no": batch.column("no"), "tie": batch.column("tie"), "starts": starts, "ends": ends}

        return f

    gathered = ranges.groupBy("no", "tie").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    return arrow_map(gathered, make, "no long, tie long, starts array<int>, ends array<int>")


def repeats(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """no, tie, starts and ends: the ranges of lines (numbered as split at line feeds) to delete, merged and in order."""
    with Scratch(docs.sparkSession) as scratch:
        anchors = scratch.cut(_anchors(docs, min_words), "minima")
        # A fingerprint at one position has one smallest and greatest position. Written tables on both sides of the joins: their
        # exchanges are plain, and the planner splits those of hot keys.
        place = F.struct("no", "tie", "spot")
        common = scratch.cut(anchors.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("mark"), "common")
        step = F.explode(F.arrays_zip("first", "last", "content")).alias("step")
        steps = scratch.cut(anchors.join(common, "mark", "left_semi").select("no", "tie", step).select("no", "tie", "step.*"), "steps")
        place = F.struct("no", "tie", "first", "last")
        first = scratch.cut(steps.groupBy("content").agg(F.min(place).alias("origin"), F.max(place).alias("end")).where("origin <> end").select("content", "origin"), "origins")
        apart = (F.col("no") != F.col("origin.no")) | (F.col("tie") != F.col("origin.tie")) | (F.col("first") > F.col("origin.last"))
        gone, _ = cut(_merged(steps.join(first, "content").where((place > F.col("origin")) & apart)), "repeats")
    return gone


def dedup(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later repeated runs deleted from text; the columns of docs and removed__, the deleted lines as a list.

    An input column removed__ gives way.
    """
    docs = docs.drop("removed__")
    no, tie, starts, ends = fresh(docs, "no__", "tie__", "starts__", "ends__")
    gone = bounded(repeats(docs, min_words=min_words), 64, "starts").toDF(no, tie, starts, ends)
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)) == gone[no]) & (F.xxhash64(docs["text"]) == gone[tie])
    lines = F.split(F.col("text"), "\n", -1)
    # What stands before each range and behind the last one. Blank lines between deleted ones go with them.
    begin, end = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1)), F.concat(starts, F.array(F.size(lines)))
    stay = F.flatten(F.zip_with(begin, end, lambda a, b: F.slice(lines, a + 1, b - a)))
    removed = F.flatten(F.zip_with(starts, ends, lambda a, b: F.sequence(a, b)))
    joined = docs.join(gone, same, "left")
    return joined.withColumn("text", F.when(F.col(starts).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))).withColumn("removed__", F.coalesce(removed, F.array().cast("array<int>"))).select(*docs.columns, "removed__")


def recount(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is such a column, as the length of text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return dedup(docs.select("doc_id", "text")).select("doc_id", F.size("removed__").cast("long").alias("n_removed"), F.array_join(F.col("removed__").cast("array<string>"), ",").alias("removed"), "text")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
a AS (SELECT doc_id, unnest(range(len(ls)))::INT AS i, unnest(list_transform(ls, lambda x: trim(x, E' \t\n\r\x0b\x0c'))) AS line FROM d),
n AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM a WHERE line <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
f AS (SELECT a.doc_id, a.p AS p, min(b.p) AS q FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - a.upto + a.w >= 50 GROUP BY a.doc_id, a.p
      UNION
      SELECT b.doc_id, max(a.p) AS p, b.p AS q FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.p >= a.p AND b.upto - a.upto + a.w >= 50 GROUP BY b.doc_id, b.p),
c AS (SELECT f.doc_id, f.p, f.q, string_agg(k.line, chr(10) ORDER BY k.p) AS content, min(k.i) AS first, max(k.i) AS last
      FROM f JOIN k ON k.doc_id = f.doc_id AND k.p BETWEEN f.p AND f.q GROUP BY f.doc_id, f.p, f.q),
o AS (SELECT content, min({'d': doc_id, 'a': first, 'b': last}) AS o FROM c GROUP BY content),
x AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1))::INT AS i FROM c JOIN o ON c.content = o.content WHERE doc_id > o.d OR first > o.b),
g AS (SELECT doc_id, list_sort(list(i)) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(gone), 0)::BIGINT AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed,
       CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda l, j: NOT list_contains(gone, (j - 1)::INT)), chr(10)) END AS text
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
