"""Mixing sources to target weights by Pareto order sampling.

Sources share a word budget by weight; a target is at most `cap` times its source's size, and what exceeds that goes to
the others by weight (like filling with water: in order of cap per weight, sources are full before the level reaches the
others). Within a source longer documents are expected more often: a document's expected number of copies is a rate times its
odds weight (ODDS plus the binary digits of its size), `cap` at most, and the rate is the one at which the expected words are
the target. The whole copies of that number are certain. What is left of it is the inclusion probability p of one copy more,
unequal within a source: documents are ranked by the Pareto key, random odds u / (1 - u) over inclusion odds p / (1 - p),
and the first ones are taken until the words come nearest to what the certain copies leave of the target.

No task sorts a source. Odds weights are few, so that rates follow from a sum of words for each source and weight. The key Q
is held as Q / (1 + Q), of which words are summed by cells (SPLIT a step); the cell in which the target falls is found from at
most SPLIT sums a source, the same is done within that cell, and only the documents of one of SPLIT * SPLIT cells are put
in order. What comes out is a bound on the key for each source.

Defined results: a null text has size 0, and documents of size 0 are never taken; sources sort by code point, null last;
rows with one doc_id share u (without one, rows with one text do), and rows of equal key are taken together; an empty table
gives an empty one; columns of the input are kept, whatever their names: working columns are named not to clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, bounded, cut, documents, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = "mix-1"
#: Cells of a histogram step.
SPLIT = 4096
#: u is a whole number below this, and a half, over this; so is the Pareto key.
RANGE = 2**52
#: The odds weight of a document is this and the number of binary digits of its size.
ODDS = 8


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters but space and U+0009 to U+000D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def random_number(doc_id: Column, text: Column, seed: str) -> Column:
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), own)), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size and target from key and source_size. One row for each source is all that meets in one task."""
    alone = Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(alone.orderBy("key")) - 1
    order = alone.orderBy(F.col("limit"), F.col("key"))
    full_before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sizes.withColumn("weight", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
        .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(alone) - F.lit(float(cap)) * full_before) / left)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("limit"), F.struct("limit", "key", "level"))).over(alone)["level"])
        .select("key", "source_size", F.least(F.col("weight") * F.coalesce("level", F.lit(float("inf"))), F.lit(float(cap)) * F.col("source_size")).alias("target"))
    )


def _crossing(sums: DataFrame, goals: DataFrame, cell: str) -> DataFrame:
    """key, cell, below: of each source the first cell whose running sum of words passes `room`, and the sum before it."""
    run = Window.partitionBy("key").orderBy(cell)
    summed = sums.withColumn("upto", F.sum("words").over(run)).join(goals.select("key", "room"), "key").where(F.col("upto") > F.col("room"))
    return summed.groupBy("key").agg(F.min(F.struct(F.col(cell), (F.col("upto") - F.col("words")).alias("below"), "upto")).alias("at"))


def odds_weight(size: Column) -> Column:
    return F.when(size > 0, F.lit(ODDS) + F.length(F.bin(size))).otherwise(F.lit(0)).cast("long")


def expected(classes: DataFrame, goals: DataFrame, *, cap: float = CAP) -> DataFrame:
    """key, weight, source_size, target, room, whole, p from the words of each source and odds weight, and the targets.

    whole copies are certain, p is the probability of one more, and room the words that the certain copies leave.
    """
    down = Window.partitionBy("key").orderBy(F.col("weight").desc())
    full_before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("weight") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    alone = Window.partitionBy("key")
    rows = classes.join(goals, "key").withColumn("level", (F.col("target") - F.lit(float(cap)) * full_before) / F.nullif(left, F.lit(0)))
    fits = (F.col("level") * F.col("weight") <= F.lit(float(cap))) & (F.col("weight") > 0)
    rows = rows.withColumn("rate", F.max(F.when(fits, F.struct("weight", "level"))).over(alone)["level"])
    copies = F.when(F.col("target") >= F.lit(float(cap)) * F.col("source_size"), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.coalesce("rate", F.lit(float(cap))) * F.col("weight")))
    rows = rows.withColumn("copies", F.when(F.col("weight") > 0, copies).otherwise(F.lit(0.0))).withColumn("whole", F.floor("copies"))
    room = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(alone)
    return rows.select("key", "weight", "source_size", "target", room.alias("room"), "whole", (F.col("copies") - F.col("whole")).alias("p"))


def pareto_key(u: Column, p: Column) -> Column:
    """Q / (1 + Q) of Q = (u / (1 - u)) / (p / (1 - p)), as a whole number up to RANGE; null where p is 0."""
    u = (u + F.lit(0.5)) / F.lit(float(RANGE))
    random, inclusion = u * (1 - p), p * (1 - u)
    return F.when(p > 0, F.floor(random / (random + inclusion) * F.lit(float(RANGE))))


def bounds(ranked: DataFrame, goals: DataFrame, scratch: Scratch, *, split: int = SPLIT) -> DataFrame:
    """key and bound from key, rank, size and from key, room: documents of rank up to bound have a copy more."""
    wide = RANGE // split
    rows = ranked.where("rank is not null")
    first, second = F.floor(F.col("rank") / wide), F.floor(F.pmod(F.col("rank"), F.lit(wide)) / (wide // split))
    one = _crossing(rows.groupBy("key", first.alias("c1")).agg(F.sum("size").alias("words")), goals, "c1")
    one = scratch.cut(goals.join(one, "key").select("key", F.col("at.c1").alias("c1"), (F.col("room") - F.col("at.below")).alias("room")), "mix-cells")
    inside = rows.withColumn("c1", first).join(one.select("key", "c1"), ["key", "c1"])
    two = _crossing(inside.groupBy("key", second.alias("c2")).agg(F.sum("size").alias("words")), one, "c2")
    two = scratch.cut(one.join(two, "key").select("key", "c1", F.col("at.c2").alias("c2"), (F.col("room") - F.col("at.below")).alias("room")), "mix-cells")
    inside = rows.withColumns({"c1": first, "c2": second}).join(two.select("key", "c1", "c2"), ["key", "c1", "c2"])
    three = _crossing(inside.groupBy("key", "rank").agg(F.sum("size").alias("words")), two, "rank")
    nearer = F.col("at.upto") - F.col("room") < F.col("room") - F.col("at.below")
    found = two.join(three, "key").select("key", F.when(nearer, F.col("at.rank")).otherwise(F.col("at.rank") - 1).alias("bound"))
    # A source whose ranked documents all fit has no crossing.
    return goals.join(found, "key", "left").select("key", F.coalesce("bound", F.lit(RANGE)).alias("bound"))


def narrow(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("key"), random_number(F.col(doc_id), F.col(text), seed).alias("u"), word_count(F.col(text)).alias("size"))
    return rows.withColumn("weight", odds_weight(F.col("size")))


def _ranked(docs: DataFrame, scratch: Scratch, *, seed: str, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, split: int = SPLIT) -> tuple[DataFrame, DataFrame]:
    """Each document with its expectation and rank; and that expectation and the bound of each source and weight."""
    rows = scratch.cut(narrow(docs, seed=seed), "mix-rows")
    classes = scratch.cut(rows.groupBy("key", "weight").agg(F.sum("size").alias("words")), "mix-classes")
    goals = targets(classes.groupBy("key").agg(F.sum("words").alias("source_size")), weights=weights, share=share, cap=cap)
    plan = scratch.cut(expected(classes, scratch.cut(goals, "mix-goals"), cap=cap), "mix-plan")
    ranked = scratch.cut(rows.join(plan.drop("room"), ["key", "weight"]).withColumn("rank", pareto_key(F.col("u"), F.col("p"))).drop("u", "p"), "mix-ranked")
    rooms = plan.groupBy("key").agg(F.max("room").alias("room"))
    limits = scratch.cut(bounds(ranked, rooms, scratch, split=split), "mix-limits")
    return ranked, plan.join(limits, "key")


def copies(size: Column, whole: Column, rank: Column, bound: Column) -> Column:
    return F.when(size > 0, whole + F.coalesce((rank <= bound).cast("long"), F.lit(0))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, *, seed: str = SEED, **options) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken (words), copies."""
    with Scratch(docs.sparkSession) as scratch:
        ranked, plan = _ranked(docs, scratch, seed=seed, **options)
        limits = plan.select("key", "bound").distinct()
        n = copies(F.col("size"), F.col("whole"), F.col("rank"), F.col("bound"))
        found = ranked.join(limits, "key").select("doc_id", "size", "source_size", "target", (n * F.col("size")).alias("taken"), n.alias("copies"))
        return cut(found, "mix")[0]


def take(docs: DataFrame, *, seed: str = SEED, **options) -> DataFrame:
    """The mix: the rows of docs that it takes, as often as it takes them, all columns."""
    with Scratch(docs.sparkSession) as scratch:
        plan, _ = cut(_ranked(docs, scratch, seed=seed, **options)[1].select("key", "weight", "whole", "p", "bound"), "mix-bounds")
    key, weight, whole, p, bound, copy, size = fresh(docs, "key__", "weight__", "whole__", "p__", "bound__", "copy__", "size__")
    plan = bounded(plan, 128).toDF(key, weight, whole, p, bound)
    sized = docs.withColumn(size, word_count(F.col("text")))
    joined = sized.join(plan, (source_key(sized["source"]) == plan[key]) & (odds_weight(sized[size]) == plan[weight]))
    rank = pareto_key(random_number(F.col("doc_id"), F.col("text"), seed), F.col(p))
    n = copies(F.col(size), F.col(whole), rank, F.col(bound))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(0), n.cast("int")))).select(*docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT AS u,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key
  FROM documents),
s AS (SELECT key, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT key, source_size, (list_value(5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE))[((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size / weight AS lim FROM w),
v AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY lim, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / sum(weight) OVER (ORDER BY lim, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
g AS (
  SELECT key, source_size, least(weight * coalesce((SELECT arg_min(level, lim) FROM v WHERE level <= lim), 'inf'::DOUBLE), 2.0::DOUBLE * source_size) AS target FROM v),
e AS (SELECT d.*, CASE WHEN size > 0 THEN 8 + length(bin(size)) ELSE 0 END AS odds FROM d),
k AS (SELECT e.key, odds, source_size, target, sum(size)::BIGINT AS words FROM e JOIN g ON e.key = g.key GROUP BY ALL),
y AS (
  SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY key ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / nullif(sum(odds * words) OVER (PARTITION BY key ORDER BY odds DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)::BIGINT AS rate FROM k),
z AS (SELECT *, max({'o': odds, 'r': rate}) FILTER (WHERE odds > 0 AND rate * odds <= 2.0) OVER (PARTITION BY key) AS best FROM y),
c AS (
  SELECT *, CASE WHEN odds = 0 THEN 0.0::DOUBLE WHEN target >= 2.0 * source_size THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, coalesce(best.r, 2.0::DOUBLE) * odds) END AS expected FROM z),
t AS (SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p, target - (sum(floor(expected)::BIGINT * words) OVER (PARTITION BY key))::BIGINT AS room FROM c),
q AS (
  SELECT e.*, source_size, target, whole, p, room, (u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE * (1 - p) AS random, p * (1 - (u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS inclusion
  FROM e JOIN t ON e.key = t.key AND e.odds = t.odds),
n AS (SELECT *, CASE WHEN p > 0 THEN floor(random / (random + inclusion) * 4503599627370496.0::DOUBLE)::BIGINT END AS rank FROM q),
r AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY key ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY key, rank) AS own
  FROM n)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE size * (whole + CASE WHEN p > 0 AND (upto <= room OR (upto - own <= room AND upto - room < room - (upto - own))) THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM r
"""
