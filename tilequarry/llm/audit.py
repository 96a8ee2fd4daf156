"""Audit of how text filters interact: what each filter of a sequence removes, in every order, by part of the corpus.

Five conditions fail a document: A, few words; B, few distinct words; C, many capitals; D, symbols; E, a copy of a text with a
smaller doc_id. Words are rows: texts are exploded, (document, word) is counted, then a document's words are summed and its
distinct words counted. The other conditions are outer-joined, the five make a number of five bits, and each part gets 32
conditional counts (of all documents, of good and of toxic ones). Everything about the 120 orders follows from those counts.

A document's key is its doc_id and the SHA-256 of its text, so that rows with one doc_id or none stay apart; texts are dealt out
by that key before words are made of them, and (document, word) and documents are counted where they are. Copies of a text
meet only as sums and are marked by a join on the smallest id of a text and the text, which no two documents share.

Defined results: a null text is an empty one; a row without doc_id is a copy of nothing, nothing is a copy of it, and it has no labels; rows
equal in doc_id and text count as often as they stand there, none being a copy of the other; a null language is the part '';
of several labels of one doc_id any good or toxic one counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm.common import documents

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
BLANKS = "[\\x20\\x09-\\x0D]+"


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def texts(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, key: texts and languages without nulls, and the text's checksum."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("key", text_key(F.col("text")))


def word_counts(rows: DataFrame) -> DataFrame:
    """doc_id, key, n_words, n_distinct of each (doc_id, text). Equal rows become one before they are shuffled; the words stay where their text is."""
    once = rows.groupBy("doc_id", "key").agg(F.first("text").alias("text"))
    words = once.select("doc_id", "key", F.explode(F.split("text", BLANKS)).alias("word")).where("word != ''")
    each = words.groupBy("doc_id", "key", "word").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id", "key").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, n (equal rows), mask: bit k is set where the document fails filter k."""
    rows = texts(docs)
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    shouts, symbols = (100 * capitals > 3 * F.length("text")).alias("shouts"), F.col("text").rlike("[#$%&*|]").alias("symbols")
    plain = rows.select("doc_id", "part", "key", shouts, symbols).groupBy("doc_id", "part", "key", "shouts", "symbols").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    p, w, f = plain.alias("p"), word_counts(rows).alias("w"), first.alias("f")
    joined = p.join(w, F.col("p.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("p.key") == F.col("w.key")), "left").join(f, F.col("p.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("p.key") == F.col("f.key")), "left")
    n_words, n_distinct = F.coalesce("w.n_words", F.lit(0)), F.coalesce("w.n_distinct", F.lit(0))
    fails = (n_words < 200, 100 * n_distinct < 50 * n_words, F.col("p.shouts"), F.col("p.symbols"), F.col("p.doc_id").isNotNull() & F.col("f.first").isNull())
    mask = sum(((F.when(x, 1 << k).otherwise(0)) for k, x in enumerate(fails)), F.lit(0))
    return joined.select("p.doc_id", "p.part", "p.n", mask.alias("mask"))


def counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, all_, good, toxic: arrays of MASKS numbers of documents by mask."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
    rows = failed.join(marks, failed["doc_id"] == marks["id"], "left")  # a hot null doc_id is split by AQE, as any skewed left side
    kinds = {"all_": F.lit(True), "good": F.col("good") == 1, "toxic": F.col("toxic") == 1}
    sums = [F.coalesce(F.sum(F.when(kind & (F.col("mask") == m), F.col("n"))), F.lit(0)).alias(f"{name}{m}") for name, kind in kinds.items() for m in range(MASKS)]
    return rows.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{name}{m}" for m in range(MASKS)]).alias(name) for name in kinds])


def report(table: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step, from counts()."""
    orders = F.explode(F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])).alias("filter_order")
    steps = table.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit_of = lambda letter: F.element_at(F.create_map(*[F.lit(v) for k, c in enumerate(FILTERS) for v in (c, 1 << k)]), letter)
    own = bit_of(F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    earlier = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, c: acc + bit_of(c))
    steps = steps.select("*", own.alias("own"), earlier.alias("earlier"))

    def total(of: str, which) -> Column:
        """The documents of all masks that are chosen."""
        return F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(MASKS - 1)), which), F.lit(0).cast("long"), lambda acc, m: acc + F.get(F.col(of), m))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("earlier")) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # Of the orders, a filter comes first among the k that fail a document in one of k.
    share = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(MASKS - 1)), fails), F.lit(0).cast("long"), lambda acc, m: acc + F.get(F.col("all_"), m) * (F.lit(len(list(permutations(FILTERS)))) / F.bit_count(m)).cast("long"))
    return steps.select(
        "part", "filter_order", "step",
        total("all_", lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total("all_", removed).alias("removed"),
        total("all_", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("all_", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return report(counts(failures(docs), labels))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


OP13_SQL = """
WITH marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 END) AS good, max(CASE WHEN toxic = 1 THEN 1 END) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
f AS (SELECT part, good, toxic, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN marks USING (doc_id)),
parts AS (SELECT DISTINCT part FROM f),
c AS (SELECT part, mask, count(*) AS n, count(good) AS good, count(toxic) AS toxic, bit_count(mask) AS k FROM f GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT l1.l || l2.l || l3.l || l4.l || l5.l AS filter_order, [l1.b, l2.b, l3.b, l4.b, l5.b] AS bits FROM l l1, l l2, l l3, l l4, l l5
      WHERE l1.b | l2.b | l3.b | l4.b | l5.b = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT p.part, s.filter_order, s.step,
       coalesce(sum(c.n) FILTER (c.mask & (s.own | s.earlier) = 0), 0)::BIGINT AS kept,
       coalesce(sum(c.n) FILTER (c.mask & s.own <> 0 AND c.mask & s.earlier = 0), 0)::BIGINT AS removed,
       coalesce(sum(c.n) FILTER (c.mask & s.own <> 0 AND c.mask & s.earlier <> 0), 0)::BIGINT AS redundant,
       coalesce(sum(c.n) FILTER (c.mask = s.own), 0)::BIGINT AS unique_fails,
       coalesce(sum(c.good) FILTER (c.mask & s.own <> 0 AND c.mask & s.earlier = 0), 0)::BIGINT AS good_lost,
       coalesce(sum(c.toxic) FILTER (c.mask & s.own <> 0 AND c.mask & s.earlier = 0), 0)::BIGINT AS toxic_lost,
       coalesce(sum(c.n * 120 // greatest(c.k, 1)) FILTER (c.mask & s.own <> 0), 0)::BIGINT AS shapley
FROM parts p CROSS JOIN s LEFT JOIN c ON c.part = p.part GROUP BY p.part, s.filter_order, s.step
"""
