"""Quality rules, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus; built-in functions only.

Every word and pair of neighbouring words of a text counts in one of BUCKETS cells by hash. The raw multinomial is counted
over all documents, the target multinomial over all documents that labels trust (quality = 1) but a held-out fold. There is
one pair of multinomials for each language group (the two letters that the declared language begins with), so that scores
don't depend on how languages are mixed. The raw one is smoothed by SMOOTHING counts a cell; the target one by PRIOR counts
dealt as the raw one, so that a cell weighs as much as the trusted text knows of it, in a small corpus as in a large one. A
document's score is the mean over its n-grams of log(target / raw): the sum normalised by length.

The threshold is calibrated on the held-out trusted documents, which score as any clean document does: their median less
SPREADS times the distance from the median down to the sixteenth percentile. A document is kept if the base rules don't fail
it and its score reaches the threshold: each document has its verdict, whatever the others get.

The model has BUCKETS numbers a language group, 677 groups at most (27 MB); it reaches the scoring expressions as a scalar
subquery. Counting combines before its shuffle, so a hot source or word is one row a task.

Defined results: a null text has no words, fails the base rules and has score 0; repeated rows and null doc_ids keep a row
each; null and unusual languages are one group, as are all rows where there is no column lang; a group without trusted text
scores 0; without held-out trusted documents nothing is below the threshold; an empty table gives an empty one; other columns
are ignored. Texts are read whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilequarry.llm.common import bounded, cut, documents

BUCKETS = 10_000
SMOOTHING = 1.0
PRIOR = 100_000.0
#: One in so many trusted documents, by hash of the id, calibrates and isn't counted.
FOLDS = 5
SPREADS = 5.0
#: Steps of a score's unit by which the calibration sees scores, up to REACH units either way.
STEPS, REACH = 10_000, 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _cells(hashes: Column, n: Column, buckets: int) -> Column:
    """The cells of all words and pairs."""
    pairs = F.transform(F.slice(hashes, 1, F.greatest(n - 1, F.lit(0))), lambda h, i: F.pmod(F.xxhash64(h, F.get(hashes, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")), pairs)


def _group(docs: DataFrame) -> Column:
    """The language group of a row: two letters, or none."""
    return F.coalesce(F.lower(F.regexp_extract(F.col("lang").cast("string"), "^([A-Za-z]{2})", 1)), F.lit("")) if "lang" in docs.columns else F.lit("")


def _held_out(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(folds)) == 0


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def measures(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, group__, the base measures and cells__, from doc_id, text and lang."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", _group(docs).alias("group__"), text.alias("text")).withColumn("words__", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    rows = rows.select(
        "doc_id",
        "group__",
        F.size("words__").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines__"),
        _hashes(F.col("words__")).alias("hashes__"),
    )
    n = F.size("hashes__")
    hashes = F.col("hashes__")
    threes = F.transform(F.slice(hashes, 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)))
    rows = rows.select("doc_id", "group__", "n_words", "word_chars", "n_symbols", (F.size("lines__") - F.size(F.array_distinct("lines__"))).cast("long").alias("n_dup_lines"), threes.alias("threes__"), _cells(hashes, n, buckets).alias("cells__"))
    repeated = F.size(F.array_distinct("threes__")) < F.size("threes__")
    # Windows are put in order only where one stands twice.
    rows = rows.withColumn("sorted__", F.when(repeated, F.sort_array(F.transform("threes__", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("threes__")
    ordered = F.col("sorted__")
    again = F.filter(ordered, lambda x, j: F.coalesce(x["h"] == F.get(ordered, j + 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, j - 1)["h"], F.lit(False)))
    rows = rows.withColumn("places__", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("sorted__")
    places = F.col("places__")
    covered = F.aggregate(F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3)))), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places__")


def model(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, smoothing: float = SMOOTHING, prior: float = PRIOR, folds: int = FOLDS) -> DataFrame:
    """One row, ratios: a map from language group to log(target / raw) by cell."""
    rows = docs.select("doc_id", _group(docs).alias("group"), F.coalesce("text", F.lit("")).alias("text"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        hashes = rows.select("group", _hashes(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("hashes"))
        return hashes.select("group", F.explode(_cells(F.col("hashes"), F.size("hashes"), buckets)).alias("cell")).groupBy("group", "cell").agg(F.count(F.lit(1)).alias(name))

    # The raw counts leave texts where they are; only the texts that may be trusted meet the labels.
    fit = ~_held_out(F.col("doc_id"), folds)
    trusted, _ = cut(_trusted(labels).where(fit), "trusted")
    target = counted(rows.where(fit).join(bounded(trusted, 16), "doc_id", "left_semi"), "target")
    # Written, as it is read more than once: at most buckets rows a group.
    counts, _ = cut(counted(rows, "raw").join(target, ["group", "cell"], "left"), "counts")
    every = counts.select("group").distinct().select("group", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("cell"))
    summed = (
        every.join(counts, ["group", "cell"], "left").groupBy("group")
        .agg(
            F.array_sort(F.collect_list(F.struct("cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("cells"),
            F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"),
            F.coalesce(F.sum("target"), F.lit(0)).alias("target"),
        )
    )

    def ratio(c: Column) -> Column:
        raw = (c["raw"] + smoothing) / (F.col("raw") + smoothing * buckets)
        return F.log((c["target"] + prior * raw) / (F.col("target") + prior) / raw).cast("float")

    entries = summed.select(F.struct("group", F.transform("cells", ratio).alias("ratios")).alias("entry"))
    return entries.agg(F.map_from_entries(F.collect_list("entry")).alias("ratios"))


def threshold(scored: DataFrame, labels: DataFrame, *, folds: int = FOLDS, spreads: float = SPREADS) -> DataFrame:
    """One row, cut: null if no trusted document is held out. Scores of a step are one row, and there are so many steps."""
    clean = scored.where(_held_out(F.col("doc_id"), folds) & ~F.col("base_failed")).select("doc_id", "score").join(_trusted(labels), "doc_id", "left_semi")
    step = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("score"))) * STEPS)
    steps = clean.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    upto, whole = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("step")), F.sum("n").over(Window.partitionBy(F.lit(0)))
    steps = steps.select("step", upto.alias("upto"), whole.alias("whole"))
    median, low = F.min(F.when(F.col("upto") * 2 >= F.col("whole"), F.col("step"))), F.min(F.when(F.col("upto") * 25 >= F.col("whole") * 4, F.col("step")))
    # A step more on either side: what a step rounds off doesn't count as spread.
    return steps.agg(((median - spreads * (median - low + 1)) / STEPS).alias("cut"))


def score(docs: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, folds: int = FOLDS, spreads: float = SPREADS, **options) -> DataFrame:
    """A row per document: doc_id, the base measures, base_failed, score and kept."""
    ratios = model(docs, labels, buckets=buckets, folds=folds, **options).scalar()
    rows = measures(docs, buckets).withColumn("ratios__", F.try_element_at(ratios, F.col("group__")))
    total = F.aggregate("cells__", F.lit(0.0), lambda acc, c: acc + F.get(F.col("ratios__"), c))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("score", F.coalesce(total / F.nullif(F.size("cells__"), F.lit(0)), F.lit(0.0))).withColumn("base_failed", failed)
    scored, _ = cut(rows.drop("cells__", "ratios__", "group__"), "quality-scores")
    limit = threshold(scored, labels, folds=folds, spreads=spreads).scalar()
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.coalesce(limit, F.lit(float("-inf")))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
