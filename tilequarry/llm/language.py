"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence meet in a posterior over LANGUAGES and `other`:

* text: hashed byte trigrams, a multinomial for each language counted over all rows that declare it, a uniform one for
  `other`; the log-likelihood is tempered (each text weighs as at most EVIDENCE trigrams), as trigrams of one text are not
  independent;
* the language that the markup or metadata declares, with a reliability table counted from declared x text language;
* the suffix of the address (top-level domain, or the first folder of the path if it is a language code), with its own table;
* a prior of the host: its counts of text languages, smoothed towards its registered domain's, which are smoothed towards
  the corpus's, each with STRENGTH pseudo-counts.

All tables come from grouped aggregations over all rows (combined before the shuffle; a hot host is one row a task). Text
models have a fixed size (CELLS a language) and are the only thing broadcast; hosts are joined. A row is kept if its best
language is not `other` and its posterior reaches CONFIDENCE.

Defined results: a null or empty text (or markup without text) gives no text evidence; null or unknown declarations,
addresses and hosts give none either; with no evidence at all the corpus prior decides; repeated rows and null ids keep a row
each; an empty table gives an empty one; clashing columns don't matter, as work is done on a narrow table. Texts of any
length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm.common import Scratch, arrow_map, cut, documents, slices, small_batches, without

LANGUAGES = ("en", "de", "fr", "es")
CELLS = 1 << 14
EVIDENCE = 60.0
STRENGTH = 20.0
CONFIDENCE = 0.5
#: Mean log-likelihood a trigram that `other` has over a uniform one: a text must beat it to be of a language.
OTHER_GAIN = 0.35
#: Probability that a declaration or suffix says nothing about the text.
NOISE = 0.05


def cells_of(text: str) -> np.ndarray:
    """The cells of a text's byte trigrams, lower case for A-Z, digits and ASCII signs as one character, runs of it once."""
    data = _FOLD[np.frombuffer(text.encode(), dtype=np.uint8)]
    if len(data) > 1:
        data = data[np.concatenate(([True], (data[1:] != 32) | (data[:-1] != 32)))]
    if len(data) < 3:
        return np.empty(0, dtype=np.int64)
    x = data.astype(np.int64)
    return ((x[:-2] * 65599 + x[1:-1]) * 65599 + x[2:]) % 2147483647 % CELLS


_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint8)


def counts_by_declared(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """declared, cell, n over all rows that declare one of the languages; tasks add up first."""
    from pyspark.sql import types as T

    def run(batches):
        total = {lang: np.zeros(CELLS, dtype=np.int64) for lang in languages}
        for batch in batches:
            for part in slices(batch):
                for lang, text in zip(part.column("declared").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if text:
                        total[lang] += np.bincount(cells_of(text), minlength=CELLS)
        for lang, n in total.items():
            cells = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(n[cells])], names=["declared", "cell", "n"])

    schema = T.StructType([T.StructField("declared", T.StringType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
    return rows.where(F.col("declared").isin(*languages)).select("declared", "text").mapInArrow(run, schema).groupBy("declared", "cell").agg(F.sum("n").alias("n"))


def text_model(rows: DataFrame, languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """log(P(cell | language) / uniform), a row a language: CELLS x languages numbers, whatever the corpus."""
    with small_batches(rows.sparkSession):
        found = counts_by_declared(rows, languages).collect()  # at most CELLS rows a language
    counts = np.full((len(languages), CELLS), 0.5)
    for r in found:
        counts[languages.index(r["declared"]), r["cell"]] += r["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True) * CELLS).astype(np.float32)


def text_evidence(rows: DataFrame, model: np.ndarray, evidence: float = EVIDENCE) -> DataFrame:
    """rows without text, and loglik array<double>: of each language, then of `other`."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + ", loglik array<double>"

    def make():
        table = np.ascontiguousarray(shared.value.T)

        def one(text: str | None) -> list[float]:
            cells = cells_of(text) if text else np.empty(0, dtype=np.int64)
            if not len(cells):
                return [0.0] * (table.shape[1] + 1)
            mean = np.bincount(cells, minlength=CELLS).astype(np.float32) @ table / len(cells) if len(cells) > CELLS else table[cells].mean(axis=0)
            return (min(len(cells), evidence) * np.append(mean.astype(np.float64), OTHER_GAIN)).tolist()

        return lambda batch: {c: batch.column(c) for c in keep} | {"loglik": [one(t) for t in batch.column("text").to_pylist()]}

    return arrow_map(rows.select(*keep, "text"), make, schema)


def _best(scores: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(scores, F.array_max(scores)).cast("int"))


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    whole = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / whole)


def _sums(names: list[str]) -> list[Column]:
    """Rows of each text language."""
    return [F.sum(F.when(F.col("text_lang") == n, 1).otherwise(0)).alias(f"n_{i}") for i, n in enumerate(names)]


def _array(names: list[str]) -> Column:
    return F.array(*[F.col(f"n_{i}").cast("double") for i in range(len(names))])


def identify(rows: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, strength: float = STRENGTH, confidence: float = CONFIDENCE, scratch: Scratch | None = None) -> DataFrame:
    """rows without text, and text_lang, lang_id, posterior, kept.

    rows: text, declared (language code), suffix, host and domain (strings or null), and any columns to keep. scratch holds
    the tables that the result is read from; without one they stay until the driver's process ends.
    """
    names, scratch = [*languages, "other"], scratch or Scratch(rows.sparkSession)
    scored = scratch.cut(text_evidence(rows, text_model(rows, languages)).withColumn("text_lang", _best(F.col("loglik"), names)), "languages")
    size = len(names)
    zeros = F.array_repeat(F.lit(0.0), size)
    corpus = scored.agg(*_sums(names)).select(F.transform(_array(names), lambda n: n + 1.0).alias("c")).select(F.transform("c", lambda n: n / F.aggregate("c", F.lit(0.0), lambda acc, x: acc + x)).alias("corpus"))
    out = scored.withColumn("corpus", corpus.scalar())

    def smooth(counts: Column, towards: Column) -> Column:
        whole = F.aggregate(counts, F.lit(0.0), lambda acc, x: acc + x)
        return F.zip_with(counts, towards, lambda n, p: (n + strength * p) / (whole + strength))

    for level in ("domain", "host"):
        # Written, so that the join's sides are plain shuffles whose hot keys the planner can split. Rows without a host or
        # domain meet nothing in it and aren't dealt by it, but by a number.
        table = scratch.cut(scored.where(F.col(level).isNotNull()).groupBy(level).agg(*_sums(names)).select(F.struct(F.col(level), F.lit(0).cast("long").alias("salt")).alias("at__"), _array(names).alias(f"{level}_counts")), level)
        salt = F.when(F.col(level).isNull(), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)).cast("long")
        own = F.struct(F.coalesce(level, F.lit("")).alias(level), salt.alias("salt"))
        out = out.withColumn("own__", own).join(table, F.col("own__") == F.col("at__"), "left").drop("own__", "at__")
    out = out.withColumn("prior", smooth(F.coalesce("domain_counts", zeros), F.col("corpus"))).withColumn("prior", smooth(F.coalesce("host_counts", zeros), F.col("prior")))
    logs = F.zip_with("loglik", F.transform("prior", lambda p: F.log(p)), lambda a, b: a + b)
    out = out.withColumn("logs", logs)
    for kind in ("declared", "suffix"):
        # P(what is declared | language): few values that languages use, everything else is one value without evidence.
        value = F.when(F.col(kind).isin(*languages), F.col(kind))
        seen = scored.select(value.alias("value"), "text_lang").where("value is not null").groupBy("value").agg(*_sums(names)).select("value", _array(names).alias("n"))
        whole = scored.select(value.alias("value"), "text_lang").where("value is not null").agg(*_sums(names)).select(_array(names).alias("n"))
        likely = seen.withColumn("all", whole.scalar()).select(F.col("value").alias(f"{kind}_value"), F.zip_with("n", "all", lambda a, b: F.log((1 - NOISE) * (a + 0.5) / (b + 0.5 * len(languages)) + NOISE / len(languages))).alias(f"{kind}_logs"))
        # A row for each language at most.
        out = out.join(F.broadcast(likely), value == F.col(f"{kind}_value"), "left").withColumn("logs", F.zip_with("logs", F.coalesce(f"{kind}_logs", zeros), lambda a, b: a + b))
    out = out.withColumn("probabilities", _softmax(F.col("logs")))
    out = out.withColumn("lang_id", _best(F.col("probabilities"), names)).withColumn("posterior", F.array_max("probabilities"))
    kept = [c for c in rows.columns if c != "text"]
    return out.select(*kept, "text_lang", "lang_id", "posterior", ((F.col("lang_id") != "other") & (F.col("posterior") >= confidence)).alias("kept"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Of documents: the declared language is `lang`, the host is `source` (which has neither domain nor suffix)."""
    none = F.lit(None).cast("string")
    return docs.select("doc_id", "text", F.lower(F.substring("lang", 1, 2)).alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), none.alias("domain"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Of pages: text without markup, scripts and styles; html's lang; path folder or top-level domain; host and domain."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    folder = F.nullif(F.lower(F.regexp_extract("url", r"^[^:]+://[^/]*/([a-zA-Z]{2})(?:[-_][a-zA-Z]{2})?(?:/|$)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2})", 1)), F.lit(""))
    return pages.select(
        "page_id", F.regexp_replace(text, r"&[a-z#0-9]+;", " ").alias("text"), declared.alias("declared"), F.coalesce(folder, F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"),
        host.alias("host"), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"),
    )


def keep_known(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose language is known, all columns. Rows with one doc_id stay if one of them does.

    Only the ids that go are joined with docs: they are few where most languages are known.
    """
    with Scratch(docs.sparkSession) as scratch:
        found = identify(document_rows(docs), scratch=scratch, **options).groupBy("doc_id").agg(F.max("kept").alias("stays")).where("not stays").select("doc_id")
        gone, _ = cut(found, "unknown-language")
    return without(docs, gone)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and per page: doc_id or page_id, declared, host, text_lang, lang_id, posterior, kept."""
    none = F.lit(None).cast("long")
    rows = document_rows(documents(spark, sf_dir)).withColumn("page_id", none)
    rows = rows.unionByName(page_rows(documents(spark, sf_dir, "pages")).withColumn("doc_id", none))
    return identify(rows).select("doc_id", "page_id", "declared", "suffix", "host", "text_lang", "lang_id", F.round("posterior", 6).alias("posterior"), "kept")
