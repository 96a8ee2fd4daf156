"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the last
return the columns of `documents`, and columns beyond these pass through, whatever their names. run() writes each stage's
result as Parquet into the shared folder and reads it again; a stage's input is deleted when its result is written. SQL can't
express the stages that hash with XXH64 or encode, so there is none: tests/llm holds the stages and run() against
brute-force versions.

Defined results: a null or empty text gives no language evidence of its own (declaration and source decide), has nothing to
delete, is a copy of other empty ones and has no tokens, but mixing takes only documents with a word. Of rows with one doc_id
near-dedup keeps those of the smallest id of a group; rows without doc_id stay only in groups that have none with one. Rows
that are equal in text get equal decisions. An empty table gives an empty one with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilequarry.llm import bpe, language, line_dedup, mixing, near_copies, simhash
from tilequarry.llm.common import cut, documents, drop_table

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't known go."""
    return language.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that stand earlier are deleted from the text; n_chars follows."""
    cleaned = line_dedup.dedup(docs).drop("removed__")
    return line_dedup.recount(cleaned).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (SimHash within 3 bits, or 5-word Jaccard 0.8) the document of smallest id stays."""
    return simhash.keep_smallest(docs, near_copies.near_copies(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and round_trip: whether decoding gives the text again."""
    return bpe.encode_checked(docs, keep=("doc_id", "lang", "source"))


STAGES = [("language ID", language_id), ("line dedup", dedup_lines), ("SimHash near-dedup", near_dedup), ("mixing", mix_sources), ("byte-level BPE", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole of `documents`."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        docs, where = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            drop_table(spark, before)
        before = where
    return docs
