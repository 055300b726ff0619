"""A corpus pipeline in five stages, each of which works on all that the one before it kept.

Quality rules reject documents; line dedup keeps one line of each group of similar lines; SimHash keeps one
document of each group of near duplicates; mixing repeats or thins sources to their targets; encoding gives
the pieces of what is left.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import linedup, mixing, simhash, spm, suffix
from millrace.llm.scratch import cut, discard


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or repeat themselves go; null and empty texts fail, repeated rows are judged alike."""
    return suffix.clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar lines the first stays; a document that has no word left goes, null texts included."""
    return linedup.without_repeats(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, of its texts the one of the smallest hash; rows without an id stay."""
    return simhash.keep_one(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes; a null source is a source."""
    return mixing.mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every whole text, and whether decoding them gave the text back."""
    found = spm.encode(docs, verify=True)
    return found.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.col("same").alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing_weights", mixing_weights),
    ("sentencepiece", sentencepiece),
]

#: SQL can express neither fuzzy lines by MinHash nor the tokenizer; tests/llm/test_pipeline.py holds run() against a plain chain.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again as the next one's input; a stage's table goes when the next is written.

    An empty table passes through all stages.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None and not docs.isEmpty():
            discard(before)
        before = docs
    return docs
