"""Labelled rows to learn from: a bounded sample, and rows held out of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are learnt from.
FIT_ROWS = 5_000
FOLDS = 5


def held_out(row_id: Column) -> Column:
    """Whether a row is never learnt from: crc32 of its id as text, modulo FOLDS, is 0; null ids are held out."""
    return F.coalesce(F.crc32(row_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most ``rows`` labelled rows that are not held out, picked by a hash of the id.

    Rows with a null id, label or text are not learnt from; the bound is what makes the broadcast safe.
    """
    known = labels.where(~held_out(F.col(row_id)) & F.col(label).isNotNull() & F.col(row_id).isNotNull())
    picked = known.select(F.col(row_id).alias("_picked"), F.col(label).cast("double").alias("label"))
    picked = picked.orderBy(F.xxhash64("_picked"), "_picked", "label").limit(rows)
    found = docs.where(F.col(text).isNotNull()).join(F.broadcast(picked), F.col(row_id) == F.col("_picked"))
    return found.select(F.col(text).alias("text"), "label").orderBy(F.xxhash64("text"), "label").limit(rows)
