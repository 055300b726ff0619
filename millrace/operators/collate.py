"""Batches as rows: the rows of a batch side by side, in the order of a key, sequences padded to the longest of their batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collated(df: DataFrame, batch: str, key: str, stack: list[str] | None = None, pad: dict[str, float] | None = None, mask: bool = True) -> DataFrame:
    """A row for each batch: ``n``, an array in the order of ``key`` of each column, and of padded ones ``<c>_length`` and ``<c>_mask``.

    ``stack`` names columns that are taken as they are, and ``pad`` array columns with the value that fills them up to the
    longest of the batch: ids, frames or boxes, whose elements may be arrays or structs of numbers themselves.  A null
    array counts as empty.  Batches are small by what made them (:func:`text.batches`).
    """
    pad = pad or {}
    fields = [*(stack or []), *pad]
    kinds = {c: df.schema[c].dataType for c in fields}
    ragged = [F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) if c in pad else F.col(c) for c in fields]
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("_key"), *ragged))).alias("_rows"))
    each = lambda c: F.transform("_rows", lambda r: r[c])
    out = [F.col(batch), F.size("_rows").alias("n"), each("_key").alias(key), *[each(c).alias(c) for c in stack or []]]
    for c, value in pad.items():
        sizes = F.transform(each(c), F.size)
        longest = F.array_max(sizes)
        fill = _like(kinds[c].elementType, value, F.flatten(each(c))[0])
        out += [_padded(each(c), fill, longest).alias(c), sizes.alias(f"{c}_length")]
        if mask:
            out.append(_masks(sizes, longest).alias(f"{c}_mask"))
    return rows.select(*out)


def _padded(arrays: Column, fill: Column, size: Column) -> Column:
    return F.transform(arrays, lambda x: F.concat(x, F.array_repeat(fill, size - F.size(x))))


def _masks(sizes: Column, size: Column) -> Column:
    return F.transform(sizes, lambda n: F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), size - n)))


def _like(kind: T.DataType, value: float, example: Column) -> Column:
    """``value`` in the shape of an element: alone, in every field of a struct, or at every place of an array like the example."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_like(f.dataType, value, example[f.name]).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(example, lambda x: _like(kind.elementType, value, x)).cast(kind)
    return F.lit(value).cast(kind)


def sequence_pairs(df: DataFrame, batch: str, key: str, source: str = "src", target: str = "tgt", pad: int = 0) -> DataFrame:
    """Batches of two sequences a row, each padded for itself."""
    return collated(df, batch, key, [], {source: pad, target: pad}, mask=False)


def detections(df: DataFrame, batch: str, key: str, images: list[str], boxes: str = "boxes", labels: str = "labels") -> DataFrame:
    """Batches of images as they are and of their boxes and labels, padded with zeros and -1."""
    return collated(df, batch, key, images, {boxes: 0.0, labels: -1})


def videos(df: DataFrame, batch: str, key: str, frames: str = "video", pad: float = 0.0, others: list[str] | None = None) -> DataFrame:
    """Batches of sequences of frames, shorter ones filled up with frames of ``pad``."""
    return collated(df, batch, key, others, {frames: pad})


def tracks(df: DataFrame, batch: str, key: str, boxes: str = "boxes", ids: str = "track_ids", visible: str = "visible", others: list[str] | None = None) -> DataFrame:
    """Batches of tracked objects: boxes, ids and visibility by time, filled up with zeros, -1 and 0."""
    return collated(df, batch, key, others, {boxes: 0.0, ids: -1, visible: 0})


def next_token_pairs(ids: Column, ignore: int = -100) -> tuple[Column, Column]:
    """A sequence and what follows each of its places; nothing follows the last, which has ``ignore``."""
    return ids, F.when(F.size(ids) > 0, F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(ignore).cast("long")))).otherwise(ids)
