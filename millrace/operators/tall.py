"""Linear algebra of tall tables: factors come from the rows themselves, never from their squares.

Every task turns its rows into the triangular factor of their QR decomposition, a matrix of at most d rows, batch by
batch; factors are stacked and turned into one again in rounds of a bounded fan-in.  The last one has the table's
singular values and right vectors, and what least squares need, to full precision also where the cross products of
the columns would have lost it.  Wide tables are first met by a random test matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import cut
from .arrow import lists, matrix

#: Factors that are stacked at once.
FAN = 16


def _triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def _folded(parts: DataFrame, width: int) -> np.ndarray:
    """The triangular factor of all of ``parts`` (part, r: rows of a factor, one after another), at most ``width`` rows."""

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.concatenate([np.asarray(x, float).reshape(-1, width) for x in pdf["r"]]))
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN], "r": [r.reshape(-1)]})

    parts = cut(parts, "triangles")
    count = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while count > FAN:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("of")).applyInPandas(stack, "part long, r array<double>")
        count = -(-count // FAN)
    held = [np.array(r["r"]).reshape(-1, width) for r in parts.collect()]  # at most FAN factors of width x width
    return _triangle(np.concatenate(held)) if held else np.zeros((0, width))


def triangular(df: DataFrame, vector: str) -> np.ndarray:
    """R of the QR decomposition of the table whose rows are ``vector``; rows that are null or hold null do not count."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    first = rows.select(F.size("v").alias("n")).first()
    if first is None or not first["n"]:
        return np.zeros((0, 0))
    width = first["n"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros((0, width))
        for batch in batches:
            held = _triangle(np.concatenate([held, matrix(batch.column(0))])) if len(batch) else held
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), lists(held.reshape(1, -1))], names=["part", "r"])

    return _folded(rows.mapInArrow(fold, "part long, r array<double>"), width)


def svd(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as rows, each with its largest component positive."""
    r = triangular(df, vector)
    if not r.size:
        return np.zeros(0), r
    _, s, vt = np.linalg.svd(r, full_matrices=False)
    return s, _signed(vt)


def _signed(vt: np.ndarray) -> np.ndarray:
    return vt * np.sign(vt[np.arange(len(vt)), np.abs(vt).argmax(1)])[:, None]


def projected(df: DataFrame, vector: str, axes: np.ndarray, out: str = "at") -> DataFrame:
    """``df`` with its vectors' products with the rows of ``axes``: with right vectors, the left ones times singular values."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, lists(matrix(batch.column(at)) @ axes.T)], names=schema.names)

    return df.mapInArrow(run, schema)


def solve(df: DataFrame, features: list[str], targets: list[str], rcond: float = 1e-12) -> np.ndarray:
    """Least squares: a column of coefficients for each target, of smallest norm where features depend on each other.

    The factor of features and targets together holds all that is needed; rows with a null do not count.
    """
    known = df.dropna(subset=[*features, *targets]).select(F.array(*[F.col(c).cast("double") for c in [*features, *targets]]).alias("v"))
    r, d = triangular(known, "v"), len(features)
    if not r.size:
        return np.zeros((d, len(targets)))
    return np.linalg.lstsq(r[:, :d], r[:, d:], rcond=rcond)[0]


def wide_svd(df: DataFrame, vector: str, rank: int, more: int = 10, passes: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``rank`` largest singular values and right vectors of a table with many columns, by a range finder.

    ``passes`` powers sharpen the range.  Tasks add up one matrix of ``rank + more`` rows; nothing of the size of
    columns squared exists.  Values are approximate unless the table has no more than ``rank + more`` independent rows
    or columns.
    """
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    first = rows.select(F.size("v").alias("n")).first()
    if first is None or not first["n"]:
        return np.zeros(0), np.zeros((0, 0))
    width = first["n"]
    test = np.random.default_rng(seed).normal(size=(min(rank + more, width), width))
    for _ in range(passes + 1):
        r = triangular(projected(rows, "v", test, "y"), "y")
        u, s, _ = np.linalg.svd(r.T, full_matrices=False)
        keep = s > s[0] * 1e-13 if len(s) and s[0] > 0 else np.zeros(len(s), bool)
        if not keep.any():
            return np.zeros(0), np.zeros((0, width))
        basis = (u[:, keep] / s[keep]).T @ test  # rows: A basisᵀ has orthonormal columns
        inner = _crossed(rows, basis, width)
        test = np.linalg.qr(inner.T)[0].T
    _, s, vt = np.linalg.svd(inner, full_matrices=False)
    return s[:rank], _signed(vt[:rank])


def _crossed(rows: DataFrame, basis: np.ndarray, width: int) -> np.ndarray:
    """The sum over all rows a of (basis a) aᵀ."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(basis), width))
        for batch in batches:
            if len(batch):
                a = matrix(batch.column(0))
                total += (a @ basis.T).T @ a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(basis), dtype=np.int32)), lists(total)], names=["line", "x"])

    long = rows.mapInArrow(add, "line int, x array<double>").select("line", F.posexplode("x").alias("place", "x"))
    out = np.zeros((len(basis), width))
    for r in long.groupBy("line", "place").agg(F.sum("x").alias("x")).collect():
        out[r["line"], r["place"]] = r["x"]
    return out
