"""Small square matrices, one to a row: inverse, determinant and singular values in Arrow batches; penalties of weight tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tall


def _each(df: DataFrame, matrix: str, out: str, kind: T.DataType, kernel: Callable[[np.ndarray], list]) -> DataFrame:
    """``df`` with what ``kernel`` makes of a stack of square matrices of one size; null where the matrix is null, holds null or is not square."""
    schema = T.StructType([*[f for f in df.schema.fields if f.name != out], T.StructField(out, kind)])
    kept = [c for c in df.columns if c != out]
    arrow = pa.float64() if isinstance(kind, T.DoubleType) else pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, groups = batch.column(len(kept)), {}
            for i, line in enumerate(lines):
                n = int(len(line) ** 0.5 + 0.5) if line.is_valid else -1
                if n > 0 and n * n == len(line) and line.values.null_count == 0:
                    groups.setdefault(n, []).append(i)
            made: list = [None] * len(batch)
            for n, rows in groups.items():
                stack = np.stack([lines[i].values.to_numpy(zero_copy_only=False) for i in rows]).reshape(-1, n, n)
                for i, value in zip(rows, kernel(stack)):
                    made[i] = value
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kept))], pa.array(made, arrow)], names=schema.names)

    return df.select(*kept, F.col(matrix).cast("array<double>").alias("_matrix")).mapInArrow(run, schema)


def inverse(df: DataFrame, matrix: str, out: str = "inverse") -> DataFrame:
    """``df`` with the inverse of each matrix (line by line in one array); null where it is singular."""

    def kernel(m: np.ndarray) -> list:
        whole = np.linalg.cond(m) < 1 / np.finfo(float).eps
        made = np.linalg.inv(np.where(whole[:, None, None], m, np.eye(m.shape[1])))
        return [x.reshape(-1) if ok else None for x, ok in zip(made, whole)]

    return _each(df, matrix, out, T.ArrayType(T.DoubleType()), kernel)


def determinant(df: DataFrame, matrix: str, out: str = "determinant") -> DataFrame:
    return _each(df, matrix, out, T.DoubleType(), lambda m: list(np.linalg.det(m)))


def singular_values(df: DataFrame, matrix: str, out: str = "singular") -> DataFrame:
    return _each(df, matrix, out, T.ArrayType(T.DoubleType()), lambda m: list(np.linalg.svd(m, compute_uv=False)))


# penalties of a weight table: a row of weights for each unit


def spectral_norm(weights: DataFrame, vector: str) -> float:
    """The largest singular value of the whole table."""
    s, _ = tall.svd(weights, vector)
    return float(s[0]) if len(s) else 0.0


def nuclear_norm(weights: DataFrame, vector: str) -> float:
    """The singular values of the whole table, summed."""
    return float(tall.svd(weights, vector)[0].sum())


def orthogonal_penalty(weights: DataFrame, vector: str, strength: float = 1.0) -> float:
    """Squared distance of the products of all columns from the unit matrix."""
    r = tall.triangular(weights, vector)
    return float(strength * ((r.T @ r - np.eye(r.shape[1])) ** 2).sum()) if r.size else 0.0


def group_lasso(weights: DataFrame, vector: str, strength: float = 1.0) -> DataFrame:
    """One row ``penalty``: the norms of the rows, each times the root of its length, summed."""
    norm = F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return weights.agg(F.coalesce(strength * F.sum(norm * F.sqrt(F.size(vector).cast("double"))), F.lit(0.0)).alias("penalty"))


def max_norm(weights: DataFrame, vector: str, most: float = 3.0, eps: float = 1e-12) -> DataFrame:
    """``weights`` with rows scaled down whose norm exceeds ``most``."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    held = weights.withColumn("_scale", F.least(F.lit(1.0), most / (norm + eps)))
    return held.withColumn(vector, F.transform(v, lambda x: x * F.col("_scale"))).drop("_scale")
