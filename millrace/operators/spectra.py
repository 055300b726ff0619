"""Series under the Fourier transform, in Arrow batches: the series of a batch that have one length are one matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .resample import drawn


def transformed(df: DataFrame, series: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], params: list[Column], out: str | None = None) -> DataFrame:
    """``df`` with what ``kernel`` makes of a matrix of series of one length and their parameters; null for null series or series with nulls."""
    out, k, n = out or series, len(df.columns), len(params)
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, own = batch.column(k), np.stack([batch.column(k + 1 + j).to_numpy(zero_copy_only=False) for j in range(n)], 1).astype(float) if n else np.zeros((len(batch), 0))
            groups: dict[int, list[int]] = {}
            for i, line in enumerate(lines):
                if line.is_valid and line.values.null_count == 0:
                    groups.setdefault(len(line), []).append(i)
            made: list = [None] * len(batch)
            for rows in groups.values():
                x = np.stack([lines[i].values.to_numpy(zero_copy_only=False) for i in rows])
                for i, y in zip(rows, kernel(x, own[rows])):
                    made[i] = y
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    given = [p.cast("double").alias(f"_given_{j}") for j, p in enumerate(params)]
    return df.select("*", F.col(series).cast("array<double>").alias("_series"), *given).mapInArrow(run, schema)


def band_dropped(x: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Series without the frequencies from ``first`` on, ``width`` of them."""
    f = np.fft.rfft(x, axis=1)
    k = np.arange(f.shape[1])[None]
    f[(k >= first[:, None]) & (k < first[:, None] + width)] = 0
    return np.fft.irfft(f, x.shape[1], axis=1)


def frequency_dropout(df: DataFrame, key: str, series: str, share: float = 0.1, chance: float = 0.2, seed: int = 0) -> DataFrame:
    """A band of ``share`` of the frequencies, at a drawn place, goes from series drawn with ``chance``; series of fewer than four values stay."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        if x.shape[1] < 4:
            return x
        frequencies = x.shape[1] // 2 + 1
        width = max(1, round(share * frequencies))
        first = np.floor(p[:, 1] * max(1, frequencies - width)).astype(int)
        return np.where((p[:, 0] <= chance)[:, None], band_dropped(x, first, width), x)

    return transformed(df, series, kernel, [drawn(key, seed, "hit"), drawn(key, seed, "band")])


def power(df: DataFrame, series: str, out: str = "power") -> DataFrame:
    """Squared magnitudes of the frequencies of each series."""
    return transformed(df, series, lambda x, _: np.abs(np.fft.rfft(x, axis=1)) ** 2 if x.shape[1] else x, [], out)
