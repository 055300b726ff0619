"""Windows over pixels: separable filters, similarity, pooling and patches; tiles with a halo for large images.

The images of :mod:`images` are one row each.  An image too large for a row is a table of tiles; every tile is given
the edges of its neighbours by one shuffle, and then any filter whose reach the halo covers works on tiles alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .images import mapped
from .resample import drawn


def gaussian(radius: int, sigma: float) -> np.ndarray:
    """2 * radius + 1 weights of a normal law, which sum to 1."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2.0 * sigma**2))
    return k / k.sum()


def convolved(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Each line of ``x`` along an axis with symmetric or other ``weights`` centred on every place, zeros beyond the ends."""
    r = len(weights) // 2
    wide = np.pad(x, [(r, len(weights) - 1 - r) if a == axis else (0, 0) for a in range(x.ndim)])
    n = x.shape[axis]
    out = np.zeros_like(x, float)
    for k, weight in enumerate(weights[::-1]):
        out += weight * np.take(wide, range(k, k + n), axis)
    return out


def filtered(df: DataFrame, down: np.ndarray, across: np.ndarray) -> DataFrame:
    """Images under a separable filter, zeros beyond their edges."""
    return mapped(df, lambda x, _: convolved(convolved(x, across, 3), down, 2))


def blurred(df: DataFrame, key: str, low: float = 0.5, high: float = 1.5, seed: int = 0) -> DataFrame:
    """A normal blur whose width is drawn for each image; the result is kept in [0, 1]."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for k, s in enumerate(p[:, 0]):
            line = gaussian(max(1, int(3 * s)), s)
            out[k] = convolved(convolved(x[k], line, 2), line, 1)
        return np.clip(out, 0, 1)

    return mapped(df, kernel, [F.lit(float(low)) + drawn(key, seed, "sigma") * float(high - low)])


def motion_blurred(df: DataFrame, key: str, size: int = 7, seed: int = 0) -> DataFrame:
    """The mean of ``size`` (odd) neighbours, across or down as drawn."""
    line = np.full(size, 1.0 / size)

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.clip(np.where((p[:, 0] < 0.5)[:, None, None, None], convolved(x, line, 3), convolved(x, line, 2)), 0, 1)

    return mapped(df, kernel, [drawn(key, seed, "direction")])


def similarity(x: np.ndarray, y: np.ndarray, data_range: float = 1.0, size: int = 11, sigma: float = 1.5, eps: float = 1e-12) -> np.ndarray:
    """Structural similarity of two stacks at every place, from means, variances and covariances under a normal window."""
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    line /= line.sum()
    # where an image is smaller than the window, the result of the full convolution is cut to the longer of the two
    blur = lambda z: _same(_same(z, line, 3), line, 2)
    mx, my = blur(x), blur(y)
    sx, sy, sxy = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    return ((2 * mx * my + c1) * (2 * sxy + c2)) / ((mx * mx + my * my + c1) * (sx + sy + c2) + eps)


def _same(x: np.ndarray, line: np.ndarray, axis: int) -> np.ndarray:
    if len(line) <= x.shape[axis]:
        return convolved(x, line, axis)
    return np.apply_along_axis(lambda m: np.convolve(m, line, "same"), axis, x)


def ssim(pairs: DataFrame, other: str = "other", data_range: float = 1.0, size: int = 11, sigma: float = 1.5, out: str = "ssim") -> DataFrame:
    """``pairs`` with the mean structural similarity of ``pixels`` and ``other``, images of one shape, in place of both."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return similarity(x, p.reshape(x.shape), data_range, size, sigma).mean((1, 2, 3))[:, None, None, None]

    same = F.when(F.size(other) == F.size("pixels"), F.col(other).cast("array<double>"))
    found = mapped(pairs.withColumn("_other", same), kernel, F.col("_other"))
    return found.withColumn(out, F.col("pixels")[0]).drop("_other", "pixels", other, "c", "h", "w")


def windows(x: np.ndarray, size: int, stride: int, pad: int = 0, value: float = 0.0, dilation: int = 1) -> np.ndarray:
    """The windows (n, c, rows, columns, size, size) of a stack."""
    wide = np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad)), constant_values=value)
    reach = (size - 1) * dilation + 1
    every = np.lib.stride_tricks.sliding_window_view(wide, (reach, reach), (2, 3))
    return every[:, :, ::stride, ::stride, ::dilation, ::dilation]


def pooled(df: DataFrame, size: int, stride: int, pad: int = 0, kind: str = "average") -> DataFrame:
    """The average (zeros in the margin count) or the largest value of every window."""
    if kind not in ("average", "largest"):
        raise ValueError(f"kind must be average or largest, not {kind!r}")
    value = 0.0 if kind == "average" else -np.inf
    return mapped(df, lambda x, _: windows(x, size, stride, pad, value).mean((4, 5)) if kind == "average" else windows(x, size, stride, pad, value).max((4, 5)))


def patches(df: DataFrame, size: int, stride: int, dilation: int = 1, place: str = "patch") -> DataFrame:
    """A row for every window, numbered line by line, with the window's pixels channel by channel; windows do not leave the image."""

    def kernel(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        each = windows(x, size, stride, dilation=dilation)
        n, c, a, b = each.shape[:4]
        return np.moveaxis(each, 1, 3).reshape(n, a * b, c, size * size)  # patch, channel, place: a stack of other shape

    found = mapped(df.withColumn("_c", F.col("c")), kernel)
    whole = F.col("_c") * size * size
    part = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.slice("pixels", (k * whole + 1).cast("int"), whole.cast("int")))
    rows = found.select(*[c for c in df.columns if c not in ("c", "h", "w", "pixels")], "_c", F.posexplode(F.when(F.col("c") > 0, part)).alias(place, "pixels"))
    return rows.select(*[c for c in df.columns if c not in ("c", "h", "w", "pixels")], F.col("_c").alias("c"), F.lit(size).alias("h"), F.lit(size).alias("w"), place, "pixels")


# tiles


def tiled(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, ty, tx, rows, columns, c, h, w, pixels): images cut into tiles of ``size``; rows and columns are how many tiles an image has."""
    count = lambda side: F.ceil(F.col(side) / size).cast("int")
    each = df.select(F.col(key).alias("key"), "c", "h", "w", "pixels", count("h").alias("rows"), count("w").alias("columns"))
    each = each.withColumn("ty", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("tx", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))

    def kernel(x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        return [own[:, int(t) * size : (int(t) + 1) * size, int(s) * size : (int(s) + 1) * size] for own, (t, s) in zip(x, p)]

    return mapped(each, kernel, [F.col("ty"), F.col("tx")]).withColumnRenamed("key", key)


def with_halo(tiles: DataFrame, key: str, halo: int) -> DataFrame:
    """Tiles with ``halo`` more pixels on all sides, from their neighbours; zeros where the image ends.

    A tile is at least ``halo`` wide and high unless it is its image's last.  Each tile is sent to its eight
    neighbours as the strip that they need, and tiles meet their strips by one shuffle.
    """
    near = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])
    sent = tiles.withColumn("_to", F.explode(near))
    sent = sent.withColumns({"_y": F.col("ty") + F.col("_to.y"), "_x": F.col("tx") + F.col("_to.x"), "dy": -F.col("_to.y"), "dx": -F.col("_to.x")}).drop("_to")
    sent = sent.where("_y >= 0 and _y < rows and _x >= 0 and _x < columns")

    def strip(x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        # a neighbour above (dy = -1) gives its last lines, one below its first
        cut = lambda d, n: slice(max(0, n - halo), n) if d < 0 else slice(0, min(halo, n)) if d > 0 else slice(0, n)
        return [own[:, cut(dy, own.shape[1]), cut(dx, own.shape[2])] for own, (dy, dx) in zip(x, p)]

    strips = mapped(sent, strip, [F.col("dy"), F.col("dx")])
    others = [c for c in tiles.columns if c not in (key, "ty", "tx", "c", "h", "w", "pixels")]
    own = (F.col("dy") == 0) & (F.col("dx") == 0)
    met = strips.groupBy(key, F.col("_y").alias("ty"), F.col("_x").alias("tx")).agg(*[F.max(F.when(own, F.col(c))).alias(c) for c in (*others, "c", "h", "w")], F.collect_list(F.struct("dy", "dx", "h", "w", "pixels")).alias("strips"))
    at, names = {c: k for k, c in enumerate(met.columns)}, tiles.columns
    kinds = {f.name: f for f in tiles.schema.fields}

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = list(zip(*(batch.column(at[n]).to_pylist() for n in "chw")))
            made = []
            for i, (c, h, w) in enumerate(shapes):
                out = np.zeros((c, h + 2 * halo, w + 2 * halo))
                parts = batch.column(at["strips"])[i].values
                sides = zip(*(parts.field(n).to_pylist() for n in ("dy", "dx", "h", "w")))
                for part, (dy, dx, high, wide) in zip(parts.field("pixels"), sides):
                    y = halo - high if dy < 0 else halo + h if dy > 0 else halo
                    x = halo - wide if dx < 0 else halo + w if dx > 0 else halo
                    out[:, y : y + high, x : x + wide] = part.values.to_numpy(zero_copy_only=False).reshape(c, high, wide)
                made.append(out)
            columns = {n: batch.column(at[n]) for n in names if n != "pixels"}
            columns |= {n: pa.array([o.shape[d] for o in made], columns[n].type) for n, d in (("h", 1), ("w", 2))}
            columns["pixels"] = pa.array([o.reshape(-1) for o in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return met.mapInArrow(join, T.StructType([T.StructField(n, kinds[n].dataType) for n in names]))


def tile_filtered(tiles: DataFrame, key: str, down: np.ndarray, across: np.ndarray) -> DataFrame:
    """Tiles under a separable filter, as if their images were filtered whole."""
    halo = max(len(down), len(across)) // 2

    def kernel(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        out = convolved(convolved(x, across, 3), down, 2)
        return out[:, :, halo : out.shape[2] - halo, halo : out.shape[3] - halo]

    return mapped(with_halo(tiles, key, halo), kernel)


def pixel_rows(df: DataFrame, *keys: str | Column) -> DataFrame:
    """(keys, channel, y, x, value): a row for every pixel."""
    at = F.posexplode("pixels").alias("_at", "value")
    return df.select(*keys, "h", "w", at).select(*keys, F.floor(F.col("_at") / (F.col("h") * F.col("w"))).alias("channel"), (F.floor(F.col("_at") / F.col("w")) % F.col("h")).alias("y"), (F.col("_at") % F.col("w")).cast("long").alias("x"), "value")
