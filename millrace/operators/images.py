"""Images as rows: channels, height, width, and pixels as one array, channel by channel and line by line.

What is drawn for an image is a column expression over its key, so reruns agree.  Pixels change in Arrow batches: the
images of a batch that have one shape are one stack, and a kernel works on the stack.  Geometry is by inverse maps: a
matrix says for every place of the result where it comes from.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .resample import drawn

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def mapped(df: DataFrame, kernel: Kernel, params: list[Column] | Column | None = None) -> DataFrame:
    """``df`` with ``c``, ``h``, ``w`` and ``pixels`` as ``kernel`` makes them of a stack (n, c, h, w) and its parameters (n, k).

    ``params``: numbers, or one array column.  Rows whose pixels, shape or parameters are null, or whose pixels are not
    as many as the shape says, get null pixels.
    """
    names = df.columns
    given = params if isinstance(params, Column) else F.array(*[p.cast("double") for p in params]) if params else F.array().cast("array<double>")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    at = {n: names.index(n) for n in ("c", "h", "w", "pixels")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = list(zip(*(batch.column(at[n]).to_pylist() for n in ("c", "h", "w"))))
            pixels, own = batch.column(at["pixels"]), batch.column(len(names))
            groups: dict[tuple, list[int]] = {}
            for i, shape in enumerate(shapes):
                if None not in shape and pixels[i].is_valid and own[i].is_valid and len(pixels[i]) == shape[0] * shape[1] * shape[2]:
                    groups.setdefault((*shape, len(own[i])), []).append(i)
            made: list = [None] * len(batch)
            for (c, h, w, k), rows in groups.items():
                x = np.stack([pixels[i].values.to_numpy(zero_copy_only=False) for i in rows]).astype(np.float64).reshape(-1, c, h, w)
                p = np.stack([own[i].values.to_numpy(zero_copy_only=False) for i in rows]).astype(np.float64).reshape(len(rows), k)
                for i, y in zip(rows, kernel(x, p)):
                    made[i] = y
            columns = list(batch.columns[: len(names)])
            for n, d in (("c", 0), ("h", 1), ("w", 2)):
                columns[at[n]] = pa.array([s[d] if y is None else y.shape[d] for s, y in zip(shapes, made)], columns[at[n]].type)
            columns[at["pixels"]] = pa.array([None if y is None else y.reshape(-1) for y in made], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema.fields[at["pixels"]].dataType = T.ArrayType(T.DoubleType())
    return df.select(*[F.col(n).cast("array<double>").alias(n) if n == "pixels" else F.col(n) for n in names], given.alias("_given")).mapInArrow(run, schema)


# inverse maps


def sampled(x: np.ndarray, y_at: np.ndarray, x_at: np.ndarray, mode: str = "bilinear", padding: str = "zeros") -> np.ndarray:
    """A stack at places (n, rows, columns) between its pixels; padding: zeros (an image ends a pixel beyond its edge) or border."""
    n, c, h, w = x.shape
    flat = x.reshape(n, c, h * w)

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        place = np.clip(yy, 0, h - 1) * w + np.clip(xx, 0, w - 1)
        return np.take_along_axis(flat, np.broadcast_to(place.reshape(n, 1, -1), (n, c, place[0].size)), 2).reshape(n, c, *place.shape[1:])

    if mode == "nearest":
        yi, xi = np.rint(y_at).astype(np.int64), np.rint(x_at).astype(np.int64)
        out, inside = at(yi, xi), (yi >= 0) & (yi < h) & (xi >= 0) & (xi < w)
    elif mode == "bilinear":
        y0, x0 = np.floor(y_at).astype(np.int64), np.floor(x_at).astype(np.int64)
        fy, fx = (y_at - y0)[:, None], (x_at - x0)[:, None]
        upper = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
        lower = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
        out, inside = upper * (1 - fy) + lower * fy, (y_at > -1) & (y_at < h) & (x_at > -1) & (x_at < w)
    else:
        raise ValueError(f"mode must be bilinear or nearest, not {mode!r}")
    return out if padding == "border" else out * inside[:, None]


def warped(df: DataFrame, matrix: Column, height: int | None = None, width: int | None = None, mode: str = "bilinear", padding: str = "zeros") -> DataFrame:
    """Images seen through ``matrix``, an array of 6 (affine) or 9 (perspective) numbers a row that maps (x, y) of the result to the image."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        m = np.concatenate([p, np.tile([0.0, 0.0, 1.0], (len(p), 1))], 1) if p.shape[1] == 6 else p
        yy, xx = np.meshgrid(np.arange(height or x.shape[2], dtype=float), np.arange(width or x.shape[3], dtype=float), indexing="ij")
        u, v, z = np.einsum("nij,jab->inab", m.reshape(-1, 3, 3), np.stack([xx, yy, np.ones_like(xx)]))
        return sampled(x, v / z, u / z, mode, padding)

    return mapped(df, kernel, matrix)


def resized(df: DataFrame, height: int, width: int, mode: str = "bilinear") -> DataFrame:
    """Images of another size; corners stay corners."""

    def kernel(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        yy, xx = np.meshgrid(np.linspace(0, x.shape[2] - 1, height), np.linspace(0, x.shape[3] - 1, width), indexing="ij")
        return sampled(x, np.broadcast_to(yy, (len(x), height, width)), np.broadcast_to(xx, (len(x), height, width)), mode, "border")

    return mapped(df, kernel)


def homographies(to: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The matrices (n, 9) that map four points of the result, ``to`` (n, 4, 2) as x, y, to four of the image, ``of``."""
    x, y, u, v = to[..., 0], to[..., 1], of[..., 0], of[..., 1]
    one, nil = np.ones_like(x), np.zeros_like(x)
    lines = np.concatenate([np.stack([x, y, one, nil, nil, nil, -x * u, -y * u], -1), np.stack([nil, nil, nil, x, y, one, -x * v, -y * v], -1)], 1)
    found = np.linalg.solve(lines, np.concatenate([u, v], 1)[..., None])[..., 0]
    return np.concatenate([found, np.ones((len(found), 1))], 1)


def perspective(df: DataFrame, corners: Column, mode: str = "bilinear", padding: str = "zeros") -> DataFrame:
    """Images whose corners come from ``corners``, an array of x, y of the upper left, upper right, lower right and lower left."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        h, w = x.shape[2:]
        ends = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
        m = homographies(np.broadcast_to(ends, (len(x), 4, 2)), p.reshape(-1, 4, 2)).reshape(-1, 3, 3)
        yy, xx = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
        u, v, z = np.einsum("nij,jab->inab", m, np.stack([xx, yy, np.ones_like(xx)]))
        return sampled(x, v / z, u / z, mode, padding)

    return mapped(df, kernel, corners)


def _span(key: str, seed: int, salt: str, low: float, high: float) -> Column:
    return F.lit(float(low)) + drawn(key, seed, salt) * float(high - low)


def about_centre(a: Column, b: Column, d: Column, e: Column, dx: Column | None = None, dy: Column | None = None) -> Column:
    """The affine map with matrix [[a, b], [d, e]] about an image's centre, and a shift."""
    cx, cy = (F.col("w") - 1) / 2.0, (F.col("h") - 1) / 2.0
    return F.array(a, b, cx - a * cx - b * cy + (F.lit(0.0) if dx is None else dx), d, e, cy - d * cx - e * cy + (F.lit(0.0) if dy is None else dy))


def rotation(key: str, degrees: float = 10.0, seed: int = 0) -> Column:
    """A drawn turn of up to ``degrees``."""
    t = F.radians(_span(key, seed, "turn", -degrees, degrees))
    return about_centre(F.cos(t), F.sin(t), -F.sin(t), F.cos(t))


def quarter_turns(n: int = 1) -> Column:
    """Exact turns by 90 degrees, for square images."""
    c, s = ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0))[n % 4]
    return about_centre(*[F.lit(x) for x in (c, s, -s, c)])


def translation(key: str, most: float = 4.0, seed: int = 0) -> Column:
    one, nil = F.lit(1.0), F.lit(0.0)
    return F.array(one, nil, _span(key, seed, "x", -most, most), nil, one, _span(key, seed, "y", -most, most))


def shearing(key: str, degrees: float = 10.0, seed: int = 0) -> Column:
    one = F.lit(1.0)
    lean = lambda salt: F.tan(F.radians(_span(key, seed, salt, -degrees, degrees)))
    return about_centre(one, lean("shear x"), lean("shear y"), one)


def zooming(key: str, low: float = 0.8, high: float = 1.2, seed: int = 0) -> Column:
    s = _span(key, seed, "zoom", low, high)
    return about_centre(s, F.lit(0.0), F.lit(0.0), s)


def affinity(key: str, degrees: float = 10.0, shift: float = 0.1, low: float = 0.9, high: float = 1.1, shear: float = 10.0, seed: int = 0) -> Column:
    """Turn, scale, shear along x and shift (shares of the size), all drawn."""
    t, s, lean = F.radians(_span(key, seed, "turn", -degrees, degrees)), _span(key, seed, "zoom", low, high), F.tan(F.radians(_span(key, seed, "shear", -shear, shear)))
    a, d = s * F.cos(t), -s * F.sin(t)
    return about_centre(a, a * lean + s * F.sin(t), d, d * lean + s * F.cos(t), _span(key, seed, "x", -shift, shift) * F.col("w"), _span(key, seed, "y", -shift, shift) * F.col("h"))


def jittered_corners(key: str, share: float = 0.2, seed: int = 0) -> Column:
    """An image's corners, each moved by up to a share of its size: what :func:`perspective` takes."""
    right, low, nil = F.col("w") - 1, F.col("h") - 1, F.lit(0)
    out = []
    for k, (x, y) in enumerate(((nil, nil), (right, nil), (right, low), (nil, low))):
        out += [x + _span(key, seed, f"corner {k} x", -share, share) * F.col("w"), y + _span(key, seed, f"corner {k} y", -share, share) * F.col("h")]
    return F.array(*out)


# crops and flips


def flipped(df: DataFrame, across: Column | bool = True, down: Column | bool = False) -> DataFrame:
    """Images turned left to right and upside down where the conditions say so."""
    flag = lambda f: (f if isinstance(f, Column) else F.lit(f)).cast("double")

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = np.where((p[:, 0] > 0)[:, None, None, None], x[..., ::-1], x)
        return np.where((p[:, 1] > 0)[:, None, None, None], x[:, :, ::-1], x)

    return mapped(df, kernel, [flag(across), flag(down)])


def padded(df: DataFrame, top: int, bottom: int, left: int, right: int, value: float = 0.0) -> DataFrame:
    return mapped(df, lambda x, _: np.pad(x, ((0, 0), (0, 0), (top, bottom), (left, right)), constant_values=value))


def cropped(df: DataFrame, height: int, width: int, top: Column, left: Column) -> DataFrame:
    """The part of ``height`` by ``width`` that begins at (top, left); less where the image ends before."""

    def kernel(x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        return [own[:, int(t) : int(t) + height, int(s) : int(s) + width] for own, (t, s) in zip(x, p)]

    return mapped(df, kernel, [top, left])


def centre_cropped(df: DataFrame, height: int, width: int) -> DataFrame:
    middle = lambda size, part: F.greatest(F.floor((F.col(size) - part) / 2), F.lit(0))
    return cropped(df, height, width, middle("h", height), middle("w", width))


def corner_crops(df: DataFrame, height: int, width: int, mirrored: bool = False) -> DataFrame:
    """Five rows an image, numbered in ``crop``: its corners (upper left, upper right, lower left, lower right) and centre; ten if also mirrored."""
    low, right = F.greatest(F.col("h") - height, F.lit(0)), F.greatest(F.col("w") - width, F.lit(0))
    five = df.withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(9 if mirrored else 4))))
    k = F.col("crop") % 5
    top = F.when(k < 2, 0).when(k < 4, low).otherwise(F.floor(low / 2))
    left = F.when(k.isin(0, 2), 0).when(k < 4, right).otherwise(F.floor(right / 2))
    out = cropped(five, height, width, top, left)
    return flipped(out, F.col("crop") >= 5) if mirrored else out


def crop_padded(df: DataFrame, key: str, height: int, width: int, pad: int = 4, seed: int = 0) -> DataFrame:
    """A drawn part of ``height`` by ``width`` of the image with a margin of ``pad`` zeros."""
    free = lambda size, part, salt: F.floor(drawn(key, seed, salt) * F.greatest(F.col(size) - part + 1, F.lit(1)))
    return cropped(padded(df, pad, pad, pad, pad), height, width, free("h", height, "top"), free("w", width, "left"))


# pixels from 0 to 1


def normalized(df: DataFrame, mean: list[float], std: list[float], eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (std + eps), channel by channel."""
    m, s = (np.array(v, float)[None, :, None, None] for v in (mean, std))
    return mapped(df, lambda x, _: (x - m) / (s + eps))


def grey(x: np.ndarray) -> np.ndarray:
    """The luminance of a stack with three channels."""
    return np.einsum("nchw,c->nhw", x, np.array([0.2989, 0.5870, 0.1140]))[:, None]


def colour_jittered(df: DataFrame, key: str, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, hue: float = 0.0, seed: int = 0) -> DataFrame:
    """Brightness added, contrast about each channel's mean, and with three channels saturation and a turn of the hue, all drawn."""
    # fixed values: red, green and blue to brightness and two colour differences, and back
    there = np.array([[0.299, 0.587, 0.114], [-0.14713, -0.28886, 0.436], [0.615, -0.51499, -0.10001]])
    back = np.array([[1.0, 0.0, 1.13983], [1.0, -0.39465, -0.58060], [1.0, 2.03211, 0.0]])

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        add, spread, colour, turn = (p[:, k, None, None, None] for k in range(4))
        x = x + add
        mean = x.mean((2, 3), keepdims=True)
        x = (x - mean) * spread + mean
        if x.shape[1] == 3:
            if saturation > 0:
                x = grey(x) + colour * (x - grey(x))
            if hue > 0:
                y, u, v = np.moveaxis(np.einsum("dc,nchw->ndhw", there, x), 1, 0)
                c, s = np.cos(turn[:, 0]), np.sin(turn[:, 0])
                x = np.einsum("dc,nchw->ndhw", back, np.stack([y, c * u - s * v, s * u + c * v], 1))
        return np.clip(x, 0, 1)

    return mapped(df, kernel, [_span(key, seed, "brightness", -brightness, brightness), _span(key, seed, "contrast", 1 - contrast, 1 + contrast), _span(key, seed, "saturation", 1 - saturation, 1 + saturation), _span(key, seed, "hue", -hue * np.pi, hue * np.pi)])


def gamma_corrected(df: DataFrame, key: str, low: float = 0.8, high: float = 1.2, seed: int = 0) -> DataFrame:
    return mapped(df, lambda x, p: np.clip(x, 0, 1) ** p[:, :, None, None], [_span(key, seed, "gamma", low, high)])


def greyed(df: DataFrame) -> DataFrame:
    """Images with three channels in grey; others stay."""
    return mapped(df, lambda x, _: np.repeat(grey(x), 3, 1) if x.shape[1] == 3 else x)


def inverted(df: DataFrame) -> DataFrame:
    return mapped(df, lambda x, _: 1 - x)


def solarized(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    return mapped(df, lambda x, _: np.where(x >= threshold, 1 - x, x))


def posterized(df: DataFrame, bits: int = 4) -> DataFrame:
    return mapped(df, lambda x, _: np.round(x * (2**bits - 1)) / (2**bits - 1))


def equalized(df: DataFrame, bins: int = 256) -> DataFrame:
    """Every value becomes the share of its channel's pixels in its bin or below."""

    def kernel(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        n, c, h, w = x.shape
        flat = np.clip(x, 0, 1).reshape(n * c, h * w)
        counts = np.stack([np.histogram(line, bins, (0.0, 1.0))[0] for line in flat])
        share = np.cumsum(counts, 1) / (h * w + 1e-12)
        return np.take_along_axis(share, np.minimum((flat * (bins - 1)).astype(np.int64), bins - 1), 1).reshape(x.shape)

    return mapped(df, kernel)


# noise and gaps; every image has a generator of its own, seeded by its key


def _own(key: str, seed: int) -> Column:
    return F.floor(drawn(key, seed, "noise") * float(1 << 52))


def _each(x: np.ndarray, p: np.ndarray, f) -> np.ndarray:
    return np.stack([f(own, np.random.default_rng(int(q[0])), q[1:]) for own, q in zip(x, p)])


def noisy(df: DataFrame, key: str, std: float = 0.05, seed: int = 0) -> DataFrame:
    return mapped(df, lambda x, p: _each(x, p, lambda o, r, _: np.clip(o + r.normal(0, std, o.shape), 0, 1)), [_own(key, seed)])


def salted(df: DataFrame, key: str, share: float = 0.02, salt: float = 0.5, seed: int = 0) -> DataFrame:
    """A share of the pixels becomes white or black in all channels."""

    def f(o, r, _):
        hit, white = r.random(o.shape[1:]) < share, r.random(o.shape[1:]) < salt
        return np.where(hit, white.astype(float), o)

    return mapped(df, lambda x, p: _each(x, p, f), [_own(key, seed)])


def erased(df: DataFrame, key: str, area: tuple[float, float] = (0.02, 0.2), aspect: tuple[float, float] = (0.3, 3.3), value: float | None = None, seed: int = 0) -> DataFrame:
    """A drawn rectangle becomes ``value``, or noise if there is none."""

    def f(o, r, q):
        c, h, w = o.shape
        high = int(np.clip(round(float(np.sqrt(q[0] * h * w * q[1]))), 1, h))
        wide = int(np.clip(round(float(np.sqrt(q[0] * h * w / q[1]))), 1, w))
        top, left = int(q[2] * (h - high + 1)), int(q[3] * (w - wide + 1))
        o = o.copy()
        o[:, top : top + high, left : left + wide] = r.random((c, high, wide)) if value is None else value
        return o

    return mapped(df, lambda x, p: _each(x, p, f), [_own(key, seed), _span(key, seed, "area", *area), _span(key, seed, "aspect", *aspect), drawn(key, seed, "top"), drawn(key, seed, "left")])


def grid_masked(df: DataFrame, key: str, low: int = 16, high: int = 32, ratio: float = 0.5, seed: int = 0) -> DataFrame:
    """Stripes of zeros across and down, ``ratio`` of a drawn distance wide."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        d, top, left = p[:, 0].astype(int)[:, None], p[:, 1].astype(int)[:, None], p[:, 2].astype(int)[:, None]
        wide = (d * ratio).astype(int)
        line = lambda n, first: (np.arange(n)[None] >= first) & ((np.arange(n)[None] - first) % d < wide)
        return x * ~(line(x.shape[2], top)[:, None, :, None] | line(x.shape[3], left)[:, None, None, :])

    d = F.floor(low + drawn(key, seed, "distance") * (high - low + 1))
    return mapped(df, kernel, [d, F.floor(drawn(key, seed, "top") * d), F.floor(drawn(key, seed, "left") * d)])


def blocky(df: DataFrame, key: str, low: int = 8, high: int = 32, seed: int = 0) -> DataFrame:
    """Values rounded to a drawn number of levels."""
    return mapped(df, lambda x, p: np.clip(np.round(x * p[:, :, None, None]) / p[:, :, None, None], 0, 1), [F.floor(low + drawn(key, seed, "levels") * (high - low + 1))])


def channel_dropped(df: DataFrame, key: str, value: float = 0.0, seed: int = 0) -> DataFrame:
    """A drawn channel becomes ``value``; images with one channel stay."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        gone = (p * x.shape[1]).astype(int) == np.arange(x.shape[1])[None]
        return x if x.shape[1] == 1 else np.where(gone[:, :, None, None], value, x)

    return mapped(df, kernel, [drawn(key, seed, "channel")])


def elastic(df: DataFrame, key: str, alpha: float = 8.0, sigma: float = 3.0, mode: str = "bilinear", padding: str = "border", seed: int = 0) -> DataFrame:
    """Pixels moved by two smoothed fields of noise."""
    from .pixels import convolved, gaussian

    line = gaussian(max(1, int(3 * sigma)), sigma)

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        h, w = x.shape[2:]
        field = np.stack([np.random.default_rng(int(q[0])).normal(size=(2, h, w)) for q in p])
        moved = convolved(convolved(field, line, 3), line, 2) * alpha
        yy, xx = np.meshgrid(np.arange(h, dtype=float), np.arange(w, dtype=float), indexing="ij")
        return sampled(x, yy + moved[:, 1], xx + moved[:, 0], mode, padding)

    return mapped(df, kernel, [_own(key, seed)])


def chance_of(df: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, share: float, seed: int = 0) -> DataFrame:
    """``step`` on a share of the images, the others as they are; one pass over each part."""
    hit = drawn(key, seed, "chance") < share
    return step(df.where(hit)).unionByName(df.where(~F.coalesce(hit, F.lit(False))))


def cut_mixed(pairs: DataFrame, key: str, other: str = "other", seed: int = 0) -> DataFrame:
    """A drawn rectangle of ``pixels`` comes from ``other`` (same shape); ``kept`` is the share that stays, by which labels mix.

    The share that is asked for is drawn evenly from [0, 1); an even and centred rectangle is cut off at the edges.
    """
    r = F.sqrt(1 - drawn(key, seed, "share"))
    side = lambda size: F.floor(F.floor(F.col(size) * r) / 2)
    at = lambda size, salt: F.floor(drawn(key, seed, salt) * F.col(size))
    edge = lambda size, salt: (F.greatest(at(size, salt) - side(size), F.lit(0)), F.least(at(size, salt) + side(size), F.col(size)))
    (y1, y2), (x1, x2) = edge("h", "y"), edge("w", "x")
    place = lambda i: ((F.floor(i / F.col("w")) % F.col("h")), i % F.col("w"))

    def one(x: Column, i: Column) -> Column:
        y, c = place(i)
        return F.when((y >= F.col("_y1")) & (y < F.col("_y2")) & (c >= F.col("_x1")) & (c < F.col("_x2")), F.col(other)[i]).otherwise(x)

    held = pairs.withColumns({"_y1": y1, "_y2": y2, "_x1": x1, "_x2": x2})
    held = held.withColumn("pixels", F.transform("pixels", one)).withColumn("kept", 1 - (F.col("_y2") - F.col("_y1")) * (F.col("_x2") - F.col("_x1")) / (F.col("h") * F.col("w")))
    return held.drop("_y1", "_y2", "_x1", "_x2")
