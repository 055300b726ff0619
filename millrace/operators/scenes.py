"""Made-up scenes: what is in a picture is drawn in columns over a key, and only its pixels are painted in tasks.

A scene is an array of objects (kind, centre, radius, angle, colour), painted one over another.  Boxes, labels, captions
and tracks come from the objects alone, so they cost no pixels; pictures and masks are the images of :mod:`images`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import mapped
from .resample import drawn

KINDS = ("circle", "square", "triangle")
#: Colours as red, green and blue.
COLOURS = {"red": (1.0, 0.0, 0.0), "green": (0.0, 1.0, 0.0), "blue": (0.0, 0.0, 1.0), "yellow": (1.0, 1.0, 0.0), "magenta": (1.0, 0.0, 1.0), "cyan": (0.0, 1.0, 1.0)}
_TURN = 6.283185307179586
_PER_OBJECT = 6  # numbers that painting takes


def scenes(keys: DataFrame, key: str, most: int = 3, height: int = 32, width: int = 32, small: float = 3.0, large: float = 7.0, seed: int = 0) -> DataFrame:
    """``keys`` with ``c``, ``h``, ``w`` and ``objects``: 1 to ``most`` objects, wholly inside the picture, later ones in front."""

    def one(k: Column) -> Column:
        at = lambda what: drawn(key, seed, F.concat_ws("-", k.cast("string"), F.lit(what)))
        r = small + at("r") * (large - small)
        reach = r * 2**0.5  # of a turned square
        return F.struct(
            F.floor(at("kind") * len(KINDS)).cast("int").alias("kind"), (reach + at("x") * (width - 1 - 2 * reach)).alias("cx"), (reach + at("y") * (height - 1 - 2 * reach)).alias("cy"),
            r.alias("r"), (at("angle") * _TURN).alias("angle"), F.floor(at("colour") * len(COLOURS)).cast("int").alias("colour"),
        )

    count = F.floor(drawn(key, seed, "count") * most).cast("int")
    return keys.select("*", F.lit(3).alias("c"), F.lit(height).alias("h"), F.lit(width).alias("w"), F.transform(F.sequence(F.lit(0), count), one).alias("objects"))


def box_of(o: Column) -> Column:
    """The box around an object: of a square its turned corners, of a triangle its three, on a circle of its radius."""

    def span(centre: Column, f) -> tuple[Column, Column]:
        corners = [o["r"] * f(o["angle"] + k * _TURN / 3) for k in range(3)]
        half = o["r"] * (F.abs(F.cos(o["angle"])) + F.abs(F.sin(o["angle"])))
        reach = F.when(o["kind"] == 0, o["r"]).otherwise(half)
        low = F.when(o["kind"] == 2, F.least(*corners)).otherwise(-reach)
        high = F.when(o["kind"] == 2, F.greatest(*corners)).otherwise(reach)
        return centre + low, centre + high

    (x1, x2), (y1, y2) = span(o["cx"], F.cos), span(o["cy"], F.sin)
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def boxes(objects: Column) -> Column:
    return F.transform(objects, box_of)


def labels(objects: Column) -> Column:
    return F.transform(objects, lambda o: o["kind"])


def _word(of, k: Column) -> Column:
    return F.element_at(F.lit(list(of)), k + 1)


def caption(objects: Column) -> Column:
    """The objects from back to front, each by colour and kind."""
    return F.array_join(F.transform(objects, lambda o: F.concat_ws(" ", F.lit("a"), _word(COLOURS, o["colour"]), _word(KINDS, o["kind"]))), " and ")


def bound_attributes(objects: Column) -> tuple[Column, Column]:
    """A caption of the first and the last object, and one with their colours exchanged; null where both would say the same."""
    a, b = F.element_at(objects, 1), F.element_at(objects, -1)
    say = lambda x, y: F.concat_ws(" ", F.lit("a"), _word(COLOURS, x), _word(KINDS, a["kind"]), F.lit("and a"), _word(COLOURS, y), _word(KINDS, b["kind"]))
    apart = (F.size(objects) > 1) & (a["colour"] != b["colour"]) & (a["kind"] != b["kind"])
    return F.when(apart, say(a["colour"], b["colour"])), F.when(apart, say(b["colour"], a["colour"]))


def _inside(h: int, w: int, kind: float, cx: float, cy: float, r: float, angle: float) -> np.ndarray:
    """The pixels whose centre lies in an object."""
    y, x = np.mgrid[0:h, 0:w].astype(float)
    dx, dy = x - cx, y - cy
    if kind == 0:
        return dx * dx + dy * dy <= r * r
    u, v = dx * np.cos(angle) + dy * np.sin(angle), dy * np.cos(angle) - dx * np.sin(angle)
    if kind == 1:
        return (np.abs(u) <= r) & (np.abs(v) <= r)
    # three half planes, each at half the radius opposite to a corner
    return np.all([u * np.cos(t) + v * np.sin(t) <= r / 2 for t in (np.pi / 3, np.pi, -np.pi / 3)], 0)


def _numbers(objects: str) -> Column:
    return F.flatten(F.transform(objects, lambda o: F.array(*[o[n].cast("double") for n in ("kind", "cx", "cy", "r", "angle", "colour")])))


def _blank(df: DataFrame) -> DataFrame:
    return df.withColumn("pixels", F.array_repeat(F.lit(0.0), (F.col("c") * F.col("h") * F.col("w")).cast("int")))


def painted(df: DataFrame, objects: str = "objects", background: float = 0.0) -> DataFrame:
    """Scenes with their ``pixels``."""
    colours = np.array(list(COLOURS.values()))

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x = x + background
        for own, row in zip(x, p.reshape(len(p), -1, _PER_OBJECT)):
            for kind, cx, cy, r, angle, colour in row:
                own[:, _inside(*own.shape[1:], kind, cx, cy, r, angle)] = colours[int(colour)][: len(own), None]
        return x

    return mapped(_blank(df), kernel, _numbers(objects))


def masks(df: DataFrame, objects: str = "objects", instances: bool = False) -> DataFrame:
    """Scenes with one channel of ``pixels``: 0 for background, and of the object in front its kind + 1 or, of instances, its number + 1."""

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        for own, row in zip(x, p.reshape(len(p), -1, _PER_OBJECT)):
            for k, (kind, cx, cy, r, angle, _) in enumerate(row):
                own[0, _inside(*own.shape[1:], kind, cx, cy, r, angle)] = (k if instances else kind) + 1
        return x

    return mapped(_blank(df.withColumn("c", F.lit(1))), kernel, _numbers(objects))


def visible_shares(df: DataFrame, objects: str = "objects", out: str = "visible") -> DataFrame:
    """Scenes with the share of each object's pixels that no later object covers."""

    def kernel(x: np.ndarray, p: np.ndarray) -> list[np.ndarray]:
        made = []
        for own, row in zip(x, p.reshape(len(p), -1, _PER_OBJECT)):
            areas = [_inside(*own.shape[1:], *o[:5]) for o in row]
            seen, free = [0.0] * len(areas), np.ones(own.shape[1:], bool)
            for k in range(len(areas) - 1, -1, -1):
                seen[k] = (areas[k] & free).sum() / max(areas[k].sum(), 1)
                free &= ~areas[k]
            made.append(np.array(seen).reshape(1, 1, -1))
        return made

    found = mapped(_blank(df.withColumn("c", F.lit(1))), kernel, _numbers(objects))
    return found.withColumnRenamed("pixels", out).drop("c", "h", "w")


def shortcut(df: DataFrame, key: str, label: Column, agree: float = 0.9, size: int = 4, seed: int = 0) -> DataFrame:
    """Pictures with a bright square in the first corner: with the chance ``agree`` where ``label`` is true, else with what is left."""
    marked = drawn(key, seed, "mark") < F.when(label, agree).otherwise(1 - agree)

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        x[p[:, 0] > 0, :, :size, :size] = 1.0
        return x

    return mapped(df.withColumn("marked", marked), kernel, [marked.cast("int")])


def textures(keys: DataFrame, key: str, height: int = 32, width: int = 32, seed: int = 0) -> DataFrame:
    """``keys`` with ``texture`` (0 stripes, 1 checks, 2 a gradient, 3 soft blobs) and one channel of ``pixels`` in [0, 1]."""
    at = lambda what: drawn(key, seed, what)
    kind = F.floor(at("texture") * 4).cast("int")
    df = keys.select("*", kind.alias("texture"), F.lit(1).alias("c"), F.lit(height).alias("h"), F.lit(width).alias("w"))

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        y, c = np.mgrid[0:height, 0:width].astype(float)
        for own, (k, period, angle, phase, noise) in zip(x, p):
            along = c * np.cos(angle) + y * np.sin(angle)
            if k == 0:
                own[0] = 0.5 + 0.5 * np.sin(2 * np.pi * (along / period + phase))
            elif k == 1:
                own[0] = (np.floor(c / period + phase) + np.floor(y / period + phase)) % 2
            elif k == 2:
                own[0] = (along - along.min()) / max(np.ptp(along), 1e-12)
            else:
                own[0] = _soft(np.random.default_rng(int(noise)), height, width, max(2, int(period)))
        return x

    return mapped(_blank(df), kernel, [kind, 4 + at("period") * 8, at("angle") * 3.141592653589793, at("phase"), F.floor(at("noise") * float(1 << 52))])


def _soft(rng: np.random.Generator, h: int, w: int, step: int) -> np.ndarray:
    """Noise on a coarse grid between which values run smoothly, from 0 to 1."""
    grid = rng.random((h // step + 2, w // step + 2))
    y, x = np.mgrid[0:h, 0:w] / step
    y0, x0 = y.astype(int), x.astype(int)
    ease = lambda t: t * t * (3 - 2 * t)
    fy, fx = ease(y - y0), ease(x - x0)
    out = (grid[y0, x0] * (1 - fx) + grid[y0, x0 + 1] * fx) * (1 - fy) + (grid[y0 + 1, x0] * (1 - fx) + grid[y0 + 1, x0 + 1] * fx) * fy
    return (out - out.min()) / max(np.ptp(out), 1e-12)


def regions(keys: DataFrame, key: str, seeds: int = 5, height: int = 32, width: int = 32, seed: int = 0) -> DataFrame:
    """``keys`` with one channel of ``pixels``: the number of the nearest of ``seeds`` drawn points, the smaller of equals."""
    point = lambda k: F.array(drawn(key, seed, F.concat(k.cast("string"), F.lit("-x"))) * (width - 1), drawn(key, seed, F.concat(k.cast("string"), F.lit("-y"))) * (height - 1))
    points = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(seeds - 1)), point))
    df = keys.select("*", F.lit(1).alias("c"), F.lit(height).alias("h"), F.lit(width).alias("w"), points.alias("points"))

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        y, c = np.mgrid[0:height, 0:width].astype(float)
        at = p.reshape(len(p), -1, 2)
        far = (c[None, None] - at[:, :, 0, None, None]) ** 2 + (y[None, None] - at[:, :, 1, None, None]) ** 2
        return far.argmin(1)[:, None].astype(float)

    return mapped(_blank(df), kernel, F.col("points"))


def soft_blobs(keys: DataFrame, key: str, blobs: int = 3, height: int = 32, width: int = 32, level: float = 0.5, seed: int = 0) -> DataFrame:
    """``keys`` with two channels of ``pixels``: a sum of normal hills cut at 1, and where it reaches ``level``."""
    at = lambda k, what: drawn(key, seed, F.concat_ws("-", k.cast("string"), F.lit(what)))
    hill = lambda k: F.array(at(k, "x") * (width - 1), at(k, "y") * (height - 1), 2 + at(k, "s") * min(height, width) / 6)
    df = keys.select("*", F.lit(2).alias("c"), F.lit(height).alias("h"), F.lit(width).alias("w"), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(blobs)), hill)).alias("hills"))

    def kernel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        y, c = np.mgrid[0:height, 0:width].astype(float)
        at = p.reshape(len(p), -1, 3)[..., None, None]
        x[:, 0] = np.minimum(np.exp(-((c - at[:, :, 0]) ** 2 + (y - at[:, :, 1]) ** 2) / (2 * at[:, :, 2] ** 2)).sum(1), 1)
        x[:, 1] = x[:, 0] >= level
        return x

    return mapped(_blank(df), kernel, F.col("hills"))


# motion


def bounced(start: Column, speed: Column, t: Column, low: Column | float, high: Column | float) -> Column:
    """Where something is at time ``t`` that moves evenly between two walls and is thrown back by both: a closed form."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    size = F.greatest(high - low, F.lit(1e-9))
    turn = F.pmod(start - low + speed * t, 2 * size)
    return low + size - F.abs(turn - size)


def tracks(df: DataFrame, key: str, steps: int = 16, fastest: float = 2.0, objects: str = "objects", seed: int = 0) -> DataFrame:
    """(key, t, track, kind, box): a row for every object of a scene at every step, moving evenly and thrown back by the edges."""
    each = df.select(key, "h", "w", F.posexplode(objects).alias("track", "o"))
    pace = lambda what: (drawn(key, seed, F.concat_ws("-", F.col("track").cast("string"), F.lit(what))) * 2 - 1) * fastest
    each = each.withColumn("vx", pace("vx")).withColumn("vy", pace("vy")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    reach = F.col("o.r") * 2**0.5
    x = bounced(F.col("o.cx"), F.col("vx"), F.col("t"), reach, F.col("w") - 1 - reach)
    y = bounced(F.col("o.cy"), F.col("vy"), F.col("t"), reach, F.col("h") - 1 - reach)
    moved = each.withColumn("o", F.struct(F.col("o.kind").alias("kind"), x.alias("cx"), y.alias("cy"), F.col("o.r").alias("r"), F.col("o.angle").alias("angle"), F.col("o.colour").alias("colour")))
    return moved.select(key, "t", "track", F.col("o.kind").alias("kind"), box_of(F.col("o")).alias("box"), "o", "h", "w")


def frames(moving: DataFrame, key: str, background: float = 0.0) -> DataFrame:
    """(key, t, c, h, w, pixels): the pictures of :func:`tracks`' steps, later tracks in front."""
    objects = F.transform(F.array_sort(F.collect_list(F.struct("track", "o"))), lambda s: s["o"])
    return painted(moving.groupBy(key, "t").agg(F.lit(3).alias("c"), F.max("h").alias("h"), F.max("w").alias("w"), objects.alias("objects")), background=background).drop("objects")


def moving_sprites(sprites: DataFrame, key: str, height: int, width: int, steps: int = 16, fastest: float = 2.0, seed: int = 0) -> DataFrame:
    """(key, t, c, h, w, pixels): images of one row each carried over a dark canvas and thrown back by its edges, cut off at whole pixels."""
    each = sprites.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    at = lambda what: drawn(key, seed, what)
    x = bounced(at("x") * (F.lit(width) - F.col("w")), (at("vx") * 2 - 1) * fastest, F.col("t"), 0.0, F.lit(width) - F.col("w"))
    y = bounced(at("y") * (F.lit(height) - F.col("h")), (at("vy") * 2 - 1) * fastest, F.col("t"), 0.0, F.lit(height) - F.col("h"))

    def kernel(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), s.shape[1], height, width))
        for own, sprite, (top, left) in zip(out, s, p.astype(int)):
            own[:, top : top + sprite.shape[1], left : left + sprite.shape[2]] = sprite
        return out

    return mapped(each, kernel, [F.floor(y), F.floor(x)])


# sparse tables


def sparse_rows(keys: DataFrame, key: str, features: int = 1000, filled: int = 10, informative: int = 50, noise: float = 0.1, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """((key, feature, value), (key, y, label)): long rows with at most ``filled`` features; y is a weighted sum of the informative ones with noise, label whether it is positive."""
    k = lambda what: F.concat_ws("-", F.col("k").cast("string"), F.lit(what))
    each = keys.select(key, F.explode(F.sequence(F.lit(1), F.lit(filled))).alias("k"))
    each = each.select(key, F.floor(drawn(key, seed, k("f")) * features).cast("int").alias("feature"), (drawn(key, seed, k("v")) * 2 - 1).alias("value"))
    long = each.groupBy(key, "feature").agg(F.sum("value").alias("value"))
    weight = F.when(F.col("feature") < informative, drawn("feature", seed, "weight") * 2 - 1).otherwise(0.0)
    sums = long.groupBy(key).agg(F.sum(F.col("value") * weight).alias("y"))
    y = F.col("y") + noise * (drawn(key, seed, "noise") * 2 - 1)
    return long, sums.select(key, y.alias("y"), (y > 0).cast("int").alias("label"))
