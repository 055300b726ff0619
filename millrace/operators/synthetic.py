"""Made-up tables on numbered rows, or on the keys of a table: every value is a hash of its row's number and the seed, so any partitioning gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .resample import chance, normal

TURN = 6.283185307179586


def _rows(spark: SparkSession, n: int | DataFrame) -> DataFrame:
    """Rows numbered ``id``: so many, or one for each value of the first column of a table."""
    return n.select(F.col(n.columns[0]).alias("id")) if isinstance(n, DataFrame) else spark.range(n)


def _vector(d: int, seed: int, kind=normal) -> Column:
    return F.array(*[kind("id", seed, 2 * k + 100) for k in range(d)])


def _coef(d: int, seed: int, used: int | None = None) -> list[float]:
    import random

    draw = random.Random(seed)
    return [draw.gauss(0, 1) if k < (d if used is None else used) else 0.0 for k in range(d)]


def _dot(v: Column, w: list[float]) -> Column:
    return reduce(Column.__add__, [v[k] * x for k, x in enumerate(w) if x], F.lit(0.0))


def _flipped(label: Column, share: float, seed: int, classes: int = 2) -> Column:
    """Another class with a chance of ``share``."""
    other = (label + 1 + F.floor(chance("id", seed, 7) * (classes - 1)).cast("int")) % classes
    return F.when(chance("id", seed, 6) < share, other).otherwise(label)


def classification(spark: SparkSession, n: int | DataFrame, d: int = 4, classes: int = 2, spread: float = 1.0, flip: float = 0.0, weights: list[float] | None = None, informative: int | None = None, seed: int = 0) -> DataFrame:
    """(id, label, v): Gaussian classes around seeded centres; ``weights`` make them unequal, ``informative`` leaves the later features without signal."""
    weights = weights or [1.0] * classes
    total, upto, u, drawn = sum(weights), 0.0, chance("id", seed, 1), F.lit(classes - 1)
    bounds = []
    for w in weights[:-1]:
        upto += w / total
        bounds.append(upto)
    for k in reversed(range(len(bounds))):
        drawn = F.when(u < bounds[k], k).otherwise(drawn)
    centres = F.lit([[3 * x for x in _coef(d, seed * 1009 + k, informative)] for k in range(classes)])
    rows = _rows(spark, n).withColumn("label", drawn.cast("int"))
    v = F.zip_with(centres[F.col("label")], _vector(d, seed), lambda c, e: c + spread * e)
    return rows.select("id", _flipped(F.col("label"), flip, seed, classes).cast("int").alias("label"), v.alias("v"))


def regression(spark: SparkSession, n: int | DataFrame, d: int = 4, noise: float = 0.1, informative: int | None = None, seed: int = 0) -> DataFrame:
    """(id, y, v): a seeded linear form of normal features; features from ``informative`` on have no weight."""
    rows = _rows(spark, n).withColumn("v", _vector(d, seed))
    return rows.select("id", (_dot(F.col("v"), _coef(d, seed, informative)) + noise * normal("id", seed, 3)).alias("y"), "v")


def xor(spark: SparkSession, n: int | DataFrame, seed: int = 0) -> DataFrame:
    """(id, label, v): two uniform features in [-1, 1); label 1 where their signs differ."""
    rows = _rows(spark, n).withColumn("v", F.transform(_vector(2, seed, chance), lambda x: 2 * x - 1))
    return rows.select("id", ((F.col("v")[0] > 0) != (F.col("v")[1] > 0)).cast("int").alias("label"), "v")


def checkerboard(spark: SparkSession, n: int | DataFrame, cells: int = 4, seed: int = 0) -> DataFrame:
    """(id, label, v): uniform points of the unit square, labelled as the squares of a board."""
    rows = _rows(spark, n).withColumn("v", _vector(2, seed, chance))
    return rows.select("id", ((F.floor(F.col("v")[0] * cells) + F.floor(F.col("v")[1] * cells)) % 2).cast("int").alias("label"), "v")


def spirals(spark: SparkSession, n: int | DataFrame, arms: int = 2, turns: float = 1.5, noise: float = 0.02, seed: int = 0) -> DataFrame:
    """(id, label, v): points along the arms of a spiral, an arm a class."""
    r, arm = F.sqrt(chance("id", seed, 1)), F.col("id") % arms
    angle = r * turns * TURN + arm * (TURN / arms)
    return _rows(spark, n).select("id", arm.cast("int").alias("label"), F.array(r * F.cos(angle) + noise * normal("id", seed, 2), r * F.sin(angle) + noise * normal("id", seed, 4)).alias("v"))


def gaussian_quantiles(spark: SparkSession, n: int | DataFrame, d: int = 2, classes: int = 3, seed: int = 0) -> DataFrame:
    """(id, label, v): standard normal rows, classes of equal share by distance from the origin."""
    rows = _rows(spark, n).withColumn("v", _vector(d, seed)).withColumn("_r", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    bounds = rows.agg(F.percentile_approx("_r", F.lit([k / classes for k in range(1, classes)]), F.lit(10_000)).alias("_b"))
    return rows.crossJoin(F.broadcast(bounds)).select("id", F.size(F.filter("_b", lambda b: b < F.col("_r"))).alias("label"), "v")


def blobs(spark: SparkSession, n: int | DataFrame, spreads: list[float], d: int = 2, seed: int = 0) -> DataFrame:
    """(id, label, v): a blob a spread, so that densities vary."""
    label = (F.col("id") % len(spreads)).cast("int")
    centres = F.lit([[8 * x for x in _coef(d, seed * 1013 + k)] for k in range(len(spreads))])
    return _rows(spark, n).select("id", label.alias("label"), F.zip_with(centres[label], _vector(d, seed), lambda c, e: c + F.lit([float(s) for s in spreads])[label] * e).alias("v"))


def outliers(spark: SparkSession, n: int | DataFrame, share: float = 0.05, far: float = 8.0, d: int = 2, seed: int = 0) -> DataFrame:
    """(id, label, v): normal rows, of which a share (label 1) is pushed to at least ``far`` from the origin."""
    out = chance("id", seed, 1) < share
    size = F.sqrt(F.aggregate(_vector(d, seed), F.lit(1e-12), lambda s, x: s + x * x))
    return _rows(spark, n).select("id", out.cast("int").alias("label"), F.transform(_vector(d, seed), lambda x: F.when(out, x / size * (far + size)).otherwise(x)).alias("v"))


def low_rank(spark: SparkSession, n: int | DataFrame, d: int = 8, rank: int = 2, noise: float = 0.01, seed: int = 0) -> DataFrame:
    """(id, v): rows of a seeded subspace of ``rank`` dimensions, with noise."""
    inner = _rows(spark, n).withColumn("_z", _vector(rank, seed))
    basis = [_coef(rank, seed * 1019 + k) for k in range(d)]
    return inner.select("id", F.array(*[_dot(F.col("_z"), w) + noise * normal("id", seed, 5000 + 2 * k) for k, w in enumerate(basis)]).alias("v"))


def ratings(spark: SparkSession, users: int | DataFrame, items: int, per_user: int = 10, rank: int = 3, noise: float = 0.2, seed: int = 0) -> DataFrame:
    """(user, item, rating): ``per_user`` draws a user, one row a pair; ratings in [1, 5] from hidden factors of both sides."""
    draws = _rows(spark, users).select(F.col("id").alias("user"), F.explode(F.sequence(F.lit(1), F.lit(per_user))).alias("k"))
    pairs = draws.select("user", F.floor(chance("user", seed, F.col("k")) * items).alias("item")).distinct()
    both = reduce(Column.__add__, [normal("user", seed + 1, 2 * k) * normal("item", seed + 2, 2 * k) for k in range(rank)])
    return pairs.select("user", "item", F.least(F.greatest(3 + both / rank**0.5 + noise * normal(F.struct("user", "item"), seed + 3), F.lit(1.0)), F.lit(5.0)).alias("rating"))


def _symbols(length: int, vocabulary: int, seed: int) -> Column:
    """Symbols from 1 on; a row's length lies between 1 and ``length``."""
    n = 1 + F.floor(chance("id", seed, 1) * length).cast("int")
    return F.transform(F.sequence(F.lit(1), n), lambda k: 1 + F.floor(chance("id", seed + 1, k) * vocabulary))


def sequence_task(spark: SparkSession, n: int | DataFrame, task: str = "copy", length: int = 10, vocabulary: int = 20, seed: int = 0) -> DataFrame:
    """(id, source, target): symbols and their copy, reverse or sorted order."""
    turn = {"copy": lambda s: s, "reverse": F.reverse, "sort": F.array_sort}[task]
    return _rows(spark, n).withColumn("source", _symbols(length, vocabulary, seed)).withColumn("target", turn(F.col("source")))


def addition(spark: SparkSession, n: int | DataFrame, digits: int = 3, seed: int = 0) -> DataFrame:
    """(id, source, target): ``"12+7="`` and ``"19"``."""
    number = lambda k: F.floor(chance("id", seed, k) * 10**digits)
    rows = _rows(spark, n).withColumns({"_a": number(1), "_b": number(2)})
    return rows.select("id", F.concat(F.col("_a").cast("string"), F.lit("+"), F.col("_b").cast("string"), F.lit("=")).alias("source"), (F.col("_a") + F.col("_b")).cast("string").alias("target"))


def dyck(spark: SparkSession, n: int | DataFrame, pairs: int = 6, seed: int = 0) -> DataFrame:
    """(id, text): balanced brackets of ``pairs`` pairs; an opening one is drawn where both kinds are possible."""

    def step(state: Column, k: Column) -> Column:
        up = (state["open"] == 0) | ((state["left"] > 0) & (chance("id", seed, k) < 0.5))
        return F.struct(F.concat(state["text"], F.when(up, "(").otherwise(")")).alias("text"), (state["open"] + F.when(up, 1).otherwise(-1)).alias("open"), (state["left"] - F.when(up, 1).otherwise(0)).alias("left"))

    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("open"), F.lit(pairs).alias("left"))
    return _rows(spark, n).select("id", F.aggregate(F.sequence(F.lit(1), F.lit(2 * pairs)), start, step, lambda s: s["text"]).alias("text"))


def next_tokens(df: DataFrame, text: str) -> DataFrame:
    """(id, source, target): the characters of a text and, for each, the one that follows it."""
    held = F.split(F.col(text), "")
    return df.select("id", F.slice(held, F.lit(1), F.length(text) - 1).alias("source"), F.slice(held, F.lit(2), F.length(text) - 1).alias("target"))


def bars_stripes(spark: SparkSession, side: int = 4) -> DataFrame:
    """(id, label, v): every pattern of full columns (label 0) and of full rows (label 1) of a square of pixels."""
    kinds = _rows(spark, 2 << side).withColumns({"label": (F.col("id") % 2).cast("int"), "_bits": F.floor(F.col("id") / 2)})
    bit = lambda k: F.expr(f"CAST(shiftright(_bits, {k}) & 1 AS INT)")
    rows, columns = [bit(k // side) for k in range(side * side)], [bit(k % side) for k in range(side * side)]
    return kinds.select("id", "label", F.when(F.col("label") == 1, F.array(*rows)).otherwise(F.array(*columns)).alias("v"))


def question_answers(spark: SparkSession, n: int | DataFrame, people: int = 10, seed: int = 0) -> DataFrame:
    """(id, context, question, answer): who holds what, and a question about one of them."""
    things = F.lit(["key", "lamp", "map", "coin", "ring"])
    held = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct((F.floor((F.col("id") * 7 + k) % people)).alias("who"), things[F.floor(chance("id", seed, k) * 5).cast("int")].alias("what")))
    rows = _rows(spark, n).withColumns({"_held": held, "_pick": F.floor(chance("id", seed, 99) * 3).cast("int")})
    said = F.concat_ws(" ", F.transform("_held", lambda h: F.concat(F.lit("Person "), h["who"].cast("string"), F.lit(" has the "), h["what"], F.lit("."))))
    asked = F.col("_held")[F.col("_pick")]
    return rows.select("id", said.alias("context"), F.concat(F.lit("What has person "), asked["who"].cast("string"), F.lit("?")).alias("question"), asked["what"].alias("answer"))
