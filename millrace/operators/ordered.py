"""Ordered analytics: running values, shifts, packing, interpolation, schedules and optimiser steps."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def running_sum(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "running") -> DataFrame:
    return df.withColumn(out, F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def softmax_over(df: DataFrame, value: str, by: list[str], out: str = "share") -> DataFrame:
    """Softmax of a column within groups, shifted by the group's largest value."""
    w = Window.partitionBy(*by)
    e = F.exp(F.col(value) - F.max(value).over(w))
    return df.withColumn("_e", e).withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def rolled(df: DataFrame, value: str, order: list[str], by: list[str], shift: int, out: str = "rolled") -> DataFrame:
    """Circular shift within groups: the row at place i gets the value of place i - shift."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    source = placed.select(*by, F.pmod(F.col("_at") + shift, F.col("_n")).alias("_at"), F.col(value).alias(out))
    return placed.join(source, [*by, "_at"]).drop("_at", "_n")


def smoothed(df: DataFrame, value: str, order: list[str], by: list[str], reach: int, out: str = "smooth") -> DataFrame:
    """Centred mean over 2 * reach + 1 rows, fewer at the ends."""
    return df.withColumn(out, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))


def next_token(df: DataFrame, token: str, order: list[str], by: list[str], pad: int = 0, out: str = "label") -> DataFrame:
    return df.withColumn(out, F.lead(token, 1, pad).over(Window.partitionBy(*by).orderBy(*order)))


def packed_blocks(df: DataFrame, tokens: str, order: str, by: str, block: int) -> DataFrame:
    """(by, block_no, tokens): the sequences of a group joined in the order of a numeric key and cut into whole blocks.

    Lengths are summed in ranges of the order, so a large group is spread over tasks; every sequence cuts its own
    tokens at the blocks' bounds, and a block is gathered from the parts that lie in it.
    """
    size = F.size(tokens)
    placed = running(df.where(size > 0), F.col(order), [], {"_end": size.cast("long")}, by=by)
    placed = placed.withColumn("_begin", F.col("_end") - size)
    first, last = F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block)
    cut = placed.withColumn("block_no", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("_begin"), F.col("block_no") * block)
    high = F.least(F.col("_end"), (F.col("block_no") + 1) * block)
    part = F.slice(F.col(tokens), (low - F.col("_begin") + 1).cast("int"), (high - low).cast("int"))
    parts = cut.select(by, "block_no", low.alias("_low"), part.alias("_part"))
    whole = parts.groupBy(by, "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_low", "_part"))), lambda x: x["_part"])).alias("tokens"))
    return whole.where(F.size("tokens") == block)


def as_of(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str, out: str = "as_of") -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left``: one shuffle of the union, no join of pairs."""
    both = left.select(*by, on, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = both.unionByName(right.select(*by, on, F.col(value).alias("_v"), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row")))
    w = Window.partitionBy(*by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", out)


def schedules(total: int = 100, base: float = 0.1, low: float = 0.001) -> dict[str, Column]:
    """Learning rates at step ``t`` (a column of longs) by closed forms."""
    t, n, pi = F.col("t").cast("double"), float(total), math.pi
    p = t / n
    up = lambda k: t / k
    phase = F.abs(t / 10 - 2 * F.floor(1 + t / 20) + 1)
    return {
        "cosine": low + (base - low) * 0.5 * (1 + F.cos(pi * p)),
        "cosine_power": low + (base - low) * F.pow(0.5 * (1 + F.cos(pi * p)), F.lit(2.0)),
        "cyclic": low + (base - low) * F.greatest(F.lit(0.0), 1 - phase),
        "exponential": base * F.pow(F.lit(0.95), t),
        "exponential_constant": base * F.exp(-0.05 * t),
        "step": base * F.pow(F.lit(0.5), F.floor(t / 30)),
        "multi_step": base * F.pow(F.lit(0.1), ((t >= 30).cast("int") + (t >= 80).cast("int")).cast("double")),
        "linear_warmup": F.when(t < 10, base * up(10)).otherwise(low + (base - low) * (n - t) / (n - 10)),
        "warm_cosine": F.when(t < 10, base * up(10)).otherwise(low + (base - low) * 0.5 * (1 + F.cos(pi * (t - 10) / (n - 10)))),
        "noam": 512**-0.5 * F.least(F.pow(t + 1, F.lit(-0.5)), (t + 1) * 40**-1.5),
        "polynomial": low + (base - low) * F.pow(1 - p, F.lit(2.0)),
        "time_based": base / (1 + 0.01 * t),
        "tanh_decay": low + (base - low) * 0.5 * (1 - F.tanh(5.0 * (p - 1))),
        "flat": F.when(p < 0.3, F.lit(base)).otherwise(low + (base - low) * 0.5 * (1 + F.cos(pi * (p - 0.3) / 0.7))),
        "slanted": base * (1 + F.when(t < 10, t / 10).otherwise(1 - (t - 10) / (n - 10)) * 31) / 32,
        "exponential_warmup": F.when(t < 10, base * (F.exp(t / 10) - 1) / (math.e - 1)).otherwise(low + (base - low) * (1 - (t - 10) / (n - 10))),
        "gradual_warmup": base * F.when(t < 10, 1 + t / 10).otherwise(2.0),
        "one_cycle": one_cycle(t, total, base),
        "warm_restarts": low + (base - low) * 0.5 * (1 + F.cos(pi * F.pmod(t, F.lit(25.0)) / 25)),
    }


def first_steps(w: Column, g: Column, lr: float = 0.01, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> dict[str, Column]:
    """Weights after one step from zero state, by optimiser; further steps carry m and v as columns."""
    m, v = (1 - beta1) * g, (1 - beta2) * g * g
    mh, vh = m / (1 - beta1), v / (1 - beta2)
    adam = w - lr * mh / (F.sqrt(vh) + eps)
    return {
        "sgd": w - lr * g,
        "momentum": w - lr * m,
        "adagrad": w - lr * g / (F.sqrt(g * g) + eps),
        "rmsprop": w - lr * g / (F.sqrt(0.1 * g * g) + eps),
        "adadelta": w - F.sqrt(F.lit(eps)) / F.sqrt(0.05 * g * g + eps) * g,
        "adam": adam,
        "adamw": adam - lr * 0.01 * w,
        "nadam": w - lr * (beta1 * mh + (1 - beta1) * g / (1 - beta1)) / (F.sqrt(vh) + eps),
        "radam": w - lr * mh,
        "lion": w - lr * F.signum(m),
        "qhadam": w - lr * (0.3 * g + 0.7 * m) / (F.sqrt(v) + eps),
    }


def optimised(w: Column, gradients: Column, kind: str = "adam", lr: float = 0.01, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8, decay: float = 0.01, nu: tuple[float, float] = (0.7, 1.0)) -> Column:
    """The weight after every step of an array of gradients, with the optimiser's moments carried from step to step.

    kind: sgd, momentum, nesterov, adagrad, rmsprop, adadelta, adam, adamw, nadam, radam, lion, qhadam, adabound or adan.
    """
    zero = F.lit(0.0)
    start = F.struct(w.cast("double").alias("w"), zero.alias("m"), zero.alias("v"), zero.alias("u"), zero.alias("d"), F.lit(1.0).alias("p1"), F.lit(1.0).alias("p2"), zero.alias("t"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, g: Column) -> Column:
        t, p1, p2, u = s["t"] + 1, s["p1"] * beta1, s["p2"] * beta2, s["u"]
        m, v = beta1 * s["m"] + (1 - beta1) * g, beta2 * s["v"] + (1 - beta2) * g * g
        mh, vh = m / (1 - p1), v / (1 - p2)
        if kind == "sgd":
            move = lr * g
        elif kind == "momentum":
            move = lr * m
        elif kind == "nesterov":
            move = lr * (beta1 * m + (1 - beta1) * g)
        elif kind == "adagrad":
            v = s["v"] + g * g
            move = lr * g / (F.sqrt(v) + eps)
        elif kind == "rmsprop":
            v = 0.9 * s["v"] + 0.1 * g * g
            move = lr * g / (F.sqrt(v) + eps)
        elif kind == "adadelta":
            v = 0.95 * s["v"] + 0.05 * g * g
            move = F.sqrt(s["u"] + eps) / F.sqrt(v + eps) * g
            u = 0.95 * s["u"] + 0.05 * move * move
        elif kind == "adam":
            move = lr * mh / (F.sqrt(vh) + eps)
        elif kind == "adamw":
            move = lr * mh / (F.sqrt(vh) + eps) + lr * decay * s["w"]
        elif kind == "nadam":
            move = lr * (beta1 * mh + (1 - beta1) * g / (1 - p1)) / (F.sqrt(vh) + eps)
        elif kind == "radam":
            most = 2 / (1 - beta2) - 1
            rho = most - 2 * t * p2 / (1 - p2)
            straight = F.sqrt((rho - 4) * (rho - 2) * most / ((most - 4) * (most - 2) * rho))
            move = F.when(rho > 4, lr * mh * straight / (F.sqrt(vh) + eps)).otherwise(lr * mh)
        elif kind == "lion":
            move = lr * F.signum(beta1 * s["m"] + (1 - beta1) * g) + lr * decay * s["w"]
            m = beta2 * s["m"] + (1 - beta2) * g
        elif kind == "qhadam":
            move = lr * ((1 - nu[0]) * g + nu[0] * mh) / (F.sqrt((1 - nu[1]) * g * g + nu[1] * vh) + eps)
        elif kind == "adabound":
            low, high = 0.1 * (1 - 1 / (1e-3 * t + 1)), 0.1 * (1 + 1 / (1e-3 * t))
            move = F.least(F.greatest(lr / (F.sqrt(vh) + eps), low), high) * mh
        elif kind == "adan":  # u: the last gradient, d: the mean of its changes
            v = 0.99 * s["v"] + 0.01 * g * g
            d = 0.92 * s["d"] + 0.08 * (g - s["u"])
            m = 0.98 * s["m"] + 0.02 * g
            power = lambda b: 1 - F.pow(F.lit(b), t)
            move = lr * ((m / power(0.98) + 0.92 * d / power(0.92)) / (F.sqrt(v / power(0.99)) + eps) + decay * s["w"])
            u = g
        else:
            raise ValueError(f"no optimiser {kind!r}")
        d = d if kind == "adan" else zero
        after = s["w"] - move
        return F.struct(after.alias("w"), m.alias("m"), v.alias("v"), u.alias("u"), d.alias("d"), p1.alias("p1"), p2.alias("p2"), t.alias("t"), F.array_append(s["out"], after).alias("out"))

    return F.aggregate(gradients, start, step, lambda s: s["out"])


def plateau_rates(values: Column, base: float = 0.1, factor: float = 0.5, patience: int = 3, least: float = 0.0, delta: float = 0.0) -> Column:
    """The rate after each value of an array of losses: cut by ``factor`` whenever more than ``patience`` in a row are no better than the best."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("waited"), F.lit(float(base)).alias("rate"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        better = x < s["best"] - delta
        waited = F.when(better, 0).otherwise(s["waited"] + 1)
        cut_now = waited > patience
        rate = F.when(cut_now, F.greatest(s["rate"] * factor, F.lit(float(least)))).otherwise(s["rate"])
        return F.struct(F.when(better, x).otherwise(s["best"]).alias("best"), F.when(cut_now, 0).otherwise(waited).alias("waited"), rate.alias("rate"), F.array_append(s["out"], rate).alias("out"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def one_cycle(t: Column, total: int, top: float = 0.1, rise: float = 0.3, first: float = 25.0, last: float = 1e4) -> Column:
    """The rate at step ``t`` of a cycle: half a cosine from ``top / first`` up over the share ``rise``, and down to ``top / first / last``."""
    edge = rise * total - 1
    low, end = top / first, top / first / last
    bend = lambda a, b, p: b + (a - b) / 2.0 * (1 + F.cos(math.pi * p))
    return F.when(t <= edge, bend(low, top, t / edge)).otherwise(bend(top, end, (t - edge) / (total - 1 - edge)))


def alpha_bars(steps: int = 1000, low: float = 0.0001, high: float = 0.02) -> list[float]:
    """The products of 1 - beta over a linear schedule of noise."""
    out, product = [], 1.0
    for k in range(steps):
        product *= 1 - (low + (high - low) * k / max(steps - 1, 1))
        out.append(product)
    return out


def noised(x: Column, t: Column, noise: Column, steps: int = 1000) -> Column:
    """A value after ``t`` steps (from 0) of a linear schedule: what is left of it, and noise for what has gone."""
    left = F.element_at(F.lit(alpha_bars(steps)), (t + 1).cast("int"))
    return F.sqrt(left) * x + F.sqrt(1 - left) * noise


def clip_by_global_norm(df: DataFrame, value: str, most: float) -> DataFrame:
    """Gradients scaled down where the norm of all of them exceeds ``most``."""
    norm = df.agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("_norm"))
    return df.crossJoin(norm).withColumn(value, F.col(value) * F.least(F.lit(1.0), most / (F.col("_norm") + 1e-12))).drop("_norm")


def ema(values: Column, beta: float) -> Column:
    """Exponential moving average of an array, from its first element."""
    return F.aggregate(F.slice(values, F.lit(2), F.size(values)), F.element_at(values, 1).cast("double"), lambda acc, x: beta * acc + (1 - beta) * x)


PENALTIES: dict[str, Callable[[Column], Column]] = {"l1": lambda w: 1e-4 * F.sum(F.abs(w)), "l2": lambda w: 0.5e-4 * F.sum(w * w), "elastic_net": lambda w: 1e-4 * F.sum(F.abs(w)) + 0.5e-4 * F.sum(w * w), "activity_l1": lambda w: 1e-4 * F.avg(F.abs(w)), "activity_l2": lambda w: 1e-4 * F.avg(w * w)}
