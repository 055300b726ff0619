"""Functions of array columns that stand for vectors and matrices."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once a row, not once an element."""
    return F.transform(F.array(value), f)[0]


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def vmean(a: Column) -> Column:
    return vsum(a) / F.size(a)


def vvar(a: Column) -> Column:
    """Population variance of the elements."""
    return bound(vmean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(a))


def vstd(a: Column, eps: float = 1e-8) -> Column:
    return F.sqrt(vvar(a) + eps)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column, order: float = 2, eps: float = 0.0) -> Column:
    """The p-norm of a vector; ``order`` is honoured, infinity included."""
    if order == float("inf"):
        return F.array_max(F.transform(a, F.abs))
    if order == 1:
        return vsum(F.transform(a, F.abs))
    if order == 2:
        return F.sqrt(dot(a, a) + eps)
    return F.pow(vsum(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(order))))), F.lit(1 / order))


def l2_normalize(a: Column, eps: float = 1e-8) -> Column:
    return bound(norm(a) + eps, lambda n: F.transform(a, lambda x: x / n))


def renorm(a: Column, maxnorm: float = 1.0, order: float = 2) -> Column:
    """A vector scaled down to ``maxnorm`` where its norm is larger."""
    return bound(norm(a, order), lambda n: F.when(n > maxnorm, F.transform(a, lambda x: x * maxnorm / n)).otherwise(a))


def argmax(a: Column) -> Column:
    """First position of the largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def argmin(a: Column) -> Column:
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def logsumexp(a: Column) -> Column:
    return bound(F.array_max(a), lambda m: m + F.ln(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))


def softmax(a: Column) -> Column:
    powers = bound(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return bound(powers, lambda e: bound(vsum(e), lambda total: F.transform(e, lambda x: x / total)))


def log_softmax(a: Column, eps: float = 1e-15) -> Column:
    shifted = bound(F.array_max(a), lambda m: F.transform(a, lambda x: x - m))
    total = lambda s: F.ln(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x) + eps))
    return bound(shifted, lambda s: bound(total(s), lambda t: F.transform(s, lambda x: x - t)))


def cumsum(a: Column) -> Column:
    """Sums up to each place, carried from place to place."""
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(a, start, lambda acc, x: bound(acc["s"] + x, lambda s: F.struct(s.alias("s"), F.array_append(acc["out"], s).alias("out"))), lambda acc: acc["out"])


def roll(a: Column, shift: int) -> Column:
    """Circular shift to the right."""
    k = F.pmod(F.lit(shift), F.size(a)).cast("int")
    return F.when(k == 0, a).otherwise(F.concat(F.slice(a, F.size(a) - k + 1, k), F.slice(a, F.lit(1), F.size(a) - k)))


def pad(a: Column, before: int, after: int, value: float = 0.0) -> Column:
    return F.concat(F.array_repeat(F.lit(value), before), a, F.array_repeat(F.lit(value), after))


def tile(a: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(a, times))


def repeat_each(a: Column, times: int) -> Column:
    return F.flatten(F.transform(a, lambda x: F.array_repeat(x, times)))


def reshape(a: Column, width: int) -> Column:
    """Rows of ``width`` elements."""
    return F.transform(F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1), lambda r: F.slice(a, r * width + 1, F.lit(width)))


def transpose(rows: Column) -> Column:
    """A matrix of rows as its columns."""
    return F.transform(F.sequence(F.lit(1), F.size(F.element_at(rows, 1))), lambda k: F.transform(rows, lambda r: F.element_at(r, k)))


def tril(rows: Column, diagonal: int = 0) -> Column:
    return F.transform(rows, lambda r, i: F.transform(r, lambda x, j: F.when(j <= i + diagonal, x).otherwise(F.lit(0.0))))


def searchsorted(bounds: Column, x: Column, side: str = "left") -> Column:
    """Position at which ``x`` is put into sorted ``bounds``."""
    return F.size(F.filter(bounds, lambda b: b < x if side == "left" else b <= x))


def gather(a: Column, index: Column) -> Column:
    """The elements at positions (from 0)."""
    return F.transform(index, lambda k: F.element_at(a, k + 1))


def scatter(a: Column, index: Column, values: Column) -> Column:
    """A vector with ``values`` written at positions (from 0); the last write of a position stays."""
    last = lambda k: F.size(index) - F.array_position(F.reverse(index), k) + 1
    return F.transform(a, lambda x, k: F.when(F.array_contains(index, k), F.element_at(values, last(k).cast("int"))).otherwise(x))


def topk(a: Column, k: int) -> Column:
    """Positions of the k largest elements, largest first, ties to the first."""
    ranked = F.array_sort(F.transform(a, lambda x, i: F.struct((-x).alias("v"), i.alias("i"))))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["i"])
