"""Losses of array columns: a row's scores or probabilities against its class or another vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot, log_softmax, vsum


def nll(log_p: Column, label: Column) -> Column:
    """Minus the log-probability of the class ``label`` (from 0)."""
    return -F.element_at(log_p, label.cast("int") + 1)


def cross_entropy(scores: Column, label: Column, smoothing: float = 0.0) -> Column:
    """Of scores before the softmax; ``smoothing`` is shared by all classes."""
    held = F.array(log_softmax(scores, 0.0))
    return F.transform(held, lambda p: (1 - smoothing) * nll(p, label) - smoothing * vsum(p) / F.size(p))[0]


def triplet(anchor: Column, same: Column, other: Column, margin: float = 1.0) -> Column:
    """How far the anchor is from its like beyond its distance from another, plus a margin; 0 at least."""
    apart = lambda a, b: F.transform(F.array(F.zip_with(a, b, lambda x, y: x - y)), lambda d: F.sqrt(dot(d, d)))[0]
    return F.greatest(apart(anchor, same) - apart(anchor, other) + margin, F.lit(0.0))


def kl_divergence(p: Column, q: Column, eps: float = 1e-15) -> Column:
    """Sum of ``p * ln(p / q)``, both kept at least ``eps``."""
    least = lambda x: F.greatest(x, F.lit(eps))
    return vsum(F.zip_with(p, q, lambda x, y: least(x) * (F.ln(least(x)) - F.ln(least(y)))))


def cross_entropy_and_dice(p: Column, y: Column, weight: float = 0.5, eps: float = 1e-7) -> Column:
    """Of two arrays, chances and 0/1 targets: ``weight`` times their mean binary cross entropy and the rest times one minus their Dice overlap."""
    inside = F.transform(p, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1 - eps)))
    each = F.zip_with(inside, y, lambda x, t: -(t * F.ln(x) + (1 - t) * F.ln(1 - x)))
    common = vsum(F.zip_with(p, y, lambda x, t: x * t))
    return weight * vsum(each) / F.size(p) + (1 - weight) * (1 - (2 * common + eps) / (vsum(p) + vsum(y) + eps))
