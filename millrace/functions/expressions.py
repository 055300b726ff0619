"""Column builders: activations, losses and other elementwise mathematics, evaluated inside generated code."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(x: float) -> Column:
    return F.lit(float(x))


def relu(x: Column) -> Column:
    return F.greatest(x, lit(0))


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * alpha)


def relu6(x: Column) -> Column:
    return clip(x, 0, 6)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, lit(high)), lit(low))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_sigmoid(x: Column) -> Column:
    """Logarithm of the logistic function, from the side on which the exponential is small."""
    return F.when(x >= 0, -F.log1p(F.exp(-x))).otherwise(x - F.log1p(F.exp(x)))


def softplus(x: Column) -> Column:
    return -log_sigmoid(-x)


def swish(x: Column) -> Column:
    return x * sigmoid(x)


def mish(x: Column) -> Column:
    return x * F.tanh(softplus(x))


def erf(x: Column) -> Column:
    """Error function by a rational approximation whose error is below 1.5e-7."""
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + 0.3275911 * F.abs(x))
    tail = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t * F.exp(-x * x)
    return F.signum(x) * (1 - tail)


def erfc(x: Column) -> Column:
    return 1 - erf(x)


def gelu(x: Column, approximate: bool = True) -> Column:
    if approximate:
        return 0.5 * x * (1 + F.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))
    return 0.5 * x * (1 + erf(x / math.sqrt(2)))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(alpha * F.expm1(F.least(x, lit(0))))


def selu(x: Column) -> Column:
    return 1.0507009873554805 * elu(x, 1.6732632423543772)


#: Activations by name.
ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: x,
    "relu": relu,
    "leaky_relu": leaky_relu,
    "relu6": relu6,
    "sigmoid": sigmoid,
    "log_sigmoid": log_sigmoid,
    "softplus": softplus,
    "swish": swish,
    "mish": mish,
    "gelu": gelu,
    "elu": elu,
    "selu": selu,
    "tanh": F.tanh,
}


def activation(name: str) -> Callable[[Column], Column]:
    if name not in ACTIVATIONS:
        raise ValueError(f"no activation named {name!r}; there are {sorted(ACTIVATIONS)}")
    return ACTIVATIONS[name]


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0; ANSI division would raise."""
    return F.try_divide(a, b)


def absolute_error(p: Column, y: Column) -> Column:
    return F.abs(p - y)


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def huber(p: Column, y: Column, delta: float = 1.0) -> Column:
    """Half the squared error over delta within delta, and the absolute error less half of delta beyond."""
    e = F.abs(p - y)
    return F.when(e < delta, 0.5 * e * e / delta).otherwise(e - 0.5 * delta)


def binary_cross_entropy(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def binary_cross_entropy_with_logits(z: Column, y: Column) -> Column:
    return -(y * log_sigmoid(z) + (1 - y) * log_sigmoid(-z))


def focal(mean_bce: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss of a mean cross entropy."""
    return alpha * F.pow(1 - F.exp(-mean_bce), lit(gamma)) * mean_bce


def kl_term(target: Column, predicted: Column, eps: float = 1e-15) -> Column:
    t, p = clip(target, eps, 1), clip(predicted, eps, 1)
    return target * (F.ln(t) - F.ln(p))


def dice_loss(inter: Column, total_a: Column, total_b: Column, smooth: float = 1e-6) -> Column:
    return 1 - (2 * inter + smooth) / (total_a + total_b + smooth)


def box_area(box: str) -> Column:
    return F.greatest(F.col(f"{box}.x2") - F.col(f"{box}.x1"), lit(0)) * F.greatest(F.col(f"{box}.y2") - F.col(f"{box}.y1"), lit(0))


def box_iou(a: str, b: str, eps: float = 1e-12) -> Column:
    """Intersection over union of two corner boxes (structs x1, y1, x2, y2)."""
    w = F.greatest(F.least(F.col(f"{a}.x2"), F.col(f"{b}.x2")) - F.greatest(F.col(f"{a}.x1"), F.col(f"{b}.x1")), lit(0))
    h = F.greatest(F.least(F.col(f"{a}.y2"), F.col(f"{b}.y2")) - F.greatest(F.col(f"{a}.y1"), F.col(f"{b}.y1")), lit(0))
    inter = w * h
    return inter / (box_area(a) + box_area(b) - inter + eps)
