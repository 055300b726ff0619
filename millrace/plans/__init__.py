"""The registered queries: each applies operators of the engine to whole tables."""

from . import expressions, factors, learned, losses, made, metrics, models, ordered, pictures, preprocessing, quantize, sampled, scenes, splits, streaming, text  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
