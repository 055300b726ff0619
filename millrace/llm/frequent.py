"""Joins with facts of groups that may be large: those of :mod:`millrace.operators.frequent`."""

from ..operators.frequent import SHARE, with_group

__all__ = ["SHARE", "with_group"]
