"""Joins of rows with one row of facts for each group, where a group may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups with more than one row in so many of all are frequent, so there are fewer frequent groups than this.
SHARE = 1000


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, share: int = SHARE) -> DataFrame:
    """``rows`` beside the row of ``groups`` that has their ``key``; ``size`` is how many rows have it.

    Facts of frequent groups, fewer than ``share``, are broadcast, so no task gets a large group; the rows of
    all others meet theirs by a sort-merge join.  ``groups`` is read three times and should be a written table.
    Keys are not null; rows whose key ``groups`` lacks go.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    often = F.col(size) * share > total
    hot = F.broadcast(groups.where(often))
    here = rows.join(hot, key)
    others = rows.join(F.broadcast(groups.where(often).select(key)), key, "left_anti")
    return here.unionByName(others.join(groups.where(~often).hint("merge"), key).select(*here.columns))
