"""Splits, folds and set operations on rows with a declared key; random order is a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

_M = 4294967296


def key_hash(key: str | Column, seed: int = 0) -> Column:
    """A number in [0, 2^32) that a row's integer key and the seed determine, in any engine."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.pmod(k, F.lit(1 << 30)) * 2654435761 + seed, F.lit(_M))


def holdout(df: DataFrame, key: str, test_share: float, seed: int = 0) -> DataFrame:
    """Adds ``is_test`` by hash: rows are judged one by one, so nothing is shuffled and reruns agree."""
    return df.withColumn("is_test", key_hash(key, seed) < int(test_share * _M))


def _places(df: DataFrame, order: list[Column], by: str | None) -> DataFrame:
    """Adds ``rank`` and ``rank_all``, over all rows or over those of the same value of ``by``."""
    return ranked(df, *order, by=by)


def holdout_exact(df: DataFrame, key: str, test_share: float, by: str | None = None, seed: int = 0) -> DataFrame:
    """Adds ``is_test`` for an exact number of test rows, per value of ``by`` at least one."""
    take = F.greatest(F.round(F.col("rank_all") * test_share), F.lit(1))
    return _places(df, [key_hash(key, seed), F.col(key)], by).withColumn("is_test", F.col("rank") <= take).drop("rank", "rank_all")


def kfold(df: DataFrame, key: str, k: int, seed: int | None = None, by: str | None = None) -> DataFrame:
    """Adds ``fold`` 0..k-1 whose sizes differ by one at most, per value of ``by`` if given; the first folds are the larger ones."""
    order = [F.col(key)] if seed is None else [key_hash(key, seed), F.col(key)]
    at, size, more = F.col("rank") - 1, F.floor(F.col("rank_all") / k), F.col("rank_all") % k
    edge = more * (size + 1)
    fold = F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / F.greatest(size, F.lit(1))))
    return _places(df, order, by).withColumn("fold", fold.cast("int")).drop("rank", "rank_all")


def chronological(df: DataFrame, ts: str, key: str, test_share: float) -> DataFrame:
    """Adds ``is_test`` for the latest share of rows, at least one and not all."""
    take = F.least(F.greatest(F.round(F.col("rank_all") * test_share), F.lit(1)), F.col("rank_all") - 1)
    order = F.col(ts).cast("timestamp") if dict(df.dtypes)[ts].startswith(("timestamp", "date")) else F.col(ts)
    return ranked(df, order, F.col(key)).withColumn("is_test", F.col("rank_all") - F.col("rank") < take).drop("rank", "rank_all")


def paired(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """Rows of ``a`` beside the rows of ``b`` that have the same place in the order of their numeric keys; the rest of the longer goes."""
    left, right = (ranked(df, F.col(key)).drop("rank_all") for df, key in ((a, a_key), (b, b_key)))
    return left.join(right, "rank").drop("rank")


def random_parts(df: DataFrame, key: str, shares: list[float], seed: int = 0) -> DataFrame:
    """Adds ``part``, by the hash's place among cumulative shares."""
    h, out, total = key_hash(key, seed) / _M, None, 0.0
    for k, s in enumerate(shares[:-1]):
        total += s
        out = F.when(h < total, k) if out is None else out.when(h < total, k)
    return df.withColumn("part", out.otherwise(len(shares) - 1) if out is not None else F.lit(0))


def subset(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def complement(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")


def shuffle_splits(df: DataFrame, key: str, splits: int, test_share: float, train_share: float | None = None, seed: int = 0, by: str | None = None) -> DataFrame:
    """(split, part, all columns): ``splits`` independent draws of a test part and a training part, per value of ``by`` if given.

    Rows are ranked by a hash of split and key; the first are tested and the next are trained on, or all the others without
    ``train_share``.  Both parts of a group have at least one row where it has two.
    """
    out = None
    for k in range(splits):
        turned = ranked(df, F.xxhash64(F.lit(seed), F.lit(k), F.col(key)), F.col(key), by=by)
        n = F.col("rank_all")
        test = F.least(F.greatest(F.round(n * test_share), F.lit(1)), F.greatest(n - 1, F.lit(1)))
        train = n - test if train_share is None else F.least(F.greatest(F.round(n * train_share), F.lit(1)), n - test)
        part = F.when(F.col("rank") <= test, "test").when(F.col("rank") <= test + train, "train")
        own = turned.withColumn("part", part).where("part is not null").drop("rank", "rank_all").select(F.lit(k).alias("split"), "part", *df.columns)
        out = own if out is None else out.unionByName(own)
    return out


def mixed(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts by column name, with the number of the part."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("part", F.lit(k))
        out = p if out is None else out.unionByName(p)
    return out
