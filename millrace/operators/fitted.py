"""Scalers and imputers in two steps: a state is fitted on one table and applied to any other, or inverted.

A state is a DataFrame of one row, ``shift_<c>``, ``scale_<c>`` and ``fill_<c>`` for every column; it is written, read and
broadcast like any small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import numbered, quantiles


def _unit(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


def fit(df: DataFrame, columns: list[str], kind: str = "standard", low: float = 0.0, high: float = 1.0) -> DataFrame:
    """State of one aggregation; kind: standard, minmax (to [low, high]), maxabs, robust, or fill_mean, fill_median.

    Nulls take no part; of a column without values all of the state is null, so that what it is applied to becomes null.
    """
    out = []
    if kind in ("robust", "fill_median"):
        held = quantiles(df, columns, [0.5, 0.25, 0.75])
        for c in columns:
            q, robust = F.col(f"q_{c}"), kind == "robust"
            fill = F.lit(None).cast("double") if robust else F.coalesce(q[0], F.lit(0.0))
            out += [(q[0] if robust else F.lit(0.0)).alias(f"shift_{c}"), (_unit(q[2] - q[1]) if robust else F.lit(1.0)).alias(f"scale_{c}"), fill.alias(f"fill_{c}")]
        return held.select(*out)
    for c in columns:
        x = F.col(c).cast("double")
        shift, scale, fill = F.lit(0.0), F.lit(1.0), F.lit(None).cast("double")
        if kind == "standard":
            shift, scale = F.avg(x), F.sqrt(F.greatest(F.var_pop(x), F.lit(1e-12)))
        elif kind == "minmax":
            scale = _unit(F.max(x) - F.min(x)) / (high - low)
            shift = F.min(x) - low * scale
        elif kind == "maxabs":
            scale = _unit(F.max(F.abs(x)))
        elif kind == "fill_mean":
            fill = F.coalesce(F.avg(x), F.lit(0.0))
        else:
            raise ValueError(f"no state of kind {kind!r}")
        out += [shift.alias(f"shift_{c}"), scale.alias(f"scale_{c}"), fill.alias(f"fill_{c}")]
    return df.agg(*out)


def _with(df: DataFrame, state: DataFrame, columns: list[str], form) -> DataFrame:
    return df.crossJoin(F.broadcast(state)).select(*[form(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def transform(df: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """(x - shift) / scale, after nulls are filled where the state fills."""
    return _with(df, state, columns, lambda c: (F.coalesce(F.col(c).cast("double"), F.col(f"fill_{c}")) - F.col(f"shift_{c}")) / F.col(f"scale_{c}"))


def inverse(df: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """x * scale + shift: what :func:`transform` was given; filled nulls stay filled."""
    return _with(df, state, columns, lambda c: F.col(c) * F.col(f"scale_{c}") + F.col(f"shift_{c}"))


def partial(old: DataFrame | None, df: DataFrame, columns: list[str]) -> DataFrame:
    """Running counts, sums and squares (one row) after another batch; :func:`from_sums` makes a standard state of them."""
    new = df.agg(*[e for c in columns for e in (F.count(c).alias(f"n_{c}"), F.coalesce(F.sum(F.col(c).cast("double")), F.lit(0.0)).alias(f"s_{c}"), F.coalesce(F.sum(F.col(c).cast("double") * F.col(c)), F.lit(0.0)).alias(f"q_{c}"))])
    return new if old is None else old.unionByName(new).agg(*[F.sum(c).alias(c) for c in new.columns])


def from_sums(sums: DataFrame, columns: list[str]) -> DataFrame:
    mean = lambda c: F.col(f"s_{c}") / F.col(f"n_{c}")
    var = lambda c: F.col(f"q_{c}") / F.col(f"n_{c}") - mean(c) * mean(c)
    return sums.select(*[e for c in columns for e in (mean(c).alias(f"shift_{c}"), F.sqrt(F.greatest(var(c), F.lit(1e-12))).alias(f"scale_{c}"), F.lit(None).cast("double").alias(f"fill_{c}"))])


# encoders: a state is a table (column, value, code, often), a row for each value seen


def fit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code, often): the values of each column, as text, numbered from 0 in the order of their own type, and how often they occur.

    A state like any other: it is written, read, and applied to any table.  Nulls are no values.
    """
    out = None
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("often"))
        own = numbered(counts, "value", "code").select(F.lit(c).alias("column"), F.col("value").cast("string").alias("value"), "code", "often")
        out = own if out is None else out.unionByName(own)
    return out


def encode_labels(df: DataFrame, state: DataFrame, column: str, out: str = "code", unknown: str = "error") -> DataFrame:
    """``df`` with the code of ``column``; a value that was not seen is an error, or -1 with ``unknown="minus"``, and null stays null."""
    own = state.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    strange = F.raise_error(F.lit(f"{column} has a value that was not seen in fitting")).cast("long") if unknown == "error" else F.lit(-1).cast("long")
    code = F.when(F.col(column).isNotNull(), F.coalesce("_code", strange))
    return df.join(own, F.col(column).cast("string") == F.col("_value"), "left").withColumn(out, code).drop("_value", "_code")


def decode_labels(df: DataFrame, state: DataFrame, column: str, code: str = "code") -> DataFrame:
    """``df`` with the value, as text, whose code stands in ``code``; null for other codes."""
    own = state.where(F.col("column") == column).select(F.col("value").alias(column), F.col("code").alias("_code"))
    return df.join(own, F.col(code) == F.col("_code"), "left").drop("_code")


def one_hot_vectors(df: DataFrame, state: DataFrame, columns: list[str], out: str = "hot", drop_first: bool = False) -> DataFrame:
    """``df`` with a sparse vector (size, indices, values) over the categories of all ``columns``, one after another; values not seen have no place."""
    sizes = {r["column"]: r["n"] for r in state.groupBy("column").agg((F.max("code") + 1).alias("n")).collect()}  # a row a column
    low, held, places = 0, df, []
    for c in columns:
        held = encode_labels(held, state, c, f"_code_{c}", "minus")
        place = F.col(f"_code_{c}") - int(drop_first)
        places.append(F.when(place >= 0, place + low))
        low += max(0, sizes.get(c, 0) - int(drop_first))
    index = F.array_compact(F.array(*places))
    whole = F.struct(F.lit(low).cast("long").alias("size"), index.alias("indices"), F.transform(index, lambda _: F.lit(1.0)).alias("values"))
    return held.withColumn(out, whole).drop(*[f"_code_{c}" for c in columns])


def fill_most_frequent(df: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with nulls of ``columns`` as the most frequent value of the state (the one of the smallest code of equals)."""
    kinds = dict(df.dtypes)
    best = state.groupBy("column").agg(F.max_by("value", F.struct("often", -F.col("code"))).alias("value"))
    one = best.agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_best"))  # an entry a column
    return df.crossJoin(F.broadcast(one)).select(*[F.coalesce(F.col(c), F.col("_best")[c].cast(kinds[c])).alias(c) if c in columns else F.col(c) for c in df.columns])


def rare_values(state: DataFrame, column: str, share: float) -> DataFrame:
    """(value) of the categories with less than ``share`` of the rows of ``column``."""
    own = state.where(F.col("column") == column)
    return own.crossJoin(F.broadcast(own.agg(F.sum("often").alias("_all")))).where(F.col("often") < share * F.col("_all")).select("value")
