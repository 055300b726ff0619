"""Tables of text as models take them: numbers, categories and a target from columns that mark what is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fitted

#: What stands for a missing value.
MISSING = ("", "?", "nan", "NaN", "NA")


@dataclass(frozen=True)
class Table:
    """Which columns of a file are numbers, which are categories, and which text of the target counts as 1 (None: a number itself)."""

    numbers: tuple[str, ...]
    categories: tuple[str, ...]
    target: str
    positive: str | None = None
    columns: tuple[str, ...] = ()


# fixed values: the columns of two public tables
ADULT = Table(
    ("age", "fnlwgt", "education-num", "capital-gain", "capital-loss", "hours-per-week"),
    ("workclass", "education", "marital-status", "occupation", "relationship", "race", "sex", "native-country"),
    "income", ">50K",
    ("age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation", "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week", "native-country", "income"),
)
TITANIC = Table(("pclass", "age", "sibsp", "parch", "fare"), ("sex", "embarked"), "survived")


def _known(c: str) -> Column:
    text = F.trim(F.col(f"`{c}`").cast("string"))
    return F.when(text.isin(*MISSING), None).otherwise(text)


def cleaned(df: DataFrame, table: Table, drop_missing: bool = False) -> DataFrame:
    """The columns of ``table`` as numbers, trimmed texts and an integer ``target``; what is missing or no number is null.

    Rows without a target go, and with ``drop_missing`` all rows with a null.
    """
    numbers = [_known(c).try_cast("double").alias(c) for c in table.numbers]
    said = _known(table.target)
    target = said.try_cast("double").cast("int") if table.positive is None else F.when(said.isNotNull(), (F.rtrim(said, F.lit(".")) == table.positive).cast("int"))
    out = df.select(*[c for c in df.columns if c not in (*table.numbers, *table.categories, table.target)], *numbers, *[_known(c).alias(c) for c in table.categories], target.alias("target")).where("target is not null")
    return out.dropna(subset=[*table.numbers, *table.categories]) if drop_missing else out


def encoded(df: DataFrame, table: Table, how: str = "onehot") -> DataFrame:
    """``cleaned`` rows with ``x``: the numbers and the categories, as indicators in the order of their values or as their numbers.

    Missing numbers and, of ordinals, categories are NaN; a missing category has no indicator.
    """
    state = fitted.fit_categories(df, list(table.categories))
    numbers = [F.coalesce(F.col(f"`{c}`"), F.lit(float("nan"))) for c in table.numbers]
    if how == "onehot":
        hot = fitted.one_hot_vectors(df, state, list(table.categories), "_hot")
        places = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_hot.size") - 1), lambda k: F.array_contains("_hot.indices", k).cast("double"))
        return hot.withColumn("x", F.concat(F.array(*numbers), F.when(F.col("_hot.size") > 0, places).otherwise(F.array().cast("array<double>")))).drop("_hot")
    if how == "ordinal":
        held = df
        for c in table.categories:
            held = fitted.encode_labels(held, state, c, f"_{c}", "minus")
        codes = [F.when(F.col(f"`_{c}`") >= 0, F.col(f"`_{c}`").cast("double")).otherwise(float("nan")) for c in table.categories]
        return held.withColumn("x", F.array(*numbers, *codes)).drop(*[f"_{c}" for c in table.categories])
    raise ValueError(f"how must be onehot or ordinal, not {how!r}")


def read_headerless(spark: SparkSession, path: str, table: Table, comment: str = "|", delimiter: str = ",") -> DataFrame:
    """Lines with as many fields as ``table`` has columns, as trimmed texts; empty lines, comments and others go."""
    parts = F.split("value", delimiter.replace("|", r"\|"), -1)
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit(comment))).select(parts.alias("p")).where(F.size("p") == len(table.columns))
    return rows.select(*[F.trim(F.col("p")[k]).alias(c) for k, c in enumerate(table.columns)])
