"""Sources and sinks: delimited, JSON-lines, text, XML and binary files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a missing number besides the empty text.
MISSING = ("", "?", "nan", "NaN", "NA")


def to_number(text: Column, kind: str = "double") -> Column:
    """A number from text; null for missing marks and for what is no number."""
    clean = F.trim(text)
    return F.when(~clean.isin(*MISSING), clean.try_cast(kind))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, header: bool = True, delimiter: str = ",") -> DataFrame:
    """Rows of delimited files; blank lines are skipped, and without a schema all columns are text."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("mode", "PERMISSIVE").option("multiLine", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(values): arrays of numbers from lines divided by commas or white space."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.transform(F.split(F.trim("value"), r"[,\s]+"), lambda x: x.try_cast("double")).alias("values"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of JSON-lines files; a given schema spares the pass that finds one."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_lines(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """(text): lines of text files, trimmed and without empty ones."""
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return lines.select(F.trim("text").alias("text")).where("text <> ''") if strip else lines


def read_text_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(text, label, file): whole files, labelled by the folder that holds them."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.col("value").alias("text"), F.element_at(F.split("_metadata.file_path", "/"), -2).alias("label"), F.col("_metadata.file_path").alias("file"))


def read_binary_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(content, label, file, sha256): files as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("content", F.element_at(F.split("path", "/"), -2).alias("label"), F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def read_ratings(spark: SparkSession, path: str, delimiter: str = r"::|\s+|,") -> DataFrame:
    """(user, item, rating, ts) with ids from 0."""
    part = F.split(F.trim("value"), delimiter)
    rows = spark.read.text(path).select((part[0].try_cast("long") - 1).alias("user"), (part[1].try_cast("long") - 1).alias("item"), part[2].try_cast("double").alias("rating"), F.get(part, 3).try_cast("long").alias("ts"))
    return rows.where("user IS NOT NULL")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label, x1, y1, x2, y2): one row per object of XML annotations."""
    schema = "filename string, object array<struct<name:string, bndbox:struct<xmin:double, ymin:double, xmax:double, ymax:double>>>"
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path).select("filename", F.explode("object").alias("o"))
    return rows.select("filename", F.col("o.name").alias("label"), *[F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])


def read_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, label) of big-endian label files: a header of 8 bytes, then a byte a label."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.hex(F.expr("substring(content, 9)")).alias("h"))
    each = files.select("file", F.posexplode(F.expr("regexp_extract_all(h, '..', 0)")).alias("pos", "h"))
    return each.select("file", "pos", F.conv("h", 16, 10).cast("int").alias("label"))


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two tables with the same key, side by side."""
    return a.join(b, key)


def write_log(df: DataFrame, path: str, kind: str = "json") -> None:
    """Append records as JSON lines, CSV or Parquet."""
    writer = df.write.mode("append")
    {"json": writer.json, "csv": writer.option("header", True).csv, "parquet": writer.parquet}[kind](path)
