"""Exact deduplication against a persistent digest index, with DataFrame functions and SQL only.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of a text.  A batch of new rows is reduced
to one candidate for each digest, the candidates that the index has not are found by a sort-merge anti-join for
which the index need not be shuffled, and these are appended.  The index lies under a path and outlives the
session; it holds a digest, an id and a few numbers for each distinct text, never a text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frequent import with_group
from .scratch import cut, exists, own_folder

#: Parts of a table that one run admits one after another.
BATCHES = 2
_COLUMNS = "digest BINARY, keep_id BIGINT, keep_mark BIGINT, run STRING"


def unchanged(text: Column) -> Column:
    return text


@dataclass(frozen=True)
class DigestIndex:
    """A digest index under ``path``; ``table`` is its name in the session's catalogue."""

    spark: SparkSession
    path: str
    table: str
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
        """The index under ``path``, made if there is none.

        ``buckets`` (default: the session's shuffle partitions) counts only then: an index keeps its number, which
        lies beside it and so survives the catalogue.
        """
        path = path.rstrip("/")
        if not exists(spark, f"{path}/spec/_SUCCESS"):
            wanted = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(wanted).alias("buckets")).write.mode("overwrite").parquet(f"{path}/spec")
        held = spark.read.schema("buckets int").parquet(f"{path}/spec").first()["buckets"]
        table = f"millrace_digests_{hashlib.md5(path.encode()).hexdigest()}"
        where = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {held} BUCKETS LOCATION '{where}/digests'")
        return cls(spark, path, table, held)

    def rows(self) -> DataFrame:
        """(digest, keep_id, keep_mark, run) of every distinct text that was admitted."""
        return self.spark.table(self.table)

    def admit(self, marked: DataFrame, run: str) -> None:
        """Append the digests of (doc_id, digest, mark) that the index lacks, each with its largest id.

        Of rows that agree in digest and id the one with the smallest mark is meant.  Admitting the same rows again
        changes nothing, so a run that broke off can be repeated.
        """
        top = marked.groupBy("digest").agg(F.max(F.struct("doc_id", (-F.col("mark")).alias("back"))).alias("top"))
        new = top.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        new = new.select("digest", F.col("top.doc_id").alias("keep_id"), (-F.col("top.back")).alias("keep_mark"), F.lit(run).alias("run"))
        new.repartition(self.buckets, "digest").write.insertInto(self.table)

    def forget(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _marked(docs: DataFrame, index: DigestIndex, run: str, row_id: str, text: str, normal: Callable[[Column], Column], *more: Column) -> DataFrame:
    """(doc_id, digest, mark, ...), written beside the index, so that marks stay what they are when a run is repeated."""
    digest = F.unhex(F.sha2(normal(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("binary"), 256))
    found = docs.select(F.col(f"`{row_id}`").cast("long").alias("doc_id"), digest.alias("digest"), F.monotonically_increasing_id().alias("mark"), *more)
    path = f"{index.path}/runs/{run}"
    if not exists(docs.sparkSession, f"{path}/_SUCCESS"):
        found.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def _index(docs: DataFrame, index: DigestIndex | None) -> DigestIndex:
    return index or DigestIndex.open(docs.sparkSession, f"{own_folder(docs.sparkSession)}/exact-index-{uuid.uuid4().hex}")


def _admitted(marked: DataFrame, index: DigestIndex, run: str, batches: int) -> None:
    """Admit in ``batches`` ranges of ids, the largest ids first and null ids last."""
    cuts = [k / batches for k in range(batches - 1, 0, -1)]
    bounds = (marked.agg(F.percentile_approx("doc_id", cuts, 1000).alias("at")).first()["at"] or []) if cuts else []
    batch = sum([(F.col("doc_id") < b).cast("int") for b in bounds], F.lit(0))
    for k in range(len(bounds) + 1):
        own = F.coalesce(batch, F.lit(len(bounds))) == k
        index.admit(marked.where(own), run)


def _decided(marked: DataFrame, index: DigestIndex, run: str) -> DataFrame:
    sizes = marked.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = cut(sizes.join(index.rows().hint("merge"), "digest"), "exact-groups")
    found = with_group(marked, groups, "digest", "group_size")
    kept = (F.col("run") == run) & (F.col("mark") == F.col("keep_mark"))
    return found.select("doc_id", "mark", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def decisions(docs: DataFrame, index: DigestIndex | None = None, run: str | None = None, *, row_id: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] = unchanged, batches: int = BATCHES) -> DataFrame:
    """(doc_id, mark, keep_id, group_size, kept, text_sha256): one row for each row of ``docs``.

    Texts are equal when ``normal`` makes the same of them; a null text counts as empty.  A text that the index
    has from an earlier run stays with the id that it has there, and all rows of it go; of any other text the row
    with the largest id stays.  Null ids are smaller than all others; of repeated rows one stays.  ``group_size``
    counts rows of ``docs``.  Without an index a new one is filled; a run that broke off is taken up again under its
    name ``run``.  An empty table gives an empty result, and
    columns other than the two named are not looked at.
    """
    index, run = _index(docs, index), run or uuid.uuid4().hex
    marked = _marked(docs, index, run, row_id, text, normal)
    _admitted(marked, index, run, batches)
    return _decided(marked, index, run)


def without_copies(docs: DataFrame, index: DigestIndex | None = None, run: str | None = None, *, row_id: str = "doc_id", text: str = "text", normal: Callable[[Column], Column] = unchanged, batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` that :func:`decisions` keeps, with all their columns; texts are written once beside their marks."""
    index, run = _index(docs, index), run or uuid.uuid4().hex
    held = _marked(docs, index, run, row_id, text, normal, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = held.select("doc_id", "digest", "mark")
    _admitted(marked, index, run, batches)
    kept = _decided(marked, index, run).where("kept").select("mark")
    return held.join(kept, "mark", "left_semi").select("row.*")
