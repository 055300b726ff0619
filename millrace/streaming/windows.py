"""Event-time windows, running statistics and mergeable moments, for streams and tables alike."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_stream(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of Parquet files as they arrive, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, ts: str, value: str, by: list[str], size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum per tumbling or sliding window; on a stream ``late`` bounds the state by a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return rows.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, ts: str, by: list[str], gap: str, late: str | None = None) -> DataFrame:
    """(start, finish, n) per session: events less than ``gap`` apart."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("finish")).select(*by, "start", "finish", "n")


class RunningMoments:
    """Count, mean and scatter of features, merged batch by batch; only d * d numbers leave a batch."""

    def __init__(self, features: list[str]):
        self.features, d = features, len(features)
        self.n, self.mean, self.scatter = 0.0, np.zeros(d), np.zeros((d, d))
        self.batches: set[int] = set()

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``; a batch that comes again after a failure counts once."""
        from ..operators.models import moments

        if batch_id in self.batches:
            return
        n, s, c = moments(batch, self.features)
        if n:
            mean = s / n
            shift, total = mean - self.mean, self.n + n
            self.scatter += c - n * np.outer(mean, mean) + np.outer(shift, shift) * self.n * n / total
            self.mean, self.n = self.mean + shift * n / total, total
        self.batches.add(batch_id)

    def components(self, k: int) -> np.ndarray:
        value, vector = np.linalg.eigh(self.scatter / max(self.n - 1, 1))
        return vector[:, np.argsort(value)[::-1][:k]].T


def for_each(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every batch of what is there now to ``handle``, then stop."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
