"""Queries of event-time windows over the events as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import windows
from .registry import query, table

_NTZ = lambda c: F.col(c).cast("timestamp_ntz")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "value", ["event_type"], "1 hour").select(_NTZ("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS start, value FROM events, (SELECT unnest([0, 1]) AS k)) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY start""")
def sliding_windows(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "value", [], "1 hour", "30 minutes").select(_NTZ("start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) AS finish, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", ["user_id"], "6 hours").select("user_id", _NTZ("start").alias("start"), _NTZ("finish").alias("finish"), "n")
