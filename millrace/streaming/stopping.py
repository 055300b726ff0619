"""Early stopping and running summaries of gradients, as a fold over a table or as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State in RocksDB, which keyed processors need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STOP = "run string, step long, value double, improved boolean, best double, best_step long, waited long, stopped boolean"


def _better(value: float, best: float | None, mode: str, delta: float) -> bool:
    return best is None or (value < best - delta if mode == "min" else value > best + delta)


def folded(steps: list[tuple[int, float]], state: tuple | None, mode: str, patience: int, delta: float) -> tuple[list[tuple], tuple]:
    """The judged steps of one run, in their order, and the state (best, best_step, waited, stopped) after them.

    After a stop nothing is judged any more.
    """
    best, best_step, waited, stopped = state or (None, None, 0, False)
    out = []
    for step, value in steps:
        if stopped:
            break
        improved = _better(value, best, mode, delta)
        if improved:
            best, best_step, waited = value, step, 0
        else:
            waited += 1
            stopped = waited >= patience
        out.append((step, value, improved, best, best_step, waited, stopped))
    return out, (best, best_step, waited, stopped)


def _checked(mode: str) -> None:
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, not {mode!r}")


def early_stopping(metrics: DataFrame, run: str, step: str, value: str, mode: str = "min", patience: int = 5, delta: float = 0.0) -> DataFrame:
    """Every judged step of every run: whether it improved, the best so far, how long none did, and whether the run stops there.

    Steps are taken in their order, ties by value; rows with a null, NaN included, are not judged.  Nothing comes after
    a stop.  A run's steps are one row of two numbers each.
    """
    _checked(mode)
    rows = metrics.select(F.col(run).cast("string").alias("run"), F.col(step).cast("long").alias("step"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value")).dropna()
    lists = rows.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("steps"))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_step"), F.lit(0).cast("long").alias("waited"), F.lit(False).alias("stopped"), F.array().cast("array<struct<step:bigint,value:double,improved:boolean,best:double,best_step:bigint,waited:bigint,stopped:boolean>>").alias("out"))

    def judged(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | ((x["value"] < s["best"] - delta) if mode == "min" else (x["value"] > s["best"] + delta))
        best, at = F.when(better, x["value"]).otherwise(s["best"]), F.when(better, x["step"]).otherwise(s["best_step"])
        waited = F.when(better, 0).otherwise(s["waited"] + 1).cast("long")
        stop = ~better & (waited >= patience)
        one = F.struct(x["step"].alias("step"), x["value"].alias("value"), better.alias("improved"), best.alias("best"), at.alias("best_step"), waited.alias("waited"), stop.alias("stopped"))
        after = F.struct(best.alias("best"), at.alias("best_step"), waited.alias("waited"), stop.alias("stopped"), F.array_append(s["out"], one).alias("out"))
        return F.when(s["stopped"], s).otherwise(after)

    return lists.select("run", F.explode(F.aggregate("steps", start, judged)["out"]).alias("o")).select("run", "o.*")


class StopProcessor(StatefulProcessor):
    """Best value, its step and the waiting of each run; a run that is silent for ``idle_ms`` is forgotten."""

    def __init__(self, mode: str, patience: int, delta: float, idle_ms: int | None):
        self.rule, self.idle_ms = (mode, patience, delta), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "best double, best_step long, waited long, stopped boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))[["step", "value"]].dropna().sort_values(["step", "value"])
        steps = [(int(s), float(v)) for s, v in zip(every["step"], every["value"])]
        out, state = folded(steps, tuple(self.held.get()) if self.held.exists() else None, *self.rule)
        if state[0] is not None:
            self.held.update(state)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=[c.split()[0] for c in _STOP.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield pd.DataFrame(columns=[c.split()[0] for c in _STOP.split(", ")])

    def close(self) -> None:
        """The state is Spark's to close."""


def stateful(spark: SparkSession) -> None:
    """Let the session keep state where keyed processors can use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def early_stopping_stream(metrics: DataFrame, run: str, step: str, value: str, mode: str = "min", patience: int = 5, delta: float = 0.0, idle_ms: int | None = None) -> DataFrame:
    """The rows of :func:`early_stopping` from a stream, each once its step has come.

    State survives a restart with the stream's checkpoint.  Steps are judged in their order within a batch, and batches
    in theirs.  With ``idle_ms`` a timer forgets runs that are silent for so long.  Call :func:`stateful` first.
    """
    _checked(mode)
    rows = metrics.select(F.col(run).cast("string").alias("run"), F.col(step).cast("long").alias("step"), F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("value")).where("run is not null")
    processor = StopProcessor(mode, patience, delta, idle_ms)
    return rows.groupBy("run").transformWithStateInPandas(processor, _STOP, "Append", "None" if idle_ms is None else "ProcessingTime")


_LOG = "name string, batches long, values long, mean double, std double, low double, high double, norm double, largest_norm double, bad long"


class GradientProcessor(StatefulProcessor):
    """Count, mean, spread, extremes and norms of each named gradient over all batches so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "batches long, n long, mean double, spread double, low double, high double, largest double, bad long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(rows))["value"].astype(float)
        bad = int((~(x.abs() < float("inf"))).sum())
        x = x[x.abs() < float("inf")]
        batches, n, mean, spread, low, high, largest, seen = self.held.get() if self.held.exists() else (0, 0, 0.0, 0.0, float("inf"), float("-inf"), 0.0, 0)
        norm = float((x * x).sum() ** 0.5)
        if len(x):
            gap, total = x.mean() - mean, n + len(x)
            spread += float(((x - x.mean()) ** 2).sum()) + gap * gap * n * len(x) / total
            mean, n, low, high = mean + gap * len(x) / total, total, min(low, x.min()), max(high, x.max())
        held = (batches + 1, n, float(mean), float(spread), float(low), float(high), max(largest, norm), seen + bad)
        self.held.update(held)
        yield pd.DataFrame([(key[0], held[0], n, held[2], (held[3] / max(n, 1)) ** 0.5, held[4], held[5], norm, held[6], held[7])], columns=[c.split()[0] for c in _LOG.split(", ")])

    def close(self) -> None:
        """The state is Spark's to close."""


def gradient_log(gradients: DataFrame, name: str, value: str) -> DataFrame:
    """A row a batch for every gradient with new values: running count, mean, deviation, extremes, this batch's norm, the largest, and non-finite values."""
    rows = gradients.select(F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("value")).where("name is not null and value is not null")
    return rows.groupBy("name").transformWithStateInPandas(GradientProcessor(), _LOG, "Append", "None")
