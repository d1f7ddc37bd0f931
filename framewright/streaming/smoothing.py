"""Metric streams: the median and mean of each metric's last values, kept as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with timers needs this store of states.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A row as it waits in state, and rows that one value of the state or one piece of a result holds.
_ROW = np.dtype([("us", "<i8"), ("step", "<i8"), ("value", "<f8")])
CHUNK = 50_000


class _Smoother(StatefulProcessor):
    """Holds rows until the watermark has passed them, so that late ones find their place, and the last k - 1 values. Rows
    go to and from the state in packed chunks, as every value of it is a call to the JVM."""

    def __init__(self, name: str, k: int, idle_ms: int):
        self.name, self.k, self.idle_ms = name, k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.recent = handle.getListState("recent", "us bigint, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        now, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for pdf in rows:
            new = _packed(pdf["us"].to_numpy(), pdf["step"].to_numpy(), pdf["value"].to_numpy())
            new = new[new["us"] > now]
            if len(new):
                self.waiting.appendList(_chunks(new))
                first = int(new["us"].min()) if first is None else min(first, int(new["us"].min()))
        if first is not None:
            self._wake(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = [np.frombuffer(bytes(c[0]), _ROW) for c in self.waiting.get()] if self.waiting.exists() else []
        waiting = np.concatenate(held) if held else np.empty(0, _ROW)
        ready = waiting["us"] <= now
        due, rest = waiting[ready], waiting[~ready]
        due = due[np.lexsort((due["value"], due["step"], due["us"]))]
        recent = list(self.recent.get()) if self.recent.exists() else []
        before = np.array([v for _, v in recent], float)
        if len(due):
            recent = [*recent, *zip(due["us"][-self.k :].tolist(), due["value"][-self.k :].tolist())]
            recent = recent[max(0, len(recent) - self.k + 1) :]
            self._put(self.recent, recent)
            self._put(self.waiting, _chunks(rest))
        elif not len(rest) and recent and recent[-1][0] // 1000 + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
            self.recent.clear()  # idle for so long that the metric begins anew
            recent = []
        if len(rest):
            self._wake(int(rest["us"].min()) // 1000 + 1, expiredTimerInfo.getExpiryTimeInMs())
        elif recent:
            self._wake(recent[-1][0] // 1000 + self.idle_ms, expiredTimerInfo.getExpiryTimeInMs())
        for at in range(0, len(due), CHUNK):
            part = due[at : at + CHUNK]
            median, mean = _windows(before, part["value"], self.k)
            values = np.concatenate([before, part["value"]])
            before = values[max(0, len(values) - self.k + 1) :]
            yield pd.DataFrame({self.name: [key[0]] * len(part), "us": part["us"], "step": part["step"], "value": part["value"], "median": median, "mean": mean})

    def _put(self, state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def _wake(self, ms: int, rings: int | None = None) -> None:
        """One timer a metric, the earliest that is wanted, besides the one that rings now."""
        held = [t for t in self.handle.listTimers() if t != rings]
        if not held or ms < min(held):
            for t in held:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def close(self) -> None:
        pass


def _packed(us: np.ndarray, step: np.ndarray, value: np.ndarray) -> np.ndarray:
    rows = np.empty(len(us), _ROW)
    rows["us"], rows["step"], rows["value"] = us, step, value
    return rows


def _chunks(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[i : i + CHUNK].tobytes(),) for i in range(0, len(rows), CHUNK)]


def _windows(before: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Median and mean of the last k of before and values up to each of values; fewer at the beginning."""
    whole = np.concatenate([before, values])
    short = range(len(before) + 1, min(k, len(whole) + 1))
    median, mean = [float(np.median(whole[:i])) for i in short], [float(whole[:i].mean()) for i in short]
    if len(whole) < k:
        return np.array(median), np.array(mean)
    full = np.lib.stride_tricks.sliding_window_view(whole, k)[max(0, len(before) + 1 - k) :]
    return np.append(median, np.median(full, axis=1)), np.append(mean, full.mean(axis=1))


def use_state_store(spark: SparkSession) -> None:
    """Streams with keyed state need it set before they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def smooth(df: DataFrame, name: str, ts: str, step: str, value: str, k: int, late: str, idle: str = "1 day") -> DataFrame:
    """(name, ts, step, value, median, mean) of a stream: of the last k values of each name up to this row, by ts and step.

    Rows may come late by as much as late: each is held until the watermark has passed it and then takes its place, later
    ones are dropped. A metric without rows for idle, by event time, is forgotten and begins anew. The state of a metric
    is k - 1 values and the rows that wait. Rows without name, ts or value are left out.
    """
    spark = df.sparkSession
    ms = int(spark.sql(f"SELECT unix_millis(TIMESTAMP'1970-01-01 00:00:00+00:00' + INTERVAL {idle}) AS ms").first()["ms"])
    rows = df.where(F.col(name).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull())
    rows = rows.select(F.col(name), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(F.col(step).cast("bigint"), F.lit(0)).alias("step"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    schema = f"`{name}` {df.schema[name].dataType.simpleString()}, us bigint, step bigint, value double, median double, mean double"
    out = rows.groupBy(name).transformWithStateInPandas(_Smoother(name, k, ms), schema, "Append", "EventTime")
    return out.select(name, F.timestamp_micros("us").alias("ts"), "step", "value", "median", "mean")
