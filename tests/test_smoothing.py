"""Smoothed metric streams against the same windows over a table."""

import random
import statistics
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import sequences as S
from framewright.streaming import smoothing

KIND = "metric string, ts timestamp_ntz, step bigint, value double"


def at(seconds):
    import datetime

    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def test_stream_equals_the_table_over_batches_and_a_restart(spark, tmp_path):
    smoothing.use_state_store(spark)
    rng = random.Random(3)
    rows = [(f"m{i % 3}", at(i * 10 + (i % 3)), i, rng.random()) for i in range(90)]
    last = [(f"m{m}", at(100_000), 999, 0.5) for m in range(3)]  # passes the watermark over all the others
    late = [("m0", at(5), 500, 9.0)]  # too late once the second batch is through
    mixed = rows[:30], [*rows[40:60], *rows[30:40]], [*late, *reversed(rows[60:])], last, []
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    seen = []
    for batch, own in enumerate(mixed):  # each run is a restart from the checkpoint
        if own:
            spark.createDataFrame(own, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = smoothing.smooth(spark.readStream.schema(KIND).parquet(source), "metric", "ts", "step", "value", 5, "4 minutes")
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        seen.append(spark.read.parquet(target).count() if batch else 0)
    got = {r.step: (r.metric, r.value, r.median, r.mean) for r in spark.read.parquet(target).collect()}
    table = S.smoothed(spark.createDataFrame(rows, KIND), "metric", ["ts", "step"], "value", 5)
    want = {r.step: (r.metric, r.value, r.median, r.mean) for r in table.collect()}
    assert got.keys() == want.keys()
    for step, (metric, value, median, mean) in want.items():
        assert got[step] == (metric, value, pytest.approx(median), pytest.approx(mean))
    assert 0 < seen[1] < seen[2] < 90 == seen[-1]


def test_windows_equal_a_plain_loop():
    values = [random.Random(i).random() for i in range(30)]
    for k in (1, 2, 5, 40):
        for n in (0, 1, 3, k - 1):
            own = np.array(values[: min(n, k - 1)])
            median, mean = smoothing._windows(own, np.array(values), k)
            tails = [[*own, *values][max(0, i - k) : i] for i in range(len(own) + 1, len(own) + 31)]
            assert median.tolist() == pytest.approx([statistics.median(t) for t in tails]) and mean.tolist() == pytest.approx([statistics.mean(t) for t in tails])


def test_many_rows_of_a_metric_take_few_calls_to_its_state():
    class State(list):
        calls = 0

        def appendList(self, rows):  # noqa: N802  Spark's name
            self.calls += 1
            self.extend(rows)

    smoother, clock = smoothing._Smoother("metric", 5, 1000), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)
    smoother.waiting, smoother._wake = State(), lambda ms: None
    rows = pd.DataFrame({"us": range(1, 10_001), "step": 0, "value": 1.0})
    list(smoother.handleInputRows(("m",), iter([rows, rows]), clock))
    assert smoother.waiting.calls == 2 and len(smoother.waiting) == 2


def test_idle_metrics_begin_anew(spark, tmp_path):
    smoothing.use_state_store(spark)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    days = 86_400
    batches = [[("a", at(0), 1, 1.0), ("a", at(1), 2, 3.0)], [("b", at(3 * days), 3, 1.0)], [("b", at(3 * days + 1), 4, 1.0)], [("a", at(4 * days), 5, 10.0)], [("b", at(9 * days), 6, 1.0)], [("b", at(9 * days + 1), 7, 1.0)]]
    kept = []
    for own in batches:
        spark.createDataFrame(own, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = smoothing.smooth(spark.readStream.schema(KIND).parquet(source), "metric", "ts", "step", "value", 5, "1 second", idle="1 day")
        stream.writeStream.foreachBatch(lambda df, _: kept.extend(df.where(F.col("metric") == "a").collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert {r.step: r.mean for r in kept} == {1: 1.0, 2: 2.0, 5: 10.0}
