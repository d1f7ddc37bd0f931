"""Results that merge: every task sends one state, and states meet in a tree of bounded fan-in.

An evaluator has columns, start(), update(state, batch), merge(a, b) and evaluate(state). evaluate_all runs any number of
them over one scan of a table; gaussians is the same protocol for means and covariances by key, whose states are matrices.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import materialise

#: States that one task merges, which bounds its memory to so many and one more.
FAN_IN = 8


class Evaluator(Protocol):
    """What a run reports. States are any objects that pickle; merge must not depend on the order of states."""

    columns: Sequence[str]

    def start(self) -> Any: ...

    def update(self, state: Any, batch: pa.RecordBatch) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def evaluate(self, state: Any) -> dict[str, float | None]: ...


def merge_tree(states: DataFrame, keys: Sequence[str], merge: Callable[[Any, Any], Any]) -> DataFrame:
    """(keys, state): one state for each key from (keys, share, state) rows, FAN_IN of them at a time; share numbers a key's
    states without large gaps. A level has an eighth of the rows of the one before it."""
    kind = ", ".join([*[f"`{k}` {states.schema[k].dataType.simpleString()}" for k in keys], "share bigint, state binary"])

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for s in pdf["state"]:
            whole = pickle.loads(s) if whole is None else merge(whole, pickle.loads(s))
        return pdf.iloc[:1].assign(state=[pickle.dumps(whole)])[[*keys, "share", "state"]]

    rows = materialise(states.select(*keys, "share", "state"))
    top = rows.agg(F.max("share")).first()[0] or 0
    while top > 0:
        rows = rows.withColumn("share", F.floor(F.col("share") / FAN_IN)).groupBy(*keys, "share").applyInPandas(merged, kind)
        top //= FAN_IN
    return rows.select(*keys, "state")


def evaluate_all(df: DataFrame, evaluators: Mapping[str, Evaluator]) -> DataFrame:
    """(evaluator, metric, value) of all evaluators from one scan of df. Metrics without a value have no row; two evaluators
    that give a metric of one name are refused, as their results are told by metric. An empty df gives what start()
    evaluates to."""
    names = list(evaluators)
    columns = list(dict.fromkeys(c for e in evaluators.values() for c in e.columns))

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states = [evaluators[n].start() for n in names]
        for batch in batches:
            for i, n in enumerate(names):
                states[i] = evaluators[n].update(states[i], batch)
        for i, n in enumerate(names):
            state = pickle.dumps((n, states[i]))
            yield pa.RecordBatch.from_pydict({"evaluator": [n], "share": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": [state]})

    states = df.select(*columns).mapInArrow(update, "evaluator string, share bigint, state binary")
    whole = merge_tree(states, ["evaluator"], lambda a, b: (a[0], evaluators[a[0]].merge(a[1], b[1])))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, k, float(v)) for n, s in zip(pdf["evaluator"], pdf["state"]) for k, v in evaluators[n].evaluate(pickle.loads(s)[1]).items() if v is not None and v == v]
            yield pd.DataFrame(rows, columns=["evaluator", "metric", "value"])

    out = materialise(whole.mapInPandas(told, "evaluator string, metric string, value double"))
    twice = out.groupBy("metric").agg(F.count("*").alias("n")).where("n > 1").first()
    if twice:
        raise ValueError(f"two evaluators tell {twice['metric']}")
    return out


class Mean:
    """The mean of a column, without nulls and NaN."""

    def __init__(self, metric: str, column: str):
        self.metric, self.columns = metric, [column]

    def start(self) -> tuple[float, int]:
        return 0.0, 0

    def update(self, state: tuple[float, int], batch: pa.RecordBatch) -> tuple[float, int]:
        x = batch.column(self.columns[0]).to_numpy(zero_copy_only=False).astype(float)
        x = x[~np.isnan(x)]
        return state[0] + float(x.sum()), state[1] + len(x)

    def merge(self, a: tuple[float, int], b: tuple[float, int]) -> tuple[float, int]:
        return a[0] + b[0], a[1] + b[1]

    def evaluate(self, state: tuple[float, int]) -> dict[str, float | None]:
        return {self.metric: state[0] / state[1] if state[1] else None}


class Classes:
    """Accuracy and mean intersection over union of classes 0 to n - 1, from a confusion matrix; rows with another class
    or none take no part, and classes that neither side has don't count in the mean."""

    def __init__(self, metric: str, truth: str, found: str, n: int):
        self.metric, self.columns, self.n = metric, [truth, found], n

    def start(self) -> np.ndarray:
        return np.zeros((self.n, self.n), np.int64)

    def update(self, state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        t, f = (batch.column(c).cast(pa.int64()).fill_null(-1).to_numpy() for c in self.columns)
        ok = (t >= 0) & (t < self.n) & (f >= 0) & (f < self.n)
        return state + np.bincount(t[ok] * self.n + f[ok], minlength=self.n * self.n).reshape(self.n, self.n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def evaluate(self, state: np.ndarray) -> dict[str, float | None]:
        right, union = np.diag(state), state.sum(0) + state.sum(1) - np.diag(state)
        some = union > 0
        iou = float((right[some] / union[some]).mean()) if some.any() else None
        return {f"{self.metric}_accuracy": float(right.sum() / state.sum()) if state.any() else None, f"{self.metric}_iou": iou}


class Ranking:
    """The area under the curve of a score for a 0/1 column: the chance that a 1 scores above a 0, ties counting half.
    Scores are counted in bins between 0 and 1; those beyond are in the first and last."""

    def __init__(self, metric: str, truth: str, score: str, bins: int = 4096):
        self.metric, self.columns, self.bins = metric, [truth, score], bins

    def start(self) -> np.ndarray:
        return np.zeros((2, self.bins), np.int64)

    def update(self, state: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        t = batch.column(self.columns[0]).cast(pa.int64()).fill_null(-1).to_numpy()
        s = batch.column(self.columns[1]).to_numpy(zero_copy_only=False).astype(float)
        ok = ((t == 0) | (t == 1)) & ~np.isnan(s)
        at = np.clip(s[ok] * self.bins, 0, self.bins - 1).astype(np.int64)
        return state + np.bincount(t[ok] * self.bins + at, minlength=2 * self.bins).reshape(2, self.bins)

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a + b

    def evaluate(self, state: np.ndarray) -> dict[str, float | None]:
        zeros, ones = state
        below = np.cumsum(zeros) - zeros
        total = int(zeros.sum()) * int(ones.sum())
        return {self.metric: float((ones * (below + zeros / 2)).sum() / total) if total else None}


def joined(a: tuple, b: tuple) -> tuple:
    """(n, mean, sum of products around it) of two sets of vectors together."""
    n = a[0] + b[0]
    if not a[0] or not b[0]:
        return a if a[0] else b
    off = b[1] - a[1]
    return n, a[1] + off * (b[0] / n), a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)


def spread(x: np.ndarray) -> tuple:
    mean = x.mean(0)
    return len(x), mean, (x - mean).T @ (x - mean)


class Gaussian:
    """The trace and mean norm of a vector column's Gaussian; its state is what distances of distributions need."""

    def __init__(self, metric: str, column: str):
        self.metric, self.columns = metric, [column]

    def start(self) -> tuple:
        return 0, None, None

    def update(self, state: tuple, batch: pa.RecordBatch) -> tuple:
        x = vectors(batch.column(self.columns[0]))
        return joined(state, spread(x)) if len(x) else state

    def merge(self, a: tuple, b: tuple) -> tuple:
        return joined(a, b)

    def evaluate(self, state: tuple) -> dict[str, float | None]:
        n, mean, products = state
        return {f"{self.metric}_norm": float(np.sqrt(mean @ mean)) if n else None, f"{self.metric}_trace": float(np.trace(products) / (n - 1)) if n > 1 else None}


def vectors(column: pa.Array) -> np.ndarray:
    """The rows of a list column that are not null; all must have one length."""
    column = column.drop_null()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gaussians(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, state): n, mean and products around the mean of each key's vectors, as a pickled tuple. A task holds a matrix
    for each key that it meets, so keys are few, or rows come by them; products are sums over blocks of rows."""
    kind = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    types = {k: to_arrow_type(df.schema[k].dataType) for k in keys}

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[tuple, tuple] = {}
        for batch in batches:
            batch = batch.filter(batch.column("__v").is_valid())
            names = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            x = vectors(batch.column("__v"))
            places: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                places.setdefault(name, []).append(i)
            for name, at in places.items():
                held[name] = joined(held.get(name, (0, None, None)), spread(x[at]))
        for name, state in held.items():
            row = {k: pa.array([v], types[k]) for k, v in zip(keys, name)}
            yield pa.RecordBatch.from_pydict(row | {"share": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": [pickle.dumps(state)]})

    states = df.select(*keys, F.col(vector).alias("__v")).mapInArrow(update, f"{kind}{', ' if keys else ''}share bigint, state binary")
    return merge_tree(states, keys, joined)


def frechet(a: tuple, b: tuple) -> float | None:
    """The distance of two Gaussians; None where one of them has fewer than two vectors. The root of the product of the
    covariances is taken by that of a symmetric matrix with the same eigenvalues, which has no complex part."""
    if a[0] < 2 or b[0] < 2:
        return None
    ca, cb = a[2] / (a[0] - 1), b[2] / (b[0] - 1)
    value, vector = np.linalg.eigh(ca)
    half = (vector * np.sqrt(np.maximum(value, 0))) @ vector.T
    roots = np.sqrt(np.maximum(np.linalg.eigvalsh(half @ cb @ half), 0))
    return float(((a[1] - b[1]) ** 2).sum() + np.trace(ca) + np.trace(cb) - 2 * roots.sum())


def frechet_distances(left: DataFrame, right: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, distance) of the features of both sides with equal keys; keys without two vectors on each side have no row."""
    a, b = gaussians(left, keys, vector), gaussians(right, keys, vector).withColumnRenamed("state", "other")
    both = a.join(b, list(keys)) if keys else a.crossJoin(F.broadcast(b))  # one row
    far = F.pandas_udf(lambda x, y: pd.Series([frechet(pickle.loads(p), pickle.loads(q)) for p, q in zip(x, y)], dtype=float), "double")
    return both.select(*keys, far("state", "other").alias("distance")).where("distance IS NOT NULL AND NOT isnan(distance)")


def heavy_metrics(sides: Mapping[str, tuple[DataFrame, DataFrame, str] | None]) -> DataFrame:
    """(metric, value): the distance of two sets of features for each name. A name without features, or whose distance does
    not exist, is left out, as where no extractor was at hand."""
    out = None
    for name, side in sides.items():
        if side is not None:
            row = frechet_distances(side[0], side[1], [], side[2]).select(F.lit(name).alias("metric"), F.col("distance").alias("value"))
            out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no metric has features")
    return out


def moments(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """(keys, n, i, j, mean_i, mean_j, cov): a row for each i <= j of the components of a key's vectors; the covariance is
    null for a single one."""
    kind = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, s in enumerate(pdf["state"]):
                n, mean, products = pickle.loads(s)
                i, j = np.triu_indices(len(mean))
                cov = products[i, j] / (n - 1) if n > 1 else np.full(len(i), np.nan)
                row = {k: [pdf[k].iloc[at]] * len(i) for k in keys}
                yield pd.DataFrame(row | {"n": n, "i": i, "j": j, "mean_i": mean[i], "mean_j": mean[j], "cov": cov})

    out = gaussians(df, keys, vector).mapInPandas(cells, f"{kind}{', ' if keys else ''}n bigint, i int, j int, mean_i double, mean_j double, cov double")
    return out.withColumn("cov", F.nullif("cov", F.lit(float("nan"))))
