"""Small groups worked on in Python: many of them in one batch, one after another in a sorted stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bounds(pdf: pd.DataFrame, keys: Sequence[str]) -> np.ndarray:
    """Where groups of equal keys begin, and the end."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(pdf))


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], f: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """f of batches that hold whole groups in order, with the groups' bounds.

    Rows are shuffled by keys once, or not at all where they stand by some of them already, and streamed; a task holds one
    batch and the group that goes on in the next one. A group must fit in a task's memory, as the boxes of one image do;
    keys must not be null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            at = bounds(pdf, keys)
            if rest and any(rest[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
                whole = pd.concat(rest, ignore_index=True)
                yield f(whole, bounds(whole, keys))
                rest = []
            if len(at) > 2:
                done = pd.concat([*rest, pdf.iloc[: at[-2]]], ignore_index=True)
                yield f(done, bounds(done, keys))
                rest = []
            rest.append(pdf.iloc[at[-2] :])
        if rest:
            whole = pd.concat(rest, ignore_index=True)
            yield f(whole, bounds(whole, keys))

    # A window asks for rows by key and in order, and Spark moves them only where they aren't.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("__place", place).mapInPandas(run, schema)
