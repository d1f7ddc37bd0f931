"""Scorers of other libraries as expressions: loaded once for each task, given batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scorer(load: Callable[[], Any], score: Callable[[Any, pd.Series], pd.Series]) -> Callable[[Column | str], Column]:
    """An expression of type double: load runs once in a task, score on each Arrow batch with what load gave. Only the
    column that is scored goes to Python."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield score(model, batch).astype("float64")
            # Series.str and its like hang a batch in a cycle of references; so few objects are made that it would stay.
            del batch
            gc.collect()

    # The annotations above are strings, which pandas_udf reads the kind of function from.
    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "double")
