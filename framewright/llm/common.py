"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: a Python worker is to hold about a thousand of them at once, unless a session says otherwise."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


_kept: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What an operator keeps in a Python worker, which outlives its stage; what other operators kept is dropped, and the
    memory given back, which the allocators would hold for a worker's whole life."""
    if operator not in _kept:
        forget()
        _kept[operator] = {}
    return _kept[operator]


def forget() -> None:
    """Drops what operators keep in this Python worker."""
    _kept.clear()
    give_back_memory()


def give_back_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def shared_checkpoints(spark: SparkSession) -> None:
    """Keeps the folder in spark.checkpoint.dir; only where none is named and all runs on one machine (tests) a temporary
    one is set."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framewright-"))


#: Keys that are told apart as hot at most, and rows of a key from which it can be one.
HOT_KEYS, HOT_ROWS = 100_000, 1024


def hot_from(rows: int) -> int:
    """Rows from which a key is hot, in a table of so many rows: at most HOT_KEYS keys are, so that a table with a row for
    each of them may be broadcast; a key that isn't has one row in HOT_KEYS at most, or less than HOT_ROWS."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a reliable checkpoint in the shared folder; it survives lost executors."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for files that Spark doesn't write itself."""
    shared_checkpoints(spark)
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
