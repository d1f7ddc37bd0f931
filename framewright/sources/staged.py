"""Results that become visible as a whole or not at all, and ledgers of what has been done.

A result is written to a folder beside its target, checked there, and renamed. What a lost driver leaves behind is either
the old result or the new one, and folders that a sweep removes.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import materialise

#: Names of folders that are being written, and of old results that are being replaced.
STAGED, OLD = "._staged-", "._old-"
#: Records of a ledger that is one JSON document, and so one value in one task.
DOCUMENT_ROWS = 1_000_000


class Published(NamedTuple):
    target: str
    rows: int
    written: bool


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _beside(spark: SparkSession, target: str, mark: str) -> list[tuple[str, int]]:
    """(path, time of last change in ms) of folders beside target that belong to it."""
    fs, p = _fs(spark, target.rstrip("/"))
    parent = p.getParent()
    if not fs.exists(parent):
        return []
    return [(s.getPath().toString(), s.getModificationTime()) for s in fs.listStatus(parent) if s.getPath().getName().startswith(f"{p.getName()}{mark}")]


def _move(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[1]):
        raise OSError(f"{source} could not be renamed to {target}")


def recover(spark: SparkSession, target: str) -> bool:
    """After a driver was lost between its two renames, the old result takes its place again; true if so."""
    target = target.rstrip("/")
    old = _beside(spark, target, OLD)
    if exists(spark, target) or not old:
        return False
    _move(spark, max(old, key=lambda x: x[1])[0], target)
    return True


def sweep(spark: SparkSession, target: str, older_than: float = 86_400.0) -> int:
    """Deletes what lost runs have left beside target, once it is older than so many seconds; returns how many folders. An
    old result is only deleted where there is a newer one."""
    recover(spark, target)
    limit, n = (time.time() - older_than) * 1000, 0
    for mark in (STAGED, OLD):
        for path, changed in _beside(spark, target, mark):
            if changed <= limit:
                fs, p = _fs(spark, path)
                n += bool(fs.delete(p, True))
    return n


def publish(df: DataFrame, target: str, form: str = "json", valid: Callable[[DataFrame], bool] | None = None, force: bool = False, dry_run: bool = False, **options: Any) -> Published:
    """Writes df to a staging folder, reads it there for valid, and renames it to target.

    A target that exists is refused unless force, before anything is computed; with force the old one is moved aside, and
    deleted once the new one is in place. A dry run writes nothing, refuses nothing and tells the rows there would be. If
    valid says no, or anything fails before the renames, the target stays as it was and the staging folder goes.
    """
    spark, target = df.sparkSession, target.rstrip("/")
    if dry_run:
        return Published(target, df.count(), False)
    recover(spark, target)
    if exists(spark, target) and not force:
        raise FileExistsError(f"{target} exists")
    staged = f"{target}{STAGED}{uuid.uuid4().hex}"
    try:
        df.write.format(form).options(**options).save(staged)
        there = spark.read.format(form).options(**options).schema(df.schema).load(staged)
        rows = there.count()
        if valid is not None and not valid(there):
            raise ValueError(f"what was written for {target} is not valid")
    except BaseException:
        fs, p = _fs(spark, staged)
        fs.delete(p, True)
        raise
    old = f"{target}{OLD}{uuid.uuid4().hex}"
    if exists(spark, target):
        _move(spark, target, old)
    _move(spark, staged, target)
    fs, p = _fs(spark, old)
    fs.delete(p, True)
    return Published(target, rows, True)


def read_ledger(spark: SparkSession, path: str, record: str, key: str = "id", missing: str = "empty", corrupt: str = "empty", defaults: Mapping[str, Any] | None = None, document: bool = False) -> DataFrame:
    """(key, fields of record): a ledger of JSON lines, or a document that maps keys to records.

    missing and corrupt are empty (a ledger that isn't there, or that has a line that can't be read, has no rows: all is done
    again) or error. Fields that a record lacks get their defaults; a null record has only defaults.
    """
    if {missing, corrupt} - {"empty", "error"}:
        raise ValueError("missing and corrupt are empty or error")
    kind = StructType.fromDDL(f"`{key}` string, {record}")
    none = spark.createDataFrame([], kind)
    if not exists(spark, path):
        if missing == "error":
            raise FileNotFoundError(path)
        return none
    fields = [f for f in kind.names if f != key]
    if document:
        text = spark.read.text(path, wholetext=True)
        held = text.select(F.from_json("value", f"map<string, struct<{', '.join(f'`{f}`: {kind[f].dataType.simpleString()}' for f in fields)}>>").alias("m"))
        bad = held.where("m IS NULL")
        rows = held.select(F.explode("m").alias(key, "r")).select(key, *[F.col(f"r.`{f}`").alias(f) for f in fields])
    else:
        lines = materialise(spark.read.schema(StructType([*kind.fields]).add("__bad", "string")).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="__bad"))
        bad = lines.where(F.col("__bad").isNotNull() | F.col(key).isNull())
        rows = lines.select(key, *fields)
    if not bad.isEmpty():
        if corrupt == "error":
            raise ValueError(f"{path} can't be read as a ledger")
        return none
    return rows.withColumns({f: F.coalesce(F.col(f), F.lit(v).cast(kind[f].dataType) if not isinstance(v, (list, tuple)) else F.array(*map(F.lit, v)).cast(kind[f].dataType)) for f, v in (defaults or {}).items()})


def write_ledger(df: DataFrame, path: str, key: str = "id", document: bool = False, force: bool = True) -> Published:
    """Replaces a ledger as a whole, as JSON lines or as one document that maps keys to records, of which there may be
    DOCUMENT_ROWS. Of rows that share a key one stays, the greatest of its fields in their order."""
    fields = [c for c in df.columns if c != key]
    one = df.groupBy(key).agg(F.max(F.struct(*fields)).alias("r")).where(F.col(key).isNotNull())
    if not document:
        return publish(one.select(key, "r.*"), path, force=force)
    one = materialise(one)
    if (n := one.count()) > DOCUMENT_ROWS:
        raise ValueError(f"{n} records are too many for one document")
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string"), "r"))))
    return publish(one.agg(F.to_json(pairs).alias("value")), path, form="text", force=force)
