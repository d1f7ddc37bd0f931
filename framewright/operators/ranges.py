"""Running sums by keys that may be few or hot: rows are dealt to ranges of (keys, order), not to keys.

A key that holds a third of all rows is then the work of a third of the tasks. What a range adds to the next ones is one
row for each key in it, so that these rows are as many as ranges and keys together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise


#: Rows for keys and ranges up to which they are broadcast; beyond, with very many keys, they are shuffled.
SMALL = 100_000


def few(df: DataFrame) -> DataFrame:
    """df written once, to be broadcast if it is small."""
    df = materialise(df)
    return F.broadcast(df) if df.count() <= SMALL else df


def _shifted(placed: DataFrame, keys: Sequence[str], per_range: DataFrame) -> DataFrame:
    """placed with the columns of per_range for its key and range; a null key is a key like others."""
    per_range = few(per_range)
    names = {k: f"__key{i}" for i, k in enumerate(keys)} | {"__part": "__from"}
    renamed = per_range.withColumnsRenamed(names)
    same = None
    for left, right in names.items():
        equal = F.col(f"`{left}`").eqNullSafe(F.col(right))
        same = equal if same is None else same & equal
    return placed.join(renamed, same).drop(*names.values())


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """df with, for each name of sums, the column's sum over the rows of the key up to this one, and as name_all over all.

    Also leaves __part and __at, the range and the place of a row in it, which latest_max needs. Rows that order does not
    tell apart are counted in any order, and together are one task's work. Nulls count 0; an empty df gives an empty one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(f"`{k}`") for k in keys], *order]
    # Ranges are cut by a sample, for which what is above would run once more.
    ranged = materialise(df).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    inputs = {f"__in_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    # Written once, so that both uses below see the same ranges.
    at = F.monotonically_increasing_id()
    placed = materialise(ranged.withColumns(inputs | {"__part": F.spark_partition_id(), "__at": at}))
    totals = placed.groupBy(*keys, "__part").agg(*[F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = totals.select(
        *keys,
        "__part",
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__base_{n}") for n in sums],
        *[F.sum(f"__sum_{n}").over(whole).alias(f"{n}_all") for n in sums],
    )
    upto = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({n: F.sum(f"__in_{n}").over(upto) for n in sums})
    shifted = _shifted(own, keys, starts).withColumns({n: F.col(n) + F.col(f"__base_{n}") for n in sums})
    return shifted.drop(*inputs, *[f"__base_{n}" for n in sums])


def latest_max(df: DataFrame, keys: Sequence[str], value: str, to: str) -> DataFrame:
    """Rows that running has placed, with the greatest value of their key from this row on."""
    tops = df.groupBy(*keys, "__part").agg(F.max(value).alias("__top"))
    later = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    rest = tops.select(*keys, "__part", F.max("__top").over(later).alias("__rest"))
    back = Window.partitionBy(*keys, "__part").orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("__own", F.max(value).over(back))
    return _shifted(own, keys, rest).withColumn(to, F.greatest("__own", "__rest")).drop("__own", "__rest")
