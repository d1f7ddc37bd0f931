"""Summaries, histograms, shares and weighted means; moments and distances of vectors are in partials."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, max, mean and population deviation of finite values, and how many are NaN or infinite."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
    return df.groupBy(*keys).agg(
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"), F.stddev_pop(finite).alias("std"), F.count_if(F.isnan(v)).alias("n_nan"), F.count_if(F.abs(v) == float("inf")).alias("n_inf")
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """(keys, bin, n): equal bins between a key's least and greatest value; the last holds its end."""
    v = F.col(value).cast("double")
    ends = df.groupBy(*keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    joined = df.join(ends, list(keys)) if keys else df.crossJoin(F.broadcast(ends))
    at = F.coalesce(F.floor(F.try_divide(v - F.col("__lo"), F.col("__hi") - F.col("__lo")) * bins), F.lit(0))
    return joined.where(v.isNotNull()).groupBy(*keys, F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def two_class_gap(df: DataFrame, keys: Sequence[str], flag: Column) -> DataFrame:
    """(keys, score): 1 less the distance of a two-class share from one half."""
    return df.groupBy(*keys).agg((1 - F.abs(F.avg(flag.cast("double")) - 0.5) * 2).alias("score"))


def three_bin_gap(df: DataFrame, keys: Sequence[str], bin_: Column) -> DataFrame:
    """(keys, score): 1 less the distance of the shares of bins 0, 1, 2 from a third each, over the greatest such one."""
    part = lambda k: F.pow(F.avg((bin_ == k).cast("double")) - 1 / 3, 2)
    return df.groupBy(*keys).agg((1 - F.sqrt(part(0) + part(1) + part(2)) / ((6**0.5) / 3)).alias("score"))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def blend(high: Column, mean: Column, low: Column) -> Column:
    return 0.4 * high + 0.3 * mean + 0.3 * low


def psnr(mse: Column) -> Column:
    return F.avg(F.when(mse > 0, 10 * F.log10(1 / mse)))


def region_mean(df: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """(keys, score): mean over frames of the mean over a region; frames without one are left out, null if all are."""
    frames = df.groupBy(*keys, "t").agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("__v"))
    return frames.groupBy(*keys).agg(F.avg("__v").alias("score"))


def vote(df: DataFrame, keys: Sequence[str], logits: str) -> DataFrame:
    """(keys, winner): position of the greatest component of the mean vector."""
    flat = df.select(*keys, F.posexplode(logits).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    return flat.groupBy(*keys).agg(F.max_by("pos", F.struct("m", -F.col("pos"))).alias("winner"))


def weighted_error(found: Column, aim: Column, weight: Column | None = None) -> Column:
    """The mean over samples of a sample's mean squared difference of two vectors, times its weight where there is one."""
    square = F.aggregate(F.zip_with(found, aim, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size(found)
    return F.avg(square if weight is None else square * weight)


def described(df: DataFrame) -> DataFrame:
    """(path, type, n, nulls, least, greatest) of every column, of the fields of structs and of the elements of arrays, as
    far as they go down: least and greatest are of numbers, and of lengths where there are none to compare. One scan."""
    parts = []

    def walk(c: Column, kind: DataType, path: str) -> None:
        if isinstance(kind, StructType):
            parts.append((path, "struct", c.isNotNull(), F.lit(None).cast("double")))
            for f in kind.fields:
                walk(c[f.name], f.dataType, f"{path}.{f.name}" if path else f.name)
        elif isinstance(kind, ArrayType):
            parts.append((path, kind.simpleString(), c.isNotNull(), F.size(c).cast("double")))
            if isinstance(kind.elementType, NumericType):
                low, high = F.array_min(c).cast("double"), F.array_max(c).cast("double")
                parts.append((f"{path}[]", kind.elementType.simpleString(), low.isNotNull(), low, high))
        elif isinstance(kind, NumericType):
            parts.append((path, kind.simpleString(), c.isNotNull(), c.cast("double")))
        else:
            parts.append((path, kind.simpleString(), c.isNotNull(), F.char_length(c.cast("string")).cast("double")))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    one = df.agg(*[F.struct(F.count("*").alias("n"), F.count_if(~p[2]).alias("nulls"), F.min(p[3]).alias("least"), F.max(p[-1]).alias("greatest")).alias(f"c{i}") for i, p in enumerate(parts)])
    rows = F.array(*[F.struct(F.lit(p[0]).alias("path"), F.lit(p[1]).alias("type"), F.col(f"c{i}").alias("s")) for i, p in enumerate(parts)])
    return one.select(F.explode(rows).alias("x")).select("x.path", "x.type", "x.s.*")
