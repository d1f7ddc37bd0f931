"""Splits and samples in a fixed order: md5 of seed and key stands for a random draw, on any cluster and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .ranges import running
from .sequences import dense_number


def draw(key: str | Column, seed: int = 42) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")))


def top_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of distinct keys by draw."""
    return df.dropDuplicates([key]).orderBy(draw(key, seed), key).limit(n)


def split_random(df: DataFrame, key: str, ratio: float, seed: int = 42, to: str = "side") -> DataFrame:
    """Marks max(1, int(n * ratio)) rows val and the others train."""
    total = df.agg(F.greatest(F.lit(1), F.floor(F.count("*") * ratio)).alias("__n"))
    ranked = dense_number(df.withColumn("__draw", draw(key, seed)), ["__draw", key], "__r")
    return ranked.crossJoin(F.broadcast(total)).withColumn(to, F.when(F.col("__r") <= F.col("__n"), "val").otherwise("train")).drop("__n", "__r", "__draw")


def split_stratified(df: DataFrame, stratum: str, key: str, ratio: float, seed: int = 42, to: str = "side") -> DataFrame:
    """The same within every stratum."""
    placed = running(df, [stratum], [draw(key, seed), F.col(key)], {"__r": F.lit(1)})
    val = F.col("__r") <= F.greatest(F.lit(1), F.floor(F.col("__r_all") * ratio))
    return placed.withColumn(to, F.when(val, "val").otherwise("train")).drop("__r", "__r_all", "__part", "__at")


def split_groups(df: DataFrame, group: Column, ratio: float, seed: int = 42, to: str = "side") -> DataFrame:
    """Whole groups go to val, in drawn order, as long as it has fewer than max(1, int(n * ratio)) rows."""
    rows = df.withColumn("__g", group.cast("string"))
    sizes = rows.groupBy("__g").agg(F.count("*").alias("__size"))
    target = sizes.agg(F.greatest(F.lit(1), F.floor(F.sum("__size") * ratio)).alias("__target"))
    # One row for each group; those before the target's are found by running sums over hash ranges, then within one.
    drawn = sizes.withColumn("__draw", draw("__g", seed)).withColumn("__range", F.substring("__draw", 1, 3))
    ranges = drawn.groupBy("__range").agg(F.sum("__size").alias("__sum"))
    before = ranges.select("__range", F.coalesce(F.sum("__sum").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.coalesce(F.sum("__size").over(Window.partitionBy("__range").orderBy("__draw", "__g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sided = drawn.withColumn("__own", inner).join(F.broadcast(before), "__range").crossJoin(F.broadcast(target))
    sided = sided.select("__g", F.when(F.col("__base") + F.col("__own") < F.col("__target"), "val").otherwise("train").alias(to))
    return rows.join(sided.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h"))).drop("__g", "__h")


def leaks(df: DataFrame, group: Column, side: str = "side") -> DataFrame:
    """(leaks): groups on both sides."""
    both = df.groupBy(group.alias("g")).agg(F.min(side).alias("a"), F.max(side).alias("b"))
    return both.agg(F.count_if(F.col("a") != F.col("b")).alias("leaks"))


def balanced(df: DataFrame, bucket: str, key: str, total: int, buckets: int, seed: int = 42) -> DataFrame:
    """total rows: total // buckets of each bucket, and the rest from what is left over, all by draw.

    No more than total rows of a bucket can be among them; ranks beyond are pruned before the shuffle.
    """
    each = total // buckets
    drawn = df.withColumn("__draw", draw(key, seed))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("__draw", key))
    ranked = materialise(drawn.withColumn("__r", rank).where(F.col("__r") <= total))
    first = ranked.where(F.col("__r") <= each).drop("__r", "__draw")
    missing = total - first.count()
    if missing <= 0:
        return first
    spare = dense_number(ranked.where(F.col("__r") > each), ["__draw", key], "__k").where(F.col("__k") <= missing)
    return first.unionByName(spare.drop("__r", "__draw", "__k"))


def rarest_bucket(labels: DataFrame, key: str, label: str, other: str = "other") -> DataFrame:
    """(key, bucket): the label of each key that fewest keys have; ties to the first by name, none to other."""
    counts = labels.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    joined = labels.join(counts, label, "left")
    return joined.groupBy(key).agg(F.coalesce(F.min_by(label, F.struct(F.coalesce("__n", F.lit(2**62)), label)), F.lit(other)).alias("bucket"))


def quota(df: DataFrame, key: str, n_rows: int, wanted: int, seed: int = 42) -> DataFrame:
    """wanted rows: the first by draw, or, past n_rows, all once and then drawn ones again. Adds pass (0 the first)."""
    ranked = dense_number(df.withColumn("__draw", draw(key, seed)), ["__draw", key], "__k", start=0)
    base = ranked.where(F.col("__k") < wanted).withColumn("pass", F.lit(0)).drop("__draw", "__k")
    if wanted <= n_rows:
        return base
    again = df.sparkSession.range(wanted - n_rows).select(F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:again:"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint"), F.lit(n_rows)).alias("__k"))
    return base.unionByName(again.join(ranked, "__k").withColumn("pass", F.lit(1)).drop("__draw", "__k"))


def quota_size(spec: float | int, n: int) -> int:
    """A float is a share of n, an int a number of rows; booleans are refused."""
    if isinstance(spec, bool) or not isinstance(spec, (int, float)):
        raise TypeError("a quota is a number")
    if spec <= 0:
        raise ValueError("a quota is positive")
    return spec if isinstance(spec, int) else max(1, round(n * spec))


def rank_slice(df: DataFrame, order: Sequence[str], world: int, rank: int, n_rows: int) -> DataFrame:
    """Every world-th row from rank on, after the rows that don't fill a round are cut."""
    placed = dense_number(df, order, "pos", start=0)
    return placed.where((F.col("pos") < n_rows - n_rows % world) & (F.pmod("pos", F.lit(world)) == rank))


def signed_subsample(df: DataFrame, keys: Sequence[str], label: str, key: str, n: int, fraction: float, seed: int = 42) -> DataFrame:
    """At most int(n * fraction) rows of label 1 and, to fill n up, rows of label 0 of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys, label).orderBy(draw(key, seed), key))
    most = int(n * fraction)
    ones = F.least(F.count_if(F.col(label) == 1).over(Window.partitionBy(*keys)), F.lit(most))
    return df.where(F.col(label).isin(0, 1)).withColumns({"__r": rank, "__p": ones}).where(F.when(F.col(label) == 1, F.col("__r") <= most).otherwise(F.col("__r") <= n - F.col("__p"))).drop("__r", "__p")


def accept_up_to(df: DataFrame, keys: Sequence[str], order: Sequence[Column], ok: Column, tries: int, keep: int) -> DataFrame:
    """Of the first tries rows of each key, the first keep that are ok."""
    w = Window.partitionBy(*keys).orderBy(*order)
    placed = df.withColumns({"__try": F.row_number().over(w), "__ok": F.coalesce(ok, F.lit(False))})
    good = F.sum(F.col("__ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("__n", good).where((F.col("__try") <= tries) & F.col("__ok") & (F.col("__n") <= keep)).drop("__try", "__ok", "__n")


def branch(key: str, shares: dict[str, float], seed: int = 42) -> Column:
    """A choice by one uniform draw from cumulated shares; the last takes the rest."""
    u = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("double") / 2**32
    names, at, out = list(shares), 0.0, None
    for name in names[:-1]:
        at += shares[name]
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])
