"""Operators on ordered rows: frames of videos, values of metrics, runs of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..storage import materialise
from .clips import middle_frames
from .ranges import running


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row of each key with the greatest order; one aggregation with partial results, no sort of a hot key."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(order)).alias("__row"))
    return best.select("__row.*")


def dense_number(df: DataFrame, order: Sequence[str], to: str, start: int = 1) -> DataFrame:
    """Numbers all rows by order without a global sort in one task.

    Rows are dealt to ranges of order; a range's rows are numbered on their own and shifted by the counts of the ranges
    before it, of which there are as many as shuffle partitions at most.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Written once: ranges are cut by a sample, and both uses below must see the same ones.
    placed = materialise(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id() % (1 << 33)))
    sizes = placed.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(starts), "__part").withColumn(to, F.col("__before") + F.col("__at") + start).drop("__part", "__at", "__before")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows of each key; Spark prunes ranks beyond n before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def frame_consistency(frames: DataFrame, clip: str = "clip_id", t: str = "t", emb: str = "emb") -> DataFrame:
    """(clip, n, total): frames after a clip's first, and the sum of their consistency: the mean of the cosines, cut at
    0, with the frame before and with the first frame. Clips of one frame have no row."""
    w = Window.partitionBy(clip).orderBy(t)
    at_least_0 = lambda c: F.greatest(c, F.lit(0.0))
    both = frames.select(clip, emb, F.lag(emb).over(w).alias("__before"), F.first(emb).over(w).alias("__first")).where("__before is not null")
    value = (at_least_0(V.cosine(F.col(emb), F.col("__before"))) + at_least_0(V.cosine(F.col(emb), F.col("__first")))) / 2
    return both.groupBy(clip).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def micro_macro(per_clip: DataFrame) -> DataFrame:
    """Mean over frames and mean over clips of (n, total) rows."""
    return per_clip.agg((F.sum("total") / F.sum("n")).alias("micro"), F.avg(F.col("total") / F.col("n")).alias("macro"))


def flicker(frames: DataFrame, clip: str, t: str, value: str) -> DataFrame:
    """(clip, score): (255 - mean absolute change between frames) / 255 of a numeric column."""
    change = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(clip).orderBy(t)))
    return frames.select(clip, change.alias("d")).groupBy(clip).agg(((255 - F.avg("d")) / 255).alias("score"))


def majority(frames: DataFrame, clip: str, t: str, bit: str, window: int, to: str = "voted") -> DataFrame:
    """The vote of window frames around each; at both ends the edge frame stands for those that are missing."""
    r = window // 2
    w = Window.partitionBy(clip).orderBy(t)
    whole = Window.partitionBy(clip).orderBy(t).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.sum(bit).over(w.rowsBetween(-r, r))
    at, n = F.row_number().over(w) - 1, F.count("*").over(Window.partitionBy(clip))
    left, right = F.greatest(r - at, F.lit(0)), F.greatest(at + r - (n - 1), F.lit(0))
    votes = near + left * F.first(bit).over(whole) + right * F.last(bit).over(whole)
    return frames.withColumn(to, F.when(votes * 2 > 2 * r + 1, 1).otherwise(0))


def smoothed(df: DataFrame, name: str, order: Sequence[str], value: str, k: int) -> DataFrame:
    """Adds median and mean of the last k values of each name."""
    w = Window.partitionBy(name).orderBy(*order).rowsBetween(-(k - 1), 0)
    return df.withColumns({"median": F.percentile(value, F.lit(0.5)).over(w), "mean": F.avg(value).over(w)})


def subsample_middle(df: DataFrame, clip: str, t: str, n: int) -> DataFrame:
    """(clip, k, t): the middle frame of each of n equal intervals; clips shorter than n repeat their last frame."""
    w = Window.partitionBy(clip).orderBy(t)
    placed = df.select(clip, t, (F.row_number().over(w) - 1).alias("at"), F.count("*").over(Window.partitionBy(clip)).alias("size"))
    sizes = placed.groupBy(clip).agg(F.first("size").alias("size"))
    wanted = sizes.select(clip, F.posexplode(middle_frames(F.col("size"), n)).alias("k", "at"))
    return wanted.join(placed.select(clip, F.col("at").cast("bigint").alias("at"), t), [clip, "at"]).select(clip, "k", t)


def clip_windows(frames: DataFrame, video: str, t: str, length: int) -> DataFrame:
    """(video, clip, t): frames cut into clips of length; a shorter tail begins earlier, to have the full length, and a
    video shorter than length stays whole."""
    placed = frames.select(video, t, (F.row_number().over(Window.partitionBy(video).orderBy(t)) - 1).alias("at"))
    sizes = placed.groupBy(video).agg(F.count("*").alias("size"))
    full = F.greatest(F.floor(F.col("size") / length), F.lit(1))
    tail = F.col("size") > full * length
    begins = sizes.select(video, F.posexplode(F.transform(F.sequence(F.lit(0), (full - 1 + tail.cast("int")).cast("int")), lambda k: F.greatest(F.least(k * length, F.col("size") - length), F.lit(0)))).alias("clip", "begin"))
    return placed.join(begins, video).where((F.col("at") >= F.col("begin")) & (F.col("at") < F.col("begin") + length)).select(video, "clip", t)


def segments(df: DataFrame, key: str, order: Sequence[str], cut: Column, to: str = "segment") -> DataFrame:
    """Numbers the runs of rows from one row that cut holds for to the next."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(to, F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def identity_share(frames: DataFrame, clip: str, t: str, emb: str, threshold: float = 0.4, least: int = 20) -> DataFrame:
    """(clip, share): frames as near to the first one as threshold; null for clips of fewer than least frames."""
    w = Window.partitionBy(clip).orderBy(t)
    near = frames.select(clip, (V.cosine(F.col(emb), F.first(emb).over(w)) >= threshold).alias("near"))
    return near.groupBy(clip).agg(F.count("*").alias("n"), F.count_if("near").alias("hits")).select(clip, F.when(F.col("n") >= least, F.col("hits") / F.col("n")).alias("share"))


def pairs_in_order(df: DataFrame, clip: str, t: str, value: str, wrap: bool = False) -> DataFrame:
    """(clip, t, a, b, wraps): each frame with the next; with wrap also (first, last) and (last, first)."""
    w = Window.partitionBy(clip).orderBy(t)
    steps = df.select(clip, t, F.col(value).alias("a"), F.lead(value).over(w).alias("b"), F.lead(t).over(w).alias("__n"), F.lit(False).alias("wraps")).where("__n is not null").drop("__n")
    if not wrap:
        return steps
    ends = df.groupBy(clip).agg(F.min_by(value, t).alias("f"), F.max_by(value, t).alias("l"), F.max(t).alias(t))
    turn = lambda a, b: ends.select(clip, t, F.col(a).alias("a"), F.col(b).alias("b"), F.lit(True).alias("wraps"))
    return steps.unionByName(turn("f", "l")).unionByName(turn("l", "f"))


def moves(pairs: DataFrame, clip: str, score: Column, threshold: float, frames: int = 16, share: int = 4) -> DataFrame:
    """(clip, moving): whether enough pairs score over threshold: share of every frames frames, of which a clip has one more
    than pairs, halves to even. Clips of one frame have no pair and no row."""
    found = pairs.groupBy(clip).agg(F.count("*").alias("n"), F.count_if(score > threshold).alias("hits"))
    return found.select(clip, (F.col("hits") >= F.bround(share * (F.col("n") + 1) / frames)).alias("moving"))


def prefix_success(answers: DataFrame, keys: Sequence[str], order: str, yes: str) -> DataFrame:
    """(keys, score): yes answers before the first no, as a share of all."""
    first_no = F.min(F.when(~F.col(yes), F.col("__at")))
    placed = answers.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return placed.groupBy(*keys).agg((F.coalesce(first_no, F.count("*")) / F.count("*")).alias("score"))


def gated(answers: DataFrame, keys: Sequence[str], order: str, yes: str) -> DataFrame:
    """(keys, score): null where the first answer is no, else 1 if all the others are yes and 0 if not."""
    w = Window.partitionBy(*keys).orderBy(order)
    placed = answers.withColumn("__at", F.row_number().over(w))
    gate = F.bool_or(F.when(F.col("__at") == 1, F.col(yes)))
    rest = F.coalesce(F.bool_and(F.when(F.col("__at") > 1, F.col(yes))), F.lit(True))
    return placed.groupBy(*keys).agg(F.when(gate, rest.cast("double")).alias("score"))


def top_fraction_mean(df: DataFrame, keys: Sequence[str], value: str, fraction: float) -> DataFrame:
    """(keys, score): mean of the largest int(n * fraction) values; null where that is none."""
    placed = running(df, keys, [F.desc(value)], {"__r": F.lit(1)})
    top = F.col("__r") <= F.floor(F.col("__r_all") * fraction)
    return placed.groupBy(*keys).agg(F.avg(F.when(top, F.col(value))).alias("score"))


def quantile_map(df: DataFrame, value: str) -> DataFrame:
    """(value, q): each value's rank / (n + 1)."""
    total = df.agg(F.count("*").alias("__n"))
    ranked = dense_number(df.select(value), [value], "rank")
    return ranked.crossJoin(F.broadcast(total)).select(value, (F.col("rank") / (F.col("__n") + 1)).alias("q"))


def inverse_map(source: DataFrame, value: str, target: DataFrame, target_value: str) -> DataFrame:
    """(value, q, mapped): the value of target at each source value's quantile, between target's values by a straight line.
    Values of source differ; the i-th of m sorted target values is the quantile i / m, and beyond the last is that one."""
    places = dense_number(target.select(F.col(target_value).alias("__v")), ["__v"], "__i", start=0)
    following = places.select((F.col("__i") - 1).alias("__i"), F.col("__v").alias("__next"))
    total = target.agg(F.count("*").alias("__m"))
    at = F.col("q") * F.col("__m")
    placed = quantile_map(source, value).crossJoin(F.broadcast(total))  # one row
    placed = placed.withColumn("__i", F.least(F.floor(at), F.col("__m") - 1))
    both = placed.join(places, "__i").join(following, "__i", "left")
    line = F.col("__v") + (at - F.col("__i")) * (F.coalesce("__next", "__v") - F.col("__v"))
    return both.select(value, "q", line.alias("mapped"))


def mapping_table(mapped: DataFrame, steps: int = 100) -> DataFrame:
    """(score, mapped): for scores 0, 1 / steps, 2 / steps and so on, what inverse_map gave the nearest quantile, ties to
    the smaller one."""
    total = mapped.agg(F.count("*").alias("__n"))
    scores = mapped.sparkSession.range(steps).select((F.col("id") / steps).alias("score")).crossJoin(F.broadcast(total))  # one row
    low = F.floor(F.col("score") * (F.col("__n") + 1))
    near = F.transform(F.array(low - 1, low, low + 1, low + 2), lambda r: F.least(F.greatest(r, F.lit(1)), F.col("__n")))
    wanted = scores.select("score", F.explode(F.array_distinct(near)).alias("__rank"))
    ranked = mapped.crossJoin(F.broadcast(total)).select(F.round(F.col("q") * (F.col("__n") + 1)).cast("bigint").alias("__rank"), "q", "mapped")
    gap = F.struct(F.abs(F.col("q") - F.col("score")), F.col("q"))
    return ranked.join(F.broadcast(wanted), "__rank").groupBy("score").agg(F.min_by("mapped", gap).alias("mapped"))


def run_lengths(df: DataFrame, key: str, order: str, bit: str) -> DataFrame:
    """(key, counts): lengths of alternating runs of a 0/1 column; the first run is of zeros, perhaps of none."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(bit).over(w) != F.col(bit)).cast("int"), F.lit(0))
    marked = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy(key, "__run").agg(F.first(bit).alias("bit"), F.count("*").alias("n"))
    lists = runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__run", "bit", "n"))).alias("r"))
    counts = F.transform("r", lambda x: x["n"])
    return lists.select(key, F.when(F.get("r", 0)["bit"] == 1, F.concat(F.array(F.lit(0).cast("bigint")), counts)).otherwise(counts).alias("counts"))
