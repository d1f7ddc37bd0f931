"""Rates, blends and means of results, rules on sequences, and per-pixel work on mask rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def success_where_seen(frames: DataFrame, key: str, seen: Column, right: Column) -> DataFrame:
    """(key, rate): the share of right frames among those that show the object; keys that never show it are left out."""
    n = F.count_if(seen)
    return frames.groupBy(key).agg(n.alias("__n"), (F.count_if(seen & right) / n).alias("rate")).where("__n > 0").drop("__n")


def means_with_total(df: DataFrame, label: str, value: str, total: str = "total") -> DataFrame:
    """(label, mean, n): one row for each label and one named total over all rows; labels without a value have a null mean."""
    v = F.col(value)
    both = df.select(F.explode(F.array(F.col(label).cast("string"), F.lit(total))).alias(label), v.alias("__v"))
    return both.groupBy(label).agg(F.avg("__v").alias("mean"), F.count("__v").alias("n"))


def macro_accuracy(df: DataFrame, group: str, right: Column, merged: Mapping[str, str] | None = None) -> DataFrame:
    """(group, accuracy, macro): accuracy by group, groups named in merged counting as another, and the mean over groups."""
    name = F.col(group)
    for old, new in (merged or {}).items():
        name = F.when(F.col(group) == old, new).otherwise(name)
    each = df.groupBy(name.alias(group)).agg(F.avg(right.cast("double")).alias("accuracy"))
    return each.crossJoin(F.broadcast(each.agg(F.avg("accuracy").alias("macro"))))


def blend(df: DataFrame, key: str, name: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """(key, score): the weighted mean of a key's mean values by name; null where one of the names is missing."""
    parts = [F.avg(F.when(F.col(name) == k, F.col(value))) * w for k, w in weights.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.groupBy(key).agg((total / sum(weights.values())).alias("score"))


def static_clips(pairs: DataFrame, key: str, score: str, wraps: Column, side: Column) -> DataFrame:
    """(key, static): few neighbouring frames differ, and the last and first frames hardly do.

    side is the shorter side of a clip's frames. A score counts as motion above 3 / 256 of it; as many pairs may move as
    an eighth of the frames, halves to even, and the two pairs that wrap around may differ by twice that many thresholds.
    pairs has a row for each frame but the last, and the two that wrap.
    """
    rows = pairs.select(F.col(key), F.col(score).alias("__s"), wraps.alias("__w"), (side * 3 / 256).alias("__t"))
    moving = F.count_if(~F.col("__w") & (F.col("__s") > F.col("__t")))
    found = rows.groupBy(key).agg(
        moving.alias("__m"), F.bround((F.count("*") - 1) / 8).alias("__k"), F.max(F.when(F.col("__w"), F.col("__s"))).alias("__last"), F.max("__t").alias("__t")
    )
    near = F.coalesce(F.col("__last") <= F.col("__t") * F.col("__k") * 2, F.lit(True))
    return found.select(key, ((F.col("__m") <= F.col("__k")) & near).alias("static"))


def image_iou(pixels: DataFrame, image: str, classes: Sequence[str], truth: str, predicted: str, ignored: str | None = None) -> DataFrame:
    """(class, iou): the mean over images of each class's IoU; 1 where neither side has the class. Pixels whose truth is
    ignored don't count."""
    rows = pixels if ignored is None else pixels.where(~F.col(truth).eqNullSafe(F.lit(ignored)))
    one = rows.select(image, truth, predicted, F.explode(F.array(*map(F.lit, classes))).alias("class"))
    t, p = F.col(truth).eqNullSafe(F.col("class")), F.col(predicted).eqNullSafe(F.col("class"))
    each = one.groupBy("class", image).agg(F.coalesce(F.try_divide(F.count_if(t & p), F.count_if(t | p)), F.lit(1.0)).alias("iou"))
    return each.groupBy("class").agg(F.avg("iou").alias("iou"))


def odd_frame_error(frames: DataFrame, key: str, at: str, value: Column, guess: Column) -> DataFrame:
    """(key, error): the mean difference of odd frames from what was interpolated for them."""
    return frames.where(F.col(at) % 2 == 1).groupBy(key).agg(F.avg(F.abs(value - guess)).alias("error"))


def first_frames(frames: DataFrame, video: str, clip: str, at: str) -> DataFrame:
    """The first frame of each clip, in the order of clips as place (from 0); videos of one clip are left out."""
    firsts = frames.withColumn("__r", F.row_number().over(Window.partitionBy(video, clip).orderBy(at))).where("__r = 1").drop("__r")
    whole = Window.partitionBy(video)
    return firsts.withColumns({"__n": F.count("*").over(whole), "place": F.row_number().over(whole.orderBy(clip)) - 1}).where("__n > 1").drop("__n")


def remaining(steps: DataFrame, key: str, at: str, seconds: str, planned: int, last: int = 1000) -> DataFrame:
    """(key, eta): the median time of the last steps, times those that are left of planned ones."""
    recent = steps.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where(F.col("__r") <= last)
    return recent.groupBy(key).agg((F.median(seconds) * (planned - F.max(at))).alias("eta"))


def shares(df: DataFrame, key: str, size: str) -> DataFrame:
    """(key, total, modules, share): sizes by key, and their part of all."""
    each = df.groupBy(key).agg(F.sum(size).alias("total"), F.count("*").alias("modules"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("total").alias("__all")))).withColumn("share", F.col("total") / F.greatest("__all", F.lit(1))).drop("__all")


def merged_patches(pixels: DataFrame, at: Sequence[str], value: str) -> DataFrame:
    """(at, mean, least): overlapping patches become one value for each place."""
    return pixels.groupBy(*at).agg((F.sum(value) / F.greatest(F.count(value), F.lit(1))).alias("mean"), F.min(value).alias("least"))


def neighbourhood(pixels: DataFrame, keys: Sequence[str], x: str, y: str, value: str, reach: int = 1, grow: bool = True) -> DataFrame:
    """pixels with the greatest (grow) or least value of the square around each; places without a pixel don't count.

    Each pixel is sent to the places around it, (2 reach + 1) squared of them, and one aggregation by place follows.
    """
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-reach, reach + 1) for dy in range(-reach, reach + 1)])
    sent = pixels.select(*keys, x, y, value, F.explode(steps).alias("s"))
    sent = sent.select(*keys, (F.col(x) + F.col("s.dx")).alias(x), (F.col(y) + F.col("s.dy")).alias(y), F.col(value), (F.col("s.dx").eqNullSafe(F.lit(0)) & F.col("s.dy").eqNullSafe(F.lit(0))).alias("own"))
    best = F.max(value) if grow else F.min(value)
    return sent.groupBy(*keys, x, y).agg(best.alias(value), F.bool_or("own").alias("own")).where("own").drop("own")


def grey_of_median(pixels: DataFrame, keys: Sequence[str], red: str, green: str, blue: str) -> DataFrame:
    """(keys, luma): the luma (0.299, 0.587, 0.114) of the median of each channel."""
    m = F.median
    return pixels.groupBy(*keys).agg((m(red) * 0.299 + m(green) * 0.587 + m(blue) * 0.114).alias("luma"))


def tight_boxes(pixels: DataFrame, keys: Sequence[str], x: str, y: str, hit: Column) -> DataFrame:
    """(keys, x0, y0, x1, y1) around the set pixels, ends excluded; keys without one are left out."""
    return pixels.where(hit).groupBy(*keys).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) + 1).alias("x1"), (F.max(y) + 1).alias("y1"))


def two_names(name: Column, word: str = " and ") -> Column:
    """struct(first, second) of 'a and b'; second is null where there is one name."""
    parts = F.split(name, word)
    return F.struct(F.get(parts, 0).alias("first"), F.get(parts, 1).alias("second"))


def present_scores(scores: Column) -> Column:
    """A map without the keys that have no value."""
    return F.map_filter(scores, lambda k, v: v.isNotNull())


def outside(path: Column, prefixes: Sequence[str]) -> Column:
    """True for paths under none of the prefixes."""
    found = F.lit(False)
    for p in prefixes:
        found = found | path.startswith(p)
    return ~F.coalesce(found, F.lit(False))


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """df with the fields of nested structs as columns of their own, named by their path."""

    def walk(kind, path: list[str]):
        for f in kind.fields:
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(separator.join(path)) for path in walk(df.schema, [])])


def or_error(value: Column, message: Column | str = "not readable") -> Column:
    """struct(value, status, error): a value that came out null is a row of status error instead of a failed job."""
    said = F.lit(message) if isinstance(message, str) else message
    bad = value.isNull()
    return F.struct(value.alias("value"), F.when(bad, "error").otherwise("ok").alias("status"), F.when(bad, said).alias("error"))
