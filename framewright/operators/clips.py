"""Clips and their frames: which frames to take, how the camera moves, which files belong together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the movement of two opposite edges says about the camera.
VERTICAL = {
    "left_left": "pan_right", "right_right": "pan_left", "down_down": "tilt_up", "up_up": "tilt_down",
    "up_down": "zoom_in", "down_up": "zoom_out", "static_static": "static",
}
HORIZONTAL = {
    "left_left": "pan_right", "right_right": "pan_left", "down_down": "tilt_up", "up_up": "tilt_down",
    "left_right": "zoom_in", "right_left": "zoom_out", "static_static": "static",
}

# What prompts call the movements.
CAMERA_PHRASES = {
    "camera pans left": "pan_left", "camera pans right": "pan_right", "camera tilts up": "tilt_up",
    "camera tilts down": "tilt_down", "camera zooms in": "zoom_in", "camera zooms out": "zoom_out",
    "camera static": "static",
}


def _interval(frames: Column, taken: Column, k: Column) -> Column:
    """Where the k-th of taken equal intervals begins; the one after the last begins at the end."""
    return F.when(k >= taken, frames).otherwise(F.floor(k * (frames / taken))).cast("bigint")


def _padded(found: Column, n: int) -> Column:
    """The list, its last value repeated up to n values."""
    return F.concat(found, F.array_repeat(F.element_at(found, -1), F.greatest(F.lit(0), n - F.size(found)).cast("int")))


def middle_frames(frames: Column, n: int) -> Column:
    """The middle frame of each of n equal intervals of a clip of frames, its last one repeated where frames are fewer."""
    taken = F.least(F.lit(n).cast("bigint"), frames.cast("bigint"))
    each = F.sequence(F.lit(0).cast("bigint"), taken - 1)
    middle = lambda k: F.floor((_interval(frames, taken, k) + _interval(frames, taken, k + 1) - 1) / 2).cast("bigint")
    return F.when(frames > 0, _padded(F.transform(each, middle), n))


def fixed_frames(frames: Column, n: int, after: int = 0) -> Column:
    """The frame that lies after frames past the begin of each of n equal intervals, padded like middle_frames."""
    taken = F.least(F.lit(n).cast("bigint"), frames.cast("bigint"))
    each = F.sequence(F.lit(0).cast("bigint"), taken - 1)
    return F.when(frames > 0, _padded(F.transform(each, lambda k: _interval(frames, taken, k) + after), n))


def frames_at_rate(frames: Column, rate: float, wanted: float, most: int | None = None) -> Column:
    """Frames of a clip of rate frames a second that lie in the middle of steps of 1 / wanted seconds, halves rounded to
    even; at most most of them."""
    gap = 1 / wanted
    last = F.ceil(((frames / rate + gap / 2) - gap / 2) / gap).cast("bigint") - 1
    steps = F.when(last < 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0))))
    found = F.filter(F.transform(steps, lambda i: F.bround((gap / 2 + i * gap) * rate).cast("bigint")), lambda f: f < frames)
    return F.slice(found, 1, most) if most else found


def every_frame(frames: Column, k: int) -> Column:
    """Frames 0, k, 2 k and so on."""
    return F.when(frames > 0, F.sequence(F.lit(0).cast("bigint"), frames.cast("bigint") - 1, F.lit(k).cast("bigint")))


def even_frames(frames: Column, n: int) -> Column:
    """n frames at equal steps from the first to the last one, cut to whole numbers."""
    last = frames.cast("bigint") - 1
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    at = lambda i: F.when(i == n - 1, last).otherwise(F.floor(i * (last / max(1, n - 1)))).cast("bigint")
    return F.when(frames > 0, F.transform(steps, at) if n > 1 else F.array(F.lit(0).cast("bigint")))


def edge_directions(tracks: DataFrame, video: str, edge: str, point: str, t: str, still: Column | float) -> DataFrame:
    """(video, edge, ways): where the points (x, y) of an edge go from their first frame to their last on average: left
    or right, up or down, or static where neither is by more than still."""
    ends = tracks.groupBy(video, edge, point).agg(
        (F.max_by("x", t) - F.min_by("x", t)).alias("__dx"), (F.max_by("y", t) - F.min_by("y", t)).alias("__dy")
    )
    mean = ends.groupBy(video, edge).agg(F.avg("__dx").alias("__dx"), F.avg("__dy").alias("__dy"))
    far = still if isinstance(still, Column) else F.lit(float(still))
    side = F.when(F.col("__dx") > far, "right").when(F.col("__dx") < -far, "left")
    height = F.when(F.col("__dy") > far, "down").when(F.col("__dy") < -far, "up")
    ways = F.array_compact(F.array(side, height))
    return mean.select(video, edge, F.when(F.size(ways) == 0, F.array(F.lit("static"))).otherwise(ways).alias("ways"))


def _read(first: Column, second: Column, meaning: Mapping[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in meaning.items() for x in pair])
    both = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.concat_ws("_", a, b))))
    known = F.array_compact(F.transform(both, lambda c: F.try_element_at(table, c)))
    return F.when(F.size(known) == 0, F.array(F.lit("None"))).otherwise(known)


def camera_labels(directions: DataFrame, video: str, edge: str = "edge", ways: str = "ways") -> DataFrame:
    """(video, labels): the camera's movements, sorted, from the ways of the edges top, down, left and right. static goes
    beside another label, then None does; videos without one of the edges are left out."""
    sides = ("top", "down", "left", "right")
    row = directions.groupBy(video).agg(*[F.max(F.when(F.col(edge) == s, F.col(ways))).alias(f"__{s}") for s in sides])
    row = row.dropna(subset=[f"__{s}" for s in sides])
    found = F.concat(_read(F.col("__top"), F.col("__down"), VERTICAL), _read(F.col("__left"), F.col("__right"), HORIZONTAL))
    row = row.select(video, F.array_sort(F.array_distinct(found)).alias("labels"))
    for name in ("static", "None"):
        row = row.withColumn("labels", F.when(F.size("labels") > 1, F.array_remove("labels", name)).otherwise(F.col("labels")))
    return row


def camera_type(name: Column, strict: bool = True) -> Column:
    """The movement that a prompt names first in the order of CAMERA_PHRASES; with strict a name without one is an error."""
    found = F.coalesce(*[F.when(F.contains(name, F.lit(k)), v) for k, v in CAMERA_PHRASES.items()])
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no camera movement in: "), F.coalesce(name, F.lit("null")))).cast("string"))


def clip_duration(videos: DataFrame, path: str, prompts: DataFrame, prompt: str, dimensions: str, lengths: Mapping[str, float]) -> DataFrame:
    """videos with duration: the greatest length of the dimensions of the prompt that the file is named after
    (prompt-number.mp4). Null where the name has no number, no prompt fits or none of its dimensions has a length."""
    known = F.create_map(*[F.lit(x) for k, v in lengths.items() for x in (k, float(v))])
    longest = F.array_max(F.transform(dimensions, lambda d: F.try_element_at(known, d)))
    each = prompts.select(F.col(prompt).alias("__prompt"), longest.alias("__long"))
    each = each.groupBy("__prompt").agg(F.max("__long").alias("duration"))
    file = F.element_at(F.split(path, "/"), -1)
    named = videos.withColumn("__prompt", F.nullif(F.regexp_extract(file, r"^(.*?)-\d+\.mp4$", 1), F.lit("")))
    return named.join(each, "__prompt", "left").drop("__prompt")


def paired(pred: DataFrame, truth: DataFrame, name: str, pred_end: str, truth_end: str, value: str) -> DataFrame:
    """(name, pred, truth): files of equal names but for their ends; unreadable ones (null values) go with their pair."""

    def side(df: DataFrame, end: str, to: str) -> DataFrame:
        stem = F.when(F.endswith(F.col(name), F.lit(end)), F.left(F.col(name), F.length(name) - len(end)))
        return df.select(stem.alias("name"), F.col(value).alias(to)).where(F.col("name").isNotNull() & F.col(to).isNotNull())

    return side(pred, pred_end, "pred").join(side(truth, truth_end, "truth"), "name")


def common_frames(pred: DataFrame, truth: DataFrame, clip: str, t: str) -> tuple[DataFrame, DataFrame]:
    """Both sides' frames of clips that both have, cut to the number of frames of the shortest clip of either side. t
    counts frames from 0."""
    sizes = pred.groupBy(clip).agg(F.count("*").alias("__p")).join(truth.groupBy(clip).agg(F.count("*").alias("__t")), clip)
    least = sizes.agg(F.min(F.least("__p", "__t")).alias("__least"))
    both = sizes.select(clip).crossJoin(F.broadcast(least))  # one row
    cut = lambda df: df.join(both, clip).where(F.col(t) < F.col("__least")).drop("__least")
    return cut(pred), cut(truth)


def part_file(pattern: Column | str, part: Column, end: str = ".single.csv") -> Column:
    """The file of a part: * in the pattern's last component becomes the part in three digits, .csv becomes end. An error
    where there is no *."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    name = F.element_at(F.split(pattern, "/"), -1)
    filled = F.replace(name, F.lit("*"), F.lpad(part.cast("string"), F.greatest(F.lit(3), F.length(part.cast("string"))), "0"))
    named = F.concat(F.regexp_replace(filled, r"\.csv$", ""), F.lit(end))
    return F.when(F.contains(name, F.lit("*")), named).otherwise(F.raise_error(F.concat(F.lit("no * in "), name)).cast("string"))


def probed(clips: DataFrame, cache: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """clips with the values of the cache and cached; clips that it doesn't have keep nulls and cached is false."""
    kept = cache.select(key, *values, F.lit(True).alias("__has")).dropDuplicates([key])
    return clips.join(kept, key, "left").withColumn("cached", F.coalesce("__has", F.lit(False))).drop("__has")


def run_name(day: Column, steps: Column, suffix: Column, resumed: Column | None = None) -> Column:
    """MMDD_s<steps>_<suffix>: signs of the suffix other than letters, digits, -, _ and . become _, an empty one goes with
    its sign before it; a run that is resumed keeps its name."""
    clean = F.regexp_replace(F.trim(F.coalesce(suffix, F.lit(""))), r"[^\p{L}\p{N}\-_.]", "_")
    base = F.concat(F.date_format(day, "MMdd"), F.lit("_s"), steps.cast("string"))
    name = F.when(clean == "", base).otherwise(F.concat_ws("_", base, clean))
    return name if resumed is None else F.coalesce(F.nullif(resumed, F.lit("")), name)
