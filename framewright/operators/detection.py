"""Boxes of images: matching, suppression, precision and recall, confusion matrices.

Boxes are struct(x0, y0, x1, y1). The boxes of one image are few, so that per-image work may be done in one group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, box, iou
from .groups import bounds, map_groups
from .ranges import latest_max, running

#: Pairs of boxes that a task compares at once.
PAIRS = 100_000


def iou_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], id_: str, box_: str = "box", overlapping: bool = False, pixel: float = 0.0) -> DataFrame:
    """(keys, l, r, iou) of all boxes of left and right with equal keys; overlapping leaves disjoint ones out. pixel is 1
    where corners name pixels, so that a box holds its last ones too."""
    l = left.select(*keys, F.col(id_).alias("l"), F.col(box_).alias("__l"))  # noqa: E741
    r = right.select(*keys, F.col(id_).alias("r"), F.col(box_).alias("__r"))
    both = l.join(r, list(keys))
    if overlapping:
        both = both.where("__l.x0 < __r.x1 and __r.x0 < __l.x1 and __l.y0 < __r.y1 and __r.y0 < __l.y1")
    whole = lambda b: Box(b.x0, b.y0, b.x1 + pixel, b.y1 + pixel) if pixel else b
    return both.select(*keys, "l", "r", iou(whole(box("__l")), whole(box("__r"))).alias("iou"))


def assign(pairs: DataFrame, keys: Sequence[str], low: float, high: float, rescue: bool = True) -> DataFrame:
    """(keys, l, r, iou, label): the best r of each l. label is 1 from high on, 0 below low, else -1. With rescue each r
    also gives 1 to those l that overlap it most, ties included, if they overlap at all."""
    best = pairs.groupBy(*keys, "l").agg(F.max_by(F.struct("r", "iou"), F.struct("iou", -F.col("r"))).alias("b")).select(*keys, "l", "b.r", "b.iou")
    label = F.when(F.col("iou") >= high, 1).when(F.col("iou") < low, 0).otherwise(-1)
    out = best.withColumn("label", label)
    if not rescue:
        return out
    most = F.max("iou").over(Window.partitionBy(*keys, "r"))
    saved = pairs.withColumn("__most", most).where((F.col("iou") == F.col("__most")) & (F.col("iou") > 0)).select(*keys, "l").distinct().withColumn("__saved", F.lit(True))
    return out.join(saved, [*keys, "l"], "left").withColumn("label", F.when(F.col("__saved"), 1).otherwise(F.col("label"))).drop("__saved")


def match_levels(det: DataFrame, truth: DataFrame, keys: Sequence[str], thresholds: Sequence[float], order: Sequence[Column], strict: bool = True, pixel: float = 1.0) -> DataFrame:
    """det with threshold, tp and fp, once for each threshold: each detection goes to its best object; in order, the first
    to claim an object that it overlaps by more than the threshold (not strict: or by just that) is right, later ones are
    wrong, and objects marked difficult count neither way.

    det and truth have keys, id and box, truth also difficult; for pixel see iou_pairs. The best object depends on neither
    claims nor thresholds, so that overlaps are found once. Whoever comes first at a threshold is told by the greatest
    overlap before it on the same object, so that rows are shuffled once and repeated only after that.
    """
    best = F.max_by(F.struct("r", "iou"), F.struct("iou", -F.col("r"))).alias("b")
    pairs = iou_pairs(det, truth, keys, "id", pixel=pixel).groupBy(*keys, "l").agg(best)
    pairs = pairs.select(*keys, F.col("l").alias("id"), F.col("b.r").alias("object"), F.col("b.iou").alias("iou"))
    objects = truth.select(*keys, F.col("id").alias("object"), "difficult")
    found = det.join(pairs, [*keys, "id"], "left").join(objects, [*keys, "object"], "left")
    before = F.max("iou").over(Window.partitionBy(*keys, "object").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("__before", before).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    over = lambda c: F.coalesce(F.col(c) > F.col("threshold") if strict else F.col(c) >= F.col("threshold"), F.lit(False))
    near, taken = over("iou"), over("__before")
    easy = ~F.coalesce(F.col("difficult"), F.lit(False))
    right, wrong = near & easy & ~taken, ~near | easy & taken
    return found.withColumns({"tp": right.cast("int"), "fp": wrong.cast("int")}).drop("__before", "difficult")


def match_greedy(det: DataFrame, truth: DataFrame, keys: Sequence[str], threshold: float, order: Sequence[Column], strict: bool = True, pixel: float = 1.0) -> DataFrame:
    """match_levels at one threshold."""
    return match_levels(det, truth, keys, [threshold], order, strict, pixel).drop("threshold")


def precision_recall(matched: DataFrame, keys: Sequence[str], order: Sequence[Column], positives: Column) -> DataFrame:
    """Adds recall, precision and envelope: the best precision at this recall or a higher one. keys may be few."""
    curve = running(matched, keys, order, {"__tp": F.col("tp"), "__fp": F.col("fp"), "__row": F.lit(1)})
    tp, fp = F.col("__tp"), F.col("__fp")
    step = {
        "recall": F.try_divide(tp, positives),
        "precision": F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)),
        "__before": F.when(F.col("__row") == 1, -1.0).otherwise(F.try_divide(tp - F.col("tp"), positives)),
    }
    return latest_max(curve.withColumns(step), keys, "precision", "envelope")


def average_precision(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ap): the area under the envelope over all recall steps."""
    step = F.col("recall") - F.greatest(F.col("__before"), F.lit(0.0))
    return curve.groupBy(*keys).agg(F.sum(step * F.col("envelope")).alias("ap"))


def interpolated_precision(curve: DataFrame, keys: Sequence[str], points: int = 101) -> DataFrame:
    """(keys, ap): mean of the envelope at equally spaced recalls (101 or 11, as a rule); 0 where none is reached."""
    levels = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i / (points - 1))
    # The envelope falls, so each row answers for the levels between the recall before it and its own.
    mine = F.size(F.filter(levels, lambda x: (x > F.col("__before")) & (x <= F.col("recall"))))
    return curve.groupBy(*keys).agg((F.sum(mine * F.col("envelope")) / points).alias("ap"))


def recall_at(best: DataFrame, positives: Column, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, recall) from the best overlap of each object; the average recall is their mean."""
    rows = best.select("iou", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return rows.groupBy("threshold").agg(F.try_divide(F.count_if(F.col("iou") >= F.col("threshold")), positives).alias("recall"))


def _iou_matrix(b: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlaps of others with b, a box or as many as others."""
    w = np.minimum(b[..., 2], others[:, 2]) - np.maximum(b[..., 0], others[:, 0])
    h = np.minimum(b[..., 3], others[:, 3]) - np.maximum(b[..., 1], others[:, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda x: (x[..., 2] - x[..., 0]) * (x[..., 3] - x[..., 1])
    union = area(b) + area(others) - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _kept(boxes: np.ndarray, at: np.ndarray, overlap, hit) -> np.ndarray:
    """For each row the place of the row that stays for it: its own, or that of the first one before it in its group that
    stays itself and whose overlap with it is a hit. The rows of many groups are compared at once, PAIRS at a time; rows
    that have gone by then are not compared."""
    of = np.full(len(boxes), -1)
    after = np.repeat(at[1:], np.diff(at)) - np.arange(len(boxes)) - 1
    total, begin = np.append(0, np.cumsum(after)), 0
    while begin < len(boxes):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
        own = begin + np.flatnonzero(of[begin:end] < 0)
        n = after[own]
        i = np.repeat(own, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        open_ = of[j] < 0
        i, j = i[open_], j[open_]
        near = hit(overlap(boxes[i], boxes[j]))
        for first, second in zip(i[near].tolist(), j[near].tolist()):
            if of[first] < 0 and of[second] < 0:
                of[second] = first
        begin = end
    return np.where(of < 0, np.arange(len(boxes)), of)


def suppress(df: DataFrame, keys: Sequence[str], id_: str, threshold: float, score: str = "score", box_: str = "box", overlap=_iou_matrix) -> DataFrame:
    """(keys, id) of boxes that non-maximum suppression keeps within each key, e.g. image and class.

    Highest score first, ties to the smaller id; a box that overlaps a kept one by more than threshold goes.
    """
    rows = df.select(*keys, F.col(id_).alias("id"), F.col(score).cast("double").alias("s"), F.col(f"{box_}.x0").alias("x0"), F.col(f"{box_}.y0").alias("y0"), F.col(f"{box_}.x1").alias("x1"), F.col(f"{box_}.y1").alias("y1"), *([F.col(f"{box_}.angle").alias("angle")] if "angle" in str(df.schema[box_].dataType.simpleString()) else []))
    corners = [c for c in ("x0", "y0", "x1", "y1", "angle") if c in rows.columns]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, "id"])

    def keep(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        of = _kept(pdf[corners].to_numpy(float), at, overlap, lambda v: ~(v <= threshold))
        return pdf.loc[of == np.arange(len(of)), [*keys, "id"]]

    return map_groups(rows, keys, [F.desc("s"), "id"], keep, schema)


def suppress_clusters(df: DataFrame, keys: Sequence[str], id_: str, threshold: float, score: str = "score", box_: str = "box") -> DataFrame:
    """(keys, id, kept): every box with the id of the box that stays for it: its own, or that of the first box kept that it
    overlaps by more than threshold. See suppress for the order."""
    rows = df.select(*keys, F.col(id_).alias("id"), F.col(score).cast("double").alias("s"), *[F.col(f"{box_}.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def cluster(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        of = _kept(pdf[["x0", "y0", "x1", "y1"]].to_numpy(float), at, _iou_matrix, lambda v: v > threshold)
        return pdf[[*keys, "id"]].assign(kept=pdf["id"].to_numpy()[of])

    return map_groups(rows, keys, [F.desc("s"), "id"], cluster, ", ".join(f"`{k}` {kind(k)}" for k in keys) + f", id {kind('id')}, kept {kind('id')}")


def final_detections(df: DataFrame, image: str, label: str, id_: str, least_score: float, threshold: float, top: int, width: float, height: float) -> DataFrame:
    """What a detector reports of an image: scores above least_score, boxes clipped to the image, suppressed within their
    class, and of all classes the top by score. Boxes and scores that aren't finite go."""
    from ..functions.geometry import clip
    from .sequences import first_n

    b = box("box")
    finite = F.coalesce(F.abs(b.x0 + b.y0 + b.x1 + b.y1 + F.col("score")) < float("inf"), F.lit(False))
    sure = df.where(finite & (F.col("score") > least_score)).withColumn("box", clip(b, F.lit(width), F.lit(height)).struct())
    kept = suppress(sure, [image, label], id_, threshold).withColumnRenamed("id", id_)
    return first_n(sure.join(kept, [image, label, id_], "left_semi"), [image], [F.desc("score"), id_], top)


def rescaled(df: DataFrame, width: Column, height: Column, to_width: Column, to_height: Column, points: str | None = None) -> DataFrame:
    """Detections of an image of one size as those of the same image in another: boxes scaled and clipped, empty ones
    left out, and the places of keypoints, an array of structs with x and y, scaled."""
    from ..functions.geometry import clip, nonempty, scale

    sx, sy = to_width / width, to_height / height
    out = df.withColumn("box", clip(scale(box("box"), sx, sy), to_width.cast("double"), to_height.cast("double")).struct()).where(nonempty(box("box")))
    if points is None:
        return out
    return out.withColumn(points, F.transform(points, lambda p: p.withField("x", p["x"] * sx).withField("y", p["y"] * sy)))


def ensemble_detections(outputs: DataFrame, image: str, label: str, id_: str, width: float, height: float, threshold: float, top: int, least_score: float = 1e-8) -> tuple[DataFrame, DataFrame]:
    """Detections of several views of an image as one: flipped ones are mirrored back, all are suppressed together, and each
    of the top that stays has its score and box, the number of boxes that it stands for and their mean box.

    outputs: image, view, flipped, label, id (of its own in the image), score, box. Also returns (image, label, id, kept),
    the box that stays for each box, by which mean_masks and other fields of a cluster are gathered.
    """
    b = box("box")
    back = F.when(F.col("flipped"), Box(width - b.x1, b.y0, width - b.x0, b.y1).struct()).otherwise(b.struct())
    union = outputs.withColumn("box", back).where(F.col("score") > least_score)
    clusters = suppress_clusters(union, [image, label], id_, threshold).withColumnRenamed("id", id_)
    sides, limits = ("x0", "y0", "x1", "y1"), np.array([width, height] * 2, float)
    rows = union.select(image, label, F.col(id_).alias("id"), "score", F.col("score").cast("double").alias("s"), *[F.col(f"box.{c}").cast("double").alias(c) for c in sides])
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = ", ".join(f"`{c}` {kind(c)}" for c in (image, label, "id", "score")) + ", members bigint, " + ", ".join(f"{c} double, mean_{c} double" for c in sides)

    def merge(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        """All boxes choose whom they stand for; of the finite ones, cut to the image, some stay, and the top of those."""
        corners, own = pdf[list(sides)].to_numpy(float), np.arange(len(pdf))
        classes = bounds(pdf, [image, label])
        of = _kept(corners, classes, _iou_matrix, lambda v: v > threshold)
        sure = np.flatnonzero(np.isfinite(corners.sum(1) + pdf["s"].to_numpy(float)))
        cut = np.minimum(np.maximum(corners, 0.0), limits)
        stays = sure[_kept(cut[sure], np.searchsorted(sure, classes), _iou_matrix, lambda v: ~(v <= threshold)) == np.arange(len(sure))]
        best = pdf.iloc[stays].assign(__group=np.repeat(np.arange(len(at) - 1), np.diff(at))[stays], __own=stays).sort_values(["__group", "s", "id"], ascending=[True, False, True])
        best = best[best.groupby("__group").cumcount() < top]
        kept = best["__own"].to_numpy()
        best, kept = best[of[kept] == kept], kept[of[kept] == kept]
        members = np.bincount(of, minlength=len(own))
        means = {f"mean_{c}": np.bincount(of, corners[:, k], len(own))[kept] / members[kept] for k, c in enumerate(sides)}
        return best[[image, label, "id", "score"]].assign(members=members[kept], **{c: cut[kept, k] for k, c in enumerate(sides)}, **means)

    found = map_groups(rows.where(F.col(label).isNotNull()), [image], [label, F.desc("s"), "id"], merge, schema)
    corner = lambda before, to: F.struct(*[F.col(before + c).alias(c) for c in sides]).alias(to)
    return found.select(image, label, F.col("id").alias(id_), "score", corner("", "box"), "members", corner("mean_", "mean_box")), clusters


def mean_masks(cells: DataFrame, keys: Sequence[str], x: str, y: str, value: str, size: int, flipped: Column) -> DataFrame:
    """(keys, x, y, value): the mean over views of an object's mask, a square of size cells; flipped ones are mirrored back."""
    at = F.when(flipped, size - 1 - F.col(x)).otherwise(F.col(x))
    return cells.withColumn(x, at).groupBy(*keys, x, y).agg(F.avg(value).alias(value))


def _clip_polygons(subjects: np.ndarray, clippers: np.ndarray) -> np.ndarray:
    """The parts of convex polygons (n, corners, 2) inside others; all run counter-clockwise. What has fewer corners than
    the widest one repeats its last, and an empty part is all zeros."""
    for k in range(clippers.shape[1]):
        a, b = clippers[:, k, None], clippers[:, (k + 1) % clippers.shape[1], None]
        side = (b[..., 0] - a[..., 0]) * (subjects[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (subjects[..., 0] - a[..., 0])
        ahead, to = np.roll(subjects, -1, axis=1), np.roll(side, -1, axis=1)
        crosses = side * to < 0
        share = side / np.where(crosses, side - to, 1)
        points = np.stack([subjects, subjects + (ahead - subjects) * share[..., None]], 2).reshape(len(subjects), 2 * side.shape[1], 2)
        valid = np.stack([side >= 0, crosses], 2).reshape(len(subjects), 2 * side.shape[1])
        n = valid.sum(1)
        order = np.argsort(~valid, axis=1, kind="stable")
        place = np.minimum(np.arange(max(1, n.max(initial=0))), np.maximum(n - 1, 0)[:, None])
        subjects = np.take_along_axis(points, np.take_along_axis(order, place, 1)[..., None], 1)
        subjects[n == 0] = 0
    return subjects


def _corners(b: np.ndarray) -> np.ndarray:
    """(n, 4, 2) corners of n boxes."""
    t = np.radians(b[:, 4, None])
    x, y = np.array([-1, 1, 1, -1]) * b[:, 2, None] / 2, np.array([-1, -1, 1, 1]) * b[:, 3, None] / 2
    return np.stack([b[:, 0, None] + x * np.cos(t) - y * np.sin(t), b[:, 1, None] + x * np.sin(t) + y * np.cos(t)], 2)


def rotated_iou(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlaps of boxes (centre x, centre y, width, height, degrees) with a, a box or as many as others, by polygon
    clipping of those whose circles meet."""
    others = np.asarray(others, float)
    a = np.broadcast_to(np.asarray(a, float), others.shape)
    apart = np.hypot(a[:, 0] - others[:, 0], a[:, 1] - others[:, 1]) > (np.hypot(a[:, 2], a[:, 3]) + np.hypot(others[:, 2], others[:, 3])) / 2 * (1 + 1e-9)
    out, meet = np.zeros(len(others)), ~apart
    p, a, b = _clip_polygons(_corners(a[meet]), _corners(others[meet])), a[meet], others[meet]
    p = p - p[:, :1]
    ahead = np.roll(p, -1, axis=1)
    both = np.abs((p[..., 0] * ahead[..., 1] - p[..., 1] * ahead[..., 0]).sum(1)) / 2
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - both
    out[meet] = np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)
    return out


def propose(df: DataFrame, image: str, level: str, id_: str, before: int, threshold: float, after: int, width: float, height: float, least: float = 0.0) -> DataFrame:
    """Best boxes of each level, clipped, without small ones, suppressed by level, and the best of each image."""
    from ..functions.geometry import clip, nonempty
    from .sequences import first_n

    top = first_n(df, [image, level], [F.desc("score"), id_], before)
    cut = top.withColumn("box", clip(box("box"), F.lit(width), F.lit(height)).struct())
    cut = cut.where(nonempty(box("box"), least))
    kept = suppress(cut, [image, level], id_, threshold).withColumnRenamed("id", id_)
    return first_n(cut.join(kept, [image, level, id_], "left_semi"), [image], [F.desc("score"), id_], after)


def confusion(df: DataFrame, truth: str, predicted: str, ignore: int | None = 255) -> DataFrame:
    """(gt, pred, n) of every pair of classes that occurs."""
    rows = df if ignore is None else df.where(F.col(truth) != ignore)
    return rows.groupBy(F.col(truth).alias("gt"), F.col(predicted).alias("pred")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, classes: int) -> DataFrame:
    """(class, tp, gt, pred, iou, acc) of all classes; iou and acc are null where their denominator is 0."""
    one = matrix.sparkSession.range(classes).select(F.col("id").cast("int").alias("class"))
    flat = matrix.select(F.explode(F.array(F.struct(F.col("gt").cast("int").alias("class"), F.col("n").alias("g"), F.lit(0).cast("bigint").alias("p"), F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0).alias("t")), F.struct(F.col("pred").cast("int").alias("class"), F.lit(0).cast("bigint").alias("g"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("t")))).alias("x"))
    sums = flat.groupBy("x.class").agg(F.sum("x.t").alias("tp"), F.sum("x.g").alias("gt"), F.sum("x.p").alias("pred"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    rows = one.join(sums, "class", "left").select("class", zero("tp"), zero("gt"), zero("pred"))
    return rows.withColumns({"iou": F.try_divide("tp", F.col("gt") + F.col("pred") - F.col("tp")), "acc": F.try_divide("tp", "gt")})


def segmentation_scores(per_class: DataFrame) -> DataFrame:
    """Pixel accuracy, mean accuracy and mean IoU with absent classes as 0 (_all), or over classes of truth (_present);
    IoU weighted by the classes' share of truth."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = F.sum("gt")
    return per_class.agg(
        F.try_divide(F.sum("tp"), total).alias("pixel_acc"),
        F.avg(zero("acc")).alias("mean_acc_all"),
        F.avg(zero("iou")).alias("miou_all"),
        F.avg(F.when(F.col("gt") > 0, F.col("acc"))).alias("mean_acc_present"),
        F.try_divide(F.sum(F.when(F.col("gt") > 0, F.col("iou"))), F.count_if(F.col("gt") + F.col("pred") > 0)).alias("miou_present"),
        F.try_divide(F.sum(zero("iou") * F.col("gt")), total).alias("fwiou"),
    )


def panoptic_quality(segments: DataFrame) -> DataFrame:
    """(class, pq, sq, rq) from (class, iou, kind) rows, kind being tp, fp or fn."""
    tp, fp, fn = (F.count_if(F.col("kind") == k) for k in ("tp", "fp", "fn"))
    total = F.coalesce(F.sum(F.when(F.col("kind") == "tp", F.col("iou"))), F.lit(0.0))
    weight = tp + fp / 2 + fn / 2
    return segments.groupBy("class").agg(F.try_divide(total, weight).alias("pq"), F.try_divide(total, tp).alias("sq"), F.try_divide(tp, weight).alias("rq"))


def lovasz(df: DataFrame, keys: Sequence[str], error: str, truth: str) -> DataFrame:
    """(keys, loss): the Lovasz extension of the IoU loss; keys without a true row are left out. truth is 0 or 1."""
    placed = running(df, keys, [F.desc(error), F.desc(truth)], {"__hits": F.col(truth), "__seen": F.lit(1)})
    total, hits, seen = F.col("__hits_all"), F.col("__hits"), F.col("__seen")
    jaccard = lambda h, k: 1 - (total - h) / (total + k - h)
    before = F.when(seen == 1, 0.0).otherwise(jaccard(hits - F.col(truth), seen - 1))
    part = F.col(error) * (jaccard(hits, seen) - before)
    return placed.where(total > 0).groupBy(*keys).agg(F.sum(part).alias("loss"))


def cover_greedily(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, l, r, iou): again and again the pair of greatest overlap among the boxes not taken yet, in every key."""
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in [*keys, "l", "r", "iou"])

    def take(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        left, right, kept = set(), set(), []
        begins = set(at.tolist())
        for i, (x, y) in enumerate(zip(pdf["l"].tolist(), pdf["r"].tolist())):
            if i in begins:
                left, right = set(), set()
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                kept.append(i)
        return pdf.loc[kept, [*keys, "l", "r", "iou"]]

    return map_groups(pairs.select(*keys, "l", "r", "iou"), keys, [F.desc("iou"), "l", "r"], take, schema)


def match_at_thresholds(pairs: DataFrame, detections: DataFrame, truth: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """(keys, threshold, id, object, ignored): detections, best score first, each take the free object of greatest
    overlap from the threshold on; objects to ignore only where no other is left, and crowds more than once.

    pairs: keys, l, r, iou. detections: keys, id, score. truth: keys, id, ignore, crowd. A detection without an object
    has a null one.
    """
    named = pairs.select(*keys, F.col("l").alias("id"), "r", "iou").join(truth.select(*keys, F.col("id").alias("r"), "ignore", "crowd"), [*keys, "r"])
    rows = detections.select(*keys, "id", "score").join(named, [*keys, "id"], "left")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = ", ".join(f"`{c}` {kind(c)}" for c in keys) + f", threshold double, id {kind('id')}, object {kind('r')}, ignored boolean"

    integers = kind("r") in ("int", "bigint")

    def match(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        ids, overlap = pdf["id"].to_numpy(), pdf["iou"].to_numpy(float)
        ignore, crowd = pdf["ignore"].eq(True).to_numpy(bool), pdf["crowd"].eq(True).to_numpy(bool)
        new = np.zeros(len(pdf), bool)
        new[at[:-1]] = True
        new[1:] |= ids[1:] != ids[:-1]
        first, own = np.flatnonzero(new), np.cumsum(new) - 1
        group = np.repeat(np.arange(len(at) - 1), np.diff(at))
        place = np.arange(len(first)) - np.searchsorted(first, at[:-1])[group[first]]
        r = pd.factorize(pdf["r"])[0]
        objects, known = np.unique(group * (r.max(initial=0) + 2) + r + 1, return_inverse=True)
        # The detections of equal place in all images choose at once; rows of one stand by overlap, greatest first.
        by_place = np.argsort(place[own], kind="stable")
        turns = np.split(by_place, np.searchsorted(place[own][by_place], np.arange(1, place.max(initial=0) + 1)))
        out = []
        for t in thresholds:
            chosen, taken = np.full(len(first), -1), np.zeros(len(objects), bool)
            for rows in turns:
                open_ = rows[(overlap[rows] >= t) & (~taken[known[rows]] | crowd[rows])]
                for side in (open_[~ignore[open_]], open_[ignore[open_]]):
                    side = side[chosen[own[side]] < 0]
                    side = side[np.append(True, own[side][1:] != own[side][:-1])[: len(side)]]
                    chosen[own[side]] = side
                    taken[known[side]] = True
            hit = chosen >= 0
            found = pdf.iloc[first][[*keys]].assign(threshold=float(t), id=ids[first])
            object_ = pdf["r"].iloc[np.maximum(chosen, 0)].reset_index(drop=True)
            found["object"] = (object_.astype("Int64") if integers else object_.astype(object)).where(hit, None).array
            out.append(found.assign(ignored=hit & ignore[chosen]))
        return pd.concat(out, ignore_index=True)

    return map_groups(rows, keys, [F.desc("score"), "id", F.desc("iou"), "r"], match, schema)


def suppress_masks(pixels: DataFrame, image: str, mask: str, score: str, pixel: str, threshold: float) -> DataFrame:
    """(image, mask, pixel): masks, best score first, lose pixels that earlier ones cover; those that share more than
    threshold of their area with them go."""
    kind = lambda c: pixels.schema[c].dataType.simpleString()

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        covered: set = set()
        parts = []
        for _, own in sorted(pdf.groupby(mask), key=lambda x: (-x[1][score].iloc[0], x[0])):
            fresh = ~own[pixel].isin(covered)
            if 1 - fresh.mean() > threshold:
                continue
            covered.update(own[pixel])
            parts.append(own.loc[fresh, [image, mask, pixel]])
        return pd.concat(parts) if parts else pdf.iloc[:0][[image, mask, pixel]]

    rows = pixels.select(image, mask, score, pixel)
    return rows.groupBy(image).applyInPandas(paint, f"`{image}` {kind(image)}, `{mask}` {kind(mask)}, `{pixel}` {kind(pixel)}")


def fill_stuff(things: DataFrame, stuff: DataFrame, image: str, pixel: str, label: str, least: int) -> DataFrame:
    """(image, label, n): stuff labels on pixels that no thing covers, where they hold least pixels or more."""
    rest = stuff.join(things.select(image, pixel).distinct(), [image, pixel], "left_anti")
    return rest.groupBy(image, label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
