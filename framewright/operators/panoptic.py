"""Panoptic segmentation: one label map from scored masks and a semantic map, and its quality against the truth.

Pixels are rows and stay in joins and counts. What is greedy, masks that lose pixels to better ones, is decided on the
few sets of masks that occur together in an image, with their numbers of pixels, and not on the pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept_masks(patterns: DataFrame, image: str, threshold: float) -> DataFrame:
    """(image, kept): places of the masks that stay, in order. A mask goes if those that stay before it cover more than
    threshold of its pixels. patterns: image, places (sorted places of the masks of some pixels, from 1), n pixels."""
    one = patterns.groupBy(image).agg(F.collect_list(F.struct("places", "n")).alias("__p"))
    area = lambda m, extra: F.aggregate("__p", F.lit(0).cast("bigint"), lambda s, p: s + F.when(F.array_contains(p["places"], m) & extra(p), p["n"]).otherwise(0))

    def step(kept: Column, m: Column) -> Column:
        covered = area(m, lambda p: F.arrays_overlap(p["places"], kept)) / area(m, lambda p: F.lit(True))
        return F.when(covered > threshold, kept).otherwise(F.concat(kept, F.array(m)))

    masks = F.array_sort(F.array_distinct(F.flatten(F.transform("__p", lambda p: p["places"]))))
    return one.select(image, F.aggregate(masks, F.array().cast("array<int>"), step).alias("kept"))


def merge(masks: DataFrame, semantic: DataFrame, image: str, pixel: Sequence[str], overlap: float, least_stuff: int, confidence: float) -> DataFrame:
    """(image, pixel, segment, class, thing): a label map from masks, best score first, ties to the smaller mask, and, on
    pixels that no mask takes, the semantic classes that hold least_stuff of them or more.

    masks: image, mask, class, score and a row for each pixel; semantic: image, pixel, label, a whole map, in which 0
    stands for things. Masks below confidence take no part; one that better masks cover by more than overlap of its area
    goes, others lose the pixels that are taken. Segments are numbered from 1 in each image, masks first, then classes.
    Pixels without segment are left out. An image's list of sets of masks is one row: sets of masks are far fewer than
    pixels, and masks of an image a hundred or so.
    """
    sure = masks.where((F.col("score") >= confidence) & F.col("mask").isNotNull())
    order = F.dense_rank().over(Window.partitionBy(image).orderBy(F.desc("score"), "mask"))
    named = sure.select(image, "mask", "score", "class").distinct().withColumn("place", order)
    at = sure.select(image, "mask", *pixel).distinct().join(named.select(image, "mask", "place"), [image, "mask"])
    sets = at.groupBy(image, *pixel).agg(F.array_sort(F.collect_set("place")).alias("places"))
    kept = kept_masks(sets.groupBy(image, "places").agg(F.count("*").alias("n")), image, overlap)
    taken = sets.join(kept, image).withColumn("place", F.array_min(F.array_intersect("places", "kept"))).where("place IS NOT NULL")
    things = taken.select(image, *pixel, "place", F.array_position("kept", F.col("place")).cast("int").alias("segment"))
    things = things.join(named.select(image, "place", "class"), [image, "place"]).select(image, *pixel, "segment", "class", F.lit(True).alias("thing"))
    free = semantic.where("label <> 0").join(things.select(image, *pixel), [image, *pixel], "left_anti")
    stuff = free.groupBy(image, "label").agg(F.count("*").alias("__n")).where(F.col("__n") >= least_stuff)
    begin = kept.select(image, F.size("kept").alias("__kept"))
    number = (F.row_number().over(Window.partitionBy(image).orderBy("label")) + F.coalesce("__kept", F.lit(0))).alias("segment")
    numbered = stuff.join(begin, image, "left").select(image, "label", number)
    rest = free.join(numbered, [image, "label"]).select(image, *pixel, "segment", F.col("label").alias("class"), F.lit(False).alias("thing"))
    return things.unionByName(rest)


def match_segments(truth: DataFrame, found: DataFrame, image: str, pixel: Sequence[str], crowd_share: float = 0.5) -> DataFrame:
    """(class, kind, iou): a row for each segment that counts: tp with its overlap, fp or fn.

    truth: image, pixel, segment, class, crowd; found: image, pixel, segment, class; pixels without a row, or of null
    segment, are void. Two segments of a class match when their overlap, without the found one's void pixels, is over
    one half, which makes matches unique. Crowds are never missed; a found segment is no error if more than crowd_share
    of it is void or in its class's crowd (the last by number, where there are several).
    """
    t = truth.where("segment IS NOT NULL").select(image, *pixel, F.col("segment").alias("t"), F.col("class").alias("ct"), F.coalesce("crowd", F.lit(False)).alias("crowd"))
    p = found.where("segment IS NOT NULL").select(image, *pixel, F.col("segment").alias("p"), F.col("class").alias("cp"))
    cells = t.join(p, [image, *pixel], "full").groupBy(image, "t", "ct", "crowd", "p", "cp").agg(F.count("*").alias("n"))
    area = lambda *by: F.sum("n").over(Window.partitionBy(image, *by))
    void = F.sum(F.when(F.col("t").isNull(), F.col("n")).otherwise(0)).over(Window.partitionBy(image, "p"))
    sized = cells.withColumns({"at": area("t"), "ap": area("p"), "void": void})
    iou = F.col("n") / (F.col("at") + F.col("ap") - F.col("n") - F.col("void"))
    same = F.col("t").isNotNull() & F.col("p").isNotNull() & (F.col("ct") == F.col("cp")) & ~F.col("crowd")
    scored = sized.withColumn("iou", F.when(same & (iou > 0.5), iou))
    right = scored.where("iou IS NOT NULL").select(F.col("ct").alias("class"), F.lit("tp").alias("kind"), "iou")
    none = F.lit(None).cast("double").alias("iou")
    segments = scored.where("t IS NOT NULL").groupBy(image, "t", "ct", "crowd").agg(F.max("iou").alias("iou"))
    missed = segments.where("iou IS NULL AND NOT crowd").select(F.col("ct").alias("class"), F.lit("fn").alias("kind"), none)
    last = scored.where("crowd").groupBy(image, "ct").agg(F.max("t").alias("last"))
    own = scored.where("p IS NOT NULL").join(last.select(image, F.col("ct").alias("cp"), "last"), [image, "cp"], "left")
    aside = F.sum(F.when(F.col("t").isNull() | (F.col("t") == F.col("last")), F.col("n")).otherwise(0))
    guesses = own.groupBy(image, "p", "cp").agg(F.max("iou").alias("iou"), (aside / F.sum("n")).alias("aside"))
    wrong = guesses.where(F.col("iou").isNull() & (F.col("aside") <= crowd_share)).select(F.col("cp").alias("class"), F.lit("fp").alias("kind"), none)
    return right.unionByName(missed).unionByName(wrong)


def quality_by_kind(per_class: DataFrame, things: Column) -> DataFrame:
    """(kind, pq, sq, rq, n) in per cent, for all classes, things and stuff: means over the classes that panoptic_quality
    has rows for; null where there is none. sq of a class without a match counts 0."""
    rows = per_class.select(F.explode(F.array(F.lit("all"), F.when(things, "things").otherwise("stuff"))).alias("kind"), "pq", F.coalesce("sq", F.lit(0.0)).alias("sq"), "rq")
    return rows.groupBy("kind").agg(*[(F.avg(c) * 100).alias(c) for c in ("pq", "sq", "rq")], F.count("*").alias("n"))
