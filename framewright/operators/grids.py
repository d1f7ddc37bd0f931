"""Rows that lie on grids: masks, label maps, anchors of feature maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .groups import map_groups


def of_classes(label: Column, classes: Sequence[int]) -> Column:
    """1 where the label is one of the classes, else 0, null labels too."""
    return F.coalesce(label.isin(list(classes)), F.lit(False)).cast("int")


def binary(value: Column, threshold: float = 0.5) -> Column:
    """1 above the threshold, else 0."""
    return F.coalesce(value > threshold, F.lit(False)).cast("int")


def _bins(at: Column, size: int, bins: int) -> Column:
    """The bins that a place counts for: bin i spans floor(i size / bins) to ceil((i + 1) size / bins), so that neighbours
    overlap where size is no multiple."""
    at = at.cast("bigint")
    return F.sequence(F.floor(at * bins / size), F.ceil((at + 1) * bins / size) - 1)


def coverage(pixels: DataFrame, keys: Sequence[str], axes: Mapping[str, tuple[int, int]], value: str, nearest: bool = False) -> DataFrame:
    """(keys, axes, value): pixels pooled to a coarser grid, by mean or by the pixel nearest to a cell's middle. axes maps
    a coordinate to its size and its number of cells."""
    if nearest:
        for axis, (size, cells) in axes.items():
            at = lambda i: F.floor((i + 0.5) * size / cells)  # noqa: B023, E731
            fits = F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: at(i) == F.col(axis))  # noqa: B023
            pixels = pixels.withColumn(axis, F.explode(fits))
        return pixels.select(*keys, *axes, value)
    for axis, (size, cells) in axes.items():
        pixels = pixels.withColumn(axis, F.explode(_bins(F.col(axis), size, cells)))
    return pixels.groupBy(*keys, *axes).agg(F.avg(value).alias(value))


def anchors(spark: SparkSession, levels: Sequence[tuple[int, int, int, Sequence[float]]], ratios: Sequence[float], offset: float = 0.0) -> DataFrame:
    """(level, at, x0, y0, x1, y1): boxes of the sizes and ratios (height by width) around every cell of feature maps. levels
    are (rows, columns, stride, sizes); at counts a level's boxes by row, column, size and ratio."""
    out = None
    for level, (rows, columns, stride, sizes) in enumerate(levels):
        shapes = [((s * s / r) ** 0.5, r * (s * s / r) ** 0.5) for s in sizes for r in ratios]
        boxes = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")) for w, h in shapes])
        cells = spark.range(rows * columns).select("id", F.posexplode(boxes).alias("k", "b"))
        x, y = (F.col("id") % columns + offset) * stride, (F.floor(F.col("id") / columns) + offset) * stride
        made = cells.select(
            F.lit(level).alias("level"), (F.col("id") * len(shapes) + F.col("k")).alias("at"),
            (x - F.col("b.w") / 2).alias("x0"), (y - F.col("b.h") / 2).alias("y0"),
            (x + F.col("b.w") / 2).alias("x1"), (y + F.col("b.h") / 2).alias("y1"),
        )
        out = made if out is None else out.unionByName(made)
    if out is None:
        raise ValueError("no levels")
    return out


def grow_regions(pixels: DataFrame, image: str, x: str, y: str, label: str, human: str, kind: str, classes: Mapping[int, int]) -> DataFrame:
    """pixels (image, x, y, label, human) with instances grown: from every labelled pixel, by rows from the top left, its
    label and human go to those of its eight neighbours that have no label (0) and the class of its label in the map
    kind, and on from these. One image is one group; places without a row end a region."""
    rows = pixels.select(image, y, x, label, human, kind)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [image, x, y, label, human])
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]

    def grow(pdf: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
        labels, humans = pdf[label].to_numpy(copy=True), pdf[human].to_numpy(copy=True)
        kinds, places = pdf[kind].tolist(), list(zip(pdf[y].tolist(), pdf[x].tolist()))
        for begin, end in zip(at[:-1].tolist(), at[1:].tolist()):
            where = {places[i]: i for i in range(begin, end)}
            for first in range(begin, end):
                own = labels[first]
                if own == 0:
                    continue
                reached = [first]
                while reached:
                    row, column = places[reached.pop()]
                    for down, right in around:
                        i = where.get((row + down, column + right))
                        if i is not None and labels[i] == 0 and kinds[i] == classes.get(int(own)):
                            labels[i], humans[i] = own, humans[first]
                            reached.append(i)
        return pdf.assign(**{label: labels, human: humans})[[image, x, y, label, human]]

    return map_groups(rows, [image], [y, x], grow, schema)
