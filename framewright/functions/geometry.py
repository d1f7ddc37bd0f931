"""Boxes: struct(x0, y0, x1, y1) of doubles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    def struct(self) -> Column:
        return F.struct(self.x0.alias("x0"), self.y0.alias("y0"), self.x1.alias("x1"), self.y1.alias("y1"))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2


def box(column: str | Column) -> Box:
    c = F.col(column) if isinstance(column, str) else column
    return Box(c["x0"], c["y0"], c["x1"], c["y1"])


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x.cast("double"), y.cast("double"), (x + w).cast("double"), (y + h).cast("double"))


def to_xywh(b: Box) -> Column:
    return F.struct(b.x0.alias("x"), b.y0.alias("y"), b.width.alias("w"), b.height.alias("h"))


def from_rotated(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Box:
    """The upright box around a rotated one."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    half_w, half_h = (c * w + s * h) / 2, (c * h + s * w) / 2
    return Box(cx - half_w, cy - half_h, cx + half_w, cy + half_h)


def intersection(a: Box, b: Box) -> Column:
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """0 for disjoint boxes; null where the union is empty."""
    both = intersection(a, b)
    return F.try_divide(both, a.area + b.area - both)


def clip(b: Box, width: Column, height: Column) -> Box:
    between = lambda v, top: F.least(F.greatest(v, F.lit(0.0)), top)
    return Box(between(b.x0, width), between(b.y0, height), between(b.x1, width), between(b.y1, height))


def scale(b: Box, sx: Column, sy: Column) -> Box:
    return Box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)


def nonempty(b: Box, threshold: float = 0.0) -> Column:
    return (b.width > threshold) & (b.height > threshold)


def inside(b: Box, width: Column, height: Column, slack: float = 0.0) -> Column:
    return (b.x0 >= -slack) & (b.y0 >= -slack) & (b.x1 < width + slack) & (b.y1 < height + slack)


def area_in(b: Box, low: float, high: float) -> Column:
    """Both ends count."""
    return b.area.between(low, high)


def finite(*values: Column) -> Column:
    ok = F.lit(True)
    for v in values:
        ok = ok & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return ok


def deltas(source: Box, target: Box, weights: tuple[float, float, float, float] = (1, 1, 1, 1)) -> Column:
    """The shift and log scale that turn source into target."""
    (sx, sy), (tx, ty) = source.centre, target.centre
    return F.struct(
        (weights[0] * (tx - sx) / source.width).alias("dx"),
        (weights[1] * (ty - sy) / source.height).alias("dy"),
        (weights[2] * F.ln(target.width / source.width)).alias("dw"),
        (weights[3] * F.ln(target.height / source.height)).alias("dh"),
    )


def apply_deltas(source: Box, d: Column, weights: tuple[float, float, float, float] = (1, 1, 1, 1)) -> Box:
    x, y = source.centre
    x, y = x + d["dx"] / weights[0] * source.width, y + d["dy"] / weights[1] * source.height
    w, h = source.width * F.exp(d["dw"] / weights[2]), source.height * F.exp(d["dh"] / weights[3])
    return Box(x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def relation_score(a: Box, b: Box, horizontal: Column, threshold: float = 0.1) -> Column:
    """1 where the centres lie apart mostly along the axis asked for, less where the boxes overlap, else 0.

    Left and right, or top and bottom, are not told apart; null where both boxes are empty.
    """
    (ax, ay), (bx, by) = a.centre, b.centre
    dx, dy = F.abs(bx - ax), F.abs(by - ay)
    along = F.when(horizontal, dx > dy).otherwise(dy > dx)
    overlap = iou(a, b)
    return F.when(overlap.isNull(), F.lit(None).cast("double")).when(~along, 0.0).when(overlap < threshold, 1.0).otherwise(F.try_divide(F.lit(threshold), overlap))


def expand(b: Box, ratio: float, width: Column, height: Column) -> Box:
    """Grows every side by ratio of the box's size, within the image."""
    dx, dy = b.width * ratio, b.height * ratio
    return clip(Box(b.x0 - dx, b.y0 - dy, b.x1 + dx, b.y1 + dy), width, height)


def fit_pad(w: Column, h: Column, to_w: int, to_h: int) -> Column:
    """Size after scaling to fit (to_w, to_h), and the padding on the left and at the top; halves round to even."""
    factor = F.least(to_w / w, to_h / h)
    new_w, new_h = F.greatest(F.bround(w * factor), F.lit(1)).cast("int"), F.greatest(F.bround(h * factor), F.lit(1)).cast("int")
    return F.struct(new_w.alias("w"), new_h.alias("h"), F.floor((to_w - new_w) / 2).cast("int").alias("left"), F.floor((to_h - new_h) / 2).cast("int").alias("top"))


def pyramid_level(b: Box, low: int, high: int, size: float = 224.0, level: int = 4) -> Column:
    """Level of a feature pyramid for the box, counted from the lowest."""
    raw = F.floor(level + F.log2(F.sqrt(b.area) / size + 1e-8))
    return (F.least(F.greatest(raw, F.lit(low)), F.lit(high)) - low).cast("int")


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula over arrays of coordinates."""
    turned = lambda a: F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))
    cross = lambda a, b: F.aggregate(F.zip_with(a, turned(b), lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.abs(cross(xs, ys) - cross(ys, xs)) / 2


def rescale(x: Column, low: float, high: float, to_low: float = 0.0, to_high: float = 1.0) -> Column:
    """Linear map of [low, high], clamped at both ends."""
    y = (x - low) / (high - low) * (to_high - to_low) + to_low
    return F.least(F.greatest(y, F.lit(to_low)), F.lit(to_high))


def expand_rounded(b: Box, ratio: float, width: Column, height: Column) -> Box:
    """Grows a box of pixels around its middle to ratio times its size; rounded, halves to even, and within the pixels that
    the image has."""
    dx, dy = b.width * ((ratio - 1) / 2), b.height * ((ratio - 1) / 2)
    low = lambda v: F.when(v < 0, F.lit(0)).otherwise(F.bround(v)).cast("int")
    high = lambda v, size: F.when(v > size - 1, size - 1).otherwise(F.bround(v)).cast("int")
    return Box(low(b.x0 - dx), low(b.y0 - dy), high(b.x1 + dx, width), high(b.y1 + dy, height))


def crop_of_face(b: Box, width: Column, height: Column, pad: float, above: float) -> Column:
    """struct(x, y, w, h) in pixels around a box given in shares of the frame: padded on all sides, more above it, of even
    sizes of 2 at least, within the frame; halves round to even."""
    unit = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    at = lambda v, size: F.bround(unit(v) * size).cast("int")
    x0, x1 = at(b.x0 - b.width * pad, width), at(b.x1 + b.width * pad, width)
    y0, y1 = at(b.y0 - b.height * (pad + above), height), at(b.y1 + b.height * pad, height)
    even = lambda a, z: F.greatest(z - a, F.lit(2)) - F.greatest(z - a, F.lit(2)) % 2
    w, h = even(x0, x1), even(y0, y1)
    inside = lambda a, size, n: F.greatest(F.least(a, (size - n).cast("int")), F.lit(0))
    return F.struct(inside(x0, width, w).alias("x"), inside(y0, height, h).alias("y"), w.alias("w"), h.alias("h"))


def crop_to_ratio(width: Column, height: Column, crop: Column, ratio: tuple[int, int], draw: Column) -> Column:
    """struct(x, y, w, h): the largest crop of a ratio, in whole steps of it, that holds crop (x, y, w, h), from the top of a
    square picture to the bottom, or from left to right of a wide one; draw, between 0 and 1, says where. Fails where crop
    does not fit."""
    rw, rh = ratio
    step = F.when(width == height, F.floor(width / rw)).otherwise(F.floor(height / rh)).cast("int")
    w, h = step * rw, step * rh

    def place(begin: Column, size: Column, own: Column, whole: Column) -> Column:
        low, high = F.greatest(begin - (size - own), F.lit(0)), F.least(begin + size, whole) - size
        fits = (size >= own) & (high >= low)
        return F.when(fits, low + F.least(F.floor(draw * (high - low + 1)), high - low)).otherwise(F.raise_error(F.lit("the crop does not fit")).cast("bigint")).cast("int")

    tall = width == height
    x = F.when(tall, F.lit(0)).otherwise(place(crop["x"], w, crop["w"], width))
    y = F.when(tall, place(crop["y"], h, crop["h"], height)).otherwise(F.lit(0))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
