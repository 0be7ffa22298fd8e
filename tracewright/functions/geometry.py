"""Boxes, points and image sizes, as built-in arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def numbers(text: Column) -> Column:
    """"a,b,c" as doubles; null if any part is no number."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def box_corners(text: Column) -> Column:
    """"x,y,w,h" as x1, y1, x2, y2; null unless it has four numbers."""
    b = numbers(F.regexp_replace(text, r"[\[\]\s]", ""))
    return F.when(F.size(b) == 4, F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))


def is_normalised(values: Column) -> Column:
    """All in [0, 1]; the pixel box 0,0,1,1 counts as well."""
    return F.forall(values, lambda v: (v >= 0) & (v <= 1))


def scaled(values: Column, width: Column, height: Column, size: int) -> Column:
    """Normalised boxes (size 4) or points (2) in pixels; others unchanged."""
    fits = (F.size(values) == size) & (width > 0) & (height > 0) & is_normalised(values)
    by = F.array(*([width, height] * (size // 2)))
    return F.when(F.coalesce(fits, F.lit(False)), F.zip_with(values, by, lambda v, k: v * k)).otherwise(values)


def centre(box: Column) -> tuple[Column, Column]:
    return box[0] + box[2] / 2, box[1] + box[3] / 2


def near(ax: Column, ay: Column, bx: Column, by: Column, limit: float = 24.0) -> Column:
    return F.coalesce(F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) <= limit, F.lit(False))


def points_match(a: Column, b: Column, limit: float = 24.0) -> Column:
    return near(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1)), limit)


def boxes_match(a: Column, b: Column, limit: float = 24.0) -> Column:
    """Centres of two x,y,w,h boxes no further apart than ``limit`` pixels."""
    g = lambda x, i: F.get(x, F.lit(i))
    whole = (F.size(a) == 4) & (F.size(b) == 4)
    return F.coalesce(whole, F.lit(False)) & near(g(a, 0) + g(a, 2) / 2, g(a, 1) + g(a, 3) / 2, g(b, 0) + g(b, 2) / 2, g(b, 1) + g(b, 3) / 2, limit)


def fit(width: Column, height: Column, target_width: int, target_height: int) -> Column:
    """Resize that keeps proportions: new size, scale and the padding around it."""
    scale = F.least(F.lit(target_width) / width, F.lit(target_height) / height)
    w, h = F.floor(width * scale).cast("long"), F.floor(height * scale).cast("long")
    return F.struct(scale.alias("scale"), w.alias("width"), h.alias("height"), F.floor((F.lit(target_width) - w) / 2).alias("pad_x"), F.floor((F.lit(target_height) - h) / 2).alias("pad_y"))


def to_original(values: Column, frame: Column) -> Column:
    """A point or box of the fitted image in the original's pixels."""
    shift = F.array(frame["pad_x"].cast("double"), frame["pad_y"].cast("double"), F.lit(0.0), F.lit(0.0))
    return F.transform(values, lambda v, i: (v - F.get(shift, i)) / frame["scale"])


def stretch(width: Column, height: Column, target_width: int, target_height: int) -> Column:
    """Resize that ignores proportions: the target's size and one scale for each axis."""
    return F.struct((F.lit(target_width) / width).alias("scale_x"), (F.lit(target_height) / height).alias("scale_y"), F.lit(target_width).cast("long").alias("width"), F.lit(target_height).cast("long").alias("height"))


def unstretched(values: Column, frame: Column) -> Column:
    """A point or box of the stretched image in the original's pixels."""
    return F.transform(values, lambda v, i: v / F.when(i % 2 == 0, frame["scale_x"]).otherwise(frame["scale_y"]))


def unit_pixels(values: Column) -> Column:
    """Channel values from 0 to 255 as floats in [0, 1]."""
    return F.transform(values, lambda v: (v / 255).cast("float"))


def downscaled(width: Column, height: Column, over: tuple[int, int], into: tuple[int, int]) -> Column:
    """Size after fitting images above ``over`` into ``into``; small ones as they are."""
    big = (width > over[0]) | (height > over[1])
    scale = F.when(big, F.least(F.lit(1.0), F.least(F.lit(into[0]) / width, F.lit(into[1]) / height))).otherwise(1.0)
    return F.struct(F.floor(width * scale).cast("long").alias("width"), F.floor(height * scale).cast("long").alias("height"))


def clamp(x: Column) -> Column:
    """Confidence in [0, 1]; 0.5 for what is no number."""
    number = x.try_cast("double")
    return F.when(number.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
