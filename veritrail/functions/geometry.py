"""Boxes (struct of left, top, right, bottom) as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left, top, right, bottom) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
    return F.struct(*[c(x).cast("double").alias(n) for x, n in zip((left, top, right, bottom), ("left", "top", "right", "bottom"))])


def width(b: Column) -> Column:
    return b["right"] - b["left"]


def height(b: Column) -> Column:
    return b["bottom"] - b["top"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre_y(b: Column) -> Column:
    return (b["top"] + b["bottom"]) / 2


def centre_x(b: Column) -> Column:
    return (b["left"] + b["right"]) / 2


def valid(b: Column) -> Column:
    return (b["right"] >= b["left"]) & (b["bottom"] >= b["top"])


def union(boxes: Column) -> Column:
    """Of an array of boxes; null for an empty one."""
    edge = lambda name, pick: pick(boxes[name])
    out = F.struct(edge("left", F.array_min).alias("left"), edge("top", F.array_min).alias("top"), edge("right", F.array_max).alias("right"), edge("bottom", F.array_max).alias("bottom"))
    return F.when(F.size(boxes) > 0, out)


def union_agg(b: Column) -> Column:
    return F.struct(F.min(b["left"]).alias("left"), F.min(b["top"]).alias("top"), F.max(b["right"]).alias("right"), F.max(b["bottom"]).alias("bottom"))


def quad_box(corners: Column) -> Column:
    """The upright box around an array of (x, y) structs."""
    xs, ys = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def intersection(a: Column, b: Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("left", "right") * side("top", "bottom")


def overlaps(a: Column, b: Column, share: float = 0.5) -> Column:
    """Whether that share of a's own area lies in b; false for a box without area."""
    return F.when(area(a) > 0, intersection(a, b) / area(a) >= share).otherwise(F.lit(False))


def contains(outer: Column, inner: Column) -> Column:
    return overlaps(inner, outer, 0.9)


def column_overlap(a: Column, b: Column) -> Column:
    """Horizontal overlap over the narrower width, 0 where that has none."""
    narrow = F.least(width(a), width(b))
    return F.when(narrow > 0, F.greatest(F.lit(0.0), F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"])) / narrow).otherwise(F.lit(0.0))


def vertical_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["top"] - a["bottom"], a["top"] - b["bottom"])


def grow(b: Column, by) -> Column:
    by = by if isinstance(by, Column) else F.lit(float(by))
    return box(b["left"] - by, b["top"] - by, b["right"] + by, b["bottom"] + by)


def wire(b: Column) -> Column:
    return F.struct(b["left"].alias("left"), b["top"].alias("top"), width(b).alias("width"), height(b).alias("height"))


def from_wire(w: Column) -> Column:
    return box(w["left"], w["top"], w["left"] + w["width"], w["top"] + w["height"])


def near(b: Column, anchor: Column, reach_heights: float) -> Column:
    """Close enough above or below an anchor, and in its column widened by the same reach."""
    reach = height(anchor) * reach_heights
    in_column = (b["left"] <= anchor["right"] + reach) & (b["right"] >= anchor["left"] - reach)
    return (vertical_gap(b, anchor) <= reach) & in_column


def percent_box(b: Column, image_width: Column, image_height: Column) -> Column:
    """Left, top, width and height in percent of the image, clamped to it; null if nothing is left."""
    clamp = lambda v, size: F.greatest(F.lit(0.0), F.least(v, size)) / size * 100
    left, right = clamp(b["left"], image_width), clamp(b["right"], image_width)
    top, bottom = clamp(b["top"], image_height), clamp(b["bottom"], image_height)
    ok = (image_width > 0) & (image_height > 0) & (right > left) & (bottom > top)
    return F.when(ok, F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")))


def same_aspect(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.02) -> Column:
    return F.abs(w1 / h1 - w2 / h2) <= tolerance * (w2 / h2)


def upload_size(w: Column, h: Column, longest: int = 2600) -> Column:
    """Width and height scaled down so that the longer edge is at most longest; 1 at least."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    edge = lambda v: F.greatest(F.lit(1), F.round(v * scale).cast("int"))
    return F.struct(edge(w).alias("width"), edge(h).alias("height"))
