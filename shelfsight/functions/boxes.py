"""Boxes as fractions of an image: struct<x, y, width, height>."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE, LEAST = 1e-4, 0.01
#: Fixed values of the quality score: weights, the best area and the best aspect ratio.
WEIGHTS = {"saliency": 0.35, "size": 0.3, "centrality": 0.25, "aspect": 0.1}
BEST_AREA, BEST_RATIO, RATIO_RANGE = 0.3, 1.25, 2.8


def make(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (width, "width"), (height, "height"))))


def is_valid(b: Column) -> Column:
    """Finite, within the image by the tolerance, and of at least LEAST extent each way."""
    parts = [b[c] for c in ("x", "y", "width", "height")]
    ok = F.lit(True)
    for p in parts:
        ok = ok & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    ok = ok & (b["x"] >= 0) & (b["y"] >= 0) & (b["width"] >= LEAST) & (b["height"] >= LEAST)
    return F.coalesce(ok & (b["x"] + b["width"] <= 1 + TOLERANCE) & (b["y"] + b["height"] <= 1 + TOLERANCE), F.lit(False))


def is_object(b: Column) -> Column:
    """A valid box that is not the whole image."""
    whole = (b["x"] <= TOLERANCE) & (b["y"] <= TOLERANCE) & (b["width"] >= 1 - TOLERANCE) & (b["height"] >= 1 - TOLERANCE)
    return is_valid(b) & ~F.coalesce(whole, F.lit(False))


def area(b: Column) -> Column:
    return b["width"] * b["height"]


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x"] + a["width"], b["x"] + b["width"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["height"], b["y"] + b["height"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Shared area over united area, 0 where there is none."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    """Shared area over the smaller box's."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(0.0)


def padded(b: Column, share: float) -> Column:
    """Grown by a share of its extent on each side, within the image."""
    left, top = F.greatest(F.lit(0.0), b["x"] - b["width"] * share), F.greatest(F.lit(0.0), b["y"] - b["height"] * share)
    right, bottom = F.least(F.lit(1.0), b["x"] + b["width"] * (1 + share)), F.least(F.lit(1.0), b["y"] + b["height"] * (1 + share))
    return make(left, top, right - left, bottom - top)


def size_score(b: Column) -> Column:
    """Highest at an area of BEST_AREA, falling to 0 at none and at the whole image."""
    a = area(b)
    return F.greatest(F.lit(0.0), F.when(a <= BEST_AREA, a / BEST_AREA).otherwise((1 - a) / (1 - BEST_AREA)))


def centrality(b: Column) -> Column:
    """1 in the middle of the image, 0 where both offsets are largest."""
    dx, dy = F.abs(b["x"] + b["width"] / 2 - 0.5), F.abs(b["y"] + b["height"] / 2 - 0.5)
    return F.greatest(F.lit(0.0), 1 - dx - dy)


def aspect_score(b: Column) -> Column:
    """1 at the best ratio of the longer to the shorter side."""
    ratio = F.greatest(b["width"], b["height"]) / F.least(b["width"], b["height"])
    return 1 - F.least(F.lit(1.0), F.abs(F.log(ratio / BEST_RATIO)) / RATIO_RANGE)


def quality(b: Column, saliency: Column | None = None) -> Column:
    """Weighted mean of the parts; without saliency its weight falls away."""
    parts = {"size": size_score(b), "centrality": centrality(b), "aspect": aspect_score(b)} | ({} if saliency is None else {"saliency": saliency})
    total = sum(WEIGHTS[n] for n in parts)
    out = F.lit(0.0)
    for n, c in parts.items():
        out = out + c * F.lit(WEIGHTS[n] / total)
    return out


def proportion(a: Column, b: Column) -> Column:
    """Compatibility of two elongations; null unless both are objects."""
    ratio = lambda x: F.greatest(x["width"], x["height"]) / F.least(x["width"], x["height"])
    score = F.greatest(F.lit(0.0), 1 - F.abs(F.log(ratio(a) / ratio(b))) / math.log(4))
    return F.when(is_object(a) & is_object(b), score)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    """Pixel box: start rounded down, end rounded up, within the image."""
    left, top = F.floor(b["x"] * width), F.floor(b["y"] * height)
    right, bottom = F.least(width, F.ceil((b["x"] + b["width"]) * width)), F.least(height, F.ceil((b["y"] + b["height"]) * height))
    return F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), (right - left).cast("int").alias("width"), (bottom - top).cast("int").alias("height"))


def to_fractions(b: Column, width: Column, height: Column) -> Column:
    """Fractions of a pixel box, to four decimals."""
    return make(F.round(b["x"] / width, 4), F.round(b["y"] / height, 4), F.round(b["width"] / width, 4), F.round(b["height"] / height, 4))
