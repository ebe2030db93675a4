"""Functions of columns over number arrays: they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def histogram(values: Column, bins: int, low: float, high: float) -> Column:
    """Counts of values in ``bins`` equal bins over [low, high); values outside go to the nearest bin."""
    bin_of = lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x.cast("double") - low) * (bins / (high - low))).cast("int")))
    placed = F.transform(values, bin_of)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(placed, lambda p: p == b)))


def chebyshev(a: Column, b: Column) -> Column:
    """The largest difference of two arrays' elements."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def difference(a: Column, b: Column) -> Column:
    """b - a, element by element."""
    return F.zip_with(a, b, lambda x, y: y - x)


def clone_channels(values: Column, times: int) -> Column:
    """The array repeated."""
    return F.flatten(F.array_repeat(values, times))


def sliding_mean(values: Column, width: int) -> Column:
    """Means of windows of an odd ``width`` around each element; the elements at the borders, without a whole window, are 0."""
    half = width // 2
    n = F.size(values)
    mean = lambda i: F.aggregate(F.slice(values, i - half + 1, width), F.lit(0.0), lambda s, x: s + x) / width
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when((i >= half) & (i < n - half), mean(i)).otherwise(F.lit(0.0)))


def resized(width: Column, height: Column, to_width: Column, to_height: Column, minimum: bool = False, preserve_aspect: bool = False) -> Column:
    """The size (struct of width, height) that a resize gives. A target of 0 follows the other by aspect; with
    ``preserve_aspect`` the frame fits the target; with ``minimum`` frames that are no larger stay."""
    ratio = width.cast("double") / height
    w = F.when(to_width == 0, F.floor(to_height * ratio)).otherwise(to_width)
    h = F.when(to_height == 0, F.floor(to_width / ratio)).otherwise(to_height)
    if preserve_aspect:
        scale = F.least(w.cast("double") / width, h.cast("double") / height)
        w, h = F.floor(width * scale), F.floor(height * scale)
    if minimum:
        stay = (width <= w) & (height <= h)
        w, h = F.when(stay, width).otherwise(w), F.when(stay, height).otherwise(h)
    return F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
