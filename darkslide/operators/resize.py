"""Target sizes of pictures: one bound at most, never larger than they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def target_size(width: Column, height: Column, long: int | None = None, short: int | None = None, megapixels: float | None = None) -> tuple[Column, Column]:
    """Width and height under a bound on the long or short side or on the area; sides are at least 1, halves to even."""
    if sum(x is not None for x in (long, short, megapixels)) > 1:
        raise ValueError("one of long, short and megapixels at most")
    w, h = width.cast("double"), height.cast("double")
    if long is not None:
        ratio = F.lit(float(long)) / F.greatest(w, h)
    elif short is not None:
        ratio = F.lit(float(short)) / F.least(w, h)
    elif megapixels is not None:
        ratio = F.sqrt(F.lit(megapixels * 1e6) / (w * h))
    else:
        return width, height
    to = lambda side: F.when(ratio >= 1, side.cast("long")).otherwise(F.greatest(F.lit(1), F.bround(side * ratio).cast("long")))
    return to(w), to(h)


def plain_size(width: int, height: int, long: int | None = None, short: int | None = None, megapixels: float | None = None) -> tuple[int, int]:
    """The same for one picture, where its size is known only in a task."""
    if not width or not height or (long, short, megapixels) == (None, None, None):
        return width, height
    ratio = long / max(width, height) if long is not None else short / min(width, height) if short is not None else (megapixels * 1e6 / (width * height)) ** 0.5
    return (width, height) if ratio >= 1 else (max(1, round(width * ratio)), max(1, round(height * ratio)))
