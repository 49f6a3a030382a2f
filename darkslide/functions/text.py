"""Display texts and Column twins of Python's number formats."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def general(x: Column) -> Column:
    """A number as Python's ``%g`` writes it, for magnitudes from 0.01 to 999,999 of at most four decimals."""
    r = F.round(x, 4)
    return F.when(r == F.floor(r), F.floor(r).cast("string")).otherwise(r.cast("string"))


#: What stands for a value that is missing.
NONE = "-"


def _shown(write: Callable[[float], str]) -> Callable[[float | None], str]:
    """A display form that has a dash for what is missing."""
    return lambda v: NONE if v is None else write(v)


iso_text = _shown(lambda v: f"{int(v):d}")
aperture_text = _shown("f/{:g}".format)
focal_text = _shown("{:g}mm".format)


@_shown
def shutter_text(seconds: float) -> str:
    """Whole and broken seconds with an s; shorter times as the nearest 1/N, unless N would be 1. Times that aren't above 0 are missing."""
    if not seconds > 0:
        return NONE
    n = round(1 / seconds) if seconds < 1 else 1
    return f"{seconds:g}s" if n == 1 else f"1/{n}"


@_shown
def bias_text(stops: float) -> str:
    """Stops to two decimals with their sign; zero has none."""
    return f"{round(stops, 2) or 0:{'+' if round(stops, 2) else ''}g}"


def size_text(n: int) -> str:
    """Bytes as they are below 1024; then in units of 1024, to two decimals below ten of a unit and else to one."""
    unit = max(0, min(4, (max(n, 1).bit_length() - 1) // 10))
    if not unit:
        return f"{n} B"
    value = n / 1024**unit
    return f"{value:.{2 if value < 10 else 1}f} {'KMGT'[unit - 1]}iB"


def hours_text(hours: Iterable[int]) -> str:
    """Sorted hours, neighbours joined to ranges; a long dash for none."""
    spans = []
    for _, run in itertools.groupby(enumerate(hours), key=lambda x: x[1] - x[0]):  # neighbours are as far from their places
        ends = [h for _, h in run]
        spans.append("\u2013".join(f"{h:02d}" for h in dict.fromkeys((ends[0], ends[-1]))))
    return ", ".join(spans) or "\u2014"


def extent_text(lo: object, hi: object, show: Callable[[object], str]) -> str:
    """Both ends of a range, one if they are the same."""
    return NONE if lo is None else " \u2013 ".join(show(v) for v in dict.fromkeys((lo, hi)))


def names_text(keys: Sequence[str], shown: int = 3, width: int | None = None) -> str:
    """All names if there are no more than ``shown``; else how many there are, the first ones and how many more.

    With a ``width``, as many of the first as fit it.
    """
    forms = [", ".join(keys) or NONE if len(keys) <= k else f"{len(keys)} ({', '.join([*keys[:k], f'+{len(keys) - k} others'])})" for k in range(shown, -1, -1)]
    return next((f for f in forms if width is None or len(f) <= width), forms[-1])
