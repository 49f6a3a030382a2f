"""Photographers' bins as Column expressions, with their keys in order."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import general

# Standard stops and the bounds and names of bins.
APERTURES = (1.0, 1.2, 1.4, 1.8, 2.0, 2.5, 2.8, 3.5, 4.0, 5.6, 8.0, 11.0, 16.0, 22.0, 32.0)
SHUTTERS = (*(1 / n for n in (8000, 4000, 2000, 1000, 500, 250, 125, 60, 30, 15, 8, 4, 2)), 1.0, 2.0, 4.0, 8.0, 15.0, 30.0, 60.0, 120.0)
ISO_TOPS = (100, 200, 400, 800, 1600, 3200, 6400)
FOCALS = ((0, 20, "<20mm ultra-wide"), (20, 35, "20-35mm wide"), (35, 70, "35-70mm standard"), (70, 200, "70-200mm tele"), (200, 600, "200-600mm long"), (600, 10000, ">600mm super-tele"))
#: An aperture this near to a stop, in proportion to the stop, is taken for it.
NEAR = 0.06

ISO_KEYS = ("\u2264100", *(f"{a + 1}\u2013{b}" for a, b in zip(ISO_TOPS, ISO_TOPS[1:])), ">6400")
APERTURE_KEYS = tuple(f"f/{s:g}" for s in APERTURES)
SHUTTER_KEYS = tuple(f"{s:g}s" if s >= 1 else f"1/{round(1 / s)}" for s in SHUTTERS)
FOCAL_KEYS = tuple(k for _, _, k in FOCALS)
BIAS_KEYS = tuple(f"{i:+d} EV" if i else "0 EV" for i in range(-3, 4))
RATING_KEYS = ("unrated", "1", "2", "3", "4", "5")
HOUR_KEYS = tuple(f"{h:02d}" for h in range(24))


def _chain(cases: list[tuple[Column, object]]) -> Column:
    out = F.when(*cases[0])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out


def iso(c: Column) -> Column:
    v = c.cast("bigint")
    return F.when(v >= 0, _chain([(v <= top, key) for top, key in zip(ISO_TOPS, ISO_KEYS)] + [(v <= 10**9, ISO_KEYS[-1])]))


def _last(test, lo: float, hi: float) -> float:
    """The last double from ``lo``, where a test holds, to ``hi``, where it doesn't; by bisection over their bits."""
    bits = lambda x: struct.unpack("<q", struct.pack("<d", x))[0]
    real = lambda n: struct.unpack("<d", struct.pack("<q", n))[0]
    a, b = bits(lo), bits(hi)
    while b - a > 1:
        mid = (a + b) // 2
        a, b = (mid, b) if test(real(mid)) else (a, mid)
    return real(a)


def _turns(stops: tuple, distance) -> list[float]:
    """For each stop but the last the greatest value that is no nearer to the next one."""
    return [_last(lambda x, i=i: distance(stops[i], x) <= distance(stops[i + 1], x), stops[i], stops[i + 1]) for i in range(len(stops) - 1)]


_APERTURE_TURNS = _turns(APERTURES, lambda s, x: abs(s - x))
_SHUTTER_TURNS = _turns(SHUTTERS, lambda s, x: abs(math.log(s) - math.log(x)))


def _aperture_ends() -> list[tuple[float, str | None]]:
    """Upper ends of the stretches of f-numbers that are one stop, or (None) none."""
    out: list[tuple[float, str | None]] = []
    for i, s in enumerate(APERTURES):
        first = _APERTURE_TURNS[i - 1] if i else 0.0
        top = _APERTURE_TURNS[i] if i < len(_APERTURE_TURNS) else 2 * s
        near = lambda x, s=s: abs(s - x) / s < NEAR
        if not near(math.nextafter(first, math.inf)):
            out.append((_last(lambda x: not near(x), first, s), None))
        out.append((top if near(top) else _last(near, s, top), APERTURE_KEYS[i]))
    return out


def aperture(c: Column) -> Column:
    f = c.cast("double")
    named = _chain([(f <= top, F.lit(key)) for top, key in _aperture_ends()])
    return F.coalesce(named, F.concat(F.lit("f/"), general(f)))


def shutter(c: Column) -> Column:
    s = c.cast("double")
    return F.when(s > 0, _chain([(s <= top, F.lit(key)) for top, key in zip(_SHUTTER_TURNS, SHUTTER_KEYS)]).otherwise(F.lit(SHUTTER_KEYS[-1])))


def focal(c: Column) -> Column:
    v = c.cast("double")
    return _chain([((v >= lo) & (v < hi), key) for lo, hi, key in FOCALS])


def bias(c: Column) -> Column:
    """Whole stops, halves to even, held to three."""
    i = F.greatest(F.lit(-3), F.least(F.lit(3), F.bround(c.cast("double")).cast("int")))
    return F.when(c.isNotNull(), F.element_at(F.array(*map(F.lit, BIAS_KEYS)), i + 4))


def rating(c: Column) -> Column:
    """Never null: what is missing or not above 0 is unrated. Between 0 and 1 it is 0, which is no bin."""
    r = c.try_cast("double")
    return F.when(r.isNull() | (r <= 0), "unrated").otherwise(F.least(r.cast("int"), F.lit(5)).cast("string"))


def hour(time: Column) -> Column:
    h = F.substring(time, 1, 2).try_cast("int")
    return F.when((F.length(time) >= 2) & h.between(0, 23), F.lpad(h.cast("string"), 2, "0"))


def _prefix(k: int):
    return lambda date: F.when(F.length(date) >= k, F.substring(date, 1, k))


year, month, day = _prefix(4), _prefix(7), _prefix(10)


def filled(c: Column) -> Column:
    return F.when(c != "", c)


#: Dimension: column it reads, bin, keys in order (None: ranked by count; "chrono": by key).
DIMENSIONS = {
    "camera": ("model", filled, None), "maker": ("maker", filled, None), "lens": ("lens", filled, None), "orientation": ("orientation", filled, None),
    "iso": ("iso", iso, ISO_KEYS), "aperture": ("fnumber", aperture, APERTURE_KEYS), "focal": ("focal", focal, FOCAL_KEYS), "shutter": ("shutter", shutter, SHUTTER_KEYS),
    "bias": ("bias", bias, BIAS_KEYS), "rating": ("rating", rating, RATING_KEYS), "hour": ("time", hour, HOUR_KEYS),
    "year": ("date", year, "chrono"), "month": ("date", month, "chrono"), "day": ("date", day, "chrono"),
}
ALIASES = {"model": "camera", "fnumber": "aperture"}
TITLES = {"camera": "Camera", "maker": "Maker", "lens": "Lens", "orientation": "Orientation", "iso": "ISO", "aperture": "Aperture", "focal": "Focal length", "shutter": "Shutter", "bias": "Bias", "rating": "Rating", "hour": "Hour", "year": "Year", "month": "Month", "day": "Day"}


def dimension(name: str) -> tuple[str, object, object]:
    """A dimension by name or alias."""
    name = name.strip().lower()
    if (key := ALIASES.get(name, name)) not in DIMENSIONS:
        raise ValueError(f"unknown dimension `{name}`; one of {', '.join(sorted({*DIMENSIONS, *ALIASES}))}")
    return DIMENSIONS[key]


def key_of(name: str) -> Column:
    column, binned, _ = dimension(name)
    return binned(F.col(column))
