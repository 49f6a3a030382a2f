"""The photo record: one wide row in which anything may be missing."""

from __future__ import annotations

from pyspark.sql import types as T

PHOTO_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType(), False)]
    + [T.StructField(n, T.StringType()) for n in ("datetime", "date", "time")]
    + [T.StructField(n, T.IntegerType()) for n in ("year", "month", "day", "hour")]
    + [T.StructField(n, T.StringType()) for n in ("maker", "model", "lens")]
    + [T.StructField("iso", T.IntegerType())]
    + [T.StructField(n, T.DoubleType()) for n in ("fnumber", "shutter", "focal", "bias")]
    + [T.StructField(n, T.IntegerType()) for n in ("rating", "image_width", "image_height", "preview_width", "preview_height")]
    + [T.StructField(n, T.DoubleType()) for n in ("gps_lat", "gps_lon")]
    + [T.StructField("gps", T.BooleanType()), T.StructField("orientation", T.StringType()), T.StructField("flash", T.BooleanType()), T.StructField("size_bytes", T.LongType())]
)

#: Fields of the filter language, by what they hold.
NUMERIC = frozenset("iso fnumber aperture shutter focal bias rating gps_lat gps_lon hour year month day".split())
STRINGS = frozenset("lens model maker orientation".split())
BOOLEANS = frozenset(("gps", "flash"))
FIELDS = NUMERIC | STRINGS | BOOLEANS | {"date", "time", "datetime"}

# Suffixes of RAW files, in lower case.
RAW_SUFFIXES = frozenset(
    ".3fr .arw .bay .cap .cr2 .cr3 .crw .dcr .dcs .dng .drf .eip .erf .fff .gpr .iiq .k25 .kdc .mdc .mef .mos .mrw .nef .nrw .orf .ori .pef .ptx .pxn .raf .raw .rw2 .rwl .rwz .sr2 .srf .srw .x3f".split()
)


def suffix_of(name: str) -> str:
    """The lower-case suffix of a file name; none for a dotfile without another dot."""
    base = name.rsplit("/", 1)[-1]
    head, dot, tail = base.rpartition(".")
    return f".{tail.lower()}" if dot and head.strip(".") and tail else ""


def is_raw(name: str) -> bool:
    return suffix_of(name) in RAW_SUFFIXES
