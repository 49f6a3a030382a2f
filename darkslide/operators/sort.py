"""Sorting of records: several keys, what is missing last in either direction, ties by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("file", "datetime", "date", "time", "model", "lens", "focal", "aperture", "fnumber", "shutter", "bias", "iso")


def parse_keys(spec: str) -> list[str]:
    """A comma list of sort keys, none twice."""
    keys = [k.strip().lower() for k in spec.split(",")]
    for i, k in enumerate(keys):
        if not k:
            raise ValueError("empty sort key")
        if k not in KEYS:
            raise ValueError(f"unknown sort key `{k}`; one of {', '.join(KEYS)}")
        if k in keys[:i]:
            raise ValueError(f"sort key `{k}` twice")
    return keys


def _value(key: str) -> Column:
    if key == "file":
        return F.lower(F.substring_index("path", "/", -1))
    if key in ("model", "lens"):
        return F.nullif(F.lower(F.col(key)), F.lit(""))
    return F.col("fnumber" if key == "aperture" else key)


def path_order(path: str = "path") -> Column:
    """Paths by their components, as ``a/b`` stands before ``a-b``."""
    return F.split(path, "/")


def sort_columns(spec: str = "datetime", reverse: bool = False) -> list[Column]:
    order = [_value(k).desc_nulls_last() if reverse else _value(k).asc_nulls_last() for k in parse_keys(spec)]
    return [*order, path_order().asc()]  # ties keep the order of paths in either direction


def sort_records(df: DataFrame, spec: str = "datetime", reverse: bool = False, limit: int | None = None) -> DataFrame:
    out = df.orderBy(*sort_columns(spec, reverse))
    return out if limit is None else out.limit(limit)
