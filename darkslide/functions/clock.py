"""Times and datetimes of mixed precision, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_time(text: str) -> str:
    """``HH:MM[:SS[.f]]`` with seconds and a fraction; a fraction that is there stays as it is."""
    head, dot, fraction = text.partition(".")
    return f"{head}:00.{fraction if dot else '000'}" if len(head) == 5 else f"{head}.{fraction if dot else '000'}"


def full_datetime(text: str) -> str:
    """A date as its midnight; a datetime with a blank and a full time."""
    day, gap, rest = text.replace("T", " ").partition(" ")
    return f"{day} {full_time(rest)}" if gap else f"{day} 00:00:00.000"


def full_time_column(c: Column) -> Column:
    head = F.substring_index(c, ".", 1)
    fraction = F.when(F.instr(c, ".") > 0, F.substr(c, F.instr(c, ".") + F.lit(1))).otherwise("000")
    return F.concat(head, F.when(F.length(head) == 5, ":00").otherwise(""), F.lit("."), fraction)


def full_datetime_column(c: Column) -> Column:
    c = F.translate(c, "T", " ")
    at = F.instr(c, " ")
    return F.when(at == 0, F.concat(c, F.lit(" 00:00:00.000"))).otherwise(F.concat(F.substr(c, F.lit(1), at), full_time_column(F.substr(c, at + F.lit(1)))))
