"""The filter language: text to syntax tree, checked for types, compiled to a Column that is never null.

    or  := and ("or" and)*      and := not ("and" not)*      not := "not" not | atom
    atom := "(" or ")" | FIELD CMP value | FIELD "~" STRING

What is missing is decided by type, not by SQL's third value: a missing number fails every comparison, a missing
text differs from every text, a missing flag is false. ``not`` is the plain complement.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import full_datetime, full_datetime_column, full_time, full_time_column
from ..schema import BOOLEANS, FIELDS, NUMERIC, STRINGS


class WhereError(ValueError):
    """A filter that can't be read or doesn't fit its fields."""


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    kind: str
    value: object


@dataclass(frozen=True)
class Contains:
    field: str
    needle: str


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class Both:
    """All of ``parts`` if ``word`` is "and", else any."""

    word: str
    parts: tuple


_LEXER = re.compile(
    r"""(?P<space>\s+)
    |(?P<datetime>\d{4}-\d\d-\d\d[ T]\d\d:\d\d(?::\d\d(?:\.\d+)?)?)
    |(?P<date>\d{4}-\d\d-\d\d)
    |(?P<time>\d\d:\d\d(?::\d\d(?:\.\d+)?)?)
    |(?P<num>-?\d+(?:\.\d+)?)
    |(?P<str>"[^"]*")
    |(?P<cmp>>=|<=|==|!=|>|<)
    |(?P<mark>[()~])
    |(?P<word>[a-z_]+)""",
    re.X,
)
_FLIPPED = {">": "<", "<": ">", ">=": "<=", "<=": ">="}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while at < len(text):
        m = _LEXER.match(text, at)
        if not m:
            raise _syntax(text, at)
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0], at))
        at = m.end()
    return [*out, ("end", "", len(text))]


def _syntax(text: str, at: int) -> WhereError:
    line = text.count("\n", 0, at) + 1
    first = text.rfind("\n", 0, at) + 1
    shown = text[first:].split("\n", 1)[0]
    return WhereError(f"can't parse filter at line {line}, column {at - first + 1}:\n{shown}\n{' ' * (at - first)}^")


def parse(text: str) -> object:
    """The checked syntax tree of a filter."""
    text = text.strip()
    if not text:
        raise WhereError("empty filter")
    tokens, at = _tokens(text), 0

    def take(*wanted: str) -> tuple[str, str, int] | None:
        nonlocal at
        if tokens[at][0] in wanted or (tokens[at][0] in ("word", "mark") and tokens[at][1] in wanted):
            at += 1
            return tokens[at - 1]
        return None

    def need(*wanted: str) -> tuple[str, str, int]:
        if not (t := take(*wanted)):
            raise _syntax(text, tokens[at][2])
        return t

    def chain(word: str, below) -> object:
        parts = [below()]
        while take(word):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Both(word, tuple(parts))

    def either() -> object:
        return chain("or", lambda: chain("and", negated))

    def negated() -> object:
        return Not(negated()) if take("not") else atom()

    def atom() -> object:
        if take("("):
            inner = either()
            need(")")
            return inner
        kind, field, where = tokens[at]
        if kind != "word" or field not in FIELDS:
            raise _syntax(text, where)
        take("word")
        if take("~"):
            return _contains(field, need("str")[1][1:-1])
        op = need("cmp")[1]
        kind, value, _ = need("num", "str", "datetime", "date", "time", "true", "false")
        return _compare(field, op, "bool" if kind == "word" else kind, value)

    tree = either()
    if tokens[at][0] != "end":
        raise _syntax(text, tokens[at][2])
    return tree


def _contains(field: str, needle: str) -> Contains:
    if field not in STRINGS and field not in ("date", "time", "datetime"):
        raise WhereError(f"`~` needs a text field; `{field}` is none")
    return Contains(field, needle.lower())


def _compare(field: str, op: str, kind: str, raw: str) -> Compare:
    value: object = raw[1:-1] if kind == "str" else raw
    if field in NUMERIC:
        if kind != "num":
            raise WhereError(f"field `{field}` is numeric; got a {kind}")
        if field == "aperture":  # a wider aperture has a smaller f-number
            field, op = "fnumber", _FLIPPED.get(op, op)
        return Compare(field, op, "num", float(raw))
    if field in BOOLEANS:
        if kind != "bool" or op not in ("==", "!="):
            raise WhereError(f"field `{field}` is a flag; use `== true` or `== false`, or `!=`")
        return Compare(field, op, "bool", raw == "true")
    fits = {"date": ("date", "str"), "time": ("time", "str"), "datetime": ("datetime", "date", "str")}.get(field, ("str", "date", "time", "datetime"))
    if kind not in fits:
        raise WhereError(f"field `{field}` takes {' or '.join(fits)}; got a {kind}")
    if field == "time":
        return Compare(field, op, "time", full_time(value))
    if field == "datetime":
        return Compare(field, op, "datetime", full_datetime(value))
    return Compare(field, op, "text", value)


_OPS = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "==": Column.__eq__, "!=": Column.__ne__}


def compile_tree(tree: object, columns: set[str]) -> Column:
    """The tree as a Column over ``columns``; fields that aren't there are missing in every row."""
    if isinstance(tree, Both):
        parts = [compile_tree(p, columns) for p in tree.parts]
        return reduce(Column.__and__ if tree.word == "and" else Column.__or__, parts)
    if isinstance(tree, Not):
        return ~compile_tree(tree.inner, columns)
    c = F.col(tree.field) if tree.field in columns else F.lit(None).cast("string")
    if isinstance(tree, Contains):
        return F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(tree.needle)), F.lit(False))
    op, value = _OPS[tree.op], F.lit(tree.value)
    if tree.kind == "num":
        return F.coalesce(op(c.try_cast("double"), value), F.lit(False))
    if tree.kind == "bool":
        return op(F.coalesce(c.cast("boolean"), F.lit(False)), value)
    c = {"time": full_time_column, "datetime": full_datetime_column}.get(tree.kind, lambda x: x)(c.cast("string"))
    return F.coalesce(op(c, value), F.lit(tree.op == "!="))


def where_column(df: DataFrame, text: str) -> Column:
    return compile_tree(parse(text), set(df.columns))


def where(df: DataFrame, text: str) -> DataFrame:
    """Rows of ``df`` that a filter keeps."""
    return df.where(where_column(df, text))


def matches(tree: object, row: dict) -> bool:
    """What the filter says of one record, in plain Python: the reference for tests."""
    if isinstance(tree, Both):
        return (all if tree.word == "and" else any)(matches(p, row) for p in tree.parts)
    if isinstance(tree, Not):
        return not matches(tree.inner, row)
    v = row.get(tree.field)
    if isinstance(tree, Contains):
        return v is not None and tree.needle in str(v).lower()
    if tree.kind == "num":
        try:
            v = float(v)
        except (TypeError, ValueError):
            return False
    elif tree.kind == "bool":
        v = bool(v)
    elif v is None:
        return tree.op == "!="
    elif tree.kind in ("time", "datetime"):
        v = (full_time if tree.kind == "time" else full_datetime)(v)
    return {">": v > tree.value, "<": v < tree.value, ">=": v >= tree.value, "<=": v <= tree.value, "==": v == tree.value, "!=": v != tree.value}[tree.op]
