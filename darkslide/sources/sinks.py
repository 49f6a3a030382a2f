"""Records as text: paths, JSON lines, an aligned table, key and value."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import aperture_text, bias_text, extent_text, focal_text, hours_text, iso_text, names_text, shutter_text, size_text
from ..operators import summary

#: Columns of the table: header, field, text, aligned right.
TABLE = (("file", "file", str, False), ("datetime", "datetime", lambda v: "-" if v is None else str(v)[:16], False), ("model", "model", lambda v: v or "-", False), ("lens", "lens", lambda v: v or "-", False), ("focal", "focal", focal_text, True), ("aperture", "fnumber", aperture_text, True), ("shutter", "shutter", shutter_text, True), ("bias", "bias", bias_text, True), ("iso", "iso", iso_text, True))
_WIDEST = {"file": 50, "lens": 32}


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, without what is missing."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_json_lines(df: DataFrame, path: str) -> None:
    json_lines(df).write.text(path)


def write_paths(df: DataFrame, path: str) -> None:
    df.select("path").write.text(path)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _folded(text: str, width: int) -> list[str]:
    lines, line = [], ""
    for c in text:
        if line and _width(line + c) > width:
            lines.append(line)
            line = ""
        line += c
    return [*lines, line]


def table_text(rows: list[dict], keys: list[str] | None = None, reverse: bool = False) -> str:
    """An aligned table of sorted records; an arrow marks the first sort key's column."""
    first = {"fnumber": "aperture"}.get(keys[0], keys[0]) if keys else None
    head = [h + (" \u2193" if reverse else " \u2191") * (h == first) for h, *_ in TABLE]
    cells = [[[show(r["path"].rsplit("/", 1)[-1] if field == "file" else r.get(field))] for _, field, show, _ in TABLE] for r in rows]
    for row in cells:
        for i, (h, *_) in enumerate(TABLE):
            row[i] = _folded(row[i][0], _WIDEST.get(h, 1000))
    widths = [max([_width(head[i]), *(_width(x) for row in cells for x in row[i])]) for i in range(len(TABLE))]
    pad = lambda t, i: (" " * (widths[i] - _width(t)) + t) if TABLE[i][3] else t + " " * (widths[i] - _width(t))
    out = ["  ".join(pad(h, i) for i, h in enumerate(head)).rstrip()]
    for row in cells:
        for k in range(max(map(len, row))):
            out.append("  ".join(pad(c[k] if k < len(c) else "", i) for i, c in enumerate(row)).rstrip())
    return "\n".join(out)


def breakdown_text(rows: list) -> str:
    """Key, count and per cent of a breakdown."""
    if not rows:
        return "no data"
    shown = [(r["key"], str(r["count"]), f"{round(r['share'] * 100)}%") for r in rows]
    w = [max(_width(s[i]) for s in shown) for i in range(3)]
    return "\n".join(f"{k}{' ' * (w[0] - _width(k))}  {c:>{w[1]}}  {p:>{w[2]}}" for k, c, p in shown)


def summary_text(df: DataFrame, where: str = "", width: int | None = None) -> str:
    """A folder's summary as key and value; names as many as fit the width of a terminal."""
    t = summary.totals(df).first().asDict()
    if not t["count"]:
        return "no records"
    names = {n: [r["key"] for r in summary.by_dimension(df, n).collect()] for n in ("camera", "lens", "maker")}
    pairs = ", ".join(f"{r['count']} ({r['key']})" for r in summary.by_dimension(df, "orientation").collect()) or "-"
    ratings = sorted(((r["key"], r["count"]) for r in summary.rating_distribution(df).collect()), key=lambda x: (x[0] != "unrated", x[0]))
    room = None if width is None else width - 13  # what the keys and the gap take
    many = lambda n, word: f"{n} {word}{'' if n == 1 else 's'}"
    rows = [("Filter", where)] * bool(where) + [
        ("Files", str(t["count"])), ("Size", size_text(t["total_bytes"])),
        ("Date range", f"{t['date_min']} \u2192 {t['date_max']}  ({many(t['span_years'], 'year')}, {many(t['span_months'], 'month')}, {many(t['span_days'], 'day')})" if t["date_min"] else "-"),
        ("Hours", hours_text(t["hours_present"])), ("Makers", names_text(names["maker"], width=room)), ("Cameras", names_text(names["camera"], width=room)), ("Lenses", names_text(names["lens"], width=room)),
        ("ISO", extent_text(t["iso_min"], t["iso_max"], iso_text)), ("Aperture", extent_text(t["fnumber_min"], t["fnumber_max"], aperture_text)), ("Shutter", extent_text(t["shutter_min"], t["shutter_max"], shutter_text)),
        ("Focal", extent_text(t["focal_min"], t["focal_max"], focal_text)), ("Bias", extent_text(t["bias_min"], t["bias_max"], bias_text)),
        ("Rating", ", ".join(f"{n} ({k})" for k, n in ratings)), ("Orientation", pairs), ("Flash", f"{t['flash_on']} (on), {t['flash_off']} (off)"), ("GPS", f"{t['gps_yes']} (yes), {t['gps_no']} (no)"),
    ]
    w = max(len(k) for k, _ in rows)
    return "\n".join(f"{k:<{w}}  {v}" for k, v in rows)


#: Order of a file's fields.
FILE_FIELDS = "datetime date time maker model lens iso fnumber shutter focal bias rating orientation flash image_width image_height gps gps_lat gps_lon".split()


def jpegs_text(width: int, height: int, size: int, error: str | None) -> list[str]:
    """What the pictures inside a file are, or why there is none."""
    return [f"unavailable ({error})" if error else f"JPEG {width}x{height} ({size_text(size)})"]


def file_record(row: dict, jpegs: list[str] | None = None) -> dict:
    """A file's record for display: present fields in order, its size, its place as text, the pictures inside."""
    out = {"path": row["path"], "size_bytes": row.get("size_bytes"), "size_human": size_text(row["size_bytes"]) if row.get("size_bytes") is not None else "-"}
    out |= {k: row[k] for k in FILE_FIELDS if row.get(k) is not None}
    if "datetime" not in out and (parts := [str(out[k]) for k in ("date", "time") if k in out]):
        out["datetime"] = " ".join(parts)
    lat, lon = out.get("gps_lat"), out.get("gps_lon")
    out["gps_text"] = "-" if lat is None or lon is None else f"{lat:.6f}, {lon:.6f}"
    return out | ({} if jpegs is None else {"embedded_jpegs": jpegs})
