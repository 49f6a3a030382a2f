"""Metadata out of RAW containers: TIFF and its kin, CR3 boxes, RAF with a JPEG inside, XMP packets.

Plain Python on bytes; a container that can't be read gives no tags. Only the head of a file is read, and one more
window where its first directory lies farther on.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

#: Bytes of a file's head, and of the second window.
WINDOW = 256 * 1024
#: Entries of a directory, and sub-directories for the picture's size, at most.
ENTRIES, SUBS = 1000, 8

# Tag numbers of TIFF, EXIF and GPS directories, and of Panasonic's own.
IFD0 = {"make": 0x010F, "model": 0x0110, "orientation_code": 0x0112, "rating": 0x4746, "width": 0x0100, "height": 0x0101, "subs": 0x014A, "exif": 0x8769, "gps": 0x8825, "rw2_iso": 0x0017, "rw2_width": 0x0002, "rw2_height": 0x0003}
EXIF = {"shutter": 0x829A, "fnumber": 0x829D, "iso": 0x8827, "iso2": 0x8833, "taken": 0x9003, "apex": 0x9202, "bias": 0x9204, "flash_code": 0x9209, "focal": 0x920A, "subsec": 0x9291, "lens": 0xA434, "full_width": 0xA002, "full_height": 0xA003}
GPS = {"lat_ref": 1, "lat": 2, "lon_ref": 3, "lon": 4}
MAGICS = (0x2A, 0x55, 0x4F52)
#: Type code: size of an element and its struct code; rationals are two elements.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "x"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
CANON_BOX = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")

Reader = Callable[[int, int], bytes]


def _value(raw: bytes, kind: int, count: int, order: str) -> object:
    _, code = TYPES[kind]
    if code == "s":
        text = raw.split(b"\0", 1)[0]
        try:
            return text.decode("utf-8")
        except UnicodeDecodeError:
            return text.decode("latin-1")
    if code == "x":
        return raw
    flat = struct.unpack(f"{order}{code[0] * (count * len(code))}", raw)
    values = [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2])] if len(code) == 2 else list(flat)
    return values[0] if count == 1 else values


def directory(data: bytes, at: int, order: str, wanted: dict[str, int], base: int = 0) -> dict[str, object]:
    """The wanted entries of the directory at an offset; what points outside is left out. ``base``: the offset of the data's first byte."""
    names, out = {v: k for k, v in wanted.items()}, {}
    at -= base
    if at < 0 or at + 2 > len(data):
        return out
    (n,) = struct.unpack_from(order + "H", data, at)
    for i in range(min(n, ENTRIES)):
        entry = at + 2 + 12 * i
        if entry + 12 > len(data):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
        if tag not in names or kind not in TYPES or not count:
            continue
        size = TYPES[kind][0] * count
        start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0] - base
        if 0 <= start and start + size <= len(data):
            out[names[tag]] = _value(data[start : start + size], kind, count, order)
    return out


def _order(data: bytes) -> str | None:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    return order if order and len(data) >= 8 and struct.unpack_from(order + "H", data, 2)[0] in MAGICS else None


def _picture_size(data: bytes, order: str, ifd: dict, base: int) -> tuple[int, int] | None:
    """The largest of the first directory's size and its sub-directories'; else Panasonic's sensor."""
    subs = ifd.get("subs", [])
    found = [ifd, *(directory(data, s, order, {"width": 0x0100, "height": 0x0101}, base) for s in (subs if isinstance(subs, list) else [subs])[:SUBS] if isinstance(s, int))]
    sizes = [(d["width"], d["height"]) for d in found if isinstance(d.get("width"), int) and isinstance(d.get("height"), int) and d["width"] > 0 and d["height"] > 0]
    if not sizes and isinstance(ifd.get("rw2_width"), int) and isinstance(ifd.get("rw2_height"), int):
        sizes = [(ifd["rw2_width"], ifd["rw2_height"])]
    return max(sizes, key=lambda s: s[0] * s[1]) if sizes else None


def _degrees(parts: object, ref: object, negative: str) -> float | None:
    if not isinstance(parts, list) or len(parts) != 3:
        return None
    sign = ref if isinstance(ref, str) else ref.decode("latin-1") if isinstance(ref, bytes) else ""
    return (parts[0] + parts[1] / 60 + parts[2] / 3600) * (-1 if sign[:1].upper() == negative else 1)


def _gathered(ifd: dict, exif: dict, gps: dict, size: tuple[int, int] | None) -> dict[str, object]:
    out = {k: v for k, v in ifd.items() if k in ("make", "model", "orientation_code", "rating")}
    out |= {k: v for k, v in exif.items() if k in ("shutter", "fnumber", "taken", "apex", "bias", "flash_code", "focal", "subsec", "lens")}
    iso = next((x[0] if isinstance(x, list) and x else x for x in (exif.get("iso"), exif.get("iso2")) if x is not None), None)
    iso = iso if iso is not None else ifd.get("rw2_iso") if isinstance(ifd.get("rw2_iso"), int) and ifd["rw2_iso"] > 0 else None
    if iso is not None:
        out["iso"] = iso
    full = (exif.get("full_width"), exif.get("full_height"))
    if all(isinstance(x, int) and x > 0 for x in full):
        area = size[0] * size[1] if size else 0
        if area < 1_000_000 and full[0] * full[1] > area:  # what is there is a thumbnail's
            size = full
    if size:
        out["image_width"], out["image_height"] = size
    for name, neg in (("lat", "S"), ("lon", "W")):
        if (v := _degrees(gps.get(name), gps.get(f"{name}_ref"), neg)) is not None:
            out[f"gps_{name}"] = v
    return out


def tiff(data: bytes) -> dict[str, object]:
    """Tags of a TIFF or one of its kin."""
    order = _order(data)
    return _linked(data, order, struct.unpack_from(order + "I", data, 4)[0], 0) if order else {}


def _linked(data: bytes, order: str, first: int, base: int) -> dict[str, object]:
    """Tags of the directory at an offset and those that it points to, out of data that begins at ``base``."""
    ifd = directory(data, first, order, IFD0, base)
    at = lambda k: ifd[k] if isinstance(ifd.get(k), int) else -1
    return _gathered(ifd, directory(data, at("exif"), order, EXIF, base), directory(data, at("gps"), order, GPS, base), _picture_size(data, order, ifd, base))


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, first byte and end of each box of an ISO media file."""
    at = start
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        stop = end if size == 0 else at + size
        if size != 0 and size < head:
            return
        yield kind, at + head, min(stop, end)
        at = stop


def cr3(data: bytes) -> dict[str, object]:
    """Tags of Canon's boxes: each of CMT1, CMT2 and CMT4 is a TIFF of one directory."""
    found: dict[str, dict] = {}
    for kind, a, b in boxes(data, 0, len(data)):
        if kind == b"moov":
            for inner, c, d in boxes(data, a, b):
                if inner == b"uuid" and data[c : c + 16] == CANON_BOX:
                    for name, e, f in boxes(data, c + 16, d):
                        wanted = {b"CMT1": IFD0, b"CMT2": EXIF, b"CMT4": GPS}.get(name)
                        part = data[e:f]
                        if wanted and (order := _order(part)):
                            found[name.decode()] = directory(part, struct.unpack_from(order + "I", part, 4)[0], order, wanted)
    ifd = found.get("CMT1", {})
    size = (ifd["width"], ifd["height"]) if isinstance(ifd.get("width"), int) and isinstance(ifd.get("height"), int) else None
    return _gathered(ifd, found.get("CMT2", {}), found.get("CMT4", {}), size)


def jpeg_segments(data: bytes, at: int = 0) -> Iterator[tuple[int, int, int]]:
    """Marker, first byte and end of a JPEG's segments up to its scan."""
    if data[at : at + 2] != b"\xff\xd8":
        return
    at += 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        if marker in (0xD9, 0xDA):
            return
        (size,) = struct.unpack_from(">H", data, at + 2)
        yield marker, at + 4, at + 2 + size
        at += 2 + size


def jpeg_tags(data: bytes, at: int = 0) -> dict[str, object]:
    for marker, a, b in jpeg_segments(data, at):
        if marker == 0xE1 and data[a : a + 6] == b"Exif\0\0":
            return tiff(data[a + 6 : b])
    return {}


def jpeg_size(data: bytes) -> tuple[int, int]:
    """Width and height by the frame's header; zeros if there is none."""
    for marker, a, b in jpeg_segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and b - a >= 5 and a + 5 <= len(data):
            height, width = struct.unpack_from(">HH", data, a + 1)
            return width, height
    return 0, 0


def raf(data: bytes) -> dict[str, object]:
    if len(data) < 0x58:
        return {}
    (at,) = struct.unpack_from(">I", data, 0x54)
    return jpeg_tags(data, at)


def xmp(data: bytes) -> dict[str, object]:
    """Maker, model and capture time of an XMP packet, as attributes or elements."""
    packet = re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.S)
    if not packet:
        return {}
    text, out = packet[0].decode("utf-8", "replace"), {}
    for name, key in (("tiff:Make", "make"), ("tiff:Model", "model"), ("exif:DateTimeOriginal", "taken")):
        if m := re.search(rf"{name}\s*=\s*[\"']([^\"']*)[\"']|<{name}>([^<]*)</{name}>", text):
            value = (m[1] if m[1] is not None else m[2]).strip()
            if key == "taken":
                value = re.sub(r"^(\d{4})-(\d\d)-(\d\d)T(\d\d:\d\d:\d\d).*$", r"\1:\2:\3 \4", value)
            if value:
                out[key] = value
    return out


def read_tags(read: Reader) -> dict[str, object]:
    """Tags of a file that ``read(offset, size)`` gives bytes of. Anything unreadable gives none."""
    try:
        data = read(0, WINDOW)
        if data[4:8] == b"ftyp":
            return cr3(data)
        if data[:8] == b"FUJIFILM":
            (at,) = struct.unpack_from(">I", data, 0x54) if len(data) >= 0x58 else (0,)
            return jpeg_tags(read(at, WINDOW)) if at + 1024 > len(data) else raf(data)
        if order := _order(data):
            (first,) = struct.unpack_from(order + "I", data, 4)
            if first + 2 > len(data):
                return _far(read, order, first)
            out = tiff(data)
            return {**xmp(data), **out} if out else out
        return jpeg_tags(data)
    except (OSError, struct.error, ValueError, IndexError):
        return {}


def _far(read: Reader, order: str, first: int) -> dict[str, object]:
    """Tags where the first directory lies beyond the head, however far: out of a window around it."""
    start = max(0, first - WINDOW // 4)
    return _linked(read(start, WINDOW), order, first, start)


def largest_jpeg(data: bytes) -> bytes | None:
    """The largest whole JPEG inside a container, by the area of its frame, then by its length."""
    best, key, at = None, (0, 0), data.find(b"\xff\xd8\xff")
    while at >= 0:
        end = data.find(b"\xff\xd9", at)
        nxt = data.find(b"\xff\xd8\xff", at + 3)
        w, h = jpeg_size(data[at : at + (1 << 20)])
        if w and h:
            stop = data.find(b"\xff\xd9", at + 2)
            depth = nxt
            while 0 <= depth < stop:  # a thumbnail inside: its end isn't this one's
                stop = data.find(b"\xff\xd9", stop + 2)
                depth = data.find(b"\xff\xd8\xff", depth + 3)
            if stop > 0 and (w * h, stop - at) > key:
                best, key = data[at : stop + 2], (w * h, stop - at)
        if end < 0:
            break
        at = nxt
    return best
