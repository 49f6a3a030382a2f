import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from darkslide import cli
from darkslide.sources import containers as c
from darkslide.sources import rawphotos, sinks


def directory(entries, order, at):
    """A TIFF directory at an offset; entries: tag, type, count, raw bytes."""
    entries = sorted(entries)
    out, extra = struct.pack(order + "H", len(entries)), b""
    rest = at + 2 + 12 * len(entries) + 4
    for tag, kind, count, raw in entries:
        if len(raw) > 4:
            out += struct.pack(order + "HHII", tag, kind, count, rest + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            out += struct.pack(order + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
    return out + struct.pack(order + "I", 0) + extra


def tiff(order="<", magic=0x2A, iso_tag=0x8827, first=8, more=(), sparse=False):
    p = lambda f, *v: struct.pack(order + f, *v)
    text = lambda tag, s: (tag, 2, len(s) + 1, s.encode() + b"\0")
    exif = [(0x829A, 5, 1, p("II", 1, 250)), (0x829D, 5, 1, p("II", 28, 10)), (iso_tag, 3, 1, p("H", 800)), text(0x9003, "2024:01:02 03:04:05"), text(0x9291, "048"), (0x9204, 10, 1, p("ii", -1, 3)), (0x9209, 3, 1, p("H", 9)), (0x920A, 5, 1, p("II", 50, 1)), text(0xA434, "Jupiter-8 50mm")]
    gps = [text(1, "S"), (2, 5, 3, p("6I", 33, 1, 52, 1, 15, 1)), text(3, "W"), (4, 5, 3, p("6I", 151, 1, 12, 1, 40, 1))]
    base = [text(0x010F, "Zorki"), text(0x0110, "Zorki 4K"), (0x0112, 3, 1, p("H", 6)), (0x0100, 4, 1, p("I", 6000)), (0x0101, 4, 1, p("I", 4000)), *more]
    size = len(directory([*base, (0x8769, 4, 1, p("I", 0)), (0x8825, 4, 1, p("I", 0))], order, first))
    exif_at = first + size
    gps_at = exif_at + len(directory(exif, order, exif_at))
    body = directory([*base, (0x8769, 4, 1, p("I", exif_at)), (0x8825, 4, 1, p("I", gps_at))], order, first) + directory(exif, order, exif_at) + directory(gps, order, gps_at)
    head = {"<": b"II", ">": b"MM"}[order] + p("HI", magic, first)
    return (head, body) if sparse else head + b"\0" * (first - 8) + body


def read(data):
    return c.read_tags(lambda at, n: data[at : at + n])


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("magic", c.MAGICS)
def test_tiff(order, magic):
    t = read(tiff(order, magic))
    assert (t["make"], t["model"], t["iso"], t["lens"], t["orientation_code"]) == ("Zorki", "Zorki 4K", 800, "Jupiter-8 50mm", 6)
    assert (t["shutter"], t["fnumber"], t["focal"]) == (0.004, 2.8, 50.0) and abs(t["bias"] + 1 / 3) < 1e-9
    assert abs(t["gps_lat"] + 33.870833) < 1e-5 and abs(t["gps_lon"] + 151.211111) < 1e-5
    assert (t["image_width"], t["image_height"]) == (6000, 4000)


def test_iso_fallbacks_and_far_directory():
    assert read(tiff(iso_tag=0x8833))["iso"] == 800
    far = tiff(first=600_000)
    assert read(far)["model"] == "Zorki 4K" and read(far)["iso"] == 800
    head, body = tiff(first=(at := 3_000_000_000), sparse=True)  # a file of three gigabytes, of which only two windows are read
    assert c.read_tags(lambda lo, n: head.ljust(n, b"\0") if lo == 0 else (b"\0" * (at - lo) + body)[:n])["iso"] == 800


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_cr3():
    one = lambda entries: b"II" + struct.pack("<HI", 0x2A, 8) + directory(entries, "<", 8)
    cmt1 = one([(0x010F, 2, 6, b"Canon\0"), (0x0110, 2, 7, b"EOS R6\0")])
    cmt2 = one([(0x8827, 3, 1, struct.pack("<H", 1600)), (0x829D, 5, 1, struct.pack("<II", 4, 1))])
    data = box(b"ftyp", b"crx isom") + box(b"moov", box(b"uuid", c.CANON_BOX + box(b"CMT1", cmt1) + box(b"CMT2", cmt2)))
    t = read(data)
    assert (t["make"], t["model"], t["iso"], t["fnumber"]) == ("Canon", "EOS R6", 1600, 4.0)


def jpeg(w, h, app=b"", body=b"xx"):
    exif = b"\xff\xe1" + struct.pack(">H", len(app) + 8) + b"Exif\0\0" + app if app else b""
    return b"\xff\xd8" + exif + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + b"\0" * 9 + b"\xff\xda\0\2" + body + b"\xff\xd9"


def test_raf_and_jpeg():
    data = b"FUJIFILMCCD-RAW ".ljust(0x54, b"\0") + struct.pack(">II", 0x60, 0) + b"\0" * 4 + jpeg(640, 480, tiff())
    assert read(data)["iso"] == 800
    assert c.jpeg_size(jpeg(640, 480)) == (640, 480) and c.jpeg_size(b"no") == (0, 0)
    assert c.largest_jpeg(b"RAW" + jpeg(160, 120) + b"zz" + jpeg(1600, 1200) + b"end") == jpeg(1600, 1200)
    assert c.largest_jpeg(b"nothing") is None


def test_xmp_fills_only_what_lacks():
    packet = b'<x:xmpmeta><rdf:Description tiff:Make="Other" exif:DateTimeOriginal="2020-01-01T01:02:03"/></x:xmpmeta>'
    assert read(tiff() + packet)["make"] == "Zorki"
    bare = b"II" + struct.pack("<HI", 0x2A, 8) + directory([(0x0112, 3, 1, struct.pack("<H", 1))], "<", 8)
    t = read(bare + packet)
    assert t["make"] == "Other" and t["taken"] == "2020:01:01 01:02:03"


@pytest.mark.parametrize("data", [b"", b"II", b"II*\0\xff\xff\xff\xff", b"\0" * 100, tiff()[:40], tiff()[:150], b"FUJIFILM", box(b"ftyp", b"crx ") + b"\0\0\0\1moov"])
def test_broken_files(data):
    assert isinstance(read(data), dict)


@pytest.fixture
def library(tmp_path):
    root = tmp_path / "lib"
    (root / "sub").mkdir(parents=True)
    (root / "a.CR2").write_bytes(tiff())
    (root / "b.arw").write_bytes(tiff(">") + jpeg(320, 200))
    (root / "broken.dng").write_bytes(b"junk")
    (root / "note.txt").write_text("x")
    (root / ".cr3").write_text("x")
    (root / "a.xmp").write_text("x")
    (root / "sub" / "c.NEF").write_bytes(tiff())
    return root


def test_listing(library):
    names = lambda **k: [p.rsplit("/", 1)[-1] for p in rawphotos.list_raws([str(library)], **k)]
    assert names() == ["a.CR2", "b.arw", "broken.dng"] and names(recursive=True) == ["a.CR2", "b.arw", "broken.dng", "c.NEF"]
    assert rawphotos.list_raws([str(library), str(library / "a.CR2"), str(library / "note.txt")]) == rawphotos.list_raws([str(library)])
    with pytest.raises(rawphotos.MissingInput):
        rawphotos.list_raws([str(library / "gone")])


def test_records(spark, library):
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in rawphotos.read_photos(spark, [str(library)], True).collect()}
    a = rows["a.CR2"]
    assert (a["datetime"], a["date"], a["time"], a["year"], a["hour"]) == ("2024-01-02 03:04:05.048", "2024-01-02", "03:04:05.048", 2024, 3)
    assert (a["maker"], a["model"], a["iso"], a["orientation"], a["flash"], a["gps"], a["rating"]) == ("Zorki", "4K", 800, "portrait", True, True, 0)
    b = rows["broken.dng"]
    assert b["maker"] is None and b["rating"] is None and b["size_bytes"] == 4


def test_model_prefixes(spark):
    from darkslide.functions.normalize import without_maker

    pairs = [("Zorki", "Zorki 4K", "4K"), ("KODAK COMPANY", "Kodak Retina IIc", "Retina IIc"), ("Zorki", "Zorkina 3", "Zorkina 3"), ("Agfa Ltd", "AGFA  Isolette", "Isolette"), ("Zorki", None, None), (None, "Mir", "Mir"), ("Mir", "Mir", "Mir"), ("Mir", "Mir ", "Mir ")]
    df = spark.createDataFrame(pairs, "maker string, model string, want string")
    assert all(r[0] == r[1] for r in df.select(without_maker(F.col("model"), F.col("maker")), "want").collect())


@pytest.fixture
def run(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("DARKSLIDE_CACHE_DIR", str(tmp_path / "cache"))

    def go(*args):
        code = cli.main([str(x) for x in args])
        said = capsys.readouterr()
        return code, said.out, said.err

    return go


class Terminal(io.StringIO):
    def isatty(self):
        return True


def test_command_line(library, tmp_path, run, monkeypatch):
    code, out, _ = run("ls", library, "-R", "-w", "iso>500", "-s", "file")
    assert code == 0 and [x.rsplit("/", 1)[-1] for x in out.split()] == ["a.CR2", "b.arw", "c.NEF"]
    assert "lens" in json.loads(run("ls", library, "--json")[1].splitlines()[0])
    assert run("ls", library, "-w", "iso>")[0] == 2 and run("ls", library, "-s", "nope")[0] == 2 and run("ls", library / "gone")[0] == 1
    assert "f/2.8" in run("summary", library, "--by", "aperture")[1] and run("summary", library, "--by", "iso,lens")[0] == 2
    assert json.loads(run("summary", library, "--json")[1])["total"]["count"] == 3
    assert "2 (portrait)" in run("summary", library)[1]
    record = json.loads(run("info", library / "b.arw", "--json")[1])
    assert record["gps_text"].startswith("-33.87") and record["embedded_jpegs"][0].startswith("JPEG 320x200 (") and "unavailable" in run("info", library / "broken.dng")[1]
    assert run("organize", library, "--by", "month", "-o", tmp_path / "out", "--copy")[0] == 0
    assert (tmp_path / "out" / "2024-01" / "a.CR2").exists() and (tmp_path / "out" / "2024-01" / "a.xmp").exists() and (tmp_path / "out" / "_unknown" / "broken.dng").exists()
    assert run("reveal", library / "a.CR2")[1].strip().endswith("1")
    assert json.loads(run("cache", "info")[1])["enabled"] is True
    for command in ("summary", "info"):  # a filter that keeps nothing
        code, out, err = run(command, library, "-w", "iso>99999")
        assert (code, out) == (1, "") and "no records" in err
    monkeypatch.chdir(library)  # without paths: the folder one is in
    assert len(run("ls")[1].split()) == 3
    monkeypatch.setattr("sys.stdin", Terminal())
    assert json.loads(run("summary", "--json")[1])["total"]["count"] == 3
    monkeypatch.setattr("sys.stdin", io.StringIO(f"{library / 'a.CR2'}\n\n"))
    assert json.loads(run("summary", "--json")[1])["total"]["count"] == 1


def test_extract(library, tmp_path, run, monkeypatch):
    assert run("extract", library / "b.arw", "-o", tmp_path / "jpg")[0] == 0 and (tmp_path / "jpg" / "b.jpg").read_bytes() == jpeg(320, 200)
    monkeypatch.chdir(tmp_path)
    assert run("extract", library / "b.arw")[0] == 0 and (tmp_path / "jpegs" / "b.jpg").exists()
    (tmp_path / "jpegs" / "b.jpg").write_bytes(b"mine")
    assert run("extract", library / "b.arw")[0] == 0 and (tmp_path / "jpegs" / "b.jpg").read_bytes() == b"mine"
    assert run("extract", library / "b.arw", "-f")[0] == 0 and (tmp_path / "jpegs" / "b.jpg").read_bytes() == jpeg(320, 200)
    assert run("extract", library)[0] == 1  # two files without a picture
    (library / "sub" / "B.cr2").write_bytes(b"x" + jpeg(9, 9))
    code, _, err = run("extract", library / "b.arw", library / "sub" / "B.cr2", "-f")
    assert code == 1 and "b.jpg" in err
    assert run("extract", library, "--long", "10", "--mp", "1")[0] == 2 and run("extract", library, "-q", "0")[0] == 2
    monkeypatch.setattr(cli, "_resizer", lambda quality: None)
    code, _, err = run("extract", library, "--long", "10")
    assert code == 1 and "Pillow" in err
    monkeypatch.setattr(cli, "_resizer", lambda quality: lambda data, w, h: f"{len(data)} {w} {h} {quality}".encode())
    assert run("extract", library / "b.arw", "--long", "160", "-q", "70", "-f")[0] == 0
    assert (tmp_path / "jpegs" / "b.jpg").read_text().split()[1:] == ["160", "100", "70"]


@pytest.fixture
def many(tmp_path):
    root = tmp_path / "many"
    root.mkdir()
    for i in range(60):
        (root / f"p{i:02}.nef").write_bytes(tiff(more=[(0x4746, 3, 1, struct.pack("<H", i % 6))]))
    (root / "junk.dng").write_bytes(b"junk")
    return root


def test_cached_reads_of_a_library(spark, many, tmp_path):
    from pyspark.sql.types import _parse_datatype_string

    from darkslide.sources.cache import Snapshot

    cache = Snapshot(spark, str(tmp_path / "cache"), _parse_datatype_string(rawphotos.CACHE_SCHEMA))
    rows = lambda df: sorted(map(repr, df.collect()))
    same = lambda: rows(rawphotos.read_photos(spark, [str(many)], cache=cache)) == rows(rawphotos.read_photos(spark, [str(many)]))
    assert same() and cache.read().count() == 61  # cold
    held = {r["abspath"]: r["mtime_ns"] for r in cache.read().collect()}
    assert same() and {r["abspath"]: r["mtime_ns"] for r in cache.read().collect()} == held  # warm
    (many / "p07.nef").write_bytes(tiff(iso_tag=0x8833, more=[(0x4746, 3, 1, struct.pack("<H", 1))]) + b"longer")
    (many / "p08.nef").unlink()
    (many / "new.nef").write_bytes(tiff())
    assert same()  # one changed, one gone, one new
    now = {r["abspath"]: r["mtime_ns"] for r in cache.read().collect()}
    assert {p for p in now if held.get(p) != now[p]} == {str(many / "p07.nef"), str(many / "new.nef")}
    assert cache.vacuum(rawphotos.existing(cache.read())) == 1 and cache.read().count() == 61
    marked = cache.read().withColumn("make", F.lit("Cached"))
    cache._replace(marked)
    assert {r["maker"] for r in rawphotos.read_photos(spark, [str(many)], cache=cache).collect()} == {"Cached"}  # nothing was read anew


def test_organize_keeps_the_cache(spark, many, tmp_path, run):
    assert run("ls", many)[0] == 0 and run("organize", many, "--by", "rating", "-o", tmp_path / "sorted")[0] == 0
    info = json.loads(run("cache", "info")[1])
    assert info["rows"] == 61 and run("cache", "vacuum")[1].strip() == "0"  # all rows are of the new places
    assert len(run("ls", tmp_path / "sorted", "-R", "-w", "rating==3")[1].split()) == 10


def test_backends(spark, library, tmp_path):
    records = [{"SourceFile": "/x/1.cr3", "EXIF:Make": "Zorki", "EXIF:Model": "Zorki 4K", "EXIF:ISO": "400", "FNumber": 2.8, "DateTimeOriginal": "2023:05:06 07:08:09", "Orientation": 6, "Rating": "none"}, {"SourceFile": "/x/2.cr3"}, {"Make": "nowhere"}]
    (tmp_path / "t.json").write_text(json.dumps(records))
    a, b = rawphotos.read_photos(spark, [str(tmp_path / "t.json")], backend="json").orderBy("path").collect()
    assert (a["maker"], a["model"], a["iso"], a["fnumber"], a["date"], a["orientation"], a["rating"]) == ("Zorki", "4K", 400, 2.8, "2023-05-06", "portrait", 0) and (b["path"], b["maker"], b["rating"]) == ("/x/2.cr3", None, None)
    with pytest.raises(ValueError, match="backend"):
        rawphotos.read_photos(spark, [], backend="other")
    with pytest.raises(ValueError, match="fallback"):
        rawphotos.read_photos(spark, [str(library)], fallback="other")
    rawphotos.register_fallback("lookup", lambda path: {"make": "Guess", "model": "Box", "iso": 50} if path.endswith("dng") else {"make": "Never"})
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in rawphotos.read_photos(spark, [str(library)], fallback="lookup").collect()}
    assert (rows["broken.dng"]["maker"], rows["broken.dng"]["iso"], rows["a.CR2"]["maker"], rows["a.CR2"]["iso"]) == ("Guess", 50, "Zorki", 800)


def test_table_and_prune(tmp_path):
    shown = sinks.table_text([{"path": "/a/x.CR3", "iso": 100, "fnumber": 2.8, "shutter": 0.004, "datetime": "2024-01-02 03:04:05", "model": "M", "lens": "L" * 40}], ["iso"])
    assert "iso ↑" in shown and "1/250" in shown and "2024-01-02 03:04" in shown and len(shown.splitlines()) == 3
    (tmp_path / "e" / "f").mkdir(parents=True)
    (tmp_path / "e" / ".DS_Store").write_text("")
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "x").write_text("")
    assert len(cli.prune(str(tmp_path))) == 2 and (tmp_path / "k").exists()
