import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from darkslide.functions import buckets, text
from darkslide.operators import organize, resize, sort, summary
from darkslide.schema import PHOTO_SCHEMA, is_raw

BASE = {"path": "/r/x.NEF", "date": "2019-11-03", "time": "17:20:31", "datetime": "2019-11-03 17:20:31", "model": "Z 6", "maker": "Nikon", "lens": "NIKKOR Z 40mm", "iso": 1250, "fnumber": 5.6, "shutter": 1 / 60, "focal": 40.0, "size_bytes": 7}


def records(spark, *overrides):
    rows = [BASE | {"path": f"/r/{i}.NEF"} | o for i, o in enumerate(overrides)]
    return spark.createDataFrame([tuple(r.get(f.name) for f in PHOTO_SCHEMA) for r in rows], PHOTO_SCHEMA)


#: Dimension: values of its field, and the bins that come out, in their order, with their counts.
BINS = {
    "iso": ("iso", [0, 101, 800, 801, 6401, 2 * 10**9, -1, None], [("≤100", 1), ("101–200", 1), ("401–800", 1), ("801–1600", 1), (">6400", 1)]),
    "aperture": ("fnumber", [1.7, 1.9, 3.4, 7.1, 22.4, None], [("f/1.8", 2), ("f/3.5", 1), ("f/22", 1)]),
    "focal": ("focal", [0.0, 19.9, 20.0, 69.9, 70.0, 599.0, 600.0, 1e4, None], [("<20mm ultra-wide", 2), ("20-35mm wide", 1), ("35-70mm standard", 1), ("70-200mm tele", 1), ("200-600mm long", 1), (">600mm super-tele", 1)]),
    "hour": ("time", ["00:00:01", "23:59", "07", "7", "24:00:00", "xx:00", None], [("00", 1), ("07", 1), ("23", 1)]),
    "bias": ("bias", [-0.5, 0.5, 1.5, -1.51, 7.0, None], [("-2 EV", 1), ("0 EV", 2), ("+2 EV", 1), ("+3 EV", 1)]),
    "rating": ("rating", [-1, 0, 1, 5, 6, None], [("unrated", 3), ("1", 1), ("5", 2)]),
    "shutter": ("shutter", [1 / 9000, 0.7, 0.71, 3.0, 500.0, 0.0, -1.0, None], [("1/8000", 1), ("1/2", 1), ("1s", 1), ("4s", 1), ("120s", 1)]),
    "year": ("date", ["2001-05-06", "1999", "199", None], [("1999", 1), ("2001", 1)]),
    "day": ("date", ["2001-05-06", "2001-05", None], [("2001-05-06", 1)]),
    "lens": ("lens", ["b", "b", "a", "c", "", None], [("b", 2), ("a", 1), ("c", 1)]),
}


@pytest.mark.parametrize("name", BINS)
def test_bins(spark, name):
    field, values, want = BINS[name]
    rows = summary.by_dimension(records(spark, *({field: v} for v in values)), name).collect()
    assert [(r["key"], r["count"]) for r in rows] == want
    assert all(r["share"] == r["count"] / len(values) for r in rows)  # of all records, those without a key included


def test_an_aperture_off_the_list_is_a_folder(spark):
    values = {7.1: "f_7.1", 13.0: "f_13", None: "_unknown", 5.6: "f_5.6", 0.95: "f_1"}
    df = records(spark, *({"fnumber": v} for v in values))
    assert [r[0] for r in df.select(organize.folder_key("aperture")).collect()] == list(values.values())


def test_nearest_stops_against_python(spark):
    values = [0.7 + 0.1 * i for i in range(330)]
    df = spark.createDataFrame([(v,) for v in values], "f double")
    for v, got in df.select("f", buckets.aperture(F.col("f"))).collect():
        best = min(buckets.APERTURES, key=lambda s: abs(s - v))
        assert got == (f"f/{best:g}" if abs(best - v) / best < 0.06 else f"f/{v:g}"), v


def test_totals(spark):
    t = summary.totals(records(spark, {"date": "2020-12-31", "bias": -1.0}, {"date": "2022-02-01", "lens": "", "flash": True}, {"iso": None, "date": None, "gps": True, "time": "03:00"})).first()
    assert (t["count"], t["total_bytes"], t["days_spanned"], t["n_lensless"], t["n_lenses"]) == (3, 21, 398, 1, 1)
    assert (t["span_years"], t["span_months"], t["span_days"]) == (1, 1, 1) and (t["flash_on"], t["flash_off"], t["gps_yes"], t["gps_no"]) == (1, 2, 1, 2)
    assert t["hours_present"] == [3, 17] and (t["iso_min"], t["iso_max"]) == (1250, 1250) and (t["bias_min"], t["bias_max"]) == (-1.0, -1.0)
    none = summary.totals(records(spark)).first()
    assert (none["count"], none["total_bytes"], none["days_spanned"], none["date_min"], none["hours_present"]) == (0, 0, 0, None, [])


def test_report(spark):
    import json

    assert json.loads(summary.report(records(spark)).first()[0]) == {"total": {"count": 0}}
    rows = ({}, {"model": "Zf", "iso": 64}, {"model": "Zf", "shutter": 2.0, "date": None}, {"time": None, "bias": 1.0, "rating": 4})
    out = json.loads(summary.report(records(spark, *rows)).first()[0])
    assert out["by_camera"] == [{"key": "Z 6", "count": 2, "share": 0.5}, {"key": "Zf", "count": 2, "share": 0.5}] and out["total"]["count"] == 4
    for n in buckets.DIMENSIONS:
        assert out[f"by_{n}"] == [r.asDict() for r in summary.by_dimension(records(spark, *rows), n).collect()]


def test_filter_commutes_with_breakdown(spark):
    from darkslide.operators.where import where

    text = 'shutter<0.01 or maker=="Leica"'
    df = records(spark, {"shutter": 0.004}, {"shutter": 0.5}, {"shutter": None, "maker": "Leica", "lens": "M 35"})
    kept = [r["path"] for r in where(df, text).collect()]
    a = summary.by_dimension(where(df, text), "lens").collect()
    assert len(kept) == 2
    assert a == summary.by_dimension(df.where(F.col("path").isin(kept)), "lens").collect()


def test_sort(spark):
    df = records(spark, {"path": "/a/b", "iso": 5, "model": "X"}, {"path": "/a-b", "iso": 5, "model": "x"}, {"path": "/c", "iso": None, "model": "X"}, {"path": "/d", "iso": 9, "model": None})
    paths = lambda *a: [r["path"] for r in sort.sort_records(df, *a).collect()]
    assert paths("iso") == ["/a/b", "/a-b", "/d", "/c"]
    assert paths("iso", True) == ["/d", "/a/b", "/a-b", "/c"]  # missing last and ties by path in either direction
    assert paths("model,iso") == ["/a/b", "/a-b", "/c", "/d"]
    for bad in ("", "iso,", "iso,iso", "size"):
        with pytest.raises(ValueError):
            sort.parse_keys(bad)


def test_organize(spark):
    df = records(spark, {"path": "/s/Wolf.NEF", "date": "2018-07-09"}, {"path": "/s/t/WOLF.nef", "date": "2018-07-30"}, {"path": "/s/fox.NEF", "date": None}, {"path": "/s/straße.nef", "date": None}, {"path": "/s/STRASSE.nef", "date": None})
    moves = organize.plan(df, ["month"], "/to/")
    assert {r["tgt"] for r in moves.collect()} == {"/to/2018-07/Wolf.NEF", "/to/2018-07/WOLF.nef", "/to/_unknown/fox.NEF", "/to/_unknown/straße.nef", "/to/_unknown/STRASSE.nef"}
    assert {tuple(r) for r in organize.collisions(moves).collect()} == {("/to/2018-07/wolf.nef", 2, "/s/Wolf.NEF"), ("/to/2018-07/wolf.nef", 2, "/s/t/WOLF.nef"), ("/to/_unknown/strasse.nef", 2, "/s/straße.nef"), ("/to/_unknown/strasse.nef", 2, "/s/STRASSE.nef")}
    files = spark.createDataFrame([("/s/fox.JPEG",), ("/s/fox.NEF",), ("/s/Fox.xmp",), ("/s/t/fox.xmp",), ("/s/fox.txt",)], "path string")
    assert {(r["src"], r["tgt"]) for r in organize.with_sidecars(moves, files).where("kind = 'sidecar'").collect()} == {("/s/fox.JPEG", "/to/_unknown/fox.JPEG")}
    there = spark.createDataFrame([("/to/_unknown/fox.NEF",)], "path string")
    assert {r["src"]: r["action"] for r in organize.with_actions(moves, there).collect()} == {"/s/fox.NEF": "skip", "/s/Wolf.NEF": "move", "/s/t/WOLF.nef": "move", "/s/straße.nef": "move", "/s/STRASSE.nef": "move"}
    assert {r["action"] for r in organize.with_actions(moves, there, True).collect()} == {"move"}
    assert {tuple(r) for r in organize.reveal_groups(df.where("date is not null")).collect()} == {("/s", 1, "/s/Wolf.NEF"), ("/s/t", 1, "/s/t/WOLF.nef")}
    assert organize.parse_chain(" Camera, model") == ["camera", "model"] and organize.parse_chain("") == []
    for bad in ("iso,lens,iso", "weather", "iso,"):
        with pytest.raises(ValueError):
            organize.parse_chain(bad)


def test_resize(spark):
    def size(w, h, **k):
        a, b = resize.target_size(F.lit(w), F.lit(h), **k)
        return tuple(spark.range(1).select(a, b).first())

    assert size(4000, 3000, long=2000) == (2000, 1500) and size(4000, 3000, short=1080) == (1440, 1080) and size(4000, 3000, megapixels=3.0) == (2000, 1500)
    assert size(1000, 800, long=2000) == (1000, 800) and size(10000, 1, long=1) == (1, 1) and size(7, 5) == (7, 5)
    with pytest.raises(ValueError):
        size(1, 1, long=1, short=1)


def test_texts():
    assert {x: text.shutter_text(x) for x in (1 / 8000, 0.3, 0.6, 0.7, 0.95, 1.0, 2.5, 120.0, None, 0.0, -2.0)} == {1 / 8000: "1/8000", 0.3: "1/3", 0.6: "1/2", 0.7: "0.7s", 0.95: "0.95s", 1.0: "1s", 2.5: "2.5s", 120.0: "120s", None: "-", 0.0: "-", -2.0: "-"}
    assert [text.bias_text(x) for x in (0.0, -0.001, 0.3333, -1.6666, 2.0, None)] == ["0", "0", "+0.33", "-1.67", "+2", "-"]
    assert [text.iso_text(x) for x in (0, 51200, None)] == ["0", "51200", "-"] and text.aperture_text(0.95) == "f/0.95" and text.focal_text(16.5) == "16.5mm" and text.focal_text(None) == "-"
    assert text.hours_text([0, 5, 6, 9, 10, 11]) == "00, 05–06, 09–11" and text.hours_text([]) == "—"
    assert [text.size_text(n) for n in (0, 1023, 1024, 10240, 1536 * 1024, 5 * 2**30, 3 * 2**50)] == ["0 B", "1023 B", "1.00 KiB", "10.0 KiB", "1.50 MiB", "5.00 GiB", "3072.0 TiB"]
    assert text.names_text([]) == "-" and text.names_text(["x", "y", "z"]) == "x, y, z" and text.names_text(list("vwxyz")) == "5 (v, w, x, +2 others)"
    assert [text.names_text(["one", "two", "three", "four"], width=w) for w in (40, 27, 22, 3)] == ["4 (one, two, three, +1 others)", "4 (one, two, +2 others)", "4 (one, +3 others)", "4 (+4 others)"]
    assert text.extent_text(None, None, str) == "-" and text.extent_text(2, 2, str) == "2" and text.extent_text(2, 3, text.focal_text) == "2mm – 3mm"


def test_suffixes():
    assert is_raw("/a/b.CR3") and not is_raw("/a/.cr3") and not is_raw("/a/b.jpg")


def test_cache_states(spark, tmp_path):
    from darkslide.sources.cache import Snapshot

    schema = _parse_datatype_string("abspath string, dev bigint, ino bigint, size bigint, mtime_ns bigint, iso int")
    cache = Snapshot(spark, str(tmp_path / "c"), schema)
    row = lambda p, m, iso: (p, 1, 1, 5, m, iso)
    cache.put(spark.createDataFrame([row("/a", 1, 100), row("/b", 1, 200)], schema))
    cache.put(spark.createDataFrame([row("/b", 2, 300)], schema))
    assert {(r["abspath"], r["iso"]) for r in cache.read().collect()} == {("/a", 100), ("/b", 300)}
    files = spark.createDataFrame([("/a", 1, 1, 5, 1), ("/b", 1, 1, 5, 9), ("/n", 1, 1, 5, 1)], "abspath string, dev bigint, ino bigint, size bigint, mtime_ns bigint")
    from darkslide.sources import cache as states

    assert [r["abspath"] for r in states.hits(files, cache.read()).collect()] == ["/a"]
    assert {r["abspath"] for r in states.misses(files, cache.read()).collect()} == {"/b", "/n"}
    moves = spark.createDataFrame([("/a", "/z", 1, 2, 5, 3)], "src string, tgt string, dev bigint, ino bigint, size bigint, mtime_ns bigint")
    cache.relocate(moves)
    assert {r["abspath"] for r in cache.read().collect()} == {"/z", "/b"}
    assert cache.vacuum(spark.createDataFrame([("/z",)], "abspath string")) == 1
    cache.enable(False)
    assert not cache.enabled and cache.read().count() == 0
    cache.enable()
    assert cache.info()["rows"] == 1 and cache.clear() == 1 and cache.read().count() == 0


def test_stream(spark, tmp_path):
    from darkslide.streaming.watch import record_stream, running_breakdown

    records(spark, {"iso": 100}, {"iso": 6400}, {"iso": None}).write.parquet(str(tmp_path / "in"))
    q = running_breakdown(record_stream(spark, str(tmp_path / "in")), "iso", "iso>0").writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r["key"], r["count"]) for r in spark.table("seen").collect()} == {("≤100", 1), ("3201–6400", 1)}
