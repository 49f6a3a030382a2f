import random

import pytest
from pyspark.sql import functions as F

from darkslide.operators import where as w
from darkslide.schema import PHOTO_SCHEMA

HARBOUR = {"path": "harbour", "date": "2021-08-30", "time": "06:12:40", "datetime": "2021-08-30 06:12:40", "hour": 6, "month": 8, "maker": "Nikon", "model": "Z 8", "lens": "NIKKOR Z 100-400mm", "iso": 64, "fnumber": 8.0, "shutter": 0.01, "focal": 210.0, "bias": -0.7, "gps": True}
CELLAR = {"path": "cellar", "date": "2023-02-28", "time": "19:47:03", "datetime": "2023-02-28 19:47:03", "hour": 19, "month": 2, "maker": "FUJIFILM", "model": "X-T5", "lens": "XF23mmF2 R WR", "iso": 5000, "fnumber": 2.0, "shutter": 0.05, "focal": 23.0, "flash": True}
MEADOW = {"path": "meadow", "date": "2021-12-01", "time": "13:00:00", "datetime": "2021-12-01 13:00:00", "hour": 13, "month": 12, "maker": "Panasonic", "model": "DC-S5", "iso": 250, "fnumber": 3.5, "shutter": 1.3, "focal": 35.0, "bias": 1.0, "flash": False}
EMPTY = {"path": "empty"}
MIDNIGHT = {"path": "midnight", "time": "00:00:09.25", "datetime": "2020-05-17 00:00:00"}
ROWS = [HARBOUR, CELLAR, MEADOW, EMPTY, MIDNIGHT]
NAMED = "harbour cellar meadow"
ALL = f"{NAMED} empty midnight"

# One group for each rule of the language: the filters, and the records that each keeps.
CASES = {
    "a missing number fails every comparison": [("iso>1000", "cellar"), ("iso<=250", "harbour meadow"), ("focal!=23", "harbour meadow"), ("iso!=1", NAMED), ("bias<0", "harbour"), ("shutter>=1.3", "meadow")],
    "a wider aperture is a smaller f-number": [("aperture>3.5", "cellar"), ("aperture<=3.5", "harbour meadow"), ("aperture==8", "harbour")],
    "a missing text differs from every text": [('lens!="none"', ALL), ('maker=="FUJIFILM"', "cellar"), ('model<"Y"', "cellar meadow")],
    "a missing flag is false": [("gps!=true", "cellar meadow empty midnight"), ("flash==true", "cellar"), ("flash==false", "harbour meadow empty midnight")],
    "text holds text, whatever the case": [('lens~"XF"', "cellar"), ('lens~"nikkor"', "harbour"), ('not lens~"mm"', "meadow empty midnight"), ('date~"2021-"', "harbour meadow")],
    "dates, quoted or not": [('date>="2021-09-01" and date<"2023-03"', "cellar meadow"), ("date<2021-12-01", "harbour"), ('date>"2022"', "cellar")],
    "times and datetimes of mixed precision": [('time<"06:13"', "harbour midnight"), ('time=="13:00"', "meadow"), ('time=="00:00:09.25"', "midnight"), ('time=="00:00:09.250"', ""), ('datetime=="2020-05-17"', "midnight"), ("datetime>=2021-12-01T13:00", "cellar meadow")],
    "whole numbers of the clock and the calendar": [("hour>13", "cellar"), ("month<=8", "harbour cellar")],
    "not is the complement, and binds before or": [("not iso>1000", "harbour meadow empty midnight"), ("not not iso>1000", "cellar"), ('iso>4000 or maker=="Nikon" and focal<100', "cellar"), ('(iso>4000 or maker=="Nikon") and focal<100', "cellar"), ('(iso>4000 or maker=="Nikon") and focal>100', "harbour")],
}


@pytest.fixture(scope="module")
def photos(spark):
    return spark.createDataFrame([tuple(r.get(f.name) for f in PHOTO_SCHEMA) for r in ROWS], PHOTO_SCHEMA)


def test_rules(photos):
    cases = [c for group in CASES.values() for c in group]
    got = photos.select("path", *(w.where_column(photos, text).alias(f"c{i}") for i, (text, _) in enumerate(cases))).collect()
    for i, (text, want) in enumerate(cases):
        assert {r["path"] for r in got if r[f"c{i}"]} == set(want.split()), text
        assert {r["path"] for r in ROWS if w.matches(w.parse(text), r)} == set(want.split()), text


@pytest.mark.parametrize("text", ["", " \t", "focal<=", "model", "gps", "width>1", "maker==7", 'focal=="wide"', 'shutter~"1"', "flash<false", 'gps=="yes"', "month==false", "((hour>1)", "hour>1 or", "model=='Z 8'", "datetime==12", "maker!=true", "iso := 5", "iso>1 iso<2"])
def test_errors(text):
    with pytest.raises(w.WhereError):
        w.parse(text)


@pytest.mark.parametrize(("text", "line", "column"), [("hour>5  && hour<3", 1, 9), ("&", 1, 1), ("iso>1 and\n  focal ?", 2, 9), ("(iso>1", 1, 7)])
def test_error_points_at_the_place(text, line, column):
    """Lines and columns count from 1; a caret stands below the place."""
    with pytest.raises(w.WhereError, match=rf"line {line}, column {column}:") as e:
        w.parse(text)
    assert str(e.value).splitlines()[-1] == " " * (column - 1) + "^"


def test_random_trees_against_plain_python(photos):
    r = random.Random(3)

    def leaf():
        return r.choice([f"iso{op}{v}" for op in ("<", ">", "==", "!=", "<=", ">=") for v in (64, 250)] + [f'{f}{op}"{v}"' for f, v in (("lens", "X"), ("maker", "Nikon"), ("date", "2022")) for op in ("<", "!=", "==", ">=")] + ["flash==true", "gps!=false", 'lens~"f2"', 'time<"13:00:00"', "aperture<3.5"])

    def tree(d):
        k = r.random()
        return leaf() if d == 0 or k < 0.2 else f"not {tree(d - 1)}" if k < 0.4 else f"({tree(d - 1)} {r.choice(('and', 'or'))} {tree(d - 1)})"

    texts = [tree(3) for _ in range(60)]
    got = photos.select("path", *(w.where_column(photos, t).alias(f"c{i}") for i, t in enumerate(texts))).collect()
    for i, t in enumerate(texts):
        for row, record in zip(got, ROWS):
            assert row[f"c{i}"] == w.matches(w.parse(t), record), (t, record["path"])


def test_no_python_in_the_plan_and_filter_is_never_null(photos):
    df = w.where(photos, 'iso>500 or lens!="x"')
    assert "Python" not in df._jdf.queryExecution().toString()
    assert photos.where(w.where_column(photos, 'not lens~"x" and iso!=3').isNull()).count() == 0


def test_column_that_is_not_there(spark):
    df = spark.createDataFrame([("a",)], "path string")
    assert w.where(df, 'lens!="x" and not iso>3').count() == 1
    assert w.where(df.withColumn("iso", F.lit("abc")), "iso>3").count() == 0
