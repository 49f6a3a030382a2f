"""From raw tags to photo records, all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PHOTO_SCHEMA


def stripped(c: Column) -> Column:
    """Without white space at the ends; null if nothing is left."""
    s = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(s != "", s)


def without_maker(model: Column, maker: Column) -> Column:
    """A model's name without the first word of the maker in front of it, if something is left."""
    first = F.concat(F.substring_index(maker, " ", 1), F.lit(" "))
    rest = F.ltrim(F.substr(model, F.length(first) + 1))
    return F.when(maker.isNotNull() & F.startswith(F.upper(model), F.upper(first)) & (rest != ""), rest).otherwise(model)


def orientation_class(code: Column) -> Column:
    return F.when(code.between(5, 8), "portrait").when(code.between(1, 4), "landscape")


def fired(flash: Column) -> Column:
    return flash.bitwiseAND(1) == 1


def aperture_of(fnumber: Column, apex: Column) -> Column:
    """The f-number, or that of the APEX value, to one decimal."""
    return F.coalesce(fnumber, F.bround(F.pow(F.lit(2.0), apex / 2), 1))


def normalize(tags: DataFrame) -> DataFrame:
    """Photo records of rows of raw tags (path, taken, subsec, make, model, lens, iso, fnumber, apex, shutter, ...).

    A capture time in a form other than ``YYYY:MM:DD HH:MM:SS`` stays in datetime as it is, without date and time.
    Year, month and day are set up to the first that is no number; hour by itself. A missing tag is a missing field.
    """
    raw = F.col("taken")
    good = (F.length(raw) >= 19) & (F.substring(raw, 5, 1) == ":") & (F.substring(raw, 8, 1) == ":")
    date = F.when(good, F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 6, 2), F.substring(raw, 9, 2)))
    fraction = stripped(F.col("subsec"))
    time = F.when(good, F.concat(F.substring(raw, 12, 8), F.coalesce(F.concat(F.lit("."), fraction), F.lit(""))))
    df = tags.withColumns({c: stripped(F.col(c)) for c in ("make", "model", "lens", "taken")})
    df = df.withColumns({"date": date, "time": time})
    df = df.withColumns({"datetime": F.when(F.col("date").isNotNull(), F.concat_ws(" ", "date", "time")).otherwise(F.col("taken")), "year": F.substring("date", 1, 4).try_cast("int")})
    df = df.withColumn("month", F.when(F.col("year").isNotNull(), F.substring("date", 6, 2).try_cast("int")))
    df = df.withColumn("day", F.when(F.col("month").isNotNull(), F.substring("date", 9, 2).try_cast("int")))
    df = df.withColumns({
        "hour": F.substring("time", 1, 2).try_cast("int"),
        "maker": F.col("make"),
        "model": without_maker(F.col("model"), F.col("make")),
        "fnumber": aperture_of(F.col("fnumber"), F.col("apex")),
        "orientation": orientation_class(F.col("orientation_code")),
        "flash": fired(F.col("flash_code")),
        "gps": F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), True),
        "rating": F.coalesce("rating", F.when(F.col("any_tag"), 0)),
        "preview_width": F.lit(None), "preview_height": F.lit(None),
    })
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in PHOTO_SCHEMA))
