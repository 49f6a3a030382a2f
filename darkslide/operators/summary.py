"""Totals and breakdowns of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import DIMENSIONS, dimension, key_of


def _is(name: str, df: DataFrame) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def totals(df: DataFrame) -> DataFrame:
    """One row of counts, extents and spans; of no records only the count isn't null, but for sums that are 0."""
    full = lambda c: F.nullif(_is(c, df).cast("string"), F.lit(""))
    lo, hi = F.try_to_date(F.col("date_min"), "yyyy-MM-dd"), F.try_to_date(F.col("date_max"), "yyyy-MM-dd")
    base = df.agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum(_is("size_bytes", df)), F.lit(0)).cast("long").alias("total_bytes"), F.min("date").alias("date_min"), F.max("date").alias("date_max"),
        *(f(c).alias(f"{c}_{n}") for c in ("iso", "fnumber", "focal", "shutter", "bias") for n, f in (("min", F.min), ("max", F.max))),
        F.count_distinct(full("model")).alias("n_cameras"), F.count_distinct(full("lens")).alias("n_lenses"), F.count_distinct(full("maker")).alias("n_makers"), F.count_if(full("lens").isNull()).alias("n_lensless"),
        F.count_if(F.coalesce(_is("flash", df).cast("boolean"), F.lit(False))).alias("flash_on"), F.count_if(F.coalesce(_is("gps", df).cast("boolean"), F.lit(False))).alias("gps_yes"),
        F.sort_array(F.collect_set(F.substring("time", 1, 2).try_cast("int"))).alias("hours_present"),
    )
    base = base.withColumns({"_a": lo, "_b": hi})
    base = base.withColumn("days_spanned", F.coalesce(F.datediff("_b", "_a") + 1, F.lit(0)))
    # whole years, months and days between: days are borrowed from the month before the end, and may stay below 0
    y, m, d = F.year("_b") - F.year("_a"), F.month("_b") - F.month("_a"), F.day("_b") - F.day("_a")
    borrowed = F.day(F.last_day(F.add_months("_b", -1)))
    months = F.when(d < 0, m - 1).otherwise(m)
    base = base.withColumns({
        "span_years": F.coalesce(F.when(months < 0, y - 1).otherwise(y), F.lit(0)), "span_months": F.coalesce(F.when(months < 0, months + 12).otherwise(months), F.lit(0)),
        "span_days": F.coalesce(F.when(d < 0, d + borrowed).otherwise(d), F.lit(0)), "flash_off": F.col("count") - F.col("flash_on"), "gps_no": F.col("count") - F.col("gps_yes"),
    })
    return base.drop("_a", "_b")


#: Columns of few distinct values, by the nature of cameras; exposure times and clock times have many.
_FEW = ("iso", "fnumber", "focal", "bias", "rating")


def by_dimension(df: DataFrame, name: str, ordered: bool = True) -> DataFrame:
    """(key, count, share) of a dimension. Shares are of all records, those without a key included.

    Bins come in their own order, dates by key, names by count. Keys outside a list of bins are left out.
    """
    column, binned, order = dimension(name)
    if isinstance(order, tuple) and column in _FEW:  # few raw values are binned, after a first count of them
        raw = df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        counted = raw.groupBy(binned(F.col("_v")).alias("key")).agg(F.sum("_c").alias("count"))
    else:
        counted = df.groupBy(key_of(name).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    # the groups are few: their sum over all is the number of records, keyless ones included
    total = counted.agg(F.sum("count").alias("_n"))
    out = counted.join(F.broadcast(total)).where("key is not null")  # one row
    if isinstance(order, tuple):
        out = out.where(F.col("key").isin(*order))
    out = out.withColumn("share", F.col("count") / F.col("_n"))
    if ordered:
        if isinstance(order, tuple):
            out = out.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col("key")))
        else:
            out = out.orderBy("key") if order == "chrono" else out.orderBy(F.desc("count"), "key")
    return out.select("key", "count", "share")


def by_dimensions(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts by several dimensions at once; what has no key counts under null. (An extension.)"""
    return df.groupBy(*(key_of(n).alias(n) for n in names)).agg(F.count(F.lit(1)).alias("count"))


def all_dimensions(df: DataFrame) -> DataFrame:
    """(dimension, ord, key, count, share) of all dimensions in a single pass over the records.

    Each record gives one row a set of keys that occur together; the sets are counted before they are taken apart, so that
    what is taken apart are the cameras, lenses and settings that were used, not the records.
    """
    sets = [("camera", "maker", "lens", "orientation", "rating"), ("iso", "aperture", "bias"), ("focal", "shutter"), ("hour", "year", "month"), ("day",)]
    keyed = df.select(*(key_of(n).cast("string").alias(n) for n in DIMENSIONS))
    either = F.array(*(F.struct(F.lit(i).alias("set"), *((F.col(n) if n in names else F.lit(None).cast("string")).alias(n) for n in DIMENSIONS)) for i, names in enumerate(sets)))
    met = keyed.select(F.explode(either).alias("x")).select("x.*").groupBy("set", *DIMENSIONS).agg(F.count(F.lit(1)).alias("_c"))
    pairs = F.array(*(F.struct(F.lit(n).alias("dimension"), F.col(n).alias("key"), (F.col("set") == i).alias("own")) for i, names in enumerate(sets) for n in names))
    counted = met.select("_c", F.explode(pairs).alias("p")).where("p.own").groupBy("p.dimension", "p.key").agg(F.sum("_c").alias("count"))
    total = counted.groupBy("dimension").agg(F.sum("count").alias("_n"))
    out = counted.join(F.broadcast(total), "dimension").where("key is not null").withColumn("share", F.col("count") / F.col("_n"))
    place = F.lit(0)
    keep = F.lit(True)
    for n, (_, _, order) in DIMENSIONS.items():
        if isinstance(order, tuple):
            at = F.array_position(F.array(*map(F.lit, order)), F.col("key"))
            place = F.when(F.col("dimension") == n, at).otherwise(place)
            keep = keep & ((F.col("dimension") != n) | (at > 0))
        elif order is None:
            place = F.when(F.col("dimension") == n, -F.col("count")).otherwise(place)
    return out.where(keep).select("dimension", place.cast("long").alias("ord"), "key", "count", "share")


def rating_distribution(df: DataFrame) -> DataFrame:
    """Counts by rating as it is; all that isn't above 0 is unrated."""
    r = F.col("rating").try_cast("int")
    return df.groupBy(F.when(r > 0, r.cast("string")).otherwise("unrated").alias("key")).agg(F.count(F.lit(1)).alias("count"))


def report(df: DataFrame) -> DataFrame:
    """One row with the whole summary as nested JSON: total and a list for each dimension; of no records the count alone."""
    lists = all_dimensions(df).groupBy("dimension").agg(F.sort_array(F.collect_list(F.struct("ord", "key", "count", "share"))).alias("items"))
    lists = lists.withColumn("items", F.transform("items", lambda x: F.struct(x["key"].alias("key"), x["count"].alias("count"), x["share"].alias("share"))))
    wide = lists.agg(*(F.coalesce(F.first(F.when(F.col("dimension") == n, F.col("items")), True), F.array().cast("array<struct<key:string,count:bigint,share:double>>")).alias(f"by_{n}") for n in DIMENSIONS))
    t = totals(df).withColumnsRenamed({"fnumber_min": "aperture_min", "fnumber_max": "aperture_max"})
    both = t.join(F.broadcast(wide))  # one row each
    full = F.to_json(F.struct(F.struct(*t.columns).alias("total"), *(f"by_{n}" for n in DIMENSIONS)))
    return both.select(F.when(F.col("count") == 0, F.to_json(F.struct(F.struct("count").alias("total")))).otherwise(full).alias("json"))


def duplicates(df: DataFrame) -> DataFrame:
    """Records of one camera and one time, to the fraction of a second. (An extension.)"""
    return df.where("datetime is not null and model is not null").groupBy("datetime", "model").agg(F.count(F.lit(1)).alias("count"), F.min("path").alias("first_path")).where("count > 1")


def paths_by_dimension(df: DataFrame, name: str) -> DataFrame:
    """(key, path), the records under each key; one row each, as a key may have any number. (An extension.)"""
    return df.select(key_of(name).alias("key"), "path").where("key is not null")
