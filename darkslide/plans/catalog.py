"""The engine's queries over ``shots``, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets
from ..functions.normalize import normalize
from ..operators import organize, resize, sort, summary
from ..operators.where import where
from .shots import SHOTS, shots

_WITH = f"WITH shots0 AS ({SHOTS.strip()}), shots AS (SELECT *, CAST(substr(date,1,4) AS INT) AS year, CAST(substr(date,6,2) AS INT) AS month, CAST(substr(date,9,2) AS INT) AS day, CAST(substr(time,1,2) AS INT) AS hour FROM shots0)"

#: Name: the filter, and what it means in SQL.
FILTERS = {
    "where_numeric": ("iso>500", "coalesce(iso > 500, false)"),
    "where_numeric_le": ("iso<=400", "coalesce(iso <= 400, false)"),
    "where_numeric_ne_missing": ("iso!=100", "coalesce(iso <> 100, false)"),
    "where_string_eq": ('model=="GR III"', "coalesce(model = 'GR III', false)"),
    "where_string_order": ('lens>="M"', "coalesce(lens >= 'M', false)"),
    "where_string_ne_missing": ('lens!="RF50mm F1.8 STM"', "coalesce(lens <> 'RF50mm F1.8 STM', true)"),
    "where_bool_missing": ("flash==false", "NOT coalesce(flash, false)"),
    "where_bool_ne": ("gps!=true", "NOT coalesce(gps, false)"),
    "where_not_missing": ("not iso>500", "NOT coalesce(iso > 500, false)"),
    "where_substring": ('lens~"gm"', "coalesce(contains(lower(lens), 'gm'), false)"),
    "where_substring_date": ('date~"2023-0"', "coalesce(contains(date, '2023-0'), false)"),
    "where_aperture_flip": ("aperture>=2.8", "coalesce(fnumber <= 2.8, false)"),
    "where_aperture_eq": ("aperture==2.8", "coalesce(fnumber = 2.8, false)"),
    "where_date_range": ('date>="2022-06-01" and date<"2023-03"', "coalesce(date >= '2022-06-01', false) AND coalesce(date < '2023-03', false)"),
    "where_date_unquoted": ("date>=2024-06-15", "coalesce(date >= '2024-06-15', false)"),
    "where_time_short": ('time>="20:00" or time<"06:30"', "coalesce(time || '.000' >= '20:00:00.000', false) OR coalesce(time || '.000' < '06:30:00.000', false)"),
    "where_datetime_midnight": ('datetime>="2024-01-02"', "coalesce(datetime || '.000' >= '2024-01-02 00:00:00.000', false)"),
    "where_datetime_minute": ("datetime<2023-05-10T12:30", "coalesce(datetime || '.000' < '2023-05-10 12:30:00.000', false)"),
    "where_int_bucket": ("hour>6 and month<=6", "coalesce(hour > 6, false) AND coalesce(month <= 6, false)"),
    "where_precedence": ('iso>=6400 or maker=="Canon" and not rating==0', "coalesce(iso >= 6400, false) OR (coalesce(maker = 'Canon', false) AND NOT coalesce(rating = 0, false))"),
    "where_parens": ('(iso>=6400 or maker=="Canon") and not (flash==true or focal<24)', "(coalesce(iso >= 6400, false) OR coalesce(maker = 'Canon', false)) AND NOT (coalesce(flash, false) OR coalesce(focal < 24, false))"),
    "where_bias_negative": ("bias<-0.5", "coalesce(bias < -0.5, false)"),
    "where_orientation": ('orientation!="portrait"', "coalesce(orientation <> 'portrait', true)"),
}

_AP = ", ".join(f"({s}, {i}, 'f/{s:g}')" for i, s in enumerate(buckets.APERTURES))
_SH = ", ".join(f"({math.log(s)!r}, {i}, '{k}')" for i, (s, k) in enumerate(zip(buckets.SHUTTERS, buckets.SHUTTER_KEYS)))

#: Dimension: its bin in SQL.
_BINS = {
    "camera": "nullif(model, '')", "maker": "nullif(maker, '')", "lens": "nullif(lens, '')", "orientation": "nullif(orientation, '')",
    "iso": "CASE WHEN iso < 0 THEN NULL WHEN iso <= 100 THEN '≤100' WHEN iso <= 200 THEN '101–200' WHEN iso <= 400 THEN '201–400' WHEN iso <= 800 THEN '401–800' WHEN iso <= 1600 THEN '801–1600' WHEN iso <= 3200 THEN '1601–3200' WHEN iso <= 6400 THEN '3201–6400' WHEN iso <= 1000000000 THEN '>6400' END",
    "aperture": f"(SELECT CASE WHEN abs(s - fnumber) / s < 0.06 THEN k ELSE 'f/' || regexp_replace(regexp_replace(printf('%.6f', fnumber), '0+$', ''), '\\.$', '') END FROM (VALUES {_AP}) v(s, i, k) WHERE fnumber IS NOT NULL ORDER BY abs(s - fnumber), i LIMIT 1)",
    "focal": "CASE WHEN focal < 0 THEN NULL WHEN focal < 20 THEN '<20mm ultra-wide' WHEN focal < 35 THEN '20-35mm wide' WHEN focal < 70 THEN '35-70mm standard' WHEN focal < 200 THEN '70-200mm tele' WHEN focal < 600 THEN '200-600mm long' WHEN focal < 10000 THEN '>600mm super-tele' END",
    "shutter": f"(SELECT k FROM (VALUES {_SH}) v(s, i, k) WHERE shutter > 0 ORDER BY abs(s - ln(shutter)), i LIMIT 1)",
    "bias": "CASE WHEN bias IS NOT NULL THEN CASE CAST(greatest(-3, least(3, round_even(bias, 0))) AS INT) WHEN -3 THEN '-3 EV' WHEN -2 THEN '-2 EV' WHEN -1 THEN '-1 EV' WHEN 0 THEN '0 EV' WHEN 1 THEN '+1 EV' WHEN 2 THEN '+2 EV' ELSE '+3 EV' END END",
    "rating": "CASE WHEN rating IS NULL OR rating <= 0 THEN 'unrated' ELSE CAST(least(rating, 5) AS STRING) END",
    "hour": "CASE WHEN hour BETWEEN 0 AND 23 THEN lpad(CAST(hour AS STRING), 2, '0') END",
    "year": "substr(date, 1, 4)", "month": "substr(date, 1, 7)", "day": "substr(date, 1, 10)",
}


def _by_sql(name: str) -> str:
    order = buckets.DIMENSIONS[name][2]
    listed = f" AND key IN ({', '.join(repr(k) for k in order)})" if isinstance(order, tuple) else ""
    return f"{_WITH} SELECT key, count(*) AS count, count(*) / CAST((SELECT count(*) FROM shots) AS DOUBLE) AS share FROM (SELECT {_BINS[name]} AS key FROM shots) WHERE key IS NOT NULL{listed} GROUP BY key"


def _paths(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: where(shots(spark, d), text).select("path")


def keepers(spark: SparkSession, d: str) -> DataFrame:
    """Rated four or more, by lens."""
    return summary.by_dimension(where(shots(spark, d), "rating>=4"), "lens", ordered=False)


def _plan(names: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: organize.plan(shots(spark, d), names, "/out").select("src", "tgt")


def _collisions(spark: SparkSession, d: str) -> DataFrame:
    return organize.collisions(organize.plan(shots(spark, d), ["month"], "/out"))


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A cache's rows, and files of which some have changed since."""
    from ..sources import cache

    seen = shots(spark, d).select(F.col("path").alias("abspath"), F.lit(1).cast("long").alias("dev"), F.col("size_bytes").alias("ino"), F.col("size_bytes").alias("size"), F.lit(7).cast("long").alias("mtime_ns"), "iso")
    now = seen.drop("iso").withColumn("mtime_ns", F.when(F.col("size") % 7000 == 0, 8).otherwise(7).cast("long"))
    return cache, seen.where(F.col("size") % 11000 != 0), now


def _cache_hits(spark: SparkSession, d: str) -> DataFrame:
    cache, seen, now = _snapshot(spark, d)
    return cache.hits(now, seen).select("abspath", "iso")


def _cache_misses(spark: SparkSession, d: str) -> DataFrame:
    cache, seen, now = _snapshot(spark, d)
    return cache.misses(now, seen).select("abspath")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    cache, seen, now = _snapshot(spark, d)
    return cache.orphans(seen, now.where("size % 3000 <> 0")).select("abspath")


def _resized(**limit) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = shots(spark, d).select("path", (F.col("size_bytes") % 7919 + 1).alias("w"), (F.col("size_bytes") % 5003 + 1).alias("h"))
        w, h = resize.target_size(F.col("w"), F.col("h"), **limit)
        return df.select("path", w.cast("long").alias("width"), h.cast("long").alias("height"))

    return run


def _resized_sql(ratio: str) -> str:
    side = lambda s: f"CASE WHEN r >= 1 THEN {s} ELSE CAST(greatest(1, round_even({s} * r, 0)) AS BIGINT) END"
    return f"{_WITH}, s AS (SELECT path, size_bytes % 7919 + 1 AS w, size_bytes % 5003 + 1 AS h FROM shots), t AS (SELECT *, {ratio} AS r FROM s) SELECT path, {side('w')} AS width, {side('h')} AS height FROM t"


def _totals(spark: SparkSession, d: str) -> DataFrame:
    t = summary.totals(shots(spark, d))
    return t.select("count", "total_bytes", "date_min", "date_max", "days_spanned", *(f"{c}_{n}" for c in ("iso", "fnumber", "focal", "shutter", "bias") for n in ("min", "max")), "n_cameras", "n_lenses", "n_makers", "n_lensless", F.concat_ws(",", F.transform("hours_present", lambda h: h.cast("string"))).alias("hours"))


def _span(spark: SparkSession, d: str) -> DataFrame:
    return summary.totals(where(shots(spark, d), 'maker=="SONY" and iso>=6400')).select("date_min", "date_max", "span_years", "span_months", "span_days")


def _top_iso(spark: SparkSession, d: str) -> DataFrame:
    return sort.sort_records(where(shots(spark, d), "iso>0"), "iso,shutter", reverse=True, limit=50).select("path", "iso")


def _sorted_rank(spark: SparkSession, d: str) -> DataFrame:
    """Each record's neighbours in kind: how many of its camera come before, nulls last."""
    from pyspark.sql import Window

    df = shots(spark, d)
    return df.select("path", F.row_number().over(Window.partitionBy("model", "year", "month", "day").orderBy(*sort.sort_columns("model,lens,iso"))).cast("long").alias("rank"))


def _report_dims(spark: SparkSession, d: str) -> DataFrame:
    return summary.all_dimensions(shots(spark, d)).select("dimension", "key", "count", "share")


def _twice(df: DataFrame) -> DataFrame:
    """Times to the hour alone, so that cameras take several pictures at a time."""
    return df.withColumn("datetime", F.substring("datetime", 1, 13))


def _sidecars(spark: SparkSession, d: str) -> DataFrame:
    df = shots(spark, d)
    suffix = F.when(F.col("size_bytes") % 3000 == 0, ".xmp").when(F.col("size_bytes") % 3000 == 1000, ".JPG").otherwise(".txt")
    files = df.where("size_bytes % 5000 = 0").select(F.concat(F.regexp_replace("path", "[.][A-Z0-9]+$", ""), suffix).alias("path"))
    return organize.with_sidecars(organize.plan(df, ["month"], "/out"), files)


def _actions(spark: SparkSession, d: str) -> DataFrame:
    df = shots(spark, d)
    moves = organize.plan(df, ["month"], "/out").join(df.select(F.col("path").alias("src"), "size_bytes"), "src")
    moves = moves.withColumn("tgt", F.when(F.col("size_bytes") % 4000 == 0, F.col("src")).otherwise(F.col("tgt"))).drop("size_bytes")
    return organize.with_actions(moves, moves.where(F.length("tgt") % 2 == 0).select(F.col("tgt").alias("path"))).select("src", "tgt", "action")


#: Raw tags made up out of events, alike in both engines: blanks, odd times, makers in models, APEX values, missing places.
_TAGS = """SELECT CAST(event_id AS STRING) AS path,
    CASE event_id % 7 WHEN 0 THEN '2021:03:04 05:06:07' WHEN 1 THEN '2021-03-04 05:06:07' WHEN 2 THEN ' 2020:12:31 23:59:58 ' WHEN 3 THEN '20ab:01:02 xx:04:05' WHEN 4 THEN '2019:zz:09 10:11:12' WHEN 5 THEN '   ' ELSE NULL END AS taken,
    CASE event_id % 5 WHEN 0 THEN '048' WHEN 1 THEN ' 5 ' WHEN 2 THEN '' ELSE NULL END AS subsec,
    CASE event_id % 4 WHEN 0 THEN 'Zorki' WHEN 1 THEN ' KODAK COMPANY ' WHEN 2 THEN '' ELSE NULL END AS make,
    CASE event_id % 6 WHEN 0 THEN 'ZORKI 4K' WHEN 1 THEN 'Kodak Retina' WHEN 2 THEN 'Zorkina' WHEN 3 THEN 'Zorki ' WHEN 4 THEN ' ' ELSE NULL END AS model,
    CAST(NULL AS STRING) AS lens, CAST(event_id % 900 AS INT) AS iso,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 40 AS DOUBLE) / 4 END AS fnumber, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 11 AS DOUBLE) / 2 END AS apex,
    CAST(NULL AS DOUBLE) AS shutter, CAST(NULL AS DOUBLE) AS focal, CAST(NULL AS DOUBLE) AS bias, CASE WHEN event_id % 8 = 0 THEN CAST(event_id % 6 AS INT) END AS rating,
    CAST(NULL AS INT) AS image_width, CAST(NULL AS INT) AS image_height, CASE WHEN event_id % 9 < 5 THEN CAST(event_id % 90 AS DOUBLE) END AS gps_lat, CASE WHEN event_id % 9 > 2 THEN CAST(event_id % 180 AS DOUBLE) END AS gps_lon,
    CASE WHEN event_id % 10 > 0 THEN CAST(event_id % 10 AS INT) END AS orientation_code, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 64 AS INT) END AS flash_code, event_id % 12 > 3 AS any_tag, CAST(event_id AS BIGINT) AS size_bytes
FROM events"""

_NORMAL = ["path", "datetime", "date", "time", "year", "month", "day", "hour", "maker", "model", "fnumber", "rating", "orientation", "flash", "gps"]
_TRIMMED = ", ".join(f"nullif(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '') AS {c}_" for c in ("taken", "subsec", "make", "model"))
_NORMAL_SQL = f"""tags AS ({_TAGS}), a AS (SELECT *, {_TRIMMED} FROM tags),
b AS (SELECT *, length(taken_) >= 19 AND substr(taken_, 5, 1) = ':' AND substr(taken_, 8, 1) = ':' AS good, upper(split_part(make_, ' ', 1)) || ' ' AS first FROM a),
c AS (SELECT *, CASE WHEN good THEN substr(taken_, 1, 4) || '-' || substr(taken_, 6, 2) || '-' || substr(taken_, 9, 2) END AS date, CASE WHEN good THEN substr(taken_, 12, 8) || coalesce('.' || subsec_, '') END AS time FROM b),
e AS (SELECT *, TRY_CAST(substr(date, 1, 4) AS INT) AS year FROM c), f AS (SELECT *, CASE WHEN year IS NOT NULL THEN TRY_CAST(substr(date, 6, 2) AS INT) END AS month FROM e),
n AS (SELECT path, coalesce(date || ' ' || time, taken_) AS datetime, date, time, year, month, CASE WHEN month IS NOT NULL THEN TRY_CAST(substr(date, 9, 2) AS INT) END AS day, TRY_CAST(substr(time, 1, 2) AS INT) AS hour, make_ AS maker,
    CASE WHEN make_ IS NOT NULL AND starts_with(upper(model_), first) AND ltrim(substr(model_, length(first) + 1)) <> '' THEN ltrim(substr(model_, length(first) + 1)) ELSE model_ END AS model,
    coalesce(fnumber, round_even(pow(2.0, apex / 2), 1)) AS fnumber, coalesce(rating, CASE WHEN any_tag THEN 0 END) AS rating,
    CASE WHEN orientation_code BETWEEN 5 AND 8 THEN 'portrait' WHEN orientation_code BETWEEN 1 AND 4 THEN 'landscape' END AS orientation, flash_code % 2 = 1 AS flash, CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN true END AS gps FROM f)"""


def _made_tags(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_TAGS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{d}/events.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _paths(text) for name, (text, _) in FILTERS.items()}
    out["where_keepers"] = keepers
    out |= {f"by_{name}": (lambda spark, d, n=name: summary.by_dimension(shots(spark, d), n, ordered=False)) for name in buckets.DIMENSIONS}
    out |= {
        "by_all_dimensions": _report_dims,
        "summary_totals": _totals,
        "summary_calendar_span": _span,
        "summary_flash_gps": lambda spark, d: summary.totals(shots(spark, d)).select("flash_on", "flash_off", "gps_yes", "gps_no"),
        "summary_rating_dist": lambda spark, d: summary.rating_distribution(shots(spark, d)),
        "organize_flat": _plan([]), "organize_one_dim": _plan(["month"]), "organize_two_dims": _plan(["camera", "aperture"]), "organize_three_dims": _plan(["year", "lens", "focal"]),
        "organize_collisions": _collisions,
        "reveal_groups": lambda spark, d: organize.reveal_groups(shots(spark, d)),
        "sort_top_iso": _top_iso, "sort_rank": _sorted_rank,
        "cache_hits": _cache_hits, "cache_misses": _cache_misses, "cache_orphans": _orphans,
        "resize_long": _resized(long=2000), "resize_short": _resized(short=1080), "resize_mp": _resized(megapixels=3.0),
        "union_inputs_distinct": lambda spark, d: shots(spark, d).where("iso >= 1600").select("path").union(shots(spark, d).where("rating > 2").select("path")).distinct(),
        "records_of_paths": lambda spark, d: shots(spark, d).select("path").join(where(shots(spark, d), "iso>500").select("path", "iso"), "path", "left"),
        "ext_by_two_dims": lambda spark, d: summary.by_dimensions(shots(spark, d), ["camera", "iso"]),
        "ext_duplicates": lambda spark, d: summary.duplicates(_twice(shots(spark, d))),
        "organize_sidecars": _sidecars, "organize_actions": _actions,
        "normalize_tags": lambda spark, d: normalize(_made_tags(spark, d)).select(*_NORMAL),
        "normalize_model": lambda spark, d: normalize(_made_tags(spark, d)).groupBy("maker", "model", "orientation", "flash", "gps", "rating").agg(F.count(F.lit(1)).alias("n")),
        "ext_paths_by_dimension": lambda spark, d: summary.paths_by_dimension(shots(spark, d), "orientation"),
    }
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: f"{_WITH} SELECT path FROM shots WHERE {sql}" for name, (_, sql) in FILTERS.items()}
    out["where_keepers"] = f"{_WITH}, k AS (SELECT * FROM shots WHERE rating >= 4) SELECT lens AS key, count(*) AS count, count(*) / CAST((SELECT count(*) FROM k) AS DOUBLE) AS share FROM k WHERE lens <> '' GROUP BY lens"
    out |= {f"by_{name}": _by_sql(name) for name in _BINS}
    each = " UNION ALL ".join(f"SELECT '{n}' AS dimension, key, count, share FROM ({_by_sql(n).removeprefix(_WITH)})" for n in _BINS)
    dim = lambda n: f"replace(coalesce(nullif({_BINS[n]}, ''), '_unknown'), '/', '_')"
    base = "regexp_extract(path, '([^/]*)$', 1)"
    plan = lambda names: f"{_WITH} SELECT path AS src, '/out/' || {''.join(f'{dim(n)} || chr(47) || ' for n in names)}{base} AS tgt FROM shots"
    extents = ", ".join(f"{f}({c}) AS {c}_{f}" for c in ("iso", "fnumber", "focal", "shutter", "bias") for f in ("min", "max"))
    cached = f"{_WITH}, seen AS (SELECT path AS abspath, size_bytes AS size, 7 AS mtime_ns, iso FROM shots WHERE size_bytes % 11000 <> 0), now AS (SELECT path AS abspath, size_bytes AS size, CASE WHEN size_bytes % 7000 = 0 THEN 8 ELSE 7 END AS mtime_ns FROM shots)"
    out |= {
        "by_all_dimensions": f"{_WITH} {each}",
        "summary_totals": f"{_WITH} SELECT count(*) AS count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, min(date) AS date_min, max(date) AS date_max, CAST(date_diff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) + 1 AS INT) AS days_spanned, {extents}, count(DISTINCT nullif(model, '')) AS n_cameras, count(DISTINCT nullif(lens, '')) AS n_lenses, count(DISTINCT nullif(maker, '')) AS n_makers, count(*) FILTER (WHERE lens IS NULL OR lens = '') AS n_lensless, array_to_string(list_sort(list(DISTINCT hour) FILTER (WHERE hour IS NOT NULL)), ',') AS hours FROM shots",
        "summary_calendar_span": f"{_WITH}, r AS (SELECT min(date) AS date_min, max(date) AS date_max, CAST(min(date) AS DATE) AS a, CAST(max(date) AS DATE) AS b FROM shots WHERE coalesce(maker = 'SONY', false) AND coalesce(iso >= 6400, false)), p AS (SELECT *, day(b) - day(a) AS d, month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS m FROM r) SELECT date_min, date_max, CAST(year(b) - year(a) - CASE WHEN m < 0 THEN 1 ELSE 0 END AS INT) AS span_years, CAST(CASE WHEN m < 0 THEN m + 12 ELSE m END AS INT) AS span_months, CAST(CASE WHEN d < 0 THEN d + day(date_trunc('month', b) - INTERVAL 1 DAY) ELSE d END AS INT) AS span_days FROM p",
        "summary_flash_gps": f"{_WITH} SELECT count(*) FILTER (WHERE flash) AS flash_on, count(*) - count(*) FILTER (WHERE flash) AS flash_off, count(*) FILTER (WHERE gps) AS gps_yes, count(*) - count(*) FILTER (WHERE gps) AS gps_no FROM shots",
        "summary_rating_dist": f"{_WITH} SELECT CASE WHEN rating > 0 THEN CAST(rating AS STRING) ELSE 'unrated' END AS key, count(*) AS count FROM shots GROUP BY 1",
        "organize_flat": plan([]), "organize_one_dim": plan(["month"]), "organize_two_dims": plan(["camera", "aperture"]), "organize_three_dims": plan(["year", "lens", "focal"]),
        "organize_collisions": f"{_WITH} SELECT lower('/out/' || {dim('month')} || '/' || {base}) AS target, count(*) OVER (PARTITION BY target) AS count, path AS src FROM shots QUALIFY count > 1",
        "reveal_groups": f"{_WITH} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, count(*) OVER (PARTITION BY parent) AS n, path FROM shots",
        "sort_top_iso": f"{_WITH} SELECT path, iso FROM shots WHERE iso > 0 ORDER BY iso DESC NULLS LAST, shutter DESC NULLS LAST, string_split(path, '/') LIMIT 50",
        "sort_rank": f"{_WITH} SELECT path, row_number() OVER (PARTITION BY model, year, month, day ORDER BY lower(model) NULLS LAST, lower(lens) NULLS LAST, iso NULLS LAST, string_split(path, '/')) AS rank FROM shots",
        "cache_hits": f"{cached} SELECT abspath, iso FROM now JOIN seen USING (abspath, size, mtime_ns)",
        "cache_misses": f"{cached} SELECT abspath FROM now ANTI JOIN seen USING (abspath, size, mtime_ns)",
        "cache_orphans": f"{cached} SELECT abspath FROM seen ANTI JOIN (SELECT * FROM now WHERE size % 3000 <> 0) USING (abspath)",
        "resize_long": _resized_sql("2000.0::DOUBLE / greatest(w, h)::DOUBLE"), "resize_short": _resized_sql("1080.0::DOUBLE / least(w, h)::DOUBLE"), "resize_mp": _resized_sql("sqrt(3000000.0::DOUBLE / (w::DOUBLE * h::DOUBLE))"),
        "union_inputs_distinct": f"{_WITH} SELECT path FROM shots WHERE iso >= 1600 UNION SELECT path FROM shots WHERE rating > 2",
        "records_of_paths": f"{_WITH} SELECT path, CASE WHEN iso > 500 THEN iso END AS iso FROM shots",
        "ext_by_two_dims": f"{_WITH} SELECT {_BINS['camera']} AS camera, {_BINS['iso']} AS iso, count(*) AS count FROM shots GROUP BY 1, 2",
        "ext_duplicates": f"{_WITH}, t AS (SELECT substr(datetime, 1, 13) AS datetime, model, path FROM shots) SELECT datetime, model, count(*) AS count, min(path) AS first_path FROM t WHERE datetime IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
        "organize_sidecars": f"{_WITH}, s AS (SELECT regexp_replace(path, '[.][A-Z0-9]+$', '') || CASE WHEN size_bytes % 3000 = 0 THEN '.xmp' WHEN size_bytes % 3000 = 1000 THEN '.JPG' ELSE '.txt' END AS side FROM shots WHERE size_bytes % 5000 = 0), m AS (SELECT path AS src, '/out/' || {dim('month')} || '/' || {base} AS tgt FROM shots) SELECT src, tgt, 'raw' AS kind FROM m UNION ALL SELECT DISTINCT side, regexp_replace(tgt, '[^/]*$', '') || regexp_extract(side, '([^/]*)$', 1), 'sidecar' FROM m JOIN s ON regexp_replace(src, '[.][^./]*$', '') = regexp_replace(side, '[.][^./]*$', '') WHERE NOT ends_with(side, '.txt')",
        "organize_actions": f"{_WITH}, m AS (SELECT path AS src, CASE WHEN size_bytes % 4000 = 0 THEN path ELSE '/out/' || {dim('month')} || '/' || {base} END AS tgt FROM shots), e AS (SELECT DISTINCT tgt FROM m WHERE length(tgt) % 2 = 0) SELECT src, m.tgt, CASE WHEN src = m.tgt THEN 'same' WHEN e.tgt IS NOT NULL THEN 'skip' ELSE 'move' END AS action FROM m LEFT JOIN e ON e.tgt = m.tgt",
        "normalize_tags": f"WITH {_NORMAL_SQL} SELECT {', '.join(_NORMAL)} FROM n",
        "normalize_model": f"WITH {_NORMAL_SQL} SELECT maker, model, orientation, flash, gps, rating, count(*) AS n FROM n GROUP BY ALL",
        "ext_paths_by_dimension": f"{_WITH} SELECT orientation AS key, path FROM shots WHERE orientation <> ''",
    }
    return out
