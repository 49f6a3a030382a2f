"""Photo records bound to the ``events`` table: one SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DATE = "CAST(2022 + event_id % 3 AS STRING) || '-' || lpad(CAST(1 + event_id % 12 AS STRING),2,'0') || '-' || lpad(CAST(1 + CAST(substr(CAST(ts AS STRING),9,2) AS INT) % 28 AS STRING),2,'0')"
_TIME = "substr(CAST(ts AS STRING),12,8)"
_DATED = "CASE WHEN event_id % 17 = 0 THEN NULL ELSE {} END"


def _cycle(n: int, values: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN event_id % {n} = {i} THEN {v}" for i, v in enumerate(values[:-1])) + f" ELSE {values[-1]} END"


SHOTS = f"""
SELECT '/lib/' || event_type || '/roll' || CAST(CAST((event_id - event_id % 400) / 400 AS INT) AS STRING)
         || CASE WHEN event_id % 800 < 400 THEN '/IMG_' ELSE '/img_' END || lpad(CAST(event_id % 400 AS STRING),4,'0')
         || {_cycle(3, ["'.CR3'", "'.ARW'", "'.DNG'"])} AS path,
       {_DATED.format(f"{_DATE} || ' ' || {_TIME}")} AS datetime, {_DATED.format(_DATE)} AS date, {_DATED.format(_TIME)} AS time,
       {_cycle(3, ["'Canon'", "'SONY'", "'RICOH'"])} AS maker, {_cycle(3, ["'EOS R5'", "'ILCE-7M4'", "'GR III'"])} AS model,
       CASE WHEN event_id % 3 = 2 THEN NULL WHEN user_id % 2 = 0 THEN 'RF50mm F1.8 STM' ELSE 'FE 24-70mm F2.8 GM' END AS lens,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST({_cycle(5, ["100", "400", "1600", "6400", "12800"])} AS INT) END AS iso,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST({_cycle(6, ["1.4", "2.8", "2.7", "6.3", "8.0", "11.0"])} AS DOUBLE) END AS fnumber,
       CASE WHEN value <= 0 THEN NULL ELSE CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + value * 20) END AS shutter,
       CAST(CASE WHEN event_id % 3 = 2 THEN 18.3 WHEN user_id % 2 = 0 THEN 50.0 ELSE 24 + event_id % 47 END AS DOUBLE) AS focal,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 9 - 4 AS DOUBLE) / 2 END AS bias,
       CAST(CASE WHEN event_id % 10 < 5 THEN 0 ELSE event_id % 10 - 4 END AS INT) AS rating,
       CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 'portrait' ELSE 'landscape' END AS orientation,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE event_id % 29 = 1 END AS flash,
       CASE WHEN event_id % 8 = 3 THEN TRUE ELSE NULL END AS gps,
       20000000 + event_id * 1000 AS size_bytes
FROM events"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records, with the parts of their date and time as numbers."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    records = spark.sql(SHOTS.replace("FROM events", "FROM {events}"), events=events)
    part = lambda c, at, k: f"CAST(substr({c}, {at}, {k}) AS INT)"
    return records.selectExpr("*", f"{part('date', 1, 4)} AS year", f"{part('date', 6, 2)} AS month", f"{part('date', 9, 2)} AS day", f"{part('time', 1, 2)} AS hour")
