"""New records as they come: the same filters and bins over a stream. (An extension.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.buckets import dimension, key_of
from ..operators.where import where
from ..schema import PHOTO_SCHEMA


def record_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Records that arrive in a folder of Parquet files."""
    return spark.readStream.schema(PHOTO_SCHEMA).parquet(folder)


def running_breakdown(stream: DataFrame, name: str, text: str = "") -> DataFrame:
    """(key, count) so far of a dimension; for output mode complete or update."""
    kept = where(stream, text) if text else stream
    order = dimension(name)[2]
    out = kept.select(key_of(name).alias("key")).where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("count"))
    return out.where(F.col("key").isin(*order)) if isinstance(order, tuple) else out
