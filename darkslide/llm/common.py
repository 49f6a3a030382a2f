"""What the training-data operators share: tables, scratch storage, grouped streaming through Arrow."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch: long texts stay within a few dozen MB.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's; where none is set and one machine does all the work, one of its own."""
    sc = spark.sparkContext
    if where := spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return where
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir isn't set: the executors need a folder that they share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="darkslide-"))
    return sc.getCheckpointDir()


_left: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read again: short lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/darkslide/{uuid.uuid4().hex}"
    _left.append((spark, path))
    out = df.write
    if partition_by:
        out = out.partitionBy(partition_by)
    out.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._darkslide_path = path
    return again


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_darkslide_path", None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if (spark, path) in _left:
        _left.remove((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in list(_left):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session is gone: its shared folder is cleaned with it
            return


def sized(df: DataFrame, rows: int, each: int) -> DataFrame:
    """What a shuffle gives, in as many tasks as so many rows need at ``each`` a task; the session's number of shuffle partitions at most."""
    return df.coalesce(min(1 + rows // each, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of whole groups out of batches sorted by ``keys``, each of about ``rows`` rows; with the groups' first rows and the end."""
    held: list[pa.RecordBatch] = []
    n = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            s = starts(t)
            if len(s) > 2:
                yield t.slice(0, s[-2]), s[:-1]
                t = t.slice(s[-2])
            held = t.combine_chunks().to_batches()
            n = t.num_rows
            rows = max(rows, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def filtered(docs: DataFrame, judge: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``docs``, whole, whose text is kept; ``judge`` makes a task's function from texts to what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = judge()
        for b in batches:
            yield b.filter(pa.array(keeps(b.column("text").to_pylist()), pa.bool_()))

    tuned(docs)
    return docs.mapInArrow(run, docs.schema)


def labels_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of ``n`` nodes reaches over the edges ``i``-``j``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new
