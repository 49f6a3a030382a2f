"""The metadata cache: a snapshot table of parsed records, valid while a file's state is the same."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What must be equal for a cached record to hold.
STATE = ["abspath", "dev", "ino", "size", "mtime_ns"]
VERSION = 1
#: Batches below this many files aren't worth a look-up.
LEAST_FILES = 50


def hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached rows of files whose state is unchanged, with whatever else the files bring."""
    return files.join(cached, STATE)


def misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files that must be read: new ones and changed ones."""
    return files.join(cached.select(*STATE), STATE, "left_anti")


def orphans(cached: DataFrame, files: DataFrame) -> DataFrame:
    """Cached rows of files that are gone."""
    return cached.join(files.select("abspath"), "abspath", "left_anti")


def merged(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows in the place of those of the same path."""
    return cached.join(fresh.select("abspath"), "abspath", "left_anti").unionByName(fresh)


class Snapshot:
    """A cache in a folder: data versions beside each other, and numbered small files, the last of which names the one in force.

    A file of the next number is written under another name and renamed, so that a crash at any time leaves the one before.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda p: path(f"{self.folder}/{p}" if p else self.folder)
        self._fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The numbers of the files that name a version, ascending."""
        if not self._fs.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(""))]
        return sorted(int(n[5:-5]) for n in names if n.startswith("meta-") and n.endswith(".json") and n[5:-5].isdigit())

    def _meta(self) -> dict:
        numbers = self._numbers()
        if not numbers:
            return {"version": VERSION, "enabled": True, "data": None}
        try:
            meta = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/meta-{numbers[-1]}.json").collect()))
        except ValueError:
            meta = {}
        if meta.get("version") != VERSION:  # of another make, or unreadable: start anew
            return {"version": VERSION, "enabled": bool(meta.get("enabled", True)), "data": None}
        return meta

    def _set(self, meta: dict) -> None:
        name, numbers = f"tmp-{uuid.uuid4().hex}", self._numbers()
        out = self._fs.create(self._path(name), True)
        out.write(bytearray(json.dumps(meta), "utf-8"))
        out.close()
        if not self._fs.rename(self._path(name), self._path(f"meta-{(numbers or [0])[-1] + 1}.json")):
            raise OSError(f"{self.folder} was changed by another at the same time")
        for n in numbers:
            self._fs.delete(self._path(f"meta-{n}.json"), False)

    @property
    def enabled(self) -> bool:
        return self._meta()["enabled"]

    def enable(self, on: bool = True) -> None:
        self._set(self._meta() | {"enabled": on})

    def read(self) -> DataFrame:
        meta = self._meta()
        if not meta["enabled"] or not meta["data"]:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{meta['data']}")

    def _replace(self, rows: DataFrame) -> None:
        meta = self._meta()
        new = f"data-{time.time_ns()}"
        rows.select(*self.schema.names).write.parquet(f"{self.folder}/{new}")
        self._set(meta | {"data": new})
        if meta["data"]:
            self._fs.delete(self._path(meta["data"]), True)

    def put(self, fresh: DataFrame) -> None:
        if self.enabled:
            self._replace(merged(self.read(), fresh))

    def relocate(self, moves: DataFrame, copy: bool = False) -> None:
        """Re-keys rows of moved files (src, tgt, and the target's state); copies keep the source's row."""
        old = self.read()
        moved = moves.join(old.drop(*STATE[1:]), moves["src"] == old["abspath"]).drop("abspath", "src").withColumnRenamed("tgt", "abspath")
        if "path" in self.schema.names:
            moved = moved.withColumn("path", F.col("abspath"))
        kept = old if copy else old.join(moves.select(F.col("src").alias("abspath")), "abspath", "left_anti")
        self._replace(merged(kept, moved.select(*self.schema.names)))

    def vacuum(self, files: DataFrame) -> int:
        """Drops rows of files that are gone; returns how many."""
        old = self.read()
        gone = orphans(old, files).count()
        if gone:
            self._replace(old.join(files.select("abspath"), "abspath", "left_semi"))
        return gone

    def clear(self) -> int:
        n = self.read().count()
        meta = self._meta()
        self._set(meta | {"data": None})
        if meta["data"]:
            self._fs.delete(self._path(meta["data"]), True)
        return n

    def info(self) -> dict:
        meta = self._meta()
        size = self._fs.getContentSummary(self._path(meta["data"])).getLength() if meta["data"] else 0
        return {"folder": self.folder, "enabled": meta["enabled"], "version": VERSION, "rows": self.read().count(), "bytes": int(size)}
