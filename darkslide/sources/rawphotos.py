"""RAW files as a table: a Spark data source that lists folders and reads metadata in parallel."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.normalize import normalize
from ..schema import is_raw
from ..operators.organize import collisions
from ..operators.resize import plain_size
from .containers import jpeg_size, largest_jpeg, read_tags

#: Raw tags of a file, before they are made a record; with the file's state for the cache.
TAGS = "path string, abspath string, dev bigint, ino bigint, size_bytes bigint, mtime_ns bigint, taken string, subsec string, make string, model string, lens string, iso int, fnumber double, apex double, shutter double, focal double, bias double, rating int, image_width int, image_height int, gps_lat double, gps_lon double, orientation_code int, flash_code int, any_tag boolean"
_NAMES = [c.split()[0] for c in TAGS.split(", ")]
_KINDS = dict(c.split() for c in TAGS.split(", "))
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


class MissingInput(FileNotFoundError):
    """An input path that isn't there."""


def list_raws(inputs: list[str], recursive: bool = False) -> list[str]:
    """RAW files under inputs, distinct and in path order. Any missing input is an error; files that are no RAW are left out.

    With ``recursive`` all levels count and links to files need not lead anywhere; else the top level's plain files do.
    Links to folders are not followed, folders that can't be read are left out.
    """
    found: set[str] = set()
    for given in inputs:
        if os.path.isdir(given):
            if recursive:
                for folder, _, names in os.walk(given):
                    found.update(os.path.join(folder, n) for n in names if is_raw(n))
            else:
                found.update(e.path for e in os.scandir(given) if is_raw(e.name) and e.is_file())
        elif os.path.exists(given):
            if is_raw(given):
                found.add(given)
        else:
            raise MissingInput(given)
    return sorted(found, key=lambda p: p.split("/"))


def paths_from(given: list[str] | None, stdin) -> list[str]:
    """The given paths; a dash, or none where standard input is no terminal, stands for those of standard input; else the folder one is in."""
    if given and given != ["-"]:
        return given
    lines = [] if not given and stdin.isatty() else [x.strip() for x in stdin if x.strip()]
    return lines or ["."]


def _scalar(value: object, kind: str) -> object:
    value = value[0] if isinstance(value, list) and value else value
    if value is None or isinstance(value, (bytes, list)):
        return None
    try:
        return {"int": int, "double": float, "string": str}[kind](value)
    except (TypeError, ValueError):
        return None


#: What tells whether a file has changed, and where it is.
STATES = "path string, abspath string, dev bigint, ino bigint, size_bytes bigint, mtime_ns bigint"
_STATE_NAMES = [c.split()[0] for c in STATES.split(", ")]

#: Reads a file that this package's own parsers know neither maker nor model of: path to tags.
Fallback = Callable[[str], dict[str, object]]
_fallbacks: dict[str, Fallback] = {}


def register_fallback(name: str, read: Fallback) -> None:
    """Makes a reader known that ``read_photos`` may be given as ``fallback``. It must be importable where tasks run."""
    _fallbacks[name] = read


def state_of(path: str) -> dict[str, object]:
    """A file's state; of one that is gone only where it was."""
    out: dict[str, object] = {"path": path, "abspath": os.path.abspath(path)}
    with contextlib.suppress(OSError):
        st = os.stat(path)
        out |= {"dev": st.st_dev, "ino": st.st_ino, "size_bytes": st.st_size, "mtime_ns": st.st_mtime_ns}
    return out


def read_file(path: str, fallback: Fallback | None = None) -> tuple:
    """A file's row of tags; of a file that can't be read the path alone. What the parsers found goes before a fallback's."""
    row: dict[str, object] = {**state_of(path), "any_tag": False}
    try:
        with open(path, "rb") as f:

            def read(at: int, size: int) -> bytes:
                f.seek(at)
                return f.read(size)

            tags = read_tags(read)
    except OSError:
        return tuple(row.get(n) for n in _NAMES)
    if fallback and not (tags.get("make") and tags.get("model")):
        with contextlib.suppress(Exception):  # another library's faults cost its tags alone
            tags = {**{k: v for k, v in fallback(path).items() if v is not None}, **tags}
    row |= {k: _scalar(v, _KINDS[k]) for k, v in tags.items() if k in _KINDS}
    row["any_tag"] = bool(tags)
    return tuple(row.get(n) for n in _NAMES)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class RawPhotos(DataSource):
    """``spark.read.format("rawphotos")`` with options paths (one a line), recursive, files (in a partition), only (states: no tags, the schema STATES)."""

    @classmethod
    def name(cls) -> str:
        return "rawphotos"

    def schema(self) -> str:
        return TAGS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.recursive, self.files = options.get("recursive", "false").lower() == "true", int(options.get("files", "500"))
        self.only_states = options.get("only", "") == "states"

    def partitions(self) -> list[Files]:
        found = list_raws(self.paths, self.recursive)
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        if self.only_states:
            return (tuple(x.get(n) for n in _STATE_NAMES) for x in map(state_of, partition.paths))
        return map(read_file, partition.paths)


def _tags_of(files: DataFrame, fallback: Fallback | None) -> DataFrame:
    """Rows of tags of the files (path), read where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read_file(p, fallback) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[_KINDS[n]]) for i, n in enumerate(_NAMES)], _NAMES)

    return files.select("path").mapInArrow(run, TAGS)


def read_photos(spark: SparkSession, inputs: list[str], recursive: bool = False, cache=None, backend: str = "own", fallback: str | None = None) -> DataFrame:
    """Photo records of all RAW files under inputs; with a cache, only new and changed files are read.

    ``backend``: own (this package's parsers), or json (inputs are files of JSON records, ``from_json``). ``fallback`` names
    a reader of ``register_fallback``. Paths under the folder one is in are told as they lie in it, if an input was. Files' states are taken in tasks, and files that are gone by then stay as records
    without tags. A cache serves from 50 files on.
    """
    from . import cache as states

    if backend == "json":
        return from_json(spark, inputs)
    if backend != "own":
        raise ValueError(f"unknown backend `{backend}`; one of own, json")
    if fallback is not None and fallback not in _fallbacks:
        raise ValueError(f"unknown fallback `{fallback}`; one of {', '.join(sorted(_fallbacks)) or 'none'}")
    if relative := [p for p in inputs if not os.path.isabs(p)]:  # tasks may stand in another folder
        here = os.getcwd()
        whole = [os.path.normpath(os.path.join(here, p)) if p in relative else p for p in inputs]
        found = read_photos(spark, whole, recursive, cache, backend, fallback)
        return found.withColumn("path", F.when(F.startswith(F.col("path"), F.lit(f"{here}/")), F.substr("path", F.lit(len(here) + 2))).otherwise(F.col("path")))
    other = _fallbacks.get(fallback or "")
    spark.dataSource.register(RawPhotos)
    source = lambda only, schema: spark.read.format("rawphotos").option("paths", "\n".join(inputs)).option("recursive", str(recursive)).option("only", only).schema(schema).load()
    listed = source("states", STATES)
    if cache is None or not cache.enabled or len(list_raws(inputs, recursive)) < states.LEAST_FILES:
        return normalize(_tags_of(listed, other) if other else source("", TAGS))
    files = listed.withColumnRenamed("size_bytes", "size")
    gone = files.where("size is null")
    files = files.where("size is not null")
    cache.put(_tags_of(states.misses(files, cache.read()), other).where("size_bytes is not null").withColumnRenamed("size_bytes", "size").drop("path").dropDuplicates(["abspath"]))
    held = states.hits(files, cache.read()).withColumnRenamed("size", "size_bytes").select(*_NAMES)
    # what has changed again meanwhile, and what is gone
    rest = states.misses(files, cache.read()).select("path").unionByName(gone.select("path"))
    return normalize(held.unionByName(_tags_of(rest, other)))


#: Tags under the names that metadata readers with JSON output use.
# Those names.
_JSON_NAMES = {
    "path": "SourceFile", "taken": "DateTimeOriginal", "subsec": "SubSecTimeOriginal", "make": "Make", "model": "Model", "lens": "LensModel", "iso": "ISO", "fnumber": "FNumber", "apex": "ApertureValue", "shutter": "ExposureTime",
    "focal": "FocalLength", "bias": "ExposureCompensation", "rating": "Rating", "image_width": "ImageWidth", "image_height": "ImageHeight", "gps_lat": "GPSLatitude", "gps_lon": "GPSLongitude", "orientation_code": "Orientation", "flash_code": "Flash",
}


def from_json(spark: SparkSession, files: list[str]) -> DataFrame:
    """Photo records out of JSON arrays of objects, one for each photo, as external metadata readers write them.

    Numbers may be text; what isn't of a field's type is missing, as are all fields that an object lacks. Group names in
    front of a tag, as in ``EXIF:ISO``, are taken off. Objects without a SourceFile are left out.
    """
    text = spark.read.option("wholetext", "true").text(files)
    bare = F.regexp_replace("value", r'"[A-Za-z0-9]+:([A-Za-z0-9]+)"\s*:', '"$1":')
    rows = text.select(F.explode(F.from_json(bare, "array<map<string,string>>")).alias("m"))
    tags = rows.select(*(F.col("m")[k].try_cast(_KINDS[n] if n != "path" else "string").alias(n) for n, k in _JSON_NAMES.items()), (F.size("m") > 1).alias("any_tag"))
    return normalize(tags.where("path is not null").withColumn("size_bytes", F.lit(None).cast("long")))


#: The cache's table: tags by absolute path and state.
CACHE_SCHEMA = ", ".join(["abspath string, dev bigint, ino bigint, size bigint, mtime_ns bigint", *(f"{n} {_KINDS[n]}" for n in _NAMES if n not in ("path", "abspath", "dev", "ino", "size_bytes", "mtime_ns"))])


def extract_jpegs(paths: DataFrame) -> DataFrame:
    """(path, data, width, height, error): the largest JPEG inside each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():  # a row at a time: pictures are large
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((p, *_jpeg_of(p)), (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.string()))], ["path", "data", "width", "height", "error"])

    return paths.select("path").mapInArrow(run, "path string, data binary, width int, height int, error string")


def _jpeg_of(path: str) -> tuple[bytes | None, int, int, str | None]:
    try:
        with open(path, "rb") as f:
            data = largest_jpeg(f.read())
    except OSError as e:
        return None, 0, 0, str(e)
    return (data, *jpeg_size(data), None) if data else (None, 0, 0, "no embedded JPEG")


def existing(files: DataFrame) -> DataFrame:
    """The files (abspath) that are still there, looked up in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([os.path.exists(p) for p in b.column("abspath").to_pylist()], pa.bool_()))

    return files.select("abspath").mapInArrow(run, "abspath string")


def pictures(paths: DataFrame) -> DataFrame:
    """(path, width, height, size, error) of the largest JPEG inside each file; the pictures stay in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, w, h, len(data or b""), error) for p in b.column("path").to_pylist() for data, w, h, error in [_jpeg_of(p)]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], ["path", "width", "height", "size", "error"])

    return paths.select("path").mapInArrow(run, "path string, width int, height int, size long, error string")


#: Makes a picture's pixels smaller: data, width and height to data.
Resizer = Callable[[bytes, int, int], bytes]


def write_jpegs(targets: DataFrame, force: bool = False, resize: Resizer | None = None, **bound) -> DataFrame:
    """Writes the pictures of files to targets (src, tgt), each in the task that reads it; returns (target, outcome).

    Colliding targets, whatever their case, write nothing: FileExistsError names the first of them. With a bound of
    ``resize.target_size``, pictures that are larger go through ``resize``; without one they are refused.
    """
    clash = collisions(targets.select("src", "tgt")).orderBy("target").limit(1).collect()
    if clash:
        raise FileExistsError(f"several files would become {clash[0][0]}")

    def put(src: str, tgt: str) -> str:
        if os.path.exists(tgt) and not force:
            return "exists"
        data, width, height, error = _jpeg_of(src)
        if error:
            return error
        size = plain_size(width, height, **bound)
        if size != (width, height):
            if resize is None:
                return "no library to resize pictures"
            data = resize(data, *size)
        try:
            os.makedirs(os.path.dirname(tgt) or ".", exist_ok=True)
            with open(f"{tgt}.part", "wb") as f:
                f.write(data)
            os.replace(f"{tgt}.part", tgt)
        except OSError as e:
            return str(e)
        return "written"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column("src").to_pylist(), b.column("tgt").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([t for _, t in pairs]), pa.array([put(s, t) for s, t in pairs])], ["target", "outcome"])

    return targets.select("src", "tgt").mapInArrow(run, "target string, outcome string")
