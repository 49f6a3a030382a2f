"""Planning of a folder layout: where each file goes, and what would collide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import dimension, key_of

SIDECARS = ("xmp", "jpg", "jpeg")


def parse_chain(spec: str) -> list[str]:
    """A comma list of dimensions, no name twice (a name and its alias are two)."""
    names = [n.strip().lower() for n in spec.split(",")] if spec else []
    for i, n in enumerate(names):
        dimension(n)
        if n in names[:i]:
            raise ValueError(f"dimension `{n}` twice")
    return names


def folder_key(name: str) -> Column:
    """A folder's name: the key, slashes as underscores; ``_unknown`` if there is none."""
    return F.translate(F.coalesce(F.nullif(key_of(name), F.lit("")), F.lit("_unknown")), "/", "_")


def target_path(names: list[str], dest: str) -> Column:
    return F.concat_ws("/", F.lit(dest.rstrip("/")), *(folder_key(n) for n in names), F.substring_index("path", "/", -1))


def plan(df: DataFrame, names: list[str], dest: str) -> DataFrame:
    """(src, tgt, kind) of every record."""
    return df.select(F.col("path").alias("src"), target_path(names, dest).alias("tgt"), F.lit("raw").alias("kind"))


def with_sidecars(moves: DataFrame, files: DataFrame) -> DataFrame:
    """A plan with the files (path) beside its own that share folder and stem and have a sidecar's suffix."""
    parts = lambda c: (F.regexp_extract(c, r"^(.*/)?", 0).alias("dir"), F.regexp_extract(c, r"([^/]*)\.[^./]*$", 1).alias("stem"))
    side = files.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*SIDECARS)).select(F.col("path").alias("side"), *parts("path"))
    own = moves.select("src", F.regexp_extract("tgt", r"^(.*/)?", 0).alias("to"), *parts("src"))
    found = own.join(side, ["dir", "stem"]).where("side <> src").select(F.col("side").alias("src"), F.concat("to", F.substring_index("side", "/", -1)).alias("tgt"), F.lit("sidecar").alias("kind"))
    return moves.unionByName(found.distinct())


def folded(c: Column) -> Column:
    """Text whose case doesn't count; a sharp s is two letters s, as in its capital form."""
    return F.lower(F.upper(F.regexp_replace(c, "[\u00df\u1e9e]", "ss")))


def collisions(moves: DataFrame) -> DataFrame:
    """(target, count, src): a row for each file of the targets that several files would take, whatever their case."""
    aimed = moves.select(folded(F.col("tgt")).alias("target"), "src")
    several = aimed.groupBy("target").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
    return several.join(aimed, "target").select("target", "count", "src")


def with_actions(moves: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """A plan with what to do: ``same`` for a file in its place, ``skip`` where another is, else ``move``."""
    there = existing.select(F.col("path").alias("tgt")).distinct().withColumn("_there", F.lit(True))
    out = moves.join(there, "tgt", "left")
    action = F.when(F.col("src") == F.col("tgt"), "same").when(F.coalesce("_there", F.lit(False)) & F.lit(not overwrite), "skip").otherwise("move")
    return out.select("src", "tgt", "kind", action.alias("action"))


def write_partitioned(df: DataFrame, names: list[str], dest: str) -> None:
    """The records themselves in a layout of ``dimension=key`` folders."""
    df.withColumns({f"by_{n}": folder_key(n) for n in names}).repartition(*(f"by_{n}" for n in names)).write.partitionBy(*(f"by_{n}" for n in names)).parquet(dest)


def relative_target(path: Column, roots: list[str]) -> Column:
    """A path below the first root that holds it, else its base name."""
    out = F.substring_index(path, "/", -1)
    for root in reversed(roots):
        base = root.rstrip("/") + "/"
        out = F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(out)
    return out


def reveal_groups(df: DataFrame) -> DataFrame:
    """(parent, n, path): a row for each file, with the number of files in its folder."""
    placed = df.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("parent"), "path")
    return placed.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).join(placed, "parent").select("parent", "n", "path")
