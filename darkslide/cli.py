"""The command line: ls, info, summary, organize, extract, reveal and cache over folders of RAW files.

Data goes to standard output, messages to standard error. Exit codes: 0 done, 1 refused or partly failed, 2 usage.
"""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import organize, sort, summary
from .operators.where import WhereError, parse, where
from .sources import rawphotos, sinks
from .sources.cache import Snapshot


class Usage(Exception):
    """Wrong arguments."""


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("darkslide").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cache(spark: SparkSession) -> Snapshot | None:
    if os.environ.get("DARKSLIDE_NO_CACHE"):
        return None
    home = os.environ.get("DARKSLIDE_CACHE_DIR") or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "darkslide")
    from pyspark.sql.types import _parse_datatype_string

    return Snapshot(spark, home, _parse_datatype_string(rawphotos.CACHE_SCHEMA))


def _checked(args: argparse.Namespace) -> None:
    """Filter, sort keys and dimensions, before anything is read."""
    try:
        if getattr(args, "where", ""):
            parse(args.where)
        if getattr(args, "sort", ""):
            sort.parse_keys(args.sort)
        by = getattr(args, "by", None)
        if by and args.command == "summary":
            if "," in by:
                raise ValueError("summary takes one dimension")
            organize.parse_chain(by)
        elif by:
            organize.parse_chain(by)
    except (WhereError, ValueError) as e:
        raise Usage(str(e)) from None


def _records(spark: SparkSession, args: argparse.Namespace, paths: list[str]) -> DataFrame:
    df = rawphotos.read_photos(spark, paths, args.recursive, _cache(spark), os.environ.get("DARKSLIDE_BACKEND") or "own")
    return where(df, args.where) if args.where else df


def _matched(df: DataFrame, args: argparse.Namespace) -> bool:
    """Whether a filter, if there is one, keeps a record; says so if not."""
    if args.where and df.isEmpty():
        print("no records match --where", file=sys.stderr)
        return False
    return True


def _ls(spark, args) -> int:
    paths = args.paths or ["."]
    if not rawphotos.list_raws(paths, args.recursive):
        return 0
    df = sort.sort_records(_records(spark, args, paths), args.sort, args.reverse)
    if args.json:
        for r in sinks.json_lines(df).toLocalIterator():
            print(r[0])
    elif sys.stdout.isatty():
        print(sinks.table_text([r.asDict() for r in df.toLocalIterator()], sort.parse_keys(args.sort), args.reverse))
    else:
        for r in df.select("path").toLocalIterator():
            print(r[0])
    return 0


def _info(spark, args) -> int:
    paths = rawphotos.paths_from(args.paths, sys.stdin)
    if not rawphotos.list_raws(paths, args.recursive):
        print("no RAW files", file=sys.stderr)
        return 1
    df = _records(spark, args, paths)
    if not _matched(df, args):
        return 1
    inside = rawphotos.pictures(df).select("path", F.struct("width", "height", "size", "error").alias("jpeg"))
    for r in df.join(inside, "path", "left").orderBy(sort.path_order()).toLocalIterator():
        record = sinks.file_record(r.asDict(), sinks.jpegs_text(*r["jpeg"]) if r["jpeg"] else None)
        print(json.dumps(record, ensure_ascii=False) if args.json else "\n".join(f"{k}: {v}" for k, v in record.items()) + "\n")
    return 0


def _summary(spark, args) -> int:
    paths = rawphotos.paths_from(args.paths, sys.stdin)
    if not rawphotos.list_raws(paths, args.recursive):
        print("no RAW files", file=sys.stderr)
        return 1
    df = _records(spark, args, paths)
    if not _matched(df, args):
        return 1
    if args.json:
        out = json.loads(summary.report(df).first()[0])
        print(json.dumps({"paths": [os.path.realpath(r[0]) for r in df.select("path").orderBy(sort.path_order()).toLocalIterator()], **out}, ensure_ascii=False))
    elif args.by:
        print(sinks.breakdown_text(summary.by_dimension(df, args.by).collect()))
    else:
        print(sinks.summary_text(df, args.where, shutil.get_terminal_size().columns if sys.stdout.isatty() else None))
    return 0


def _organize(spark, args) -> int:
    piped = args.paths == ["-"] or (not args.paths and not sys.stdin.isatty())
    paths = rawphotos.paths_from(args.paths, sys.stdin)
    if piped and not args.output:
        raise Usage("with paths from standard input, -o is needed")
    dest = args.output or (paths[0] if os.path.isdir(paths[0]) else os.getcwd())
    moves = organize.plan(_records(spark, args, paths), organize.parse_chain(args.by), dest)
    found = rawphotos.list_raws(paths, args.recursive)
    beside = sorted({os.path.join(d, n) for d in {os.path.dirname(p) or "." for p in found} for n in os.listdir(d)})
    if beside:
        moves = organize.with_sidecars(moves, spark.createDataFrame([(p,) for p in beside], "path string"))
    moves = moves.cache()
    clash: dict[str, list[str]] = {}
    for c in organize.collisions(moves).orderBy("target", "src").toLocalIterator():
        clash.setdefault(c["target"], []).append(c["src"])
    for target, sources in clash.items():
        print(f"{target}: {', '.join(sources)}", file=sys.stderr)
    if clash:
        return 1
    failed, done = 0, []
    there = spark.createDataFrame([(t["tgt"],) for t in moves.select("tgt").toLocalIterator() if os.path.exists(t["tgt"])], "path string")
    for m in organize.with_actions(moves, there, args.overwrite).orderBy("src").toLocalIterator():
        if m["action"] == "same" or (os.path.exists(m["tgt"]) and os.path.samefile(m["src"], m["tgt"])):
            continue
        if m["action"] == "skip":
            print(f"exists: {m['tgt']}", file=sys.stderr)
            continue
        print(f"{m['src']} -> {m['tgt']}", file=sys.stderr)
        if not args.dry_run:
            try:
                os.makedirs(os.path.dirname(m["tgt"]), exist_ok=True)
                (shutil.copy2 if args.copy else shutil.move)(m["src"], m["tgt"])
                done.append((os.path.abspath(m["src"]), m["tgt"]))
            except OSError as e:
                print(e, file=sys.stderr)
                failed += 1
    _rekey(spark, done, args.copy)
    if args.prune and not args.dry_run:
        for p in paths:
            prune(p)
    return 1 if failed else 0


def _rekey(spark: SparkSession, done: list[tuple[str, str]], copied: bool) -> None:
    """Has the cache know moved files under their new paths, and copies as well as their sources."""
    cache = _cache(spark)
    if not done or cache is None or not cache.enabled:
        return
    rows = [(src, x["abspath"], *(x.get(k) for k in ("dev", "ino", "size_bytes", "mtime_ns"))) for src, tgt in done for x in [rawphotos.state_of(tgt)]]
    cache.relocate(spark.createDataFrame(rows, "src string, tgt string, dev bigint, ino bigint, size bigint, mtime_ns bigint"), copied)


def prune(root: str) -> list[str]:
    """Removes empty folders below a root that aren't hidden, from the bottom; a .DS_Store doesn't count as content."""
    gone = []
    for folder, _, _ in os.walk(root, topdown=False):
        if folder == root or any(x.startswith(".") for x in os.path.relpath(folder, root).split("/")):
            continue
        if not set(os.listdir(folder)) - {".DS_Store"}:
            if os.path.exists(junk := os.path.join(folder, ".DS_Store")):
                os.remove(junk)
            os.rmdir(folder)
            gone.append(folder)
    return gone


def _resizer(quality: int):
    """What resizes pictures, if its library is here."""
    try:
        import io

        from PIL import Image, ImageOps
    except ImportError:
        return None

    def resize(data: bytes, width: int, height: int) -> bytes:
        picture = ImageOps.exif_transpose(Image.open(io.BytesIO(data)))
        out = io.BytesIO()
        sides = (width, height) if (picture.width >= picture.height) == (width >= height) else (height, width)
        picture.convert("RGB").resize(sides, Image.Resampling.LANCZOS).save(out, "JPEG", quality=quality, subsampling=0)
        return out.getvalue()

    return resize


def _extract(spark, args) -> int:
    bound = {k: v for k, v in (("long", args.long), ("short", args.short), ("megapixels", args.mp)) if v}
    if len(bound) > 1:
        raise Usage("one of --long, --short and --mp at most")
    if any(v < 0 for v in bound.values()) or not 1 <= args.quality <= 100:
        raise Usage("bounds must be above 0, --quality from 1 to 100")
    if bound and _resizer(args.quality) is None:
        print("--long, --short and --mp need the Pillow library", file=sys.stderr)
        return 1
    paths = [os.path.abspath(p) for p in rawphotos.paths_from(args.paths, sys.stdin)]
    found = rawphotos.list_raws(paths, args.recursive)
    if not found:
        print("no RAW files", file=sys.stderr)
        return 1
    src = spark.createDataFrame([(p,) for p in found], "path string")
    if args.where:
        src = _records(spark, args, paths).select("path")
        if not _matched(src, args):
            return 1
    rel = F.regexp_replace(organize.relative_target(F.col("path"), [p for p in paths if os.path.isdir(p)]), r"\.[^./]*$", ".jpg")
    targets = src.select(F.col("path").alias("src"), F.concat(F.lit(os.path.abspath(args.output).rstrip("/") + "/"), rel).alias("tgt"))
    try:
        done = rawphotos.write_jpegs(targets, args.force, _resizer(args.quality) if bound else None, **bound).collect()  # a line of text a file
    except FileExistsError as e:
        print(e, file=sys.stderr)
        return 1
    for r in sorted(done):
        print(f"{r['target']}: {r['outcome']}", file=sys.stderr)
    return 0 if all(r["outcome"] in ("written", "exists") for r in done) else 1


def _reveal(spark, args) -> int:
    paths = [p for p in rawphotos.paths_from(args.paths, sys.stdin) if os.path.exists(p)]
    df = spark.createDataFrame([(os.path.realpath(p),) for p in paths], "path string")
    for r in organize.reveal_groups(df).select("parent", "n").distinct().orderBy("parent").toLocalIterator():
        print(r["parent"], r["n"], sep="\t")
    return 0


def _cache_admin(spark, args) -> int:
    cache = _cache(spark)
    if cache is None:
        print("the cache is off by DARKSLIDE_NO_CACHE", file=sys.stderr)
        return 1
    if args.action == "info":
        print(json.dumps(cache.info()))
    elif args.action == "clear":
        if not args.yes and not sys.stdin.isatty():
            raise Usage("cache clear needs --yes")
        print(cache.clear())
    elif args.action == "vacuum":
        print(cache.vacuum(rawphotos.existing(cache.read())))
    else:
        cache.enable(args.action == "enable")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="darkslide", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *, filters: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        p.add_argument("paths", nargs="*")
        if filters:
            p.add_argument("-R", "--recursive", action="store_true")
            p.add_argument("-w", "--where", default="")
        return p

    p = command("ls", _ls)
    p.add_argument("-s", "--sort", default="datetime")
    p.add_argument("-r", "--reverse", action="store_true")
    p.add_argument("--json", action="store_true")
    command("info", _info).add_argument("--json", action="store_true")
    p = command("summary", _summary)
    p.add_argument("--by")
    p.add_argument("--json", action="store_true")
    p = command("organize", _organize)
    p.add_argument("--by", default="")
    p.add_argument("-o", "--output")
    for flag in ("--copy", "--overwrite", "--dry-run", "--prune"):
        p.add_argument(flag, action="store_true")
    p = command("extract", _extract)
    p.add_argument("-o", "--output", default="./jpegs")
    p.add_argument("-f", "--force", "--overwrite", action="store_true")
    p.add_argument("--long", type=int, default=0)
    p.add_argument("--short", type=int, default=0)
    p.add_argument("--mp", type=float, default=0.0)
    p.add_argument("-q", "--quality", type=int, default=90)
    command("reveal", _reveal, filters=False)
    p = sub.add_parser("cache")
    p.set_defaults(run=_cache_admin)
    p.add_argument("action", choices=("info", "clear", "vacuum", "enable", "disable"))
    p.add_argument("--yes", action="store_true")
    args = top.parse_args(argv)
    try:
        _checked(args)
        return args.run(_session(), args)
    except Usage as e:
        print(e, file=sys.stderr)
        return 2
    except rawphotos.MissingInput as e:
        print(f"not found: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
