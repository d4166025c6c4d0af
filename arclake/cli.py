"""Command line: pack, unpack, list and dump archives.

    arclake [--workers N] [--progress] [--lenient] COMMAND
    arclake pack SOURCE[+SOURCE...] NAME --family FAMILY [--stored] [--split GIB] [--share yes|no] [--masks a;b] [--flags HEX] [--file-flags HEX] [--replace]
    arclake unpack ARCHIVE [DIR] [--replace]
    arclake list ARCHIVE [--dump] [--masks a;b]

A source is a folder, an archive, whose entries are packed, or a file.

Exit codes: 0 done, 1 the archive or target refuses, 2 wrong usage, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arclake import VERSION
from arclake.operators import control, pack, publish, sources, staging, validate
from arclake.plans import packing
from arclake.sources import archive, wire


def _hex(text: str) -> int:
    value = int(text, 16)
    if not 0 <= value < 1 << 32:
        raise argparse.ArgumentTypeError("not an unsigned 32-bit number")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arclake")
    top.add_argument("--version", action="version", version=f"arclake {VERSION}")
    top.add_argument("--workers", type=int, help="threads on this machine, where no cluster is configured")
    top.add_argument("--progress", action="store_true", help="count tasks on standard error")
    top.add_argument("--lenient", action="store_true", help="read what the compatibility profile tolerates")
    commands = top.add_subparsers(dest="command", required=True)
    p = commands.add_parser("pack")
    p.add_argument("sources")
    p.add_argument("target")
    p.add_argument("--family", required=True, choices=wire.WRITERS)
    p.add_argument("--stored", action="store_true")
    p.add_argument("--split", type=int, choices=range(9), help="GiB of a part, 0 for the family's own")
    p.add_argument("--share", choices=("yes", "no"), default="yes")
    p.add_argument("--masks", default="")
    p.add_argument("--flags", type=_hex)
    p.add_argument("--file-flags", type=_hex)
    p.add_argument("--replace", action="store_true")
    u = commands.add_parser("unpack")
    u.add_argument("archive")
    u.add_argument("target", nargs="?", default=".")
    u.add_argument("--replace", action="store_true")
    show = commands.add_parser("list")
    show.add_argument("archive")
    show.add_argument("--dump", action="store_true")
    show.add_argument("--masks", default="")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    policy = "REPLACE" if getattr(args, "replace", False) else "FAIL"
    if args.command == "pack":
        target = Path(args.target).resolve()
        paths = [sources.DetectedPath(s) for s in args.sources.split("+")]
        entries = sources.entries(spark, paths, (str(target),), args.lenient).withColumn("archive", F.lit(target.stem))
        options = pack.PackOptions(args.family, not args.stored, args.share == "yes", args.split << 30 if args.split else None, tuple(m for m in args.masks.split(";") if m), args.flags, args.file_flags, leave_out=(), require_entries=True)
        done = publish.publish_parts(pack.pack(entries, options), str(target.parent), target.suffix, policy)
        return [f"{n}\t{size}" for n, size in done]
    files = archive.listed(spark, args.archive)
    control.require(archive.entries(files, args.lenient), control.Limits(), ["path"])
    if args.command == "unpack":
        return [f"{n}\t{size}" for n, size in publish.extract(archive.contents(files, lenient=args.lenient), str(Path(args.target).resolve()), policy)]
    found = archive.entries(files, args.lenient)
    if args.masks:
        found = packing.keep_masks(found, [m for m in args.masks.split(";") if m], "display")
    columns = ["ordinal", "display", "decoded_size", *(["stored_size", "codec", "offset", "hash"] if args.dump else [])]
    lines = ["\t".join(map(str, r)) for r in found.orderBy("path", "ordinal").select(*columns).toLocalIterator()]
    notes = validate.retain(archive.diagnostics(files, args.lenient).withColumns({"phase": F.lit(0), "location": F.col("field")}), ["path"], control.Limits().diagnostics)
    lines += [f"{r['id']}{'' if r['omitted'] is None else chr(9) + str(r['omitted'])}" for r in notes.orderBy("path", "place").toLocalIterator()]
    totals = archive.summary(files, args.lenient).orderBy("path").toLocalIterator()
    return lines + [f"{r['family']}\t{r['entries']} entries\t{r['compressed']} compressed\t{r['decoded_bytes']} bytes" for r in totals]


def watched(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """The command as an operation whose tasks are counted on standard error, and which an interrupt cancels."""
    operation = control.Operation(spark, lambda: run(spark, args))
    try:
        while operation.thread.is_alive():
            operation.thread.join(1.0)
            now = operation.progress()
            if args.progress and now.tasks:
                print(f"\r{now.done}/{now.tasks} tasks", end="", file=sys.stderr)
    except KeyboardInterrupt:
        operation.cancel()
    return operation.wait()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("arclake").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = (builder.master(f"local[{args.workers}]") if args.workers else builder).getOrCreate()
    try:
        print("\n".join(watched(spark, args)))
        return 0
    except control.Cancelled:
        return 130
    except (pack.PackError, publish.PublicationError, sources.SourceError, ValueError) as fault:
        print(fault, file=sys.stderr)
        return 1
    finally:
        staging.release(spark)


if __name__ == "__main__":
    sys.exit(main())
