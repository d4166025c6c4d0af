"""What an archive is packed from: folders, files, other archives, named files and generated entries, as one relation.

Only names, lengths and times are listed on the driver; contents are read by the executors, which refuse a file that is
not the one that was listed.  Entries come with ``seq``: sources in their order, within a folder by identity, then by the
name as it is spelt, within an archive by ordinal.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclake.sources import archive, wire

ENTRIES = "name string, payload binary, seq long"
#: Entries of one source at most; sources are numbered above.
PLACES = 40


class SourceError(ValueError):
    """``pack.source-missing``, ``pack.source-kind``, ``source.changed`` or a payload's own error."""


@dataclass(frozen=True)
class DetectedPath:
    """A folder, an archive that is recognised, or any other file, which keeps its last name."""

    path: str


@dataclass(frozen=True)
class NamedFile:
    """A file under a name of its own."""

    path: str
    name: str


@dataclass(frozen=True)
class Generated:
    """Deterministic bytes under a name: ``archive.corpus_bytes`` of a seed."""

    name: str
    seed: str
    size: int


Source = DetectedPath | NamedFile | Generated


def walk(root: str, outputs: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(name, path) of the regular files below a folder, by identity and then by name; links are not followed.

    ``outputs`` are targets: neither they nor their numbered parts are sources.
    """
    own = [re.compile(re.escape(stem) + r"\d*" + re.escape(dot + ext) + r"\Z") for stem, dot, ext in (_stem(os.path.abspath(o)) for o in outputs)]
    found: list[tuple[str, str]] = []
    folders = [os.path.abspath(root)]
    base = len(folders[0].rstrip("/")) + 1
    while folders:
        with os.scandir(folders.pop()) as items:
            for item in items:
                if item.is_dir(follow_symlinks=False):
                    folders.append(item.path)
                elif item.is_file(follow_symlinks=False) and not any(p.match(item.path) for p in own):
                    found.append((item.path[base:].replace("/", "\\"), item.path))
    return sorted(found, key=lambda f: (wire.identity(f[0]) or "", f[0]))


def _stem(path: str) -> tuple[str, str, str]:
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".")
    return (f"{folder}/{stem}", dot, ext) if dot else (path, "", "")


def _is_archive(path: str) -> bool:
    with open(path, "rb") as file:
        return wire.detect(file.read(wire.PREFIX_BYTES)).status == "SUPPORTED_FAMILY"


def listing(sources: list[Source], outputs: tuple[str, ...] = ()) -> tuple[list[tuple], list[tuple[int, str]], list[tuple]]:
    """Files (name, path, length, modified, seq), archives (source, path) and generated entries (name, seed, size, seq)."""
    files: list[tuple] = []
    archives: list[tuple[int, str]] = []
    made: list[tuple] = []
    for i, source in enumerate(sources):
        first = i << PLACES
        if isinstance(source, Generated):
            made.append((source.name, source.seed, source.size, first))
            continue
        if not os.path.lexists(source.path):
            raise SourceError("pack.source-missing")
        named = [(source.name, source.path)] if isinstance(source, NamedFile) else walk(source.path, outputs) if os.path.isdir(source.path) else [(os.path.basename(source.path), source.path)]
        if isinstance(source, DetectedPath) and os.path.isfile(source.path) and _is_archive(source.path):
            archives.append((i, source.path))
            continue
        for place, (name, path) in enumerate(named):
            if not os.path.isfile(path):
                raise SourceError("pack.source-kind")
            info = os.stat(path)
            files.append((name, os.path.abspath(path), info.st_size, info.st_mtime_ns, first + place))
    return files, archives, made


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            path, size, modified = (batch.column(c)[i].as_py() for c in ("path", "length", "modified"))
            store, place = fs.FileSystem.from_uri(f"file://{path}") if "://" not in path else fs.FileSystem.from_uri(path)
            with store.open_input_stream(place, compression=None) as file:
                data = file.read()
            info = store.get_file_info(place)
            if (len(data), info.size, info.mtime_ns) != (size, size, modified):
                raise SourceError(f"source.changed: {path}")
            row = batch.slice(i, 1)
            yield pa.RecordBatch.from_arrays([row.column("name"), pa.array([data], pa.binary()), row.column("seq")], ["name", "payload", "seq"])


def _make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            data = archive.corpus_bytes(batch.column("seed")[i].as_py(), batch.column("size")[i].as_py())
            yield pa.RecordBatch.from_arrays([row.column("name"), pa.array([data], pa.binary()), row.column("seq")], ["name", "payload", "seq"])


def entries(spark: SparkSession, sources: list[Source], outputs: tuple[str, ...] = (), lenient: bool = False) -> DataFrame:
    """name, payload, seq of all sources, to be overlaid by the packer."""
    files, archives, made = listing(sources, outputs)
    spread = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    parts = [spark.createDataFrame(files, "name string, path string, length long, modified long, seq long").repartition(spread).mapInArrow(_read, ENTRIES)]
    if made:
        parts.append(spark.createDataFrame(made, "name string, seed string, size long, seq long").mapInArrow(_make, ENTRIES))
    for i, path in archives:
        found = archive.contents(archive.listed(spark, os.path.abspath(path)), lenient=lenient)
        payload = F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.col("error")).cast("binary"))
        parts.append(found.select(F.col("display").alias("name"), payload.alias("payload"), (F.col("ordinal") + (i << PLACES)).alias("seq")))
    return reduce(DataFrame.unionByName, parts)
