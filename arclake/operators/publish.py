"""Staged, all-or-nothing publication of files built by a query.

Executors write every file below a staging folder beside the target; only when the whole job has ended are the files
moved into place, with predecessors kept until the last move has succeeded and put back if one fails.  Attempts that
were lost leave only unlisted files in the staging folder, which is removed once everything is in place or put back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arclake.functions import names
from arclake.operators import validate
from arclake.sources import archive

STAGED = "name string, staged string, size long"


class PublicationError(ValueError):
    """``target.exists``, ``target.unsafe-name`` or ``target.collision``."""


def _stage(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            rows = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                staged = f"{root}/{uuid.uuid4().hex}"
                with store.open_output_stream(staged, compression=None) as out:
                    out.write(content)
                rows.append((name, staged, len(content)))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["name", "staged", "size"])

    return run


#: States of a transaction.  ROLLBACK_INCOMPLETE leaves the staging folder with whatever could not be put back.
STATES = ("STAGED", "COMMITTED", "ROLLED_BACK", "ROLLBACK_INCOMPLETE")


class Transaction:
    """Moves staged files into place, or puts everything back.

    Every step is recorded before it is taken, so that an interruption between the two is undone as well.  A file that
    someone else puts in place meanwhile is never removed: moves do not overwrite, and rollback only takes away what was
    moved from this staging folder.
    """

    def __init__(self, store: fs.FileSystem, root: str, staging: str) -> None:
        self.store, self.root, self.staging, self.state = store, root, staging, "STAGED"
        self.steps: list[tuple[str, str]] = []

    def exists(self, path: str) -> bool:
        return self.store.get_file_info(path).type != fs.FileType.NotFound

    def move(self, source: str, target: str) -> None:
        if self.exists(target):
            raise PublicationError("target.exists")
        self.steps.append((source, target))
        self.store.move(source, target)

    def commit(self, rows: list[tuple[str, str, int]], replaced: set[str]) -> None:
        try:
            for name, staged, _ in rows:
                place = f"{self.root}/{name}"
                self.store.create_dir(place.rpartition("/")[0], recursive=True)
                if name in replaced:
                    self.move(place, f"{self.staging}/{uuid.uuid4().hex}.kept")
                self.move(staged, place)
        except BaseException:
            self.rollback()
            raise
        self.state = "COMMITTED"

    def rollback(self) -> None:
        """Undo the steps, last first; a step whose source is still there was never taken."""
        self.state = "ROLLED_BACK"
        for source, target in reversed(self.steps):
            try:
                if not self.exists(source) and self.exists(target):
                    self.store.move(target, source)
            except OSError:
                self.state = "ROLLBACK_INCOMPLETE"

    def clean(self) -> None:
        """Remove the staging folder, unless it holds predecessors that could not be put back."""
        if self.state != "ROLLBACK_INCOMPLETE" and self.exists(self.staging):
            self.store.delete_dir(self.staging)


def publish(files: DataFrame, target: str, policy: str = "FAIL", verify: Callable[[list[tuple[str, str, int]]], None] | None = None) -> list[tuple[str, int]]:
    """Write (name, content) rows as files below ``target``; returns what was published, in name order.

    ``FAIL`` refuses a target that has any of the files, ``REPLACE`` puts them in its place.  Names use ``/``.  ``verify``
    sees the staged files (name, place, size) before anything is moved.
    """
    if policy not in ("FAIL", "REPLACE"):
        raise ValueError(policy)
    target = target if "://" in target else f"file://{target}"
    store, root = fs.FileSystem.from_uri(target)
    staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"
    work = Transaction(store, root, fs.FileSystem.from_uri(staging)[1])
    try:
        rows = sorted((r["name"], r["staged"], r["size"]) for r in files.select("name", "content").mapInArrow(_stage(staging), STAGED).toLocalIterator())
        if any(n.startswith("/") or any(s in ("", ".", "..") for s in n.split("/")) for n, _, _ in rows):
            raise PublicationError("target.unsafe-name")
        if len({n.lower() for n, _, _ in rows}) < len(rows):
            raise PublicationError("target.collision")
        there = {n for n, _, _ in rows if work.exists(f"{root}/{n}")}
        if there and policy == "FAIL":
            raise PublicationError("target.exists")
        if verify is not None:
            verify(rows)
        work.commit(rows, there)
    finally:
        work.clean()
    return [(n, size) for n, _, size in rows]


def read_back(spark: SparkSession) -> Callable[[list[tuple[str, str, int]]], None]:
    """Checks staged archives: each is opened again and must be free of diagnostics that make it noncanonical."""

    def verify(rows: list[tuple[str, str, int]]) -> None:
        files = spark.createDataFrame([(f"file://{p}" if p.startswith("/") else p,) for _, p, _ in rows], "path string")
        found = archive.diagnostics(archive.restated(files)).filter(~F.col("id").isin(*validate.WARN_ONLY)).limit(1).collect()
        if found:
            raise PublicationError(f"{found[0]['id'].split('.')[0]}.noncanonical-staged-output")

    return verify


def publish_parts(parts: DataFrame, target: str, extension: str, policy: str = "FAIL") -> list[tuple[str, int]]:
    """Archive parts as files: the first keeps the archive's name, further ones carry their number before the dot."""
    whole = F.concat("archive", F.lit(extension))
    name = F.when(F.col("part") == 0, whole).otherwise(names.split_path(whole, F.col("part")))
    return publish(parts.select(name.alias("name"), "content"), target, policy, read_back(parts.sparkSession))


def extract(contents: DataFrame, target: str, policy: str = "FAIL") -> list[tuple[str, int]]:
    """Decoded entries as a tree; every entry needs an identity, a name that Windows accepts too, and sound content."""
    refused = F.col("identity").isNull() | names.is_windows_invalid(F.col("display"))
    bad = contents.filter(refused | F.col("error").isNotNull()).select("ordinal", refused.alias("refused"), "error").agg(F.min(F.struct(~F.col("refused"), "ordinal", "error")).alias("first")).first()["first"]
    if bad is not None:
        raise PublicationError(bad["error"] if bad[0] else "target.unsafe-name")
    return publish(contents.select(F.translate(F.col("display"), "\\", "/").alias("name"), "content"), target, policy)
