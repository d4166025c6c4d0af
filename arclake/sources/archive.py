"""Archives as tables: detections, entries, chunks, diagnostics and contents of any path Spark can read.

Files come through Spark's ``binaryFile`` source, so globs, object stores and path filters work as for any table.
One archive is one row and is walked in one Python worker; rows of entries stream out in Arrow batches.  ``archives``
holds each file in a row, 2 GB at most; ``listed`` holds names and lengths, and the scans seek in the files themselves,
however large, reading indexes without payloads.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arclake.functions.codec import CodecError, decode
from arclake.functions.texture import TextureError, canonical_header
from arclake.sources.scan import File, Index, walk
from arclake.sources.wire import PREFIX_BYTES

ENTRIES = "path string, family string, ordinal long, display string, identity string, decoded_size long, stored_size long, offset long, content_offset long, content_size long, codec string, hash long, folder_hash long"
CHUNKS = "path string, ordinal long, chunk int, offset long, packed long, decoded long, start_mip int, end_mip int, codec string"
DIAGNOSTICS = "path string, id string, severity string, ordinal long, field string, stored string, expected string"
CONTENTS = "path string, ordinal long, display string, identity string, content binary, error string"


def archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, content of every file below ``path``; never decoded here."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def _u32(prefix: Column, at: int) -> Column:
    byte = lambda i: F.conv(F.hex(F.substring(prefix, i + 1, 1)), 16, 10).cast("long")
    return byte(at) + byte(at + 1) * 256 + byte(at + 2) * 65536 + byte(at + 3) * 16777216


def detect(files: DataFrame) -> DataFrame:
    """path, status, family, version, subtype, method from the first 36 bytes, as column expressions."""
    prefix = F.substring("content", 1, PREFIX_BYTES)
    n, magic = F.length(prefix), F.hex(F.substring(prefix, 1, 4))
    is_magic = {k: (n > 0) & F.lit(v).startswith(magic) for k, v in (("tes3", "00010000"), ("bsa", "42534100"), ("ba2", "42544458"))}
    tes3, bsa, ba2 = is_magic["tes3"], is_magic["bsa"] & ~is_magic["tes3"], is_magic["ba2"] & ~is_magic["bsa"]
    version = F.when((bsa | ba2) & (n >= 8), _u32(prefix, 4))
    subtype = F.when(ba2 & (n >= 12), F.decode(F.substring(prefix, 9, 4), "ISO-8859-1"))
    method = F.when(ba2 & (n >= 36) & (version == 3), _u32(prefix, 32))
    game = F.when(version.isin(1, 7, 8), "FO4").when((version == 2) | (version == 3) & F.coalesce(method == 3, F.lit(True)), "STARFIELD")
    kind = F.when(subtype == "GNRL", "GENERAL").when(subtype == "DX10", "DDS")
    family = (
        F.when(tes3 & (n >= 4), "TES3_BSA")
        .when(bsa & (version == 0x67), "TES4_BSA")
        .when(bsa & (version == 0x68), "FO3_FNV_SKYRIM_LE_BSA")
        .when(bsa & (version == 0x69), "SSE_BSA")
        .when(ba2, F.concat(game, F.lit("_"), kind, F.lit("_BA2")))
    )
    status = F.when(~(tes3 | bsa | ba2), "UNRECOGNIZED").when(family.isNotNull(), "SUPPORTED_FAMILY").when(tes3 | (bsa & version.isNull()) | (ba2 & subtype.isNull()), "INDETERMINATE").otherwise("UNSUPPORTED_VARIANT")
    return files.select("path", status.alias("status"), family.alias("family"), version.alias("version"), subtype.alias("subtype"), method.alias("method"))


KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(schema: str, rows_of, lenient: bool):
    """mapInArrow function that yields ``rows_of(path, index)`` of each archive, read from its bytes or its path."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [KINDS[c.split()[1]] for c in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def of(path: str, index: Index) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for row in rows_of(path, index):
            rows.append(row)
            size += len(row.get("content") or b"") + 200
            if size > 16 << 20:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if "content" in batch.schema.names:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                    yield from of(path, walk(content.as_py(), lenient, path.rpartition("/")[2]))
                continue
            for path, size, modified in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "modified")), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                found = store.get_file_info(place)
                if found.size != size or found.mtime_ns is not None and found.mtime_ns // 1_000_000 != modified:
                    raise SourceChanged(f"source.changed: {path}")
                with store.open_input_file(place) as file:
                    yield from of(path, walk(File(file, size), lenient, path.rpartition("/")[2]))

    return run


class SourceChanged(ValueError):
    """``source.changed``: a file is not the one that was listed."""


def listed(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modified (ms) of every file below ``path``: what the scans below read positionally.

    Contents are not read here nor, for an index, later: a scan seeks in the files and reads their index only, a few
    hundred bytes an entry.  Files must be in a store that Arrow opens; ``archives`` is for those that only Spark reads.
    A file that has changed since it was listed fails the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    modified = F.unix_millis("modificationTime")
    return files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"), F.col("length").cast("long").alias("length"), modified.alias("modified"))


def restated(paths: DataFrame) -> DataFrame:
    """``listed`` rows of known paths, whose lengths and times are looked up where the rows are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fs.FileSystem.from_uri(p) for p in batch.column("path").to_pylist()]
            info = [store.get_file_info(place) for store, place in found]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([i.size for i in info], pa.int64()), pa.array([(i.mtime_ns or 0) // 1_000_000 for i in info], pa.int64())], ["path", "length", "modified"])

    return paths.select("path").mapInArrow(run, "path string, length long, modified long")


def dealt(files: DataFrame) -> DataFrame:
    """``listed`` rows over as many tasks as a shuffle has; they are so few that Spark would leave them to one."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def _scan(files: DataFrame, schema: str, rows_of, lenient: bool) -> DataFrame:
    columns = ["path", "content"] if "content" in files.columns else ["path", "length", "modified"]
    return files.select(*columns).mapInArrow(_rows(schema, rows_of, lenient), schema)


def entries(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Entry rows without payloads, of ``archives`` or of ``listed`` files."""
    return _scan(files, ENTRIES, lambda path, x: ({"path": path, "family": x.found.family, **e} for e in x.entries), lenient)


def chunks(files: DataFrame, lenient: bool = False) -> DataFrame:
    return _scan(files, CHUNKS, lambda path, x: ({"path": path, **c} for c in x.chunks), lenient)


def diagnostics(files: DataFrame, lenient: bool = False) -> DataFrame:
    return _scan(files, DIAGNOSTICS, lambda path, x: ({"path": path, **d} for d in x.diagnostics), lenient)


def payload(x: Index, at: int, size: int) -> bytes:
    data = x.blob.read(at, size)
    if len(data) != size:
        raise CodecError("io.span-out-of-range")
    return data


def read_entry(x: Index, entry: dict, own: list[dict] | None = None) -> bytes:
    """Decoded bytes of an entry; a texture is its canonical header and its chunks in serialized order."""
    t = entry["dds"]
    if t is None:
        return decode(payload(x, entry["content_offset"], entry["content_size"]), entry["codec"], entry["decoded_size"])
    own = [c for c in x.chunks if c["ordinal"] == entry["ordinal"]] if own is None else own
    parts = [decode(payload(x, c["offset"], c["packed"] or c["decoded"]), c["codec"], c["decoded"]) for c in own]
    return canonical_header(t["width"], t["height"], t["mips"], t["format"], bool(t["flags"] & 1), t["tile"], t["console"]) + b"".join(parts)


def require_distinct(ordinals: list[int]) -> set[int]:
    """A selection names each ordinal once."""
    if len(set(ordinals)) < len(ordinals):
        raise ValueError("selection.duplicate-ordinal")
    return set(ordinals)


def contents(files: DataFrame, ordinals: list[int] | None = None, lenient: bool = False) -> DataFrame:
    """Decoded entries; ``ordinals`` are picked before anything is decoded."""
    wanted = None if ordinals is None else require_distinct(ordinals)

    def rows(path: str, x: Index) -> Iterator[dict]:
        chunks_of: dict[int, list[dict]] = {}
        for c in x.chunks:
            chunks_of.setdefault(c["ordinal"], []).append(c)
        for e in x.entries:
            if wanted is None or e["ordinal"] in wanted:
                row = {"path": path, "ordinal": e["ordinal"], "display": e["display"], "identity": e["identity"]}
                try:
                    yield {**row, "content": read_entry(x, e, chunks_of.get(e["ordinal"], []))}
                except (CodecError, TextureError, struct.error) as fault:
                    yield {**row, "error": str(fault)}

    return _scan(files, CONTENTS, rows, lenient)


def summary(files: DataFrame, lenient: bool = False, path: Column | None = None) -> DataFrame:
    """Per archive: entries, compressed entries, codecs, bytes; archives for which ``path`` gives the same are added up."""
    found = entries(files, lenient)
    return (found if path is None else found.withColumn("path", path)).groupBy("path", "family").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("codec") != "stored").alias("compressed"),
        F.array_join(F.array_sort(F.collect_set("codec")), ",").alias("codecs"), F.sum("decoded_size").alias("decoded_bytes"), F.sum("stored_size").alias("stored_bytes"),
    )


def corpus_bytes(seed: str, size: int, block: int = 1 << 20) -> bytes:
    """Deterministic bytes for benchmarks: SHAKE-256 of the seed and the number of each block."""
    out = b"".join(hashlib.shake_256(f"{seed}:{i}".encode()).digest(min(block, size - i * block)) for i in range(-(-size // block)))
    return out[:size]
