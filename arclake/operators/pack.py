"""Packing as one plan: overlay, masks, order, codec, sharing, parts, assembly; and its inverse, extraction.

Names, hashes, order, sharing and parts are planned without payloads; payloads are fetched and encoded in Arrow batches,
each distinct one once; an archive part is assembled from its rows, whose size the split target bounds, or written
through to a file, whatever its size (``pack_files``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arclake.functions import codec as codecs
from arclake.functions import names
from arclake.operators import staging
from arclake.plans import packing
from arclake.functions.texture import analyze, canonical_header, widen_bgr24
from arclake.sources.wire import WRITERS, Item, Texture, around, build, build_textures, embeds, frame

PARTS = "archive string, part int, entries long, content binary"
FILES = "archive string, part int, entries long, path string, length long, modified long"


class PackError(ValueError):
    """A rejected request: ``pack.*`` or a format limit."""


@dataclass(frozen=True)
class PackOptions:
    """How to pack; flags of None follow the entries, a split target of None the family, a ceiling of None has no end."""

    family: str
    compress: bool = True
    share: bool = True
    split: int | None = None
    masks: tuple[str, ...] = ()
    archive_flags: int | None = None
    file_flags: int | None = None
    #: Compression of chosen entries: identity, compression, and archive where choices are of one archive.
    overrides: DataFrame | None = field(default=None, compare=False)
    max_decoded: int | None = None
    #: Entries left out instead of rejected; an empty tuple rejects every request the reference rejects.
    leave_out: tuple[str, ...] = ("unsafe", "non-dds")
    #: Whether a request without entries is rejected; a query over an empty table has no archives instead.
    require_entries: bool = False


def check_options(options: PackOptions) -> None:
    """Rejections in their fixed order: family, codec, flags, split."""
    if options.family not in WRITERS:
        raise PackError("archive.unsupported-encoding")
    layout, version, _ = WRITERS[options.family]
    if options.compress and layout == "tes3" and options.overrides is not None:
        raise PackError("pack.unsupported-compression")
    for value in (options.archive_flags, options.file_flags):
        if value is not None and (layout != "bsa" or not 0 <= value < 1 << 32):
            raise PackError("pack.unsupported-flags")
    if options.split is not None and options.split < 0:
        raise PackError("pack.invalid-split")


def admit(entries: DataFrame, options: PackOptions) -> DataFrame:
    """The winning row of each identity, without payloads: archive, identity, seq, position, size, print, as a table.

    Or the first rejection in the reference's order: names that cannot be encoded, masked or overlaid ones too; then name
    rules and limits in plan order; then overrides that match nothing; then decoded bytes.  One pass reads names, sizes
    and prints; no payload is shuffled.
    """
    layout, version, _ = WRITERS[options.family]
    n = F.col("name")
    encodable = names.is_ascii(n) if layout in ("tes3", "bsa") else names.is_ansi(n)
    payload = F.col("payload").cast("binary")
    rows = entries.select("archive", "name", names.identity(n).alias("identity"), F.coalesce(encodable, F.lit(False)).alias("encodable"), "seq", F.octet_length(payload).cast("long").alias("size"), packing.content_print(payload).alias("print"))
    if "unsafe" in options.leave_out:
        rows = rows.filter(F.col("identity").isNotNull())
    rows = rows.withColumn("bad", F.col("identity").isNull() | ~F.col("encodable"))
    kept = F.col("bad") | names.matches_masks(n, list(options.masks))
    if layout == "dds" and "non-dds" in options.leave_out:
        kept &= F.col("bad") | F.col("identity").endswith(".dds")
    key = F.concat_ws("\x00", "archive", "identity")
    rows = staging.stage(packing.overlay(rows.filter(kept).select(F.when(~F.col("bad"), key).alias("key"), "archive", "identity", "bad", "size", "print", "seq", F.col("seq").alias("winner")), "key", "seq").drop("key"))
    embedded = embeds_names(options)
    fault = F.when(F.col("bad"), "pack.invalid-encode-name").otherwise(name_fault(layout, embedded))
    order = F.struct(~F.col("bad"), "archive", "position", "identity", fault.alias("fault"))
    first = rows.filter(fault.isNotNull()).agg(F.min(order).alias("first")).first()["first"]
    if first is not None:
        raise PackError(first["fault"])
    if options.require_entries and rows.isEmpty():
        raise PackError(f"{'ba2' if layout == 'dds' else layout}.empty-entry-set")
    if options.overrides is not None:
        check_choices(rows, options.overrides)
    if layout != "dds":
        check_decoded(rows.withColumnRenamed("position", "ordinal"), options, "size")
    return rows.select("archive", "identity", F.col("winner").alias("seq"), "position", "size", "print")


def choice_keys(overrides: DataFrame) -> list[str]:
    return [k for k in ("archive", "identity") if k in overrides.columns]


def check_choices(rows: DataFrame, overrides: DataFrame) -> None:
    """Each choice matches an entry, and no entry has two: a join would double it, and no reader takes such an archive."""
    keys = choice_keys(overrides)
    if not packing.unmatched_overrides(rows, overrides, keys).isEmpty():
        raise PackError("pack.unmatched-entry-compression")
    if not overrides.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise PackError("pack.repeated-entry-compression")


def embeds_names(options: PackOptions) -> bool:
    layout, version, _ = WRITERS[options.family]
    return embeds(layout, version, options.archive_flags or 0)


def name_fault(layout: str, embedded: bool) -> Column:
    """What a family refuses about an identity, or null."""
    key = F.col("identity")
    if layout == "tes3":
        return F.lit(None).cast("string")
    limit = packing.wire_limits(layout, embedded).isNotNull()
    foldered = key.contains("\\")
    if layout == "bsa":
        return F.when(~foldered | names.basename(key).rlike(r"\A\.[^.]*\z") | limit, "bsa.invalid-encode-name")
    refused = F.when(~foldered | ~names.is_ascii(key) | limit, "ba2.invalid-encode-name")
    return F.when(~key.endswith(".dds"), "dds.non-dds-entry").otherwise(refused) if layout == "dds" else refused


def check_decoded(rows: DataFrame, options: PackOptions, size: str) -> None:
    if options.max_decoded is not None and not packing.decoded_limit(rows.select("archive", "ordinal", size), options.max_decoded, size, ["archive"]).isEmpty():
        raise PackError("operation.resource-limit")


def payloads_of(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """The payloads of chosen rows; the one place where payloads are shuffled before they are encoded."""
    sources = entries.select("archive", names.identity(F.col("name")).alias("identity"), "seq", F.col("payload").cast("binary").alias("payload"))
    return sources.join(wanted, ["archive", "identity", "seq"])


def plan_entries(entries: DataFrame, options: PackOptions) -> tuple[DataFrame, DataFrame]:
    """archive, name, payload, seq -> ordered entries with identity, codec, owner, part and flags, and the stored bytes of owners.

    Payloads are compared as they will be stored: with embedded names a payload's frame holds its own name, so nothing is
    shared.  In BA2 an entry whose owner is in its part already adds no payload to it.
    """
    layout, version, packed = WRITERS[options.family]
    rows = admit(entries, options)
    default = F.lit(packed if options.compress else "stored")
    if options.overrides is not None and layout != "tes3":
        rows = packing.with_overrides(rows, options.overrides, default, choice_keys(options.overrides), "compression").withColumn("codec", F.when(F.col("compression") == "stored", "stored").otherwise(packed)).drop("compression")
    else:
        rows = rows.withColumn("codec", default)
    rows = packing.in_archive_order(rows, layout, ["archive"])
    if options.share and not embeds_names(options):
        rows = packing.share_by_print(rows, ["archive", "codec"])
    else:
        rows = rows.withColumn("owner", F.col("ordinal"))
    rows = staging.stage(rows.select("archive", "identity", "seq", "ordinal", "owner", "codec", "size"))
    owners = payloads_of(entries, rows.filter("owner = ordinal").select("archive", "identity", "seq", "owner", "codec"))
    stored = staging.stage(owners.select("archive", "owner", codecs.encode_column(F.col("payload"), F.col("codec")).alias("stored")))
    rows = rows.join(stored.select("archive", "owner", F.octet_length("stored").cast("long").alias("stored_size")), ["archive", "owner"])
    refused = packing.size_limit(layout, framed_size(options) if layout == "bsa" else F.col("stored_size"))
    if (fault := rows.select(refused.alias("id")).filter("id is not null").first()) is not None:
        raise PackError(fault["id"])
    target = packing.SPLIT_TARGETS[layout] if options.split is None else options.split
    name_bytes = F.octet_length("identity")
    if layout in ("ba2", "dds"):
        parts = packing.split_parts(rows, target, packing.entry_cost(F.lit(0), name_bytes), ["archive"], shared=F.col("stored_size"))
    else:
        parts = packing.split_parts(rows, target, packing.entry_cost(F.col("size") if layout == "tes3" else framed_size(options), name_bytes), ["archive"])
    # Of the rows of a part that share an owner, the first carries its bytes.
    carriers = parts.groupBy("archive", "part", "owner").agg(F.min("ordinal").alias("ordinal")).join(stored, ["archive", "owner"]).select("archive", "part", "ordinal", "stored")
    if layout == "bsa":
        flags = packing.archive_flags(parts, version, ["archive", "part"], F.col("codec") != "stored")
        for name in ("archive_flags", "file_flags"):
            if (given := getattr(options, name)) is not None:
                flags = flags.withColumn(name, F.lit(given).cast("long"))
        parts = parts.join(flags, ["archive", "part"])
    else:
        parts = parts.withColumns({"archive_flags": F.lit(0).cast("long"), "file_flags": F.lit(0).cast("long")})
    return parts, carriers


def framed_size(options: PackOptions) -> Column:
    """Stored bytes of a versioned entry with what stands before them: an embedded name, the decoded size."""
    name = F.octet_length("identity") + 1 if embeds_names(options) else F.lit(0)
    return F.col("stored_size") + name + F.when(F.col("codec") != "stored", 4).otherwise(0).cast("long")


def pack(entries: DataFrame, options: PackOptions) -> DataFrame:
    """Archive parts: archive, part, entries, content.  Same result whatever the parallelism."""
    check_options(options)
    layout, version, _ = WRITERS[options.family]
    if layout == "dds":
        return pack_textures(entries, options)
    parts, carriers = plan_entries(entries, options)
    planned = parts.join(carriers, ["archive", "part", "ordinal"], "left")
    rows = planned.select("archive", "part", "identity", "ordinal", "owner", "stored", "codec", "size", "archive_flags", "file_flags")
    family = options.family

    def assemble(part: pa.Table) -> pa.Table:
        part = part.sort_by("ordinal")
        columns = (part.column(c).to_pylist() for c in ("identity", "ordinal", "owner", "stored", "codec", "size"))
        items = [Item(name.encode("ascii"), *rest) for name, *rest in zip(*columns, strict=True)]
        first = part.slice(0, 1).to_pylist()[0]
        data = build(family, items, first["archive_flags"], first["file_flags"])
        return pa.table({"archive": [first["archive"]], "part": pa.array([first["part"]], pa.int32()), "entries": pa.array([len(items)], pa.int64()), "content": pa.array([data], pa.binary())})

    return rows.groupBy("archive", "part").applyInArrow(assemble, PARTS)


def _through(family: str, folder: str):
    """Write rows through to files, an archive part each; those of a part come together, its entries before the payloads it
    stores, both by ordinal.  Of a part only the index is held."""
    layout, version, _ = WRITERS[family]
    columns = ("archive", "part", "payloads", "ordinal", "identity", "owner", "codec", "size", "stored_size", "archive_flags", "file_flags")

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), batch.column("stored"), strict=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for (archive, part), own in groupby(told(batches), key=lambda r: r[:2]):
            items: dict[int, Item] = {}
            waiting: set[int] = set()
            flags, embed, tail, length, name = (0, 0), False, b"", 0, uuid.uuid4().hex
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for payloads, rows in groupby(own, key=lambda r: r[2]):
                    if not payloads:
                        for _, _, _, ordinal, identity, owner, codec, size, stored_size, *flags, _ in rows:
                            items[ordinal] = Item(identity.encode("ascii"), ordinal, owner, None, codec, size, stored_size)
                        embed = embeds(layout, version, flags[0])
                        head, tail = around(family, list(items.values()), *flags)
                        out.write(head)
                        length, waiting = len(head), {i.owner for i in items.values()}
                        continue
                    for _, _, _, ordinal, *_, stored in rows:
                        before, data = frame(items[ordinal], layout, embed), stored.as_buffer()
                        if data.size != items[ordinal].stored_size:
                            raise PackError("pack.changed-payload")
                        waiting.remove(items[ordinal].owner)
                        out.write(before)
                        out.write(data)
                        length += len(before) + data.size
                out.write(tail)
            found = store.get_file_info(f"{root}/{name}")
            if waiting or found.size != length + len(tail):
                raise PackError("pack.missing-payload")
            row = ([archive], pa.array([part], pa.int32()), pa.array([len(items)], pa.int64()), [f"{folder}/{name}"], pa.array([found.size], pa.int64()), pa.array([(found.mtime_ns or 0) // 1_000_000], pa.int64()))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in row], [c.split()[0] for c in FILES.split(", ")])

    return run


def pack_files(entries: DataFrame, options: PackOptions, folder: str | None = None) -> DataFrame:
    """Archive parts as files: archive, part, entries, and path, length, modified, which the scans take as ``listed``.

    The bytes are those of ``pack``, but neither a row nor a worker holds a part: a task sorts its rows, which spills, and
    writes each payload as it comes.  Files are below the shared folder by default and go with the staged tables;
    attempts that were lost leave unlisted ones there.
    """
    check_options(options)
    if WRITERS[options.family][0] == "dds":
        raise PackError("archive.unsupported-encoding")
    parts, carriers = plan_entries(entries, options)
    folder = folder or staging.to_release(f"{staging.shared_folder(entries.sparkSession)}/packed-{uuid.uuid4().hex}")
    index = parts.select("archive", "part", F.lit(False).alias("payloads"), "ordinal", "identity", "owner", "codec", "size", "stored_size", "archive_flags", "file_flags")
    rows = index.unionByName(carriers.withColumn("payloads", F.lit(True)), allowMissingColumns=True)
    rows = rows.repartition("archive", "part").sortWithinPartitions("archive", "part", "payloads", "ordinal")
    return staging.stage(rows.mapInArrow(_through(options.family, re.sub("^file:/+", "file:///", folder)), FILES))


TEXTURES = "archive string, identity string, ordinal long, texture struct<width:int,height:int,mips:int,format:int,cube:boolean,tile:int>, chunks array<struct<stored:binary,decoded:long,first:int,last:int>>, stored_size long, decoded_size long"


def _textures(packed: str):
    """Analyse texture files and encode their chunks, a row each."""
    shape = ("width", "height", "mips", "format", "cube", "tile")
    kinds = pa.struct([(k, pa.bool_() if k == "cube" else pa.int32()) for k in shape])
    chunk = pa.struct([("stored", pa.binary()), ("decoded", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("payload")[i].as_py()
                t = analyze(data)
                pixels = data[t["header_size"] :]
                pixels = widen_bgr24(pixels) if t["narrow"] else pixels
                own = [{"stored": codecs.encode(pixels[at : at + size], packed), "decoded": size, "first": a, "last": b} for at, size, a, b in t["chunks"]]
                head = len(canonical_header(*(t[k] for k in shape)))
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("archive", "identity", "ordinal")), pa.array([{k: t[k] for k in shape}], kinds), pa.array([own], pa.list_(chunk)), pa.array([sum(len(c["stored"]) for c in own)], pa.int64()), pa.array([head + sum(c["decoded"] for c in own)], pa.int64())],
                    ["archive", "identity", "ordinal", "texture", "chunks", "stored_size", "decoded_size"],
                )

    return run


def pack_textures(entries: DataFrame, options: PackOptions) -> DataFrame:
    """Texture archives: every chunk is compressed and equal chunks are stored once; same result columns as ``pack``."""
    _, _, packed = WRITERS[options.family]
    rows = packing.in_archive_order(admit(entries, options), "ba2", ["archive"])
    wanted = payloads_of(entries, rows.select("archive", "identity", "seq", "ordinal"))
    encoded = staging.stage(wanted.select("archive", "identity", "ordinal", "payload").mapInArrow(_textures(packed), TEXTURES))
    check_decoded(encoded, options, "decoded_size")
    target = packing.SPLIT_TARGETS["ba2"] if options.split is None else options.split
    parts = packing.split_parts(encoded, target, packing.entry_cost(F.col("stored_size"), F.octet_length("identity")), ["archive"])
    family = options.family

    def assemble(part: pa.Table) -> pa.Table:
        own = sorted(part.to_pylist(), key=lambda r: r["ordinal"])
        items = [Texture(r["identity"].encode("ascii"), **r["texture"], chunks=[(c["stored"], c["decoded"], c["first"], c["last"]) for c in r["chunks"]]) for r in own]
        return pa.table({"archive": [own[0]["archive"]], "part": pa.array([own[0]["part"]], pa.int32()), "entries": pa.array([len(own)], pa.int64()), "content": pa.array([build_textures(family, items)], pa.binary())})

    return parts.select("archive", "part", "identity", "ordinal", "texture", "chunks").groupBy("archive", "part").applyInArrow(assemble, PARTS)
