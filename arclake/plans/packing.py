"""Pack planning as relational operators over an entry relation (name, payload or its size, position).

Each step is a DataFrame transformation, so Catalyst decides how it runs; nothing relies on the order of partitions,
only on explicit order columns.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arclake.functions import names
from arclake.operators.staging import stage

#: Default split targets, and bytes charged to an entry beside its payload and name.
SPLIT_TARGETS = {"tes3": 2_147_483_647, "bsa": 2_147_483_647, "ba2": 0}
ENTRY_OVERHEAD = 200


def overlay(sources: DataFrame, key: str = "identity", order: str = "seq") -> DataFrame:
    """Later rows win per identity; the position is that of the first.  Aggregates before it shuffles."""
    columns = [c for c in sources.columns if c not in (key, order)]
    kept = sources.groupBy(key).agg(F.min(order).alias("position"), F.max_by(F.struct(*columns), order).alias("row"))
    return kept.select(key, "position", "row.*")


def layers(sources: DataFrame, by: list[str], order: list[str], key: str = "identity") -> DataFrame:
    """The layer of each row: how many rows of its identity come before it.

    An archive holds an identity once, and ``overlay`` keeps the last row of each; archives of one layer keep them all.
    Rows that tie in ``order`` should be equal in all that is packed.
    """
    return sources.withColumn("layer", F.row_number().over(Window.partitionBy(*by, key).orderBy(*order)) - 1)


def keep_masks(entries: DataFrame, masks: list[str], name: str = "name") -> DataFrame:
    return entries.filter(names.matches_masks(F.col(name), masks))


def with_overrides(entries: DataFrame, overrides: DataFrame, default: Column, key: str | list[str] = "identity", value: str = "compression") -> DataFrame:
    """Per-entry choice where one is given, the default elsewhere.  The planner broadcasts small choice tables."""
    return entries.join(overrides, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def unmatched_overrides(entries: DataFrame, overrides: DataFrame, key: str | list[str] = "identity") -> DataFrame:
    return overrides.join(entries, key, "left_anti")


def select_ordinals(entries: DataFrame, wanted: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return entries.join(wanted, ordinal, "left_semi")


def unknown_ordinals(entries: DataFrame, wanted: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    return wanted.join(entries, ordinal, "left_anti")


def in_archive_order(entries: DataFrame, family: str, by: list[str] | None = None, identity: str = "identity", ties: list[str] | None = None) -> DataFrame:
    """Adds the archive ordinal from 0: by hash halves for the oldest family, by folder and name hashes for the versioned
    ones, as planned (``position``) else.

    Names are cut and hashed once, into columns of their own, before anything sorts by them.  Coarse keys that sort as
    the archive does (leading bits of a hash, or runs of positions) keep a whole archive out of one task.
    """
    key, last = F.col(identity), [F.col(c) for c in ties or []]
    if family == "tes3":
        rows = entries.withColumn("__hash", names.tes3_hash(key))
        low = F.col("__hash").bitwiseAND(F.lit(names.MASK32))
        order, coarse = [low, F.call_function("shiftrightunsigned", "__hash", F.lit(32)), key.cast("binary")], [F.call_function("shiftrightunsigned", low, F.lit(20))]
    elif family == "bsa":
        rows = entries.withColumns({"__folder": names.dirname(key), "__base": names.basename(key)})
        rows = names.with_bsa_hash(rows, "__folder_hash", F.col("__folder"), False)
        rows = names.with_bsa_hash(rows, "__base_hash", F.col("__base"), True)
        folder = [names.unsigned(F.col("__folder_hash")), F.col("__folder").cast("binary")]
        order, coarse = [*folder, names.unsigned(F.col("__base_hash")), F.col("__base").cast("binary")], [*folder, F.call_function("shiftrightunsigned", "__base_hash", F.lit(56))]
    else:
        rows, order, coarse = entries, [F.col("position")], [F.call_function("shiftright", "position", F.lit(16))]
    rows = stage(rows) if family in ("tes3", "bsa") else rows  # hashed once, whatever reads it
    return ordinals(rows, [*order, *last], by, coarse).drop("__hash", "__folder", "__base", "__folder_hash", "__base_hash")


def ordinals(entries: DataFrame, order: list[Column], by: list[str] | None = None, coarse: list[Column] | None = None) -> DataFrame:
    """Archive ordinal from 0.

    With ``coarse`` keys no task holds a whole archive: rows are numbered within their coarse group, and the table of
    group sizes, far smaller than the entries, gives each group its first ordinal.
    """
    by, cuts = by or [], [f"__cut{i}" for i in range(len(coarse or []))]
    rows = entries.withColumns(dict(zip(cuts, coarse or [], strict=True)))
    group = Window.partitionBy(*(by + cuts or [F.lit(0)]))
    inside = rows.withColumn("__row", F.row_number().over(group.orderBy(*order)) - 1)
    if not cuts:
        return inside.withColumn("ordinal", F.col("__row").cast("long")).drop("__row")
    # The first row of a group tells its size, so that both sides of the join come from one exchange.
    inside = inside.withColumn("__n", F.count(F.lit(1)).over(group))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy(*cuts).rowsBetween(Window.unboundedPreceding, -1)
    firsts = inside.filter("__row = 0").select(*by, *cuts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    joined = inside.join(firsts, [*by, *cuts])
    return joined.withColumn("ordinal", (F.col("__first") + F.col("__row")).cast("long")).drop("__first", "__row", "__n", *cuts)


def content_print(payload: Column) -> Column:
    return F.sha2(payload.cast("binary"), 256)


def share_by_print(entries: DataFrame, scope: list[str]) -> DataFrame:
    """Owner (first ordinal) of equal payloads in a scope, from their ``size`` and SHA-256 (``print``) alone.

    No payload is shuffled; owners come from an aggregate, so a payload that very many entries share is combined first.
    """
    keys = [*scope, "size", "print"]
    owners = entries.groupBy(*keys).agg(F.min("ordinal").alias("owner"))
    return entries.join(owners, keys).withColumn("owned", F.col("owner") == F.col("ordinal"))


def share(entries: DataFrame, scope: list[str], payload: str = "payload") -> DataFrame:
    """The entries without their payloads: size, print, owner, and whether a row is its own owner."""
    rows = entries.withColumn("size", F.octet_length(payload).cast("long")).withColumn("print", content_print(F.col(payload)))
    return share_by_print(rows.drop(payload), scope)


def entry_cost(payload_size: Column, name_bytes: Column) -> Column:
    return payload_size + ENTRY_OVERHEAD + name_bytes


def split_parts(entries: DataFrame, target: int, cost: Column, by: list[str] | None = None, shared: Column | None = None) -> DataFrame:
    """Greedy parts: a part closes when the next cost would pass the target.

    ``shared`` is what an entry adds only where its part does not hold its ``owner`` yet.  The assignment is a fold over
    one archive in order, so that only four numbers an entry meet in a task, never the entries.  A target of 0 keeps one
    part.
    """
    by = by or []
    costed = entries.withColumn("cost", (cost if shared is None else cost + shared).cast("long"))
    if not target:
        return costed.withColumn("part", F.lit(0))
    own = costed.select(*by, "ordinal", (F.lit(None) if shared is None else F.col("owner")).cast("long").alias("owner"), cost.cast("long").alias("alone"), "cost")
    kinds = ", ".join(f"`{c}` {entries.schema[c].dataType.simpleString()}" for c in by)

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ordinal")
        parts, part, used, held = [], 0, 0, set()
        for owner, alone, full in zip(*(rows.column(c).to_pylist() for c in ("owner", "alone", "cost")), strict=True):
            n = alone if owner is not None and owner in held else full
            if used and n > target - used:
                part, used, held, n = part + 1, 0, set(), full
            used += n
            held.add(owner)
            parts.append(part)
        return rows.select([*by, "ordinal"]).append_column("part", pa.array(parts, pa.int32()))

    parts = own.groupBy(*by).applyInArrow(fold, f"{kinds}{', ' * bool(by)}ordinal long, part int")
    return costed.join(parts, [*by, "ordinal"])


def place(entries: DataFrame, payload_start: Column, size: Column, by: list[str]) -> DataFrame:
    """Offsets: a running sum of newly owned sizes; shared rows take their owner's offset."""
    before = Window.partitionBy(*by).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("owner") == F.col("ordinal"), size).otherwise(0)
    placed = entries.withColumn("running", (payload_start + F.coalesce(F.sum(own).over(before), F.lit(0))).cast("long"))
    group = Window.partitionBy(*by, "owner").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return placed.withColumn("offset", F.first("running").over(group)).drop("running")


def folder_groups(entries: DataFrame, identity: str = "identity", by: list[str] | None = None) -> DataFrame:
    """Per folder: files, and bytes of its name and of its files' names on the wire."""
    key = F.col(identity)
    return entries.groupBy(*(by or []), names.dirname(key).alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), (F.octet_length(F.first(names.dirname(key))) + 1).cast("long").alias("folder_name_bytes"), F.sum(F.octet_length(names.basename(key)) + 1).cast("long").alias("file_name_bytes")
    )


def file_flags(entries: DataFrame, version: int, by: list[str], identity: str = "identity") -> DataFrame:
    """OR of class contributions, then the bits a version has."""
    key = F.col(identity)
    bits = names.contribution(names.asset_class(key))
    if version == 0x67:
        bits = bits.bitwiseOR(F.when(names.basename(key).endswith(".xml"), 4).otherwise(0).cast("long"))
    keep = ~(0 if version == 0x67 else 4 | 0x20 | 0x80) & ~(0x100 if version == 0x69 else 0)
    return entries.groupBy(*by).agg(F.bit_or(bits).bitwiseAND(F.lit(keep).cast("long")).alias("file_flags"))


def archive_flags(entries: DataFrame, version: int, by: list[str], compressed: Column, identity: str = "identity") -> DataFrame:
    """Name bits always, retained-name bits by version, and bits for compression, meshes and sound or scripts."""
    kind = names.asset_class(F.col(identity))
    flags = file_flags(entries, version, by, identity)
    facts = entries.groupBy(*by).agg(F.bool_or(compressed).alias("any_compressed"), F.bool_or(kind.isin(5, 9)).alias("retain"))
    bits = lambda c, v: F.when(c, v).otherwise(0)
    total = F.lit(0x603 if version == 0x67 else 3) + bits(F.col("any_compressed"), 4) + bits(F.col("file_flags").bitwiseAND(F.lit(1).cast("long")) != 0, 0x80) + bits(F.col("retain"), 0x10)
    return facts.join(flags, by).withColumn("archive_flags", total.cast("long")).select(*by, "archive_flags", "file_flags")


def decoded_limit(entries: DataFrame, most: int, size: str = "size", by: list[str] | None = None) -> DataFrame:
    """First entry in plan order at which the decoded bytes pass the ceiling; with ``by`` a row for each group that passes it.

    Runs of ordinals are summed first, and only the run in which the ceiling is passed is looked at row by row.
    """
    by, run = by or [], F.call_function("shiftright", F.col("ordinal").cast("long"), F.lit(16)).alias("__run")
    runs = entries.groupBy(*by, run).agg(F.sum(size).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("__run"))
    first = runs.withColumn("__to", total).filter(F.col("__to") > most).groupBy(*by).agg(F.min(F.struct("__run", (F.col("__to") - F.col("__n")).alias("__before"))).alias("__first")).select(*by, "__first.*").filter("__run is not null")
    inside = entries.withColumn("__run", run).join(first, [*by, "__run"])
    running = F.col("__before") + F.sum(size).over(Window.partitionBy(*by, "__run").orderBy("ordinal"))
    return inside.withColumn("decoded", running).filter(F.col("decoded") > most).groupBy(*by).agg(F.min("ordinal").alias("ordinal"), F.min("decoded").alias("decoded")).filter("ordinal is not null")


def wire_limits(layout: str, embedded: bool = False, identity: str = "identity") -> Column:
    """Which length field a name does not fit, or null: of folders and embedded names in versioned archives, of names in BA2."""
    key = F.col(identity)
    folder, whole = F.octet_length(names.dirname(key)), F.octet_length(key)
    if layout == "bsa":
        return F.when(folder > 254, "folder-name").when(F.lit(embedded) & (whole > 255), "full-name")
    return F.when(F.lit(layout in ("ba2", "dds")) & (whole > 65535), "ba2-name")


def size_limit(layout: str, size: Column) -> Column:
    """The id with which a family refuses a record of ``size`` bytes, or null: sizes have 32 bits, and in versioned archives
    bit 30 tells that a record is compressed."""
    beyond = (size < 0) | (size > 0xFFFFFFFF)
    if layout == "bsa":
        beyond |= size.bitwiseAND(F.lit(0x40000000).cast("long")) != 0
    family = "ba2" if layout == "dds" else layout
    return F.when(beyond, f"{family}.wire-limit")
