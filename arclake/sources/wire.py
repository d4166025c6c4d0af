"""The archive layouts in plain Python: recognise, name, lay out and write.  No Spark here.

Numbers are little-endian unsigned; hashes are kept as signed 64-bit patterns.  ``scan`` reads what is written here.
"""

from __future__ import annotations

import struct
import zlib
from itertools import groupby
from typing import NamedTuple

# Selectors, versions, sentinels.
TES3_MAGIC, BSA_MAGIC, BA2_MAGIC = b"\x00\x01\x00\x00", b"BSA\x00", b"BTDX"
BSA_FAMILIES = {0x67: "TES4_BSA", 0x68: "FO3_FNV_SKYRIM_LE_BSA", 0x69: "SSE_BSA"}
FO4_VERSIONS, STARFIELD_VERSIONS = (1, 7, 8), (2, 3)
BA2_KINDS = {b"GNRL": "GENERAL", b"DX10": "DDS"}
SENTINEL = 0xBAADF00D
PREFIX_BYTES = 36
SIGNED_2GIB = 0x7FFFFFFF
TOGGLE = 0x40000000
UNSUPPORTED_ROOTS = ("sound", "music", "video", "fonts", "splash")
#: How each writable family is written: layout, version, codec of compressed payloads.
WRITERS = {
    "TES3_BSA": ("tes3", None, "stored"),
    "TES4_BSA": ("bsa", 0x67, "zlib"),
    "FO3_FNV_SKYRIM_LE_BSA": ("bsa", 0x68, "zlib"),
    "SSE_BSA": ("bsa", 0x69, "lz4_frame"),
    "FO4_GENERAL_BA2": ("ba2", 1, "zlib"),
    "STARFIELD_GENERAL_BA2": ("ba2", 2, "zlib"),
    "STARFIELD_GENERAL_BA2_V3": ("ba2", 3, "lz4_raw"),
    "FO4_DDS_BA2": ("dds", 1, "zlib"),
    "STARFIELD_DDS_BA2": ("dds", 2, "zlib"),
    "STARFIELD_DDS_BA2_V3": ("dds", 3, "lz4_raw"),
}


class Detection(NamedTuple):
    status: str
    family: str | None
    version: int | None
    subtype: str | None
    method: int | None


def detect(prefix: bytes) -> Detection:
    """Classify at most 36 bytes; nothing else is read."""
    prefix = prefix[:PREFIX_BYTES]
    magic = next((m for m in (TES3_MAGIC, BSA_MAGIC, BA2_MAGIC) if prefix and m.startswith(prefix[:4])), None)
    if magic is None:
        return Detection("UNRECOGNIZED", None, None, None, None)
    waiting = Detection("INDETERMINATE", None, None, None, None)
    if len(prefix) < 4:
        return waiting
    if magic == TES3_MAGIC:
        return Detection("SUPPORTED_FAMILY", "TES3_BSA", None, None, None)
    if len(prefix) < 8:
        return waiting
    (version,) = struct.unpack_from("<I", prefix, 4)
    if magic == BSA_MAGIC:
        family = BSA_FAMILIES.get(version)
        return Detection("SUPPORTED_FAMILY" if family else "UNSUPPORTED_VARIANT", family, version, None, None)
    if len(prefix) < 12:
        return waiting._replace(version=version)
    subtype = prefix[8:12]
    method = struct.unpack_from("<I", prefix, 32)[0] if version == 3 and len(prefix) >= 36 else None
    game = "FO4" if version in FO4_VERSIONS else "STARFIELD" if version == 2 or version == 3 and method in (None, 3) else None
    family = f"{game}_{BA2_KINDS[subtype]}_BA2" if game and subtype in BA2_KINDS else None
    return Detection("SUPPORTED_FAMILY" if family else "UNSUPPORTED_VARIANT", family, version, subtype.decode("latin-1"), method)


# Names -----------------------------------------------------------------------------------------------------------


def fold(name: bytes) -> bytes:
    return name.replace(b"/", b"\\").lower()


def identity(name: str) -> str | None:
    name = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name.replace("/", "\\"))
    safe = name and "\x00" not in name and ":" not in name and all(s and s[-1] not in " ." for s in name.split("\\"))
    return name if safe else None


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tes3_hash(name: bytes) -> int:
    half, low, high = len(name) // 2, 0, 0
    for i, b in enumerate(name[:half]):
        low ^= b << 8 * (i % 4)
    for i, b in enumerate(name[half:]):
        part = b << 8 * (i % 4)
        x, r = high ^ part, part % 32
        high = (x >> r | x << 32 - r) & 0xFFFFFFFF
    return signed(high << 32 | low)


def bsa_hash(name: bytes, is_file: bool, version: int) -> int:
    n = name.rfind(b".") if is_file and b"." in name else len(name)
    if n == 0:
        return 0
    value = (lambda b: b - 256 if b > 127 else b) if version == 0x67 else int

    def folded(part: bytes) -> int:
        total = 0
        for b in part:
            total = (total * 65599 + value(b)) & 0xFFFFFFFF
        return total

    ext = name[n:]
    low = name[n - 1] | (n & 255) << 16 | name[0] << 24 | (name[n - 2] << 8 if n > 2 else 0)
    low |= {b".kf": 0x80, b".nif": 0x8000, b".dds": 0x8080, b".wav": 0x80000000}.get(ext, 0)
    return signed((folded(name[1 : max(1, n - 2)]) + folded(ext) & 0xFFFFFFFF) << 32 | low)


def crc0(data: bytes) -> int:
    """CRC-32 from zero, not inverted."""
    return zlib.crc32(data) ^ zlib.crc32(bytes(len(data)))


def ba2_identity(name: bytes) -> tuple[int, bytes, int]:
    folder, _, base = fold(name).rpartition(b"\\")
    stem, dot, ext = base.rpartition(b".")
    return crc0(stem if dot else base), (ext if dot else b"")[:4].ljust(4, b"\x00"), crc0(folder)


def is_ascii(data: bytes) -> bool:
    return all(b < 128 for b in data)


def ba2_header_size(version: int) -> int:
    return {2: 32, 3: 36}.get(version, 24)


# Writing ---------------------------------------------------------------------------------------------------------


class Item(NamedTuple):
    """One planned entry: canonical name, stored bytes' owner and codec."""

    name: bytes
    ordinal: int
    owner: int
    stored: bytes | None
    codec: str
    decoded_size: int
    #: Length of ``stored`` where the index is laid out without it.
    stored_size: int | None = None


def frame(item: Item, layout: str, embed: bool) -> bytes:
    """What stands before a payload in versioned archives: the embedded name and the decoded size."""
    if layout != "bsa":
        return b""
    head = bytes([len(item.name)]) + item.name if embed else b""
    return head + (struct.pack("<I", item.decoded_size) if item.codec != "stored" else b"")


def embeds(layout: str, version: int | None, archive_flags: int) -> bool:
    return layout == "bsa" and version != 0x67 and bool(archive_flags & 0x100)


def around(family: str, items: list[Item], archive_flags: int = 3, file_flags: int = 0) -> tuple[bytes, bytes]:
    """What stands before and after the payloads of one archive part; sizes of payloads are enough for it."""
    layout, version, _ = WRITERS[family]
    if layout == "tes3":
        return _around_tes3(items), b""
    if layout == "bsa":
        return _around_bsa(items, version, archive_flags, file_flags), b""
    return _around_ba2(items, version)


def build(family: str, items: list[Item], archive_flags: int = 3, file_flags: int = 0) -> bytes:
    """One archive part; ``items`` in archive order, shared payloads by owner ordinal."""
    layout, version, _ = WRITERS[family]
    embed = embeds(layout, version, archive_flags)
    head, tail = around(family, items, archive_flags, file_flags)
    carriers: dict[int, Item] = {}
    for i in items:
        carriers.setdefault(i.owner, i)
    return b"".join((head, *(x for i in carriers.values() for x in (frame(i, layout, embed), i.stored)), tail))


def _placed(items: list[Item], start: int, layout: str, embed: bool) -> tuple[dict[int, tuple[int, int]], int]:
    """Offset and size by ordinal, and the bytes of all payloads: owners one after the other."""
    places: dict[int, tuple[int, int]] = {}
    at = start
    for item in items:
        if item.owner in places:
            places[item.ordinal] = places[item.owner]
        else:
            size = len(frame(item, layout, embed)) + (len(item.stored) if item.stored_size is None else item.stored_size)
            places[item.ordinal] = places[item.owner] = (at, size)
            at += size
    return places, at - start


def _around_tes3(items: list[Item]) -> bytes:
    names = b"".join(i.name + b"\x00" for i in items)
    hash_offset = 12 * len(items) + len(names)
    places, _ = _placed(items, 0, "tes3", False)
    at, offsets = 0, []
    for i in items:
        offsets.append(at)
        at += len(i.name) + 1
    rows = b"".join(struct.pack("<II", places[i.ordinal][1], places[i.ordinal][0]) for i in items)
    return struct.pack("<4sII", TES3_MAGIC, hash_offset, len(items)) + rows + struct.pack(f"<{len(items)}I", *offsets) + names + b"".join(struct.pack("<q", tes3_hash(i.name)) for i in items)


def _around_bsa(items: list[Item], version: int, flags: int, file_flags: int) -> bytes:
    split = [(i.name.rpartition(b"\\")[0], i.name.rpartition(b"\\")[2], i) for i in items]
    folders = [(folder, list(g)) for folder, g in groupby(split, key=lambda x: x[0])]
    file_names = b"".join(base + b"\x00" for _, base, _ in split)
    width = 24 if version == 0x69 else 16
    folder_bytes = sum(len(f) + 1 for f, _ in folders)
    blocks_size = sum(len(f) + 2 + 16 * len(g) for f, g in folders)
    start = 36 + width * len(folders) + blocks_size + len(file_names)
    places, _ = _placed(items, start, "bsa", embeds("bsa", version, flags))
    records, blocks = bytearray(), bytearray()
    at = 36 + width * len(folders)
    for folder, group in folders:
        key, offset = bsa_hash(folder, False, version), at + len(blocks) + len(file_names)
        records += struct.pack("<qIIII", key, len(group), 0, offset, 0) if width == 24 else struct.pack("<qII", key, len(group), offset)
        blocks += bytes([len(folder) + 1]) + folder + b"\x00"
        for _, base, item in group:
            offset, size = places[item.ordinal]
            toggle = TOGGLE if bool(flags & 4) != (item.codec != "stored") else 0
            blocks += struct.pack("<qII", bsa_hash(base, True, version), size | toggle, offset)
    head = struct.pack("<4sIIIIIIII", BSA_MAGIC, version, 36, flags, len(folders), len(items), folder_bytes, len(file_names), file_flags)
    return head + bytes(records) + bytes(blocks) + file_names


def _around_ba2(items: list[Item], version: int) -> tuple[bytes, bytes]:
    header = ba2_header_size(version)
    places, length = _placed(items, header + 36 * len(items), "ba2", False)
    rows = bytearray()
    for i in items:
        base_hash, ext, dir_hash = ba2_identity(i.name)
        offset, size = places[i.ordinal]
        rows += struct.pack("<I4sIBBHQIII", base_hash, ext, dir_hash, 0, 1, 16, offset, size if i.codec != "stored" else 0, i.decoded_size, SENTINEL)
    names = b"".join(struct.pack("<H", len(i.name)) + i.name for i in items)
    head = struct.pack("<4sI4sIQ", BA2_MAGIC, version, b"GNRL", len(items), header + len(rows) + length)
    return head + (struct.pack("<Q", 1) if version >= 2 else b"") + (struct.pack("<I", 3) if version == 3 else b"") + bytes(rows), names


class Texture(NamedTuple):
    """One planned texture: canonical name, shape, and (stored, decoded size, first mip, last mip) of its chunks."""

    name: bytes
    width: int
    height: int
    mips: int
    format: int
    cube: bool
    tile: int
    chunks: list[tuple[bytes, int, int, int]]


def build_textures(family: str, items: list[Texture]) -> bytes:
    """One texture archive part; equal chunks are stored once."""
    _, version, _ = WRITERS[family]
    header = ba2_header_size(version)
    start = header + sum(24 + 24 * len(i.chunks) for i in items)
    places: dict[tuple[bytes, int], int] = {}
    rows, body = bytearray(), bytearray()
    for i in items:
        base_hash, ext, dir_hash = ba2_identity(i.name)
        rows += struct.pack("<I4sIBBHHHBBBB", base_hash, ext, dir_hash, 0, len(i.chunks), 24, i.height, i.width, i.mips, i.format, int(i.cube), i.tile)
        for stored, decoded, first, last in i.chunks:
            if (stored, decoded) not in places:
                places[stored, decoded] = start + len(body)
                body += stored
            rows += struct.pack("<QIIHHI", places[stored, decoded], len(stored), decoded, first, last, SENTINEL)
    names = b"".join(struct.pack("<H", len(i.name)) + i.name for i in items)
    head = struct.pack("<4sI4sIQ", BA2_MAGIC, version, b"DX10", len(items), start + len(body))
    return head + (struct.pack("<Q", 1) if version >= 2 else b"") + (struct.pack("<I", 3) if version == 3 else b"") + bytes(rows) + bytes(body) + names
