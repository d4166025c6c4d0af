"""Archive indexes as tables: fixed-width records are decoded at once, and every rule is a predicate over their columns.

Rules report events (record, rank, id).  Sorted, they tell what a reader going through the file would meet first: the
first ERROR ends the archive, which then has no entries, and later events are dropped.  Only the index is read, and of
old texture entries a few bytes of payload; payloads themselves are read when an entry is opened.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np

from arclake.functions import names as spelling
from arclake.functions.codec import CodecError, decode_prefix
from arclake.functions.texture import TextureError, header_size
from arclake.sources.wire import (
    BA2_KINDS, BSA_FAMILIES, FO4_VERSIONS, PREFIX_BYTES, SENTINEL, SIGNED_2GIB, STARFIELD_VERSIONS, TOGGLE, UNSUPPORTED_ROOTS,
    Detection, ba2_header_size, ba2_identity, bsa_hash, detect, fold, identity, is_ascii, tes3_hash,
)

# The records of each layout.
BSA_FOLDER = np.dtype([("hash", "<i8"), ("files", "<u4"), ("offset", "<u4")])
SSE_FOLDER = np.dtype([("hash", "<i8"), ("files", "<u4"), ("before", "<u4"), ("offset", "<u4"), ("after", "<u4")])
BSA_FILE = np.dtype([("hash", "<i8"), ("size", "<u4"), ("offset", "<u4")])
BA2_HEAD = [("base", "<u4"), ("ext", "V4"), ("dir", "<u4"), ("mod", "u1"), ("chunks", "u1"), ("width", "<u2")]
GENERAL = np.dtype([*BA2_HEAD, ("offset", "<u8"), ("packed", "<u4"), ("unpacked", "<u4"), ("sentinel", "<u4")])
TEXTURE = np.dtype([*BA2_HEAD, ("height", "<u2"), ("wide", "<u2"), ("mips", "u1"), ("format", "u1"), ("flags", "u1"), ("tile", "u1")])
CHUNK = np.dtype([("offset", "<u8"), ("packed", "<u4"), ("decoded", "<u4"), ("first", "<u2"), ("last", "<u2"), ("sentinel", "<u4")])
ERROR, WARNING = "ERROR", "WARNING"
#: Bytes of one positional read of an index; far below what an archive may hold.
WINDOW = 64 << 10


class Bytes:
    """Positional reads of bytes in memory."""

    def __init__(self, data: bytes) -> None:
        self.data, self.size = data, len(data)

    def read(self, at: int, n: int) -> bytes:
        return self.data[at : at + n] if n > 0 else b""


class File:
    """Positional reads of a file that can seek; small reads are served from a window."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size = file, size
        self.at, self.window, self.taken = 0, b"", 0

    def read(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if n <= 0:
            return b""
        if n > WINDOW:
            return self._fetch(at, n)
        if not (self.at <= at and at + n <= self.at + len(self.window)):
            self.at, self.window = at, self._fetch(at, min(WINDOW, self.size - at))
        return self.window[at - self.at : at - self.at + n]

    def _fetch(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        self.taken += n
        return self.file.read(n)


class Ended(Exception):
    """The index cannot be decoded beyond an event that has been reported."""


class Event(NamedTuple):
    """What a rule found; sorted by record, then by rank."""

    record: int
    rank: tuple[int, ...]
    severity: str
    id: str
    ordinal: int | None
    field: str | None
    stored: object
    expected: object


def number(h: int) -> str:
    return f"{h & (1 << 64) - 1:016X}"


class Index:
    """One archive's entries, chunks and diagnostics."""

    def __init__(self, blob: Bytes | File, found: Detection, lenient: bool = False) -> None:
        self.blob, self.found, self.lenient = blob, found, lenient
        self.entries: list[dict] = []
        self.chunks: list[dict] = []
        self.facts: dict[str, int] = {}
        self.events: list[Event] = []

    # Reporting ---------------------------------------------------------------------------------------------------

    def say(self, record: int, rank: tuple[int, ...], id_: str, severity: str = WARNING, ordinal: int | None = None, field: str | None = None, stored: object = None, expected: object = None) -> None:
        self.events.append(Event(record, rank, severity, id_, ordinal, field, stored, expected))

    def warn(self, rank: int, id_: str, mask: Iterable[bool], field: str | None = None, stored=None, expected=None) -> None:
        """A warning of every entry where ``mask`` holds; values are constants or columns."""
        of = lambda x, i: x[i] if isinstance(x, (list, np.ndarray)) else x
        for i in np.flatnonzero(np.asarray(mask, bool)).tolist():
            self.say(i, (1, rank), id_, WARNING, i, field, of(stored, i), of(expected, i))

    def refuse(self, rank: int, id_: str, mask: Iterable[bool]) -> None:
        """The first entry where ``mask`` holds ends the archive."""
        bad = np.flatnonzero(np.asarray(mask, bool))
        if len(bad):
            self.say(int(bad[0]), (1, rank), id_, ERROR)

    def require(self, holds: bool, id_: str, record: int = -1, rank: tuple[int, ...] = (9,)) -> None:
        if not holds:
            self.say(record, rank, id_, ERROR)
            raise Ended

    @property
    def diagnostics(self) -> list[dict]:
        text = lambda x: None if x is None else str(x)
        out = []
        for e in sorted(self.events, key=lambda e: (e.record, e.rank)):
            out.append({"id": e.id, "severity": e.severity, "ordinal": e.ordinal, "field": e.field, "stored": text(e.stored), "expected": text(e.expected)})
            if e.severity == ERROR:
                break
        return out

    # Decoding ----------------------------------------------------------------------------------------------------

    def unpack(self, layout: str, at: int) -> tuple[int, ...]:
        n = struct.calcsize("<" + layout)
        data = self.blob.read(at, n)
        self.require(len(data) == n, "io.span-out-of-range")
        return struct.unpack("<" + layout, data)

    def table(self, kind: np.dtype, at: int, count: int) -> np.ndarray:
        return np.frombuffer(self.blob.read(at, kind.itemsize * count), kind)

    def named(self, rank: int, raw: list[bytes | None], component: str) -> list[str | None]:
        """Windows-1252 texts; bytes that have no character are reported."""
        texts: list[str | None] = []
        for wire in raw:
            try:
                texts.append(None if wire is None else wire.decode("cp1252"))
            except UnicodeDecodeError:
                texts.append(None)
        self.warn(rank, "archive-name.undecodable-wire-bytes", [t is None and w is not None for t, w in zip(texts, raw, strict=True)], component)
        return texts

    def identities(self, rank: int, displays: list[str | None], id_: str) -> list[str | None]:
        """Identities of known names; the first that came before ends the archive."""
        own = [None if d is None else identity(d) for d in displays]
        seen: set[str] = set()
        again = [i is not None and (i in seen or bool(seen.add(i))) for i in own]
        self.refuse(rank, id_, again)
        return own

    def overlaps(self, start: np.ndarray, size: np.ndarray, record: int, id_: str, region: tuple[int, int] | None = None) -> None:
        """Distinct spans in order: none may begin before the furthest end so far, none may touch the region."""
        full = size > 0
        spans = np.unique(np.stack([start[full], start[full] + size[full]], axis=1), axis=0)
        if not len(spans):
            return
        met = np.flatnonzero(spans[1:, 0] < np.maximum.accumulate(spans[:, 1])[:-1]) + 1
        touched = np.flatnonzero((spans[:, 0] < region[1]) & (spans[:, 1] > region[0])) if region else met[:0]
        first = min((int(x[0]) for x in (met, touched) if len(x)), default=None)
        if first is not None:
            self.say(record, (1,), id_ if first in met[:1] else "ba2.payload-overlaps-names", ERROR)

    def trailing(self, used: int, record: int, id_: str) -> None:
        if used < self.blob.size:
            self.say(record, (2,), id_, stored=self.blob.size - used, expected=0)

    def unsafe(self, displays: list[str], record: int) -> None:
        """What extraction would have to refuse, after all else."""
        for i, display in enumerate(displays):
            name = display.replace("/", "\\")
            parts = name.split("\\")
            dots = next((k for k, s in enumerate(parts) if s in (".", "..")), None)
            found = (
                ("archive-name.absolute-path", name.startswith("\\") or name[1:3] == ":\\" and name[0].isascii() and name[0].isalpha(), None, None),
                ("archive-name.traversal-segment", dots is not None, "segment", dots),
                ("archive-name.windows-invalid-segment", any(map(spelling.refused_by_windows, parts)), None, None),
            )
            for k, (id_, holds, field, stored) in enumerate(found):
                if holds:
                    self.say(record, (3, i, k), id_, WARNING, i, field, stored)


def terminated(block: bytes, count: int) -> tuple[list[bytes], np.ndarray, int]:
    """Up to ``count`` NUL-terminated strings: their bytes, where they start, and the end of the last."""
    ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 0)[:count]
    starts = np.concatenate((np.zeros(1, np.int64), ends + 1))
    return [block[a:b] for a, b in zip(starts, ends, strict=False)], starts[: len(ends)], int(starts[-1]) if count else 0


def rows(**columns) -> list[dict]:
    lists = [c.tolist() if isinstance(c, np.ndarray) else c for c in columns.values()]
    return [dict(zip(columns, row, strict=True)) for row in zip(*lists, strict=True)]


def tes3(x: Index) -> None:
    hash_offset, count = x.unpack("II", 4)
    names, hashes = 12 + 12 * count, 12 + hash_offset
    x.require(names <= hashes and hashes + 8 * count <= x.blob.size, "io.span-out-of-range")
    records = x.table(np.dtype([("size", "<u4"), ("offset", "<u4")]), 12, count)
    name_offset = x.table(np.dtype("<u4"), 12 + 8 * count, count).astype(np.int64)
    stored_hash = x.table(np.dtype("<i8"), hashes, count)
    start = hashes + 8 * count
    size, offset = records["size"].astype(np.int64), records["offset"].astype(np.int64) + start
    raw, expected, end = terminated(x.blob.read(names, hashes - names), count)
    x.refuse(0, "tes3.invalid-name-offset", name_offset >= hashes - names)
    x.refuse(1, "tes3.unterminated-name", np.arange(count) >= len(raw))
    raw += [b""] * (count - len(raw))
    texts = x.named(2, raw, "complete")
    displays = [t if t is not None else f"{spelling.SYNTHETIC_WIRE}\\e{i:08x}" for i, t in enumerate(texts)]
    own = x.identities(3, texts, "tes3.duplicate-name")
    moved = np.zeros(count, bool)
    moved[: len(expected)] = name_offset[: len(expected)] != expected
    x.warn(4, "tes3.name-offset-inconsistency", moved, "nameOffset", name_offset, expected)
    hashed = [tes3_hash(fold(w)) if o is not None and is_ascii(w) else None for w, o in zip(raw, own, strict=True)]
    x.warn(5, "tes3.stored-hash-mismatch", [h is not None and h != s for h, s in zip(hashed, stored_hash.tolist(), strict=True)], "nameHash", [number(h) for h in stored_hash.tolist()], [number(h or 0) for h in hashed])
    x.refuse(6, "io.span-out-of-range", offset + size > x.blob.size)
    x.warn(7, "tes3.payload-offset-over-signed-2gib", offset > SIGNED_2GIB, "dataOffset", offset, SIGNED_2GIB)
    roots = [fold(d.encode("utf-8")).partition(b"\\")[0].decode("utf-8") if "\\" in d.replace("/", "\\") else "" for d in displays]
    x.warn(8, "tes3.unsupported-asset-root", [r in UNSUPPORTED_ROOTS for r in roots], "complete", roots)
    if end != hashes - names:
        x.say(count, (0,), "tes3.invalid-name-block", ERROR)
    x.overlaps(offset, size, count, "tes3.overlapping-payloads")
    x.trailing(int(max(start, (offset + size).max(initial=0))), count, "tes3.trailing-data")
    x.unsafe(displays, count)
    x.facts = {"entries": count, "hash_offset": hash_offset, "data_start": start}
    x.entries = rows(ordinal=list(range(count)), display=displays, identity=own, decoded_size=size, stored_size=size, offset=offset, content_offset=offset, content_size=size, codec=["stored"] * count, hash=stored_hash, folder_hash=[None] * count, dds=[None] * count)


class Folders(NamedTuple):
    """The folder part of a versioned index: folder of each file, file records, and what folders hold."""

    of: np.ndarray
    files: np.ndarray
    names: list[bytes | None]
    hashes: np.ndarray
    name_bytes: int
    end: int


def _folders(x: Index, version: int, records: int, flags: int, folders: int, count: int, file_names: int, names: int) -> Folders:
    """Folder records are one table; each folder's block follows from the lengths before it."""
    kind = SSE_FOLDER if version == 0x69 else BSA_FOLDER
    table = x.table(kind, records, folders)
    at, done, name_bytes = records + kind.itemsize * folders, 0, 0
    texts: list[bytes | None] = []
    parts: list[np.ndarray] = []

    def fault(holds: bool, id_: str, f: int, rank: int) -> None:
        x.require(not holds, id_, done, (0, f, rank))

    for f, (files, offset) in enumerate(zip(table["files"].tolist(), table["offset"].tolist(), strict=True)):
        for k, column in enumerate(("before", "after") if kind is SSE_FOLDER else ()):
            if value := int(table[column][f]):
                x.say(done, (0, f, k), "bsa.nonzero-folder-padding", field="paddingBefore" if column == "before" else "paddingAfter", stored=value, expected=0)
        fault(files > count - done or offset != at + file_names, "bsa.invalid-folder-record", f, 2)
        own = None
        if flags & 1:
            head = x.blob.read(at, 1)
            fault(not head, "io.span-out-of-range", f, 3)
            fault(not head[0], "bsa.invalid-folder-name", f, 4)
            fault(at + 1 + head[0] > names, "io.span-out-of-range", f, 5)
            raw = x.blob.read(at + 1, head[0])
            fault(raw[-1] != 0, "bsa.unterminated-folder-name", f, 6)
            own = raw[:-1]
            fault(0 in own, "bsa.invalid-folder-name", f, 7)
            name_bytes += len(raw)
            at += 1 + len(raw)
        fault(at + BSA_FILE.itemsize * files > names, "io.span-out-of-range", f, 8)
        if own is not None and is_ascii(own) and (expected := bsa_hash(fold(own), False, version)) != (stored := int(table["hash"][f])):
            x.say(done, (1, 3) if files else (0, f, 9), "bsa.folder-hash-mismatch", ordinal=done if files else None, field="folderHash", stored=number(stored), expected=number(expected))
        parts.append(x.table(BSA_FILE, at, files))
        texts.append(own)
        at, done = at + BSA_FILE.itemsize * files, done + files
    counts = [len(p) for p in parts]
    return Folders(np.repeat(np.arange(folders), counts), np.concatenate(parts) if parts else np.zeros(0, BSA_FILE), texts, table["hash"], name_bytes, at)


def bsa(x: Index) -> None:
    version, records, flags, folders, count, folder_names, file_names, file_flags = x.unpack("IIIIIIII", 4)
    x.require(records >= 36 and (flags & 1 or not folder_names) and (flags & 2 or not file_names), "bsa.invalid-name-sections")
    names = records + (24 if version == 0x69 else 16) * folders + BSA_FILE.itemsize * count + folder_names + (folders if flags & 1 else 0)
    start = names + file_names
    x.require(start <= x.blob.size, "io.span-out-of-range")
    try:
        found = _folders(x, version, records, flags, folders, count, file_names, names)
    except Ended:
        return  # no folder beyond it can be read, and files before it cannot make the archive sound
    files, of = found.files, found.of
    n = len(files)
    toggled = files["size"].astype(np.int64)
    size, offset, stored_hash = toggled & ~TOGGLE, files["offset"].astype(np.int64), files["hash"]
    bases: list[bytes | None] = [None] * n
    end = 0
    if flags & 2:
        raw, _, end = terminated(x.blob.read(names, file_names), n)
        x.refuse(0, "bsa.unterminated-basename", np.arange(n) >= len(raw))
        bases[: len(raw)] = raw
    folder_of = [found.names[f] for f in of.tolist()]
    folder_texts, base_texts = x.named(1, folder_of, "folder"), x.named(1, bases, "basename")
    known = [f"{a}\\{b}" if a is not None and b is not None else None for a, b in zip(folder_texts, base_texts, strict=True)]
    unsigned = lambda h: h & (1 << 64) - 1
    displays = [k if k is not None else f"{spelling.SYNTHETIC_HASH}\\f{f:08x}-{unsigned(fh):016x}\\e{i:08x}-{unsigned(h):016x}" for i, (k, f, fh, h) in enumerate(zip(known, of.tolist(), found.hashes[of].tolist(), stored_hash.tolist(), strict=True))]
    own = x.identities(2, known, "bsa.duplicate-name")
    hashed = [bsa_hash(fold(b), True, version) if b is not None and is_ascii(b) and b.rfind(b".") != 0 else None for b in bases]
    x.warn(4, "bsa.file-hash-mismatch", [h is not None and h != s for h, s in zip(hashed, stored_hash.tolist(), strict=True)], "nameHash", [number(h) for h in stored_hash.tolist()], [number(h or 0) for h in hashed])
    x.refuse(5, "bsa.payload-overlaps-index", offset < start)
    beyond = offset + size > x.blob.size
    x.refuse(6, "io.span-out-of-range", beyond)
    x.warn(7, "bsa.payload-offset-over-signed-2gib", offset > SIGNED_2GIB, "dataOffset", offset, SIGNED_2GIB)
    compressed = (toggled & TOGGLE != 0) != bool(flags & 4)
    texture = np.array([t is not None and t.lower().endswith(".dds") for t in base_texts], bool)
    at, left = offset.copy(), size.copy()
    embedded = version != 0x67 and bool(flags & 0x100)
    if embedded:
        lengths = np.array([(x.blob.read(a, 1) or b"\0")[0] for a in offset.tolist()], np.int64)
        x.refuse(8, "bsa.invalid-embedded-name-framing", size == 0)
        x.refuse(9, "io.span-out-of-range", lengths + 1 > size)
        inner = [x.blob.read(a + 1, k) for a, k in zip(offset.tolist(), lengths.tolist(), strict=True)]
        x.warn(10, "bsa.embedded-name-mismatch", [a is not None and b is not None and i != a + b"\\" + b for a, b, i in zip(folder_of, bases, inner, strict=True)], "embedded")
        x.warn(11, "bsa.nontexture-with-embedded-name", [t is not None and not d for t, d in zip(base_texts, texture.tolist(), strict=True)], "embedded")
        x.warn(12, "bsa.uncompressed-sse-embedded-name", ~compressed & (version == 0x69), "embedded")
        at, left = at + 1 + lengths, left - 1 - lengths
    x.refuse(13, "bsa.invalid-compressed-framing", compressed & (left < 4))
    sound = ~beyond & (left >= 4)
    decoded = left.copy()
    for i in np.flatnonzero(compressed & sound).tolist():
        decoded[i] = struct.unpack("<I", x.blob.read(int(at[i]), 4))[0]
    at, left = np.where(compressed, at + 4, at), np.where(compressed, left - 4, left)
    codec = np.where(compressed, "lz4_frame" if version == 0x69 else "zlib", "stored").tolist()
    if not embedded:
        _cubemaps(x, np.flatnonzero(texture & (decoded >= 128) & ~beyond & (left >= 0)).tolist(), at, left, codec)
    if n != count or found.name_bytes != folder_names or found.end != names or (end if flags & 2 else 0) != file_names:
        x.say(n, (0,), "bsa.invalid-section-lengths", ERROR)
    x.overlaps(offset, size, n, "bsa.overlapping-payloads")
    x.unsafe(displays, n)
    x.facts = {"entries": count, "archive_flags": flags, "file_flags": file_flags, "folders": folders, "data_start": start}
    x.entries = rows(ordinal=list(range(n)), display=displays, identity=own, decoded_size=decoded, stored_size=size, offset=offset, content_offset=at, content_size=left, codec=codec, hash=stored_hash, folder_hash=found.hashes[of], dds=[None] * n)


def _cubemaps(x: Index, ordinals: list[int], at: np.ndarray, left: np.ndarray, codec: list[str]) -> None:
    """Textures whose own header says cube map, which these archives only keep under embedded names."""
    for i in ordinals:
        try:
            head = decode_prefix(x.blob.read(int(at[i]), int(left[i]) if codec[i] != "stored" else 128), codec[i])
        except (CodecError, zlib.error, struct.error, IndexError):
            x.say(i, (1, 14), "codec.invalid-data", ERROR)
            return
        if len(head) == 128 and (head[:8], head[76:80]) == (b"DDS \x7c\0\0\0", b"\x20\0\0\0") and head[113] & 2:
            x.say(i, (1, 15), "bsa.cubemap-without-embedded-name", ordinal=i, field="payload")


def _ba2_names(x: Index, table: np.ndarray, at: int, ranks: int) -> tuple[list[str], list[str | None], int]:
    """Displays and identities from the name table at ``at`` (0: none), and its end; events from rank ``ranks`` on."""
    count = len(table)
    keys = list(zip(table["base"].tolist(), [v.tobytes() for v in table["ext"]], table["dir"].tolist(), strict=True))
    if not at:
        return [f"{spelling.SYNTHETIC_HASH}\\d{d:08x}\\e{i:08x}-{b:08x}-x{e.hex()}" for i, (b, e, d) in enumerate(keys)], [None] * count, 0
    raw: list[bytes] = []
    for i in range(count):
        length = x.blob.read(at, 2)
        wire = x.blob.read(at + 2, n := int.from_bytes(length, "little")) if len(length) == 2 else None
        if wire is None or len(wire) < n:
            x.say(i, (1, ranks), "io.span-out-of-range", ERROR)
            break
        raw.append(wire)
        at += 2 + n
    x.refuse(ranks + 1, "ba2.nul-name", [b"\0" in w for w in raw])
    raw += [b""] * (count - len(raw))
    texts = x.named(ranks + 2, raw, "complete")
    known = [None if t is None else t.replace("/", "\\") for t in texts]
    own = x.identities(ranks + 3, known, "ba2.duplicate-name")
    expected = [ba2_identity(w) if t is not None and is_ascii(w) else k for w, t, k in zip(raw, texts, keys, strict=True)]
    show = lambda v: v.hex().upper() if isinstance(v, bytes) else f"{v:08X}"
    for k, part in enumerate(("basename-hash", "extension", "directory-hash")):
        x.warn(ranks + 4 + k, f"ba2.{part}-mismatch", [s[k] != e[k] for s, e in zip(keys, expected, strict=True)], part, [show(s[k]) for s in keys], [show(e[k]) for e in expected])
    return [k if k is not None else f"{spelling.SYNTHETIC_WIRE}\\e{i:08x}" for i, k in enumerate(known)], own, at


def _ba2_common(x: Index, table: np.ndarray, kind: str, width: int, rank: int) -> None:
    x.warn(rank, f"{kind}.nonzero-mod-index", table["mod"] != 0, "modIndex", table["mod"], 0)
    x.warn(rank + 1, f"{kind}.chunk-header-size", table["width"] != width, "chunkHeaderSize", table["width"], width)


def _spans(offset: np.ndarray) -> np.ndarray:
    """Offsets as signed numbers; those beyond are past any file."""
    return np.minimum(offset, np.uint64((1 << 62) - 1)).astype(np.int64)


def ba2(x: Index, console: bool = False) -> None:
    version, subtype, count, name_offset = x.unpack("I4sIQ", 4)
    general, header = BA2_KINDS.get(subtype) == "GENERAL", ba2_header_size(version)
    codec = "zlib"
    if version in STARFIELD_VERSIONS and (extra := x.unpack("Q", 24)[0]) != 1:
        x.say(-1, (0,), "ba2.extra-header-value", field="unknownValueAt24", stored=extra, expected=1)
    if version == 3:
        (method,) = x.unpack("I", 32)
        codec = "lz4_raw" if method == 3 else "zlib"
        if method != 3:
            x.require(x.lenient, "archive.unsupported-encoding", rank=(1,))
            x.say(-1, (1,), "ba2.sf3-zlib-fallback", field="compressionMethod", stored=method)
    least = GENERAL.itemsize if general else TEXTURE.itemsize + CHUNK.itemsize
    x.require(header + least * count <= x.blob.size, "io.span-out-of-range", rank=(2,))
    names_at = name_offset if 0 < name_offset < x.blob.size else 0
    if not names_at:
        x.say(-1, (3,), "ba2.missing-name-table", field="fileNameTableOffset", stored=name_offset)
    if general:
        ends = header + least * count
        x.require(not names_at or names_at >= ends, "ba2.names-overlap-index", rank=(4,))
        table = x.table(GENERAL, header, count)
        x.refuse(0, "gnrl.invalid-chunk-count", table["chunks"] != 1)
        displays, own, named_to = _ba2_names(x, table, names_at, 1)
        _ba2_common(x, table, "gnrl", 16, 10)
        x.warn(12, "gnrl.sentinel-mismatch", table["sentinel"] != SENTINEL, "sentinel", [f"{v:08X}" for v in table["sentinel"].tolist()], f"{SENTINEL:08X}")
        packed, decoded, offset = table["packed"].astype(np.int64), table["unpacked"].astype(np.int64), _spans(table["offset"])
        size = np.where(packed > 0, packed, decoded)
        x.refuse(13, "ba2.payload-overlaps-index", offset < ends)
        x.refuse(14, "io.span-out-of-range", offset + size > x.blob.size)
        codecs = np.where(packed > 0, codec, "stored").tolist()
        x.entries = rows(ordinal=list(range(count)), display=displays, identity=own, decoded_size=decoded, stored_size=size, offset=offset, content_offset=offset, content_size=size, codec=codecs, hash=table["base"].astype(np.int64), folder_hash=table["dir"].astype(np.int64), dds=[None] * count)
    else:
        ends, offset, size, displays, named_to = _textures(x, header, count, names_at, codec, console)
        early = (offset < ends).any()
        if names_at and names_at < ends or early:
            x.say(count, (0,), "ba2.names-overlap-index" if names_at and names_at < ends else "ba2.payload-overlaps-index", ERROR)
    x.overlaps(offset, size, count, "ba2.overlapping-payloads", (names_at, named_to) if names_at else None)
    x.trailing(int(max(ends, named_to, np.where(size > 0, offset + size, 0).max(initial=0))), count, "ba2.trailing-data")
    x.unsafe(displays, count)
    x.facts = {"entries": count, "name_offset": name_offset}


def _textures(x: Index, header: int, count: int, names_at: int, codec: str, console: bool) -> tuple[int, np.ndarray, np.ndarray, list[str], int]:
    """Texture records, each followed by its chunks: end of the records, chunk spans, displays, end of the names."""
    heads, parts, at = [], [], header
    for i in range(count):
        head = x.table(TEXTURE, at, 1)
        chunks = int(head["chunks"][0]) if len(head) else 0
        if not len(head) or not 1 <= chunks <= 4 or at + TEXTURE.itemsize + CHUNK.itemsize * chunks > x.blob.size:
            count = i + 1  # its own rules refuse it below
            heads.append(head if len(head) else np.zeros(1, TEXTURE))
            parts.append(np.zeros(0, CHUNK))
            x.say(i, (1, 3), "io.span-out-of-range", ERROR)
            break
        heads.append(head)
        parts.append(x.table(CHUNK, at + TEXTURE.itemsize, chunks))
        at += TEXTURE.itemsize + CHUNK.itemsize * chunks
    table = np.concatenate(heads) if heads else np.zeros(0, TEXTURE)
    all_ = np.concatenate(parts) if parts else np.zeros(0, CHUNK)
    lengths = np.array([len(p) for p in parts], np.int64)
    of = np.repeat(np.arange(len(parts)), lengths)
    place = np.arange(len(all_)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    cube = (table["flags"] & 1).astype(bool)
    wide, high, mips = (table[c].astype(np.int64) for c in ("wide", "height", "mips"))
    x.refuse(0, "dx10.invalid-chunk-count", (table["chunks"] < 1) | (table["chunks"] > 4) | cube & (table["chunks"] != 1))
    most = np.floor(np.log2(np.maximum(np.maximum(wide, high), 1))).astype(np.int64) + 1
    x.refuse(1, "dx10.invalid-mip-count", (wide == 0) | (high == 0) | (mips == 0) | (mips > most))
    first, last = all_["first"].astype(np.int64), all_["last"].astype(np.int64)
    final = place == lengths[of] - 1
    wanted = np.where(place == 0, 0, np.concatenate((np.zeros(1, np.int64), last[:-1] + 1))[: len(all_)])
    offset, packed, decoded = _spans(all_["offset"]), all_["packed"].astype(np.int64), all_["decoded"].astype(np.int64)
    size = np.where(packed > 0, packed, decoded)
    wrong = (first != wanted) | (last < first) | (last >= mips[of]) | ~final & (last != first)
    codecs = np.where(packed > 0, codec, "stored").tolist()
    sentinel = all_["sentinel"].tolist()
    for c in np.flatnonzero(wrong | (offset + size > x.blob.size) | (packed == 0) | (all_["sentinel"] != SENTINEL)).tolist():
        i, rank = int(of[c]), (1, 4, int(place[c]))
        if wrong[c]:
            x.say(i, (*rank, 0), "dx10.invalid-mip-range", ERROR)
        if offset[c] + size[c] > x.blob.size:
            x.say(i, (*rank, 1), "io.span-out-of-range", ERROR)
        if not packed[c]:
            x.say(i, (*rank, 2), "dx10.stored-chunk", ordinal=i, field="chunkSizes", stored=0, expected=int(decoded[c]))
        if sentinel[c] != SENTINEL:
            x.say(i, (*rank, 3), "dx10.sentinel-mismatch", ordinal=i, field="sentinel", stored=f"{sentinel[c]:08X}", expected=f"{SENTINEL:08X}")
    covered = np.zeros(len(table), np.int64)
    np.maximum.at(covered, of, last + 1)
    x.refuse(5, "dx10.invalid-mip-range", covered != mips)
    displays, own, named_to = _ba2_names(x, table, names_at, 6)
    _ba2_common(x, table, "dx10", 24, 20)
    head_bytes = []
    for i, f in enumerate(table["format"].tolist()):
        try:
            head_bytes.append(header_size(f, console))
        except TextureError as fault:
            x.say(i, (1, 22), str(fault), ERROR)
            head_bytes.append(0)
    total = lambda v: np.bincount(of, v, len(table)).astype(np.int64)
    shapes = rows(width=wide, height=high, mips=mips, format=table["format"], flags=table["flags"], tile=table["tile"], console=[console] * len(table))
    x.chunks = rows(ordinal=of, chunk=place, offset=offset, packed=packed, decoded=decoded, start_mip=first, end_mip=last, codec=codecs)
    n = len(table)
    x.entries = rows(ordinal=list(range(n)), display=displays, identity=own, decoded_size=total(decoded) + np.array(head_bytes, np.int64), stored_size=total(size), offset=[None] * n, content_offset=[None] * n, content_size=[None] * n, codec=["dds"] * n, hash=table["base"].astype(np.int64), folder_hash=table["dir"].astype(np.int64), dds=shapes)
    return at, offset, size, displays, named_to


def walk(data: bytes | Bytes | File, lenient: bool = False, name: str = "") -> Index:
    """The index of one archive; a structural fault is its last diagnostic, an ERROR, and leaves it without entries.

    ``lenient`` offers what the compatibility profile tolerates when reading: other compression methods of the newest
    texture layout's version are taken for zlib, with a warning, and a file named for a console has console textures.
    """
    blob = Bytes(data) if isinstance(data, (bytes, bytearray)) else data
    found = detect(blob.read(0, PREFIX_BYTES))
    if lenient and found.status == "UNSUPPORTED_VARIANT" and found.version == 3 and found.subtype and (kind := BA2_KINDS.get(found.subtype.encode("latin-1"))):
        found = found._replace(status="SUPPORTED_FAMILY", family=f"STARFIELD_{kind}_BA2")
    x = Index(blob, found, lenient)
    if found.status != "SUPPORTED_FAMILY":
        x.say(-1, (0,), {"UNRECOGNIZED": "archive.unrecognized", "INDETERMINATE": "archive.indeterminate"}.get(found.status, "archive.unsupported-encoding"), ERROR)
        return x
    try:
        if found.family == "TES3_BSA":
            tes3(x)
        elif found.family in BSA_FAMILIES.values():
            bsa(x)
        else:
            assert found.version in FO4_VERSIONS + STARFIELD_VERSIONS
            ba2(x, lenient and "_xbox." in name.lower())
    except Ended:
        pass
    if any(e.severity == ERROR for e in x.events):
        x.entries, x.chunks = [], []
    return x
