from __future__ import annotations

import random
import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from arclake.functions import codec, texture
from arclake.operators import pack
from arclake.sources import archive, scan, wire


@given(st.binary(max_size=3000), st.sampled_from(codec.CODECS))
def test_codecs_round_trip(data, kind):
    packed = codec.encode(data, kind)
    assert codec.decode(packed, kind, len(data)) == data
    assert codec.decode_prefix(packed, kind, 128) == data[:128] if data or kind != "lz4_frame" else True
    with pytest.raises(codec.CodecError):
        codec.decode(packed, kind, len(data) + 1)


@given(st.binary(max_size=60), st.sampled_from(["zlib", "lz4_frame", "lz4_raw"]))
def test_damaged_streams_never_crash(data, kind):
    try:
        codec.decode(data, kind, 10)
    except codec.CodecError:
        pass


def test_long_matches_and_overlaps():
    for data in (b"a" * 100_000, b"abc" * 5000, bytes(random.Random(1).choices(b"ab", k=70_000))):
        assert codec.lz4_block_decode(codec.lz4_block_encode(data), len(data)) == data


def items(kind):
    payloads = [b"first payload " * 9, b"", b"shared", b"shared"]
    names = [b"meshes\\a.nif", b"meshes\\b.txt", b"textures\\c.xml", b"textures\\d.xml"]
    return [wire.Item(n, i, 2 if i == 3 else i, codec.encode(p, kind), kind, len(p)) for i, (n, p) in enumerate(zip(names, payloads, strict=True))], payloads


@pytest.mark.parametrize("family", [f for f in wire.WRITERS if "DDS" not in f])
@pytest.mark.parametrize("compress", [False, True])
def test_build_and_walk(family, compress):
    layout, version, packed = wire.WRITERS[family]
    kind = packed if compress else "stored"
    own, payloads = items(kind)
    if layout == "bsa":
        own.sort(key=lambda i: (wire.bsa_hash(i.name.rpartition(b"\\")[0], False, version) & (1 << 64) - 1, wire.bsa_hash(i.name.rpartition(b"\\")[2], True, version) & (1 << 64) - 1))
    data = wire.build(family, own, 3 | (4 if compress and kind != "stored" else 0))
    w = scan.walk(data)
    assert w.diagnostics == [] and w.found.family == family.removesuffix("_V3")
    got = {e["identity"]: archive.read_entry(w, e) for e in w.entries}
    assert got == {i.name.decode(): payloads[i.ordinal] for i in own}
    shared = {e["identity"]: e["offset"] for e in w.entries}
    assert shared["textures\\c.xml"] == shared["textures\\d.xml"]


@pytest.mark.parametrize("family", [f for f in wire.WRITERS if "DDS" not in f])
def test_truncation_is_rejected_not_raised(family):
    own, _ = items("stored")
    data = wire.build(family, own)
    whole = scan.walk(data)
    for n in range(len(data)):
        w = scan.walk(data[:n])
        ids = {d["id"] for d in w.diagnostics if d["severity"] == "ERROR"}
        assert ids or {d["id"] for d in w.diagnostics} >= {"ba2.missing-name-table"} or len(w.entries) == len(whole.entries)


def test_structural_faults_and_warnings():
    own, _ = items("stored")
    data = bytearray(wire.build("FO4_GENERAL_BA2", own))
    struct.pack_into("<I", data, 24 + 32, 1)
    struct.pack_into("<I", data, 24, 7)
    ids = [d["id"] for d in scan.walk(bytes(data) + b"xx").diagnostics]
    assert ids == ["ba2.basename-hash-mismatch", "gnrl.sentinel-mismatch", "ba2.trailing-data"]
    data[24 + 13] = 2
    assert scan.walk(bytes(data)).diagnostics[-1]["id"] == "gnrl.invalid-chunk-count"
    twice = [i._replace(name=b"meshes\\a.nif") for i in own]
    assert scan.walk(wire.build("TES3_BSA", twice)).diagnostics[-1]["id"] == "tes3.duplicate-name"
    overlap = bytearray(wire.build("TES3_BSA", own))
    struct.pack_into("<I", overlap, 12 + 8 * 2 + 4, 3)
    assert scan.walk(bytes(overlap)).diagnostics[-1]["id"] == "tes3.overlapping-payloads"


def dds_archive(version, kind):
    head = texture.canonical_header(1024, 512, 3, 71, False)
    t = texture.analyze(head, 128 + sum(texture.mip_size(1024 >> i, 512 >> i, 71) for i in range(3)))
    raw = [bytes([i]) * size for i, (_, size, _, _) in enumerate(t["chunks"])]
    packed = [codec.encode(r, kind) for r in raw]
    name = b"textures\\a.dds"
    base_hash, ext, dir_hash = wire.ba2_identity(name)
    header = wire.ba2_header_size(version)
    at = header + 24 + 24 * len(raw)
    record = struct.pack("<I4sIBBHHHBBBB", base_hash, ext, dir_hash, 0, len(raw), 24, 512, 1024, 3, 71, 0, 0)
    for r, p, (_, _, a, b) in zip(raw, packed, t["chunks"], strict=True):
        record += struct.pack("<QIIHHI", at, len(p), len(r), a, b, wire.SENTINEL)
        at += len(p)
    top = struct.pack("<4sI4sIQ", wire.BA2_MAGIC, version, b"DX10", 1, at) + (struct.pack("<Q", 1) if version in (2, 3) else b"") + (struct.pack("<I", 3) if version == 3 else b"")
    return top + record + b"".join(packed) + struct.pack("<H", len(name)) + name, head + b"".join(raw)


@pytest.mark.parametrize(("version", "kind"), [(1, "zlib"), (8, "zlib"), (2, "zlib"), (3, "lz4_raw")])
def test_textures_are_rebuilt(version, kind):
    data, expected = dds_archive(version, kind)
    w = scan.walk(data)
    assert w.diagnostics == [] and len(w.chunks) == 2
    assert archive.read_entry(w, w.entries[0]) == expected and w.entries[0]["decoded_size"] == len(expected)


@pytest.mark.parametrize("family", [f for f in wire.WRITERS if "DDS" in f])
def test_texture_archives_are_written(spark, family):
    _, texture_file = dds_archive(1, "zlib")
    narrow = bytearray(texture.canonical_header(2, 2, 1, 88, False))
    struct.pack_into("<I", narrow, 88, 24)
    rows = [("a", "Textures/One.DDS", texture_file, 0), ("a", "textures\\two.dds", texture_file, 1), ("a", "textures\\three.dds", bytes(narrow) + bytes(range(12)), 2), ("a", "readme.txt", b"x", 3)]
    parts = pack.pack(spark.createDataFrame(rows, "archive string, name string, payload binary, seq long"), pack.PackOptions(family)).collect()
    w = scan.walk(bytes(parts[0]["content"]))
    assert w.diagnostics == [] and w.found.family == family.removesuffix("_V3")
    got = {e["identity"]: archive.read_entry(w, e) for e in w.entries}
    wide = texture.canonical_header(2, 2, 1, 88, False) + texture.widen_bgr24(bytes(range(12)))
    assert got == {"textures\\one.dds": texture_file, "textures\\two.dds": texture_file, "textures\\three.dds": wide}
    assert len({c["offset"] for c in w.chunks}) == len(w.chunks) - 2


def test_texture_headers():
    for f in (*texture.LEGACY_WRITABLE, *texture.EXTENDED_WRITABLE):
        for cube in (False, True):
            head = texture.canonical_header(64, 64, 7, f, cube)
            size = sum(texture.mip_size(max(1, 64 >> i), max(1, 64 >> i), f) for i in range(7)) * (6 if cube else 1)
            t = texture.analyze(head, len(head) + size)
            assert (t["format"], t["cube"], t["payload"]) == (f, cube, size)
    with pytest.raises(texture.TextureError, match="dds.unsupported-format"):
        texture.canonical_header(4, 4, 1, 2, False)
    with pytest.raises(texture.TextureError, match="dds.payload-size"):
        texture.analyze(head, len(head) + 1)
    assert texture.widen_bgr24(b"abcdef") == b"abc\xffdef\xff"
