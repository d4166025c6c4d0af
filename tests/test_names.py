from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arclake.functions import names
from arclake.sources import wire

SPELLINGS = ["Meshes/A.NIF", "meshes\\a.nif", "a", "", "..\\x", "a\\.\\b", "C:\\x.txt", "\\x", "con.txt", "a\\LPT1", "x.", "a\\\\b", "a b ", "sound\\voice\\x.WAV", "scripts\\source\\q.psc", "scripts", "x.kf", "ÄÖ\\ü.dds", "a\\b.tar.gz", ".nif", "q?"]


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("name")
    base, folder = names.basename(names.canonical(n)), names.dirname(names.canonical(n))
    hashed = names.with_bsa_hash(names.with_bsa_hash(spark.createDataFrame([(s,) for s in SPELLINGS], "name string"), "bsa", base, True), "folder", folder, False)
    df = hashed.select(
        n, names.identity(n).alias("identity"), names.is_absolute(n).alias("absolute"), names.traversal_ordinal(n).alias("traversal"), names.is_windows_invalid(n).alias("windows"),
        names.tes3_hash(names.canonical(n)).alias("tes3"), "bsa", "folder", names.ba2_identity(n).alias("ba2"),
        names.asset_class(names.identity(n)).alias("kind"), names.matches_masks(n, ["*.NIF", "?"]).alias("masked"), names.split_path(n, F.lit(2)).alias("split"),
    )
    return {r["name"]: r for r in df.collect()}


def test_identity_agrees_with_plain_python(rows):
    for name, r in rows.items():
        assert r["identity"] == wire.identity(name)


def test_hashes_agree_with_plain_python(rows):
    for name, r in rows.items():
        if name.isascii():
            c = wire.fold(name.encode())
            folder, _, base = c.rpartition(b"\\")
            assert r["tes3"] == wire.tes3_hash(c)
            if base:
                assert r["bsa"] == wire.bsa_hash(base, True, 0x68)
            if folder:
                assert r["folder"] == wire.bsa_hash(folder, False, 0x68)
            assert (r["ba2"]["base_hash"], bytes(r["ba2"]["extension"]), r["ba2"]["dir_hash"]) == wire.ba2_identity(name.encode())


def test_safety(rows):
    assert rows["C:\\x.txt"]["absolute"] and rows["\\x"]["absolute"] and not rows["a"]["absolute"]
    assert rows["..\\x"]["traversal"] == 0 and rows["a\\.\\b"]["traversal"] == 1 and rows["a"]["traversal"] is None
    assert [n for n, r in rows.items() if r["windows"]] == ["con.txt", "a\\LPT1", "q?"]


def test_classes_masks_parts(rows):
    assert rows["sound\\voice\\x.WAV"]["kind"] == 4 and rows["scripts\\source\\q.psc"]["kind"] == 7 and rows["scripts"]["kind"] == 9
    assert rows["x.kf"]["kind"] == 0 and rows["a\\b.tar.gz"]["kind"] == 30
    fits = [n for n in SPELLINGS if (b := n.replace("/", "\\").rpartition("\\")[2]).lower().endswith(".nif") or len(b) == 1]
    assert [n for n, r in rows.items() if r["masked"]] == fits
    assert rows["a\\b.tar.gz"]["split"] == "a\\b.tar2.gz" and rows["a"]["split"] == "a2"


@given(st.binary(max_size=40))
def test_crc_from_zero_matches_the_bitwise_rule(data):
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    assert wire.crc0(data) == crc
