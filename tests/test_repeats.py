"""Names that repeat in a source: no row is lost to the overlay, and queries still give what DuckDB gives."""

from __future__ import annotations

import tracemalloc
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from test_oracle import plain

import __spark_entry__ as entry
from arclake.operators import pack
from arclake.sources import archive

PERIOD = 13 * 64  # ids so far apart have names alike but for the number, which ids of 9 modulo 13 do not have


@pytest.fixture(scope="module")
def repeats(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("repeats"))
    rows = [(i, f"text {i}" * (i % 7), "en", s) for s, first in (("src0", 9), ("a/7", 22)) for i in (first, first + PERIOD, first + 2 * PERIOD, first + 3 * PERIOD, first + 4, first + 19, first + 51)]
    rows += [(9 + 4 * PERIOD, rows[1][1], "en", "src0"), (9 + 5 * PERIOD, None, "en", "src0"), (9 + 6 * PERIOD, "none", "en", None), (14, "late", None, "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["roundtrip_fo4_zlib", "roundtrip_starfield_lz4", "roundtrip_tes4_zlib", "roundtrip_fo3_stored", "roundtrip_sse_lz4", "roundtrip_tes3_stored", "inspect_summary", "inspect_compressed", "open_by_ordinal"])
def test_repeated_names_are_all_there(spark, repeats, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{repeats}/documents.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, repeats).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert plain(got, sorted(want.columns)) == plain(want, sorted(want.columns))


def test_choices_of_one_archive_and_repeated_choices(spark):
    rows = [(a, f"meshes\\{n}.nif", b"x" * 99, i) for i, (a, n) in enumerate([("one", "a"), ("one", "b"), ("two", "a")])]
    entries = spark.createDataFrame(rows, "archive string, name string, payload binary, seq long")
    choices = spark.createDataFrame([("one", "meshes\\a.nif", "stored")], "archive string, identity string, compression string")
    parts = pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", overrides=choices)).selectExpr("archive AS path", "content")
    assert {(r["path"], r["identity"], r["codec"]) for r in archive.entries(parts).collect()} == {("one", "meshes\\a.nif", "stored"), ("one", "meshes\\b.nif", "zlib"), ("two", "meshes\\a.nif", "zlib")}
    with pytest.raises(pack.PackError, match="pack.unmatched-entry-compression"):
        pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", overrides=choices.selectExpr("'two' AS archive", "'meshes\\\\b.nif' AS identity", "compression")))
    with pytest.raises(pack.PackError, match="pack.repeated-entry-compression"):
        pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", overrides=choices.union(choices).drop("archive")))


def test_order_tes3_leaves_only_ties_open(spark, repeats):
    """The SQL orders by hash and name alone: names stand where it puts them, and equal ones here by their doc_id."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{repeats}/documents.parquet/*.parquet'")
    named = {r["doc_id"]: r["identity"] for r in entry.queries()["name_identity"](spark, repeats).collect()}
    got = entry.queries()["order_tes3"](spark, repeats).orderBy("ordinal").toPandas()["doc_id"].tolist()
    want = con.sql(f"SELECT doc_id FROM ({entry.oracle_sql()['order_tes3']}) ORDER BY ordinal").df()["doc_id"].tolist()
    assert [named[i] for i in got] == [named[i] for i in want]
    assert len(set(named[i] for i in got)) < len(got) and all(a < b for a, b in zip(got, got[1:], strict=False) if named[a] == named[b])


@pytest.mark.parametrize(("family", "flags"), [("TES3_BSA", None), ("TES4_BSA", None), ("FO3_FNV_SKYRIM_LE_BSA", 0x103), ("SSE_BSA", None), ("FO4_GENERAL_BA2", None), ("STARFIELD_GENERAL_BA2_V3", None)])
def test_files_have_the_bytes_of_rows(spark, family, flags):
    rows = [(a, f"meshes\\{n}.nif", (b"shared" if n % 3 else bytes([n])) * 99 * (n % 4), n) for a in ("one", "two/0") for n in range(20)]
    entries = spark.createDataFrame(rows, "archive string, name string, payload binary, seq long").repartition(3)
    for split in (None, 1500):
        options = pack.PackOptions(family, split=split, archive_flags=flags)
        want = {(r["archive"], r["part"]): (r["entries"], bytes(r["content"])) for r in pack.pack(entries, options).collect()}
        files = pack.pack_files(entries, options)
        got = {(r["archive"], r["part"]): (r["entries"], Path(r["path"].removeprefix("file://")).read_bytes()) for r in files.collect()}
        assert got == want and len(got) >= 2
        assert archive.contents(archive.dealt(files)).filter("error is null").count() == len(rows)


def test_a_file_is_written_through(tmp_path):
    """A part of 64 MB, its payloads in batches of 1 MB: the worker holds far less."""
    kinds = {"archive": pa.string(), "part": pa.int32(), "payloads": pa.bool_(), "ordinal": pa.int64(), "identity": pa.string(), "owner": pa.int64(), "codec": pa.string(), "size": pa.int64(), "stored_size": pa.int64(), "archive_flags": pa.int64(), "file_flags": pa.int64(), "stored": pa.binary()}
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, pa.schema(kinds.items()))
    n, size = 64, 1 << 20

    def batches():
        yield batch([{"archive": "a", "part": 0, "payloads": False, "ordinal": i, "identity": f"m\\{i}.nif", "owner": i, "codec": "stored", "size": size, "stored_size": size, "archive_flags": 3, "file_flags": 0} for i in range(n)])
        for i in range(n):
            yield batch([{"archive": "a", "part": 0, "payloads": True, "ordinal": i, "stored": bytes([i]) * size}])

    pa.default_memory_pool().release_unused()
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    held = []
    done = list(pack._through("SSE_BSA", f"file://{tmp_path}")(held.append(pa.total_allocated_bytes() - before) or b for b in batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done[0].column("length")[0].as_py() > n * size
    assert peak < 8 * size and max(held) < 8 * size
    with pytest.raises(pack.PackError, match="pack.missing-payload"):
        list(pack._through("SSE_BSA", f"file://{tmp_path}")(b for k, b in enumerate(batches()) if k < n))


def test_whole_archives_of_round_trips_are_files(spark, repeats, monkeypatch):
    """No plan of an unsplit round trip has an archive as a value."""
    monkeypatch.setattr(pack, "pack", None)
    for name in ("roundtrip_sse_lz4", "roundtrip_tes4_zlib", "roundtrip_tes3_stored", "roundtrip_starfield_lz4"):
        assert entry.queries()[name](spark, repeats).count() > 0
