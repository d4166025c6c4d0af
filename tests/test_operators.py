from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from arclake.operators import measures, pack, publish, validate
from arclake.plans import packing
from arclake.sources import archive


@pytest.fixture(scope="module")
def sources(spark):
    rows = [("one", "Meshes\\A.nif", b"old", 0), ("one", "meshes/a.NIF", b"new", 1), ("one", "textures\\b.dds", b"x" * 500, 2), ("one", "textures\\c.dds", b"x" * 500, 3), ("two", "sound\\d.wav", b"", 4), ("two", "..\\bad", b"?", 5)]
    return spark.createDataFrame(rows, "archive string, name string, payload binary, seq long")


@pytest.mark.parametrize("family", ["TES3_BSA", "TES4_BSA", "SSE_BSA", "FO4_GENERAL_BA2", "STARFIELD_GENERAL_BA2_V3"])
def test_pack_publish_scan_extract(spark, sources, family, tmp_path):
    parts = pack.pack(sources, pack.PackOptions(family))
    done = publish.publish_parts(parts, str(tmp_path / "out"), ".ba2")
    assert [n for n, _ in done] == ["one.ba2", "two.ba2"]
    files = archive.archives(spark, str(tmp_path / "out"))
    assert {r["status"] for r in archive.detect(files).collect()} == {"SUPPORTED_FAMILY"}
    assert not [d for d in archive.diagnostics(files).collect() if d["severity"] == "ERROR"]
    found = archive.contents(files)
    got = {r["identity"]: bytes(r["content"]) for r in found.collect()}
    assert got == {"meshes\\a.nif": b"new", "textures\\b.dds": b"x" * 500, "textures\\c.dds": b"x" * 500, "sound\\d.wav": b""}
    publish.extract(found, str(tmp_path / "tree"))
    assert (tmp_path / "tree/meshes/a.nif").read_bytes() == b"new"
    assert archive.contents(files, [0]).count() == 2
    with pytest.raises(publish.PublicationError, match="target.exists"):
        publish.extract(found, str(tmp_path / "tree"))
    publish.extract(found, str(tmp_path / "tree"), "REPLACE")
    assert not list(tmp_path.glob("*.staging-*"))


def test_same_bytes_at_any_parallelism(spark, sources):
    options = pack.PackOptions("SSE_BSA", split=400)
    want = [(r["archive"], r["part"], bytes(r["content"])) for r in pack.pack(sources, options).orderBy("archive", "part").collect()]
    for n in (1, 7):
        again = pack.pack(sources.repartition(n), options).orderBy("archive", "part").collect()
        assert [(r["archive"], r["part"], bytes(r["content"])) for r in again] == want


def test_rollback_restores_predecessors(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a.bin", b"1"), ("b.bin", b"2")], "name string, content binary")
    publish.publish(files, str(tmp_path / "t"))
    newer = spark.createDataFrame([("a.bin", b"3"), ("b.bin/c", b"4")], "name string, content binary")
    with pytest.raises(Exception):  # noqa: B017
        publish.publish(newer, str(tmp_path / "t"), "REPLACE")
    assert (tmp_path / "t/a.bin").read_bytes() == b"1" and (tmp_path / "t/b.bin").read_bytes() == b"2"


def test_rejected_requests(sources):
    for options, error in ((pack.PackOptions("X"), "archive.unsupported-encoding"), (pack.PackOptions("TES3_BSA", archive_flags=1), "pack.unsupported-flags"), (pack.PackOptions("SSE_BSA", split=-1), "pack.invalid-split")):
        with pytest.raises(pack.PackError, match=error):
            pack.check_options(options)


def test_split_resets_and_oversized(spark):
    own = spark.createDataFrame([(i, c) for i, c in enumerate([50, 60, 500, 10, 10, 90])], "ordinal long, c long")
    parts = {r["ordinal"]: r["part"] for r in packing.split_parts(own, 100, F.col("c")).collect()}
    assert parts == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3, 5: 4}


def test_overlaps_and_limits(spark):
    spans = spark.createDataFrame([("a", 0, 10), ("a", 0, 10), ("a", 10, 12), ("a", 11, 15), ("a", 5, 5), ("b", 0, 3)], "p string, start long, stop long")
    assert [(r["start"], r["stop"]) for r in validate.overlaps(spans, ["p"]).collect()] == [(11, 15)]
    own = spark.createDataFrame([(0, 5), (1, 5), (2, 5)], "ordinal long, size long")
    assert packing.decoded_limit(own, 9).first()["ordinal"] == 1


def test_bootstrap_is_seeded(spark):
    import random
    import statistics

    values = [1.0, 1.1, 0.9, 1.2, 0.95, 1.05, 1.0]
    rng = random.Random(measures.SEED)
    draws = sorted(statistics.median(rng.choices(values, k=7)) for _ in range(measures.RESAMPLES))
    got = measures.bootstrap_ci(spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, round int, v double"), "g", "v").first()
    place = (len(draws) - 1) * 0.025
    low = draws[int(place)] + (draws[int(place) + 1] - draws[int(place)]) * (place - int(place))
    assert abs(got["low"] - low) < 1e-12


def test_impact_rules(spark):
    paths = spark.createDataFrame([("a/x.py",), ("q",)], "path string")
    got = {r["path"]: r["lanes"] for r in measures.impacted(paths, [("^a/", "unit"), (r"\.py$", "lint")]).collect()}
    assert got == {"a/x.py": ["lint", "unit"], "q": ["full"]}


def texture_file():
    from arclake.functions import texture

    return texture.canonical_header(2, 2, 1, 28, False) + bytes(16)


@pytest.mark.parametrize(
    ("family", "name", "error"),
    [
        ("TES3_BSA", "\u00e9.nif", "pack.invalid-encode-name"),
        ("SSE_BSA", "meshes\\\u00e9.nif", "pack.invalid-encode-name"),
        ("SSE_BSA", "top.nif", "bsa.invalid-encode-name"),
        ("SSE_BSA", "meshes\\.nif", "bsa.invalid-encode-name"),
        ("SSE_BSA", "f" * 255 + "\\a.nif", "bsa.invalid-encode-name"),
        ("FO4_GENERAL_BA2", "meshes\\\u00e9.nif", "ba2.invalid-encode-name"),
        ("FO4_GENERAL_BA2", "meshes\\\u0142.nif", "pack.invalid-encode-name"),
        ("FO4_GENERAL_BA2", "top.nif", "ba2.invalid-encode-name"),
        ("FO4_GENERAL_BA2", "a\\" + "f" * 65534, "ba2.invalid-encode-name"),
        ("FO4_DDS_BA2", "top.dds", "ba2.invalid-encode-name"),
        ("FO4_DDS_BA2", "readme.txt", "dds.non-dds-entry"),
        ("FO4_GENERAL_BA2", "..\\bad", "pack.invalid-encode-name"),
    ],
)
def test_entries_are_rejected_not_left_out(spark, family, name, error):
    rows = [("a", "textures\\good.dds", texture_file(), 0), ("a", name, b"?", 1)]
    entries = spark.createDataFrame(rows, "archive string, name string, payload binary, seq long")
    with pytest.raises(pack.PackError, match=f"^{error}$"):
        pack.pack(entries, pack.PackOptions(family, leave_out=()))


def test_names_are_rejected_by_default_and_in_plan_order(spark):
    rows = [("a", "x\\.n", b"?", 3), ("a", "top", b"?", 1), ("a", "x\\y", b"1", 0), ("a", "b" * 200 + "\\" + "c" * 60, b"1", 2)]
    entries = spark.createDataFrame(rows, "archive string, name string, payload binary, seq long")
    with pytest.raises(pack.PackError, match="bsa.invalid-encode-name"):
        pack.pack(entries, pack.PackOptions("SSE_BSA"))
    long = entries.filter("seq in (0, 2)")
    assert pack.pack(long, pack.PackOptions("SSE_BSA")).first()["entries"] == 2
    with pytest.raises(pack.PackError, match="bsa.invalid-encode-name"):
        pack.pack(long, pack.PackOptions("SSE_BSA", archive_flags=0x103))


def test_unmatched_overrides_and_decoded_bytes_are_rejected(spark):
    entries = spark.createDataFrame([("a", "x\\one.dds", texture_file(), 0), ("a", "x\\two.dds", texture_file(), 1), ("b", "x\\one.dds", texture_file(), 2)], "archive string, name string, payload binary, seq long")
    choices = spark.createDataFrame([("x\\one.dds", "stored"), ("x\\none", "stored")], "identity string, compression string")
    with pytest.raises(pack.PackError, match="pack.unmatched-entry-compression"):
        pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", overrides=choices))
    assert pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", overrides=choices.limit(1))).count() == 2
    most = 2 * len(texture_file())
    for family in ("FO4_GENERAL_BA2", "FO4_DDS_BA2"):
        assert pack.pack(entries, pack.PackOptions(family, max_decoded=most)).count() == 2
        with pytest.raises(pack.PackError, match="operation.resource-limit"):
            pack.pack(entries, pack.PackOptions(family, max_decoded=most - 1))


def test_failing_rollback_keeps_predecessors(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a.bin", b"1"), ("b.bin", b"2")], "name string, content binary")
    publish.publish(files, str(tmp_path / "t"))
    newer = spark.createDataFrame([("a.bin", b"3"), ("b.bin", b"4")], "name string, content binary")
    moves = []

    class Store:
        """Refuses the last move of the commit and the first one of the rollback."""

        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def move(self, source, target):
            moves.append((source, target))
            if len(moves) in (4, 5):
                raise OSError("no space")
            self.inner.move(source, target)

    of = publish.fs.FileSystem.from_uri

    class Stores:
        @staticmethod
        def from_uri(uri):
            store, path = of(uri)
            return Store(store), path

    class Fs:
        FileSystem, FileType = Stores, publish.fs.FileType

    monkeypatch.setattr(publish, "_stage", lambda folder, stage=publish._stage: stage(folder))
    rows = publish.publish.__globals__
    monkeypatch.setitem(rows, "fs", Fs)
    monkeypatch.setitem(rows, "_stage", staged_by_driver(of))
    with pytest.raises(OSError, match="no space"):
        publish.publish(newer, str(tmp_path / "t"), "REPLACE")
    left = {p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert {b"1", b"2"} <= left


def staged_by_driver(of):
    """The staging step with the real file system, whatever the module's is replaced by."""

    def stage(folder):
        def run(batches):
            import uuid

            import pyarrow as pa

            store, root = of(folder)
            store.create_dir(root, recursive=True)
            for batch in batches:
                names, staged, sizes = [], [], []
                for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    path = f"{root}/{uuid.uuid4().hex}"
                    with store.open_output_stream(path, compression=None) as out:
                        out.write(content)
                    names.append(name), staged.append(path), sizes.append(len(content))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(staged, pa.string()), pa.array(sizes, pa.int64())], ["name", "staged", "size"])

        return run

    return stage


def test_a_file_put_in_place_meanwhile_stays(spark, tmp_path):
    files = spark.createDataFrame([("a.bin", b"1"), ("b.bin", b"2")], "name string, content binary")

    def meanwhile(rows):
        (tmp_path / "t").mkdir()
        (tmp_path / "t/b.bin").write_bytes(b"other")

    with pytest.raises(publish.PublicationError, match="target.exists"):
        publish.publish(files, str(tmp_path / "t"), "FAIL", meanwhile)
    assert (tmp_path / "t/b.bin").read_bytes() == b"other" and not (tmp_path / "t/a.bin").exists()


def test_windows_invalid_names_are_not_extracted(spark, tmp_path):
    rows = spark.createDataFrame([("p", 0, "meshes\\con.nif", "meshes\\con.nif", b"1", None), ("p", 1, "meshes\\b.nif", "meshes\\b.nif", b"1", None)], archive.CONTENTS)
    with pytest.raises(publish.PublicationError, match="target.unsafe-name"):
        publish.extract(rows, str(tmp_path / "tree"))
    assert not list(tmp_path.iterdir())


def test_shared_payloads_and_embedded_names(spark):
    rows = [("a", "textures\\x.dds", b"same" * 50, 0), ("a", "textures\\y.dds", b"same" * 50, 1)]
    entries = spark.createDataFrame(rows, "archive string, name string, payload binary, seq long")
    parts = pack.pack(entries, pack.PackOptions("SSE_BSA", archive_flags=0x103)).select(F.col("archive").alias("path"), "content")
    assert not [d for d in archive.diagnostics(parts).collect() if d["id"] == "bsa.embedded-name-mismatch"]
    assert {bytes(r["content"]) for r in archive.contents(parts).collect()} == {b"same" * 50}
    plain = pack.pack(entries, pack.PackOptions("SSE_BSA", compress=False)).select(F.col("archive").alias("path"), "content")
    assert archive.entries(plain).select("offset").distinct().count() == 1


def test_owners_are_charged_once_a_part(spark):
    rows = [("a", f"meshes\\{i}.nif", b"p" * 1000 if i < 6 else bytes([i]) * 1000, i) for i in range(8)]
    entries = spark.createDataFrame(rows, "archive string, name string, payload binary, seq long")
    parts = pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", compress=False, split=3000)).orderBy("part").collect()
    assert [r["entries"] for r in parts] == [6, 2]  # 1000 + 6 * (200 + 12), then a part of its own
    parts = pack.pack(entries, pack.PackOptions("FO4_GENERAL_BA2", compress=False, split=3000, share=False)).orderBy("part").collect()
    assert [r["entries"] for r in parts] == [2, 2, 2, 2]


def test_listed_files_are_scanned_without_payloads(spark, sources, tmp_path):
    publish.publish_parts(pack.pack(sources, pack.PackOptions("SSE_BSA")), str(tmp_path / "out"), ".bsa")
    whole, listed = archive.archives(spark, str(tmp_path / "out")), archive.listed(spark, str(tmp_path / "out"))
    columns = ["ordinal", "identity", "decoded_size", "stored_size", "offset", "codec"]
    key = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert key(archive.entries(whole)) == key(archive.entries(listed))
    assert sorted(bytes(r["content"]) for r in archive.contents(listed).collect()) == sorted(bytes(r["content"]) for r in archive.contents(whole).collect())
    with pytest.raises(ValueError, match="selection.duplicate-ordinal"):
        archive.contents(listed, [0, 0])
    (tmp_path / "out/one.bsa").write_bytes(b"changed")
    with pytest.raises(Exception, match="source.changed"):
        archive.entries(listed.select("path", "length", F.lit(0).cast("long").alias("modified"))).count()


def test_empty_requests(spark, sources):
    none = sources.filter("false")
    assert pack.pack(none, pack.PackOptions("SSE_BSA")).count() == 0
    with pytest.raises(pack.PackError, match="bsa.empty-entry-set"):
        pack.pack(none, pack.PackOptions("SSE_BSA", require_entries=True))
