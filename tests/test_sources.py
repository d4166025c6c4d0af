"""What is packed, ceilings, cancelled operations and capsules."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from arclake.operators import control, evidence, sources
from arclake.sources import archive, scan
from arclake import vectors


def test_folder_walk(tmp_path):
    for name in ("b/Z.nif", "B/a.nif", "b/y.nif", "out.bsa", "out2.bsa", "outer.bsa"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "link").symlink_to(tmp_path / "b")
    (tmp_path / "b/file").symlink_to(tmp_path / "out.bsa")
    names = [n for n, _ in sources.walk(str(tmp_path), (str(tmp_path / "out.bsa"),))]
    assert names == ["B\\a.nif", "b\\y.nif", "b\\Z.nif", "outer.bsa"]


def test_source_kinds(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.nif").write_bytes(b"loose")
    (tmp_path / "a.ba2").write_bytes(vectors.vector("gnrl_sound"))
    own = [sources.DetectedPath(str(tmp_path / "a.ba2")), sources.DetectedPath(str(tmp_path / "d")), sources.NamedFile(str(tmp_path / "d/x.nif"), "meshes\\n.nif"), sources.Generated("g.bin", "seed", 3_000_000)]
    got = [(r["name"], bytes(r["payload"])) for r in sources.entries(spark, own).orderBy("seq").collect()]
    assert got[:4] == [("meshes\\a.nif", b"AB"), ("meshes\\b.txt", b"CDE"), ("x.nif", b"loose"), ("meshes\\n.nif", b"loose")]
    assert got[4] == ("g.bin", archive.corpus_bytes("seed", 3_000_000)) and len(got) == 5
    rows = sources.entries(spark, own[1:2])
    time.sleep(0.01)
    (tmp_path / "d/x.nif").write_bytes(b"other")
    with pytest.raises(Exception, match="source.changed"):
        rows.collect()


def test_offsets_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: the second payload starts beyond 2 GiB; only the index is read."""
    data = bytearray(vectors.vector("tes3_sound"))
    data[24:28] = (0x80000000).to_bytes(4, "little")
    path = tmp_path / "big.bsa"
    with open(path, "wb") as file:
        file.write(data)
        file.seek(76 + 0x80000000)
        file.write(b"CDE")
    with open(path, "rb") as file:
        blob = scan.File(file, os.path.getsize(path))
        x = scan.walk(blob)
        assert [d["id"] for d in x.diagnostics] == ["tes3.payload-offset-over-signed-2gib"] and blob.taken <= 2 * scan.WINDOW
    found = archive.contents(archive.listed(spark, str(path)))
    assert [bytes(r["content"]) for r in found.orderBy("ordinal").collect()] == [b"AB", b"CDE"]


def test_limits(spark):
    files = spark.createDataFrame([(c, vectors.vector(c)) for c in ("gnrl_sound", "tes3_sound")], "path string, content binary")
    entries = archive.entries(files)
    control.require(entries, control.Limits(entries=2, decoded_bytes=5), ["path"])
    for limits, name in ((control.Limits(entries=1), "entries"), (control.Limits(decoded_bytes=4), "decoded_bytes"), (control.Limits(metadata_bytes=9), "metadata_bytes")):
        assert {r["limit"] for r in control.passed(entries, limits, ["path"]).collect()} == {name}
        with pytest.raises(Exception, match="operation.resource-limit"):
            control.require(entries, limits, ["path"])


def test_operations_tell_their_progress_and_can_be_cancelled(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(30)
            yield batch

    operation = control.Operation(spark, lambda: spark.range(4).repartition(4).mapInArrow(slow, "id long").count())
    began = time.time()
    while not operation.progress().tasks and time.time() - began < 20:
        time.sleep(0.1)
    assert operation.progress().tasks
    operation.cancel()
    with pytest.raises(control.Cancelled):
        operation.wait()
    assert time.time() - began < 25
    assert control.Operation(spark, lambda: spark.range(7).count()).wait() == 7
    with pytest.raises(ZeroDivisionError):
        control.Operation(spark, lambda: 1 // 0).wait()


def test_capsules(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2), ("a", None)], "k string, v long")
    data = evidence.section(rows, ["k"])
    assert data == b'[{"k":"a","v":null},{"k":"b","v":2}]\n'
    evidence.write_capsule(spark, str(tmp_path / "c"), {"one": data, "two": evidence.canonical({"z": 1, "a": "\u00e9"})})
    files = lambda: spark.createDataFrame([(p.name, p.read_bytes()) for p in (tmp_path / "c").iterdir()], "name string, content binary")
    assert evidence.verify_capsule(files()) == []
    (tmp_path / "c/two.json").write_bytes(b"{}")
    (tmp_path / "c/three.json").write_bytes(b"{}")
    assert evidence.verify_capsule(files()) == ["three.json", "two"]


def test_lenient_scans(spark):
    files = spark.createDataFrame([("x/a_xbox.ba2", vectors.vector("dx10_sound")), ("x/a.ba2", vectors.vector("sf3_method"))], "path string, content binary")
    sizes = {r["path"]: r["decoded_size"] for r in archive.entries(files, lenient=True).filter(F.col("codec") == "dds").collect()}
    assert sizes == {"x/a_xbox.ba2": 16 + 164} and {r["path"] for r in archive.entries(files).collect()} == {"x/a_xbox.ba2"}
