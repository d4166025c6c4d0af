from __future__ import annotations

from arclake import cli
from arclake.streaming import watch


def run(spark, *argv):
    return cli.run(spark, cli.parser().parse_args(argv))


def test_pack_list_unpack(spark, tmp_path):
    for layer, name, data in (("a", "meshes/x.nif", b"one"), ("a", "textures/y.dds", b"two" * 99), ("b", "Meshes/X.nif", b"over")):
        path = tmp_path / layer / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "a/link").symlink_to(tmp_path / "b")
    target = str(tmp_path / "out/pack.bsa")
    assert [line.split("\t")[0] for line in run(spark, "pack", f"{tmp_path}/a+{tmp_path}/b", target, "--family", "SSE_BSA")] == ["pack.bsa"]
    listed = run(spark, "list", target)
    assert sorted(line.split("\t")[1] for line in listed[:2]) == ["meshes\\x.nif", "textures\\y.dds"] and listed[2] == "SSE_BSA\t2 entries\t2 compressed\t301 bytes"
    assert len(run(spark, "list", target, "--masks", "*.NIF")) == 2
    run(spark, "unpack", target, str(tmp_path / "tree"))
    assert (tmp_path / "tree/meshes/x.nif").read_bytes() == b"over"
    query = watch.index_stream(spark, str(tmp_path / "out"), str(tmp_path / "index"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2


def test_a_top_level_file_is_refused(spark, tmp_path, capsys):
    (tmp_path / "a/meshes").mkdir(parents=True)
    (tmp_path / "a/meshes/x.nif").write_bytes(b"one")
    (tmp_path / "a/top.nif").write_bytes(b"two")
    assert cli.main(["pack", f"{tmp_path}/a", f"{tmp_path}/out/pack.bsa", "--family", "SSE_BSA"]) == 1
    assert "bsa.invalid-encode-name" in capsys.readouterr().err and not (tmp_path / "out/pack.bsa").exists()


def test_archives_are_sources_and_targets_are_not(spark, tmp_path):
    (tmp_path / "in/meshes").mkdir(parents=True)
    (tmp_path / "in/meshes/x.nif").write_bytes(b"one")
    first = str(tmp_path / "in/first.ba2")
    run(spark, "pack", f"{tmp_path}/in", first, "--family", "FO4_GENERAL_BA2")
    (tmp_path / "in/meshes/z.nif").write_bytes(b"two")
    run(spark, "pack", f"{first}+{tmp_path}/in", first, "--family", "STARFIELD_GENERAL_BA2", "--replace")
    assert [line.split("\t")[1] for line in run(spark, "list", first)[:2]] == ["meshes\\x.nif", "meshes\\z.nif"]


def test_missing_sources(spark, tmp_path, capsys):
    assert cli.main(["pack", f"{tmp_path}/none", f"{tmp_path}/out.bsa", "--family", "SSE_BSA"]) == 1
    assert "pack.source-missing" in capsys.readouterr().err
