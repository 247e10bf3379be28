import json

import pytest

from shelfmark import library
from shelfmark.__main__ import main
from shelfmark.plans.export import export


def test_scan_report_and_export(spark, tmp_path, capsys):
    models, data, out = tmp_path / "in" / "bert-base", tmp_path / "in" / "corpus", str(tmp_path / "cat")
    models.mkdir(parents=True)
    data.mkdir()
    (models / "config.json").write_text('{"model_type": "bert"}')
    (models / "model.safetensors").write_bytes(b"x" * 2000)
    for i in range(3):
        (data / f"{i}.csv").write_bytes(b"y" * 300_000)
    (tmp_path / "in" / "caps").mkdir()
    for i in range(3):
        (tmp_path / "in" / "caps" / f"{i}.pcap").write_text(str(i))
    assert main(["--catalog", out, "scan", str(tmp_path / "in")], spark) == 0
    rows = {r["name"]: r for r in library.inventory(spark, out).collect()}
    assert rows["bert-base"]["category"] == "embedding" and rows["bert-base"]["n_files"] == 2 and rows["bert-base"]["size_bytes"] == 2022
    assert rows["caps"]["detector"] == "cybersecurity_dataset" and len(rows) == 3
    assert rows["corpus"]["kind"] == "dataset" and rows["corpus"]["size_bytes"] == 900_000
    assert [r["name"] for r in library.inventory(spark, out, "models").collect()] == ["bert-base"]
    with pytest.raises(ValueError):
        library.inventory(spark, out, "nosuch")
    dup = library.duplicates(spark, out, 1000).collect()
    assert [(r["n_files"], r["wasted_bytes"]) for r in dup] == [(3, 600_000)]
    for words in (["list", "datasets"], ["stats"], ["duplicates"], ["facts"], ["list", "--format", "markdown", "--out", str(tmp_path / "md")]):
        assert main(["--catalog", out, *words], spark) == 0
    assert "corpus" in capsys.readouterr().out
    lines = "".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*"))).splitlines()
    assert lines[0] == "# Inventory" and lines[2].startswith("| asset_id") and sum("878.9 KiB" in x for x in lines) == 1
    odd = spark.createDataFrame([("a|b\nc", None)], "name string, size_bytes long")
    export(odd, "markdown", str(tmp_path / "odd"))
    assert "| a\\|b c |  |" in "".join(p.read_text() for p in (tmp_path / "odd").glob("part-*"))
    export(odd, "json", str(tmp_path / "js"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "js").glob("part-*"))) == {"name": "a|b\nc", "size_bytes": None}


def test_duplicates_are_equal_in_full(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, middle in (("a", b"1"), ("b", b"2"), ("c", b"1")):
        (tmp_path / "in" / name).write_bytes(b"x" * (5 << 20) + middle + b"y" * (5 << 20))
    library.scan(spark, [str(tmp_path / "in")], str(tmp_path / "cat"))
    found = library.duplicates(spark, str(tmp_path / "cat")).collect()
    assert [[p.rsplit("/", 1)[1] for p in r["paths"]] for r in found] == [["a", "c"]] and found[0]["wasted_bytes"] == (10 << 20) + 1


def test_further_detectors(spark):
    from shelfmark.operators import recognise

    paths = ["a/proj/train.py", "a/proj/requirements.txt", "a/proj/configs/x.yaml", "a/ls/label_config.xml", "a/mot/seq1/seqinfo.ini", "a/mot/seq1/1.jpg", "a/pd/inference.pdmodel", "a/pd/inference.pdiparams", "a/mlx/mlx_config.json", "a/co/annotations/instances_val.json"]
    paths += [f"a/bdd_x/images/{i}.jpg" for i in range(20)] + ["a/bdd_x/labels/1.txt"] + [f"a/vid/{i}.mp4" for i in range(10)] + ["a/vid/labels/x.txt"] + [f"a/ic/{p}/{i}.png" for p in ("train/cat", "train/dog", "val/cat") for i in range(12)]
    files = spark.createDataFrame([(p, 10) for p in paths], "path string, size_bytes long")
    profiles = recognise.directory_profiles(files)
    coco = recognise.coco_folders(spark.createDataFrame([("a/co/annotations/instances_val.json", "num_images", "3")], "path string, key string, value string"))
    found = {r["path"]: r["detector"] for r in recognise.detected(profiles, recognise.mot_folders(profiles), coco).collect()}
    assert found == {"a/proj": "ai_project", "a/ls": "label_studio", "a/mot": "mot", "a/pd": "paddle_inference", "a/mlx": "mlx", "a/bdd_x": "bdd100k", "a/vid": "media_collection", "a/co": "coco", "a/ic": "image_classification"}


def test_later_scans_keep_what_did_not_change(spark, tmp_path):
    out, root, other = str(tmp_path / "cat"), tmp_path / "in", tmp_path / "else"
    for name in ("a", "b", "c"):
        (root / name).mkdir(parents=True)
        (root / name / "config.json").write_text('{"model_type": "bert"}')
        (root / name / "model.safetensors").write_bytes(b"x" * 2000)
    other.mkdir()
    (other / "z.gguf").write_bytes(b"z" * 3000)
    first = {r["name"]: r for r in library.scan(spark, [str(root), str(other)], out).collect()}
    assert {r["action"] for r in first.values()} == {"inserted"} and first["a"]["health_score"] == 100
    assert library.duplicates(spark, out, 1000).first()["n_copies"] == 3
    groups, near = library.duplicate_assets(spark, out)
    assert groups.first()["member_count"] == 3 and near.count() == 0
    (root / "b" / "model.safetensors").write_bytes(b"y" * 2001)
    (root / "c" / "model.safetensors").unlink()
    (root / "c" / "config.json").unlink()
    later = {r["name"]: r for r in library.scan(spark, [str(root)], out).collect()}
    assert {n: r["action"] for n, r in later.items()} == {"a": "unchanged", "b": "updated", "c": "missing", "else": "kept"}
    assert {n: r["asset_id"] for n, r in later.items()} == {n: r["asset_id"] for n, r in first.items()}
    files = {r["path"].removeprefix(str(tmp_path)): r for r in library.table(spark, out, "files").collect()}
    assert files["/in/a/model.safetensors"]["sha256"] and files["/in/b/model.safetensors"]["sha256"] is None and "/else/z.gguf" in files and "/in/c/config.json" not in files
    assert [r["name"] for r in library.search(spark, out, "kind:model size:>1k missing:false").collect()] == ["else", "b", "a"]
    assert library.search(spark, out, "missing:true c").count() >= 1 and library.locate(spark, out, "IN/B").first()["name"] == "b"
    assert library.table(spark, out, "roots").count() == 2 and library.candidates(spark, [str(tmp_path)], out).where("dir like '%/in/%'").count() == 0
    for words in (["status"], ["health"], ["search", "kind:model"], ["where", "b"], ["show", str(root / "b")], ["discover", str(root)]):
        assert main(["--catalog", out, *words], spark) == 0


def test_equal_weights_and_other_definitions(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "cat")

    def model(name, config, shards=30, notes="", odd=""):
        (root / name).mkdir(parents=True)
        (root / name / "config.json").write_text(config)
        (root / name / "README.md").write_text(notes)
        for i in range(shards):
            (root / name / f"model-{i}.safetensors").write_bytes(f"{odd}{i}".encode() * 1000)

    model("a", '{"model_type": "bert"}', notes="one")
    model("b", '{"model_type": "bert"}', notes="another")  # the same but for documentation
    model("c", '{"model_type": "bert", "rope": 2}')  # the same weights under another definition
    model("d", '{"model_type": "bert"}', shards=31)  # a copy with one more file, which nothing else has
    model("e", '{"model_type": "bert"}', odd="x")
    library.scan(spark, [str(root)], out)
    names = {r["asset_id"]: r["name"] for r in library.present(spark, out).collect()}
    groups, near = library.duplicate_assets(spark, out)
    assert [(r["member_count"], names[r["keeper"]] in "ab") for r in groups.collect()] == [(2, True)]
    pairs = {frozenset((names[r["left_id"]], names[r["right_id"]])) for r in near.collect()}
    assert frozenset("cd") in pairs and len(pairs) == 3  # one of a and b stands for both
    assert not any("e" in p for p in pairs)
    files = {r["path"].removeprefix(str(root)): r for r in library.table(spark, out, "files").collect()}
    assert files["/d/model-30.safetensors"]["sha256"] and files["/a/config.json"]["sha256"] and files["/e/config.json"]["sha256"] is None


def places(out):
    """Which folder holds each bucket of each table."""
    versions = sorted(int(p.name) for p in (out / "versions").iterdir() if (p / "manifest.json").exists())
    return json.loads((out / "versions" / str(versions[-1]) / "manifest.json").read_text())


def test_one_changed_asset_rewrites_its_bucket_only(spark, tmp_path):
    root, out = tmp_path / "in", tmp_path / "cat"
    for i in range(12):
        (root / f"m{i}").mkdir(parents=True)
        (root / f"m{i}" / "config.json").write_text('{"model_type": "bert"}')
        (root / f"m{i}" / "model.safetensors").write_bytes(b"x" * (1000 + i))
    library.scan(spark, [str(root)], str(out))
    before = places(out)
    (root / "m3" / "model.safetensors").write_bytes(b"y" * 5000)
    assert library.rescan(spark, str(out), [str(root / "m3")], stream="watch", batch=7)
    after = places(out)
    moved = {t: {b for b in after["tables"][t] if after["tables"][t][b] != before["tables"][t].get(b)} for t in ("files", "facts", "assets")}
    assert [len(x) for x in moved.values()] == [1, 1, 1] and after["tables"]["roots"] == before["tables"]["roots"] and after["applied"]["watch"] == 7
    rows = {r["name"]: r for r in library.table(spark, str(out), "assets").collect()}
    assert len(rows) == 12 and rows["m3"]["action"] == "updated" and rows["m3"]["size_bytes"] == 5022 and {rows[f"m{i}"]["action"] for i in range(12) if i != 3} == {"kept"}
    assert library.table(spark, str(out), "files").count() == 24
    # the same batch again, and an older one, change nothing
    assert not library.rescan(spark, str(out), [str(root / "m3")], stream="watch", batch=7) and not library.rescan(spark, str(out), [str(root)], stream="watch", batch=3)
    assert places(out) == after
    # a folder that is gone, and a failed write that left a draft
    for f in (root / "m5").iterdir():
        f.unlink()
    (root / "m5").rmdir()
    (out / "versions" / str(after["number"] + 1) / "files").mkdir(parents=True)
    assert library.rescan(spark, str(out), [str(root / "m5")], stream="watch", batch=8)
    rows = {r["name"]: r for r in library.table(spark, str(out), "assets").collect()}
    assert rows["m5"]["is_missing"] and rows["m5"]["action"] == "missing" and library.table(spark, str(out), "files").count() == 22


def test_details_of_headers_and_the_full_export(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "cat")
    (root / "my-lora").mkdir(parents=True)
    (root / "my-lora" / "adapter_config.json").write_text('{"base_model_name_or_path": "org/base", "peft_type": "LORA", "r": 8}')
    (root / "my-lora" / "adapter_model.safetensors").write_bytes(b"x" * 100)
    (root / "my-lora" / "README.md").write_text("---\nlicense: apache-2.0\ntags:\n- chat\n---\nA description of this adapter that is long enough to be taken for one.\n")
    library.scan(spark, [str(root)], out)
    row = library.table(spark, out, "assets").first()
    assert (row["base_model"], row["license"], row["tags"]) == ("org/base", "apache-2.0", "chat") and "adapter.no_base_model" not in (row["health_findings"] or [])
    assert library.search(spark, out, "license:apache-2.0 lora").count() == 1 and library.search(spark, out, "license:mit").count() == 0
    assert main(["--catalog", out, "list", "--format", "csv", "--out", str(tmp_path / "csv")], spark) == 0
    head, line = [x for p in sorted((tmp_path / "csv").glob("part-*")) for x in p.read_text().splitlines()]
    assert len(head.split(",")) == 36 and "apache-2.0" in line and "my-lora" in line
    assert main(["--catalog", out, "list", "--format", "json", "--out", str(tmp_path / "js")], spark) == 0
    assert any("all" in p.read_text() for p in (tmp_path / "js-summary").glob("part-*"))
    assert main(["--catalog", out, "roots", "disable", str(root)], spark) == 0
    with pytest.raises(RuntimeError):
        main(["--catalog", out, "scan"], spark)
    assert main(["--catalog", out, "roots", "remove", str(root)], spark) == 0 and library.table(spark, out, "roots").count() == 0
    for words in (["warnings"], ["installations"], ["watch", "--status"]):
        assert main(["--catalog", out, *words], spark) == 0
