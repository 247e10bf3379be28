import json
import os
import struct

import pytest

from shelfmark.sources import stores


def put(path, text=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    (path.write_bytes if isinstance(text, bytes) else path.write_text)(text)
    return path


def listed(spark, root):
    rows = [(str(root), os.path.join(d, f), os.path.getsize(os.path.join(d, f)), int(os.path.getmtime(os.path.join(d, f)))) for d, _, names in os.walk(root) for f in names]
    return spark.createDataFrame(rows, "root string, path string, size long, mtime long")


def told(rows):
    return {(r.path, r.key): r.value for r in rows.collect()}


def test_hub_caches(spark, tmp_path):
    cache = tmp_path / "models--some-org--my--model"
    put(cache / "snapshots/aaa/config.json", "{}")
    put(cache / "snapshots/bbb/weights.bin", "12345")
    put(cache / "refs/main", "aaa\n")
    put(tmp_path / "datasets--gsm/blobs/x", "1")
    put(tmp_path / "other/x", "1")
    found = told(stores.hub_caches(listed(spark, tmp_path)))
    own = {k: v for (p, k), v in found.items() if p == str(cache)}
    assert own == {"repo_id": "some-org/my--model", "name": "my--model", "display_name": "some-org/my--model", "author": "some-org", "kind": "model", "is_hf_cache": "true",
                   "revision": "aaa", "content_root": f"{cache}/snapshots/aaa", "stale_revisions": '["bbb"]', "stale_bytes": "5"}
    assert {k: v for (p, k), v in found.items() if p != str(cache)} == {"repo_id": "gsm", "name": "gsm", "display_name": "gsm", "kind": "dataset", "is_hf_cache": "true"}


def test_ollama_models(spark, tmp_path):
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    put(tmp_path / "blobs/sha256-1", b"GGUF" + struct.pack("<IQQ", 3, 0, 1) + text("general.architecture") + struct.pack("<I", 8) + text("llama"))
    layer = lambda digest: json.dumps({"layers": [{"mediaType": stores.OLLAMA_WEIGHTS, "digest": digest, "size": 7}, {"mediaType": "x", "size": 3}]})
    good = put(tmp_path / "manifests/registry.ollama.ai/library/llama3/8b", layer("sha256:1"))
    gone = put(tmp_path / "manifests/registry.ollama.ai/me/mine/latest", layer("sha256:2"))
    bad = put(tmp_path / "manifests/registry.ollama.ai/library/bad/1", "{")
    put(tmp_path / "manifests/registry.ollama.ai/library/empty/1")
    found = told(stores.ollama_models(listed(spark, tmp_path)))
    own = lambda path: {k: v for (p, k), v in found.items() if p == str(path)}
    assert own(good).items() >= {"reference": "llama3:8b", "registry": "registry.ollama.ai", "size": "10", "architecture": "llama"}.items()
    assert own(gone)["reference"] == "me/mine:latest" and own(gone)["warning"] == "weight blob missing"
    assert own(bad) == {"error": "JSONDecodeError"} and len({p for p, _ in found}) == 3


@pytest.mark.parametrize("text", ["names: [cat, 'dog']", "names:\n  - cat\n  - dog # hound\npath: x", "names:\n  1: dog\n  0: cat\n", "names: {1: dog, 0: cat}"])
def test_yolo_names(text):
    assert stores.yolo_names(f"train: a\n{text}\n") == (["cat", "dog"], None)
    assert stores.yolo_names(f"nc: 5\n{text}\n")[1] == 5


def test_yolo_and_voc_datasets(spark, tmp_path):
    yolo, voc = tmp_path / "y", tmp_path / "v"
    put(yolo / "data.yaml", "nc: 2\nnames: [a, b]\n")
    for name in ("images/train/1.jpg", "images/train/2.jpg", "images/val/3.png", "labels/train/1.txt", "notes.txt"):
        put(yolo / name)
    for name, of in (("1", "cat"), ("2", "dog")):
        put(voc / f"Annotations/{name}.xml", f"<annotation><object><name>{of}</name><part><name>head</name></part></object></annotation>")
    put(voc / "Annotations/3.xml", "<annotation>")
    put(voc / "ImageSets/Main/train.txt", "1\n\n2\n")
    put(voc / "ImageSets/Main/val.txt", "3\n")
    files = listed(spark, yolo).unionAll(listed(spark, voc))
    assert {k: v for (p, k), v in told(stores.yolo_datasets(files)).items()} == {"class_names": '["a", "b"]', "num_classes": "2", "num_annotations": "1", "num_images": "3", "splits": '{"train":2,"val":1}'}
    assert {k: v for (p, k), v in told(stores.voc_datasets(files)).items()} == {"num_annotations": "3", "class_names": '["cat","dog"]', "num_classes": "2", "splits": '{"train":2,"val":1}'}
    assert stores.voc_datasets(files.limit(0)).isEmpty() and stores.yolo_datasets(files.limit(0)).isEmpty()
