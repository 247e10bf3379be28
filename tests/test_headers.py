import json
import pickle
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.catalogue import best_facts
from shelfmark.sources import headers


def text(s):
    return struct.pack("<Q", len(s)) + s.encode()


def gguf_bytes():
    pairs = text("general.architecture") + struct.pack("<I", 8) + text("llama") + text("general.file_type") + struct.pack("<II", 4, 15)
    pairs += text("tokens") + struct.pack("<IIQ", 9, 8, 2) + text("a") + text("b") + text("llama.context_length") + struct.pack("<II", 4, 4096)
    tensors = text("w") + struct.pack("<IQQIQ", 2, 3, 5, 0, 0)
    return b"GGUF" + struct.pack("<IQQ", 3, 1, 4) + pairs + tensors


@pytest.fixture
def found(spark, tmp_path):
    (tmp_path / "m.gguf").write_bytes(gguf_bytes())
    (tmp_path / "cut.gguf").write_bytes(gguf_bytes()[:-20])
    (tmp_path / "no.gguf").write_bytes(b"abcdefgh")
    (tmp_path / "m.onnx").write_bytes(b"\x08\x09" + b"\x12\x03abc" + b"\x42\x04\x0a\x00\x10\x11" + b"\x3a\xff\xff\x7f" + b"xx")
    with zipfile.ZipFile(tmp_path / "m.pt", "w") as z:
        z.writestr("m/data.pkl", pickle.dumps(["torch HalfStorage"]))
        z.writestr("m/data/0", bytes(64))
    (tmp_path / "config.json").write_text(json.dumps({"model_type": "bert", "architectures": ["BertModel"]}))
    (tmp_path / "README.md").write_text("---\nlicense: mit\ntags:\n- a\n- b\nlanguage: [en, de]\n---\n# Title\n\nThis card describes a model that does nothing much at all.\n")
    (tmp_path / "instances_val.json").write_text(json.dumps({"images": [{}, {}], "annotations": [{"bbox": [1]}], "categories": [{"name": "cat"}]}))
    (tmp_path / "other.txt").write_text("x")
    paths = [(str(p),) for p in tmp_path.iterdir()] + [(None,), (str(tmp_path / "gone.gguf"),)]
    rows = headers.facts(spark.createDataFrame(paths, "path string"))
    return {(r["path"].rsplit("/", 1)[1], r["key"]): r["value"] for r in best_facts(rows.withColumnRenamed("path", "asset_id")).withColumnRenamed("asset_id", "path").collect()}


def test_facts(found):
    get = lambda name: {k: v for (n, k), v in found.items() if n == name}
    assert get("m.gguf") == {"gguf_version": "3", "tensor_count": "1", "param_count": "15", "architecture": "llama", "context_length": "4096", "quantization": "Q4_K_M"}
    assert "param_count" not in get("cut.gguf") and get("cut.gguf")["architecture"] == "llama"
    assert get("no.gguf") == {"error": "ValueError"} and get("gone.gguf") == {"error": "FileNotFoundError"}
    assert get("m.onnx") == {"framework": "onnxruntime", "ir_version": "9", "producer": "abc", "opset": "17"}
    assert get("m.pt") == {"framework": "pytorch", "container": "zip", "param_count": "32"}
    assert get("config.json") == {"architecture_type": "bert", "architecture": "BertModel"}
    card = get("README.md")
    assert card["license"] == "mit" and card["tags"] == "a, b" and card["language"] == "en, de" and card["description"].startswith("This card")
    assert get("instances_val.json") == {"num_images": "2", "num_annotations": "1", "class_names": '["cat"]', "has_boxes": "true", "has_masks": "false", "has_keypoints": "false"}
    assert not get("other.txt")


def test_long_coco_files_are_counted(tmp_path, monkeypatch):
    monkeypatch.setattr(headers, "COCO_PARSED", 10)
    path = tmp_path / "instances.json"
    path.write_text('{"image_id": 1}, {"file_name": 2}, ' * 400_000)
    assert {k: v for k, v, _, _ in headers.coco(str(path))} == {"num_annotations": 400_000, "num_images": 400_000}


def test_folder_classes(spark):
    paths = ["r/train/cat/1.jpg", "r/train/cat/2.JPG", "r/val/dog/1.png", "r/x.png", "r/train/cat/a.txt", "r/bird/1.png", "r/test/1.jpg"]
    rows = headers.folder_classes(spark.createDataFrame([("r", p) for p in paths], "root string, path string")).collect()
    assert {(r["split"], r["class_name"], r["n_images"]) for r in rows} == {("train", "cat", 2), ("val", "dog", 1), (None, "bird", 1)}
