"""Identity from paths: the cases of names, sources and components."""

import pytest

from shelfmark.operators.identity import identified, is_generic

U = "C:\\Users\\pc\\"
CASES = [
    (U + r"AppData\Local\Google\Chrome\User Data\screen_ai\1.0.3\model.tflite", "model", True, {"display_name": "Chrome ScreenAI OCR Model", "vendor": "Google", "product": "Chrome"}),
    (U + r"AppData\Local\Microsoft\Edge\User Data\OptimizationGuidePredictionModels\4\model.tflite", "model", True, {"display_name": "Edge Optimization Guide Model"}),
    (U + r".vscode\extensions\devsense.intelli-php-vscode-1.2\model.onnx", "model", True, {"display_name": "VS Code Completion"}),
    (U + r"AppData\Roaming\Zoom\bin\aomhost\virtual_background\model.onnx", "model", True, {"display_name": "Zoom Background Segmentation"}),
    (U + r"AppData\Local\Programs\cursor\resources\app\out\model.onnx", "model", True, {"display_name": "Cursor Model"}),
    (U + r".cache\huggingface\hub\models--Qwen--Qwen2.5-0.5B-Instruct", "Qwen/Qwen2.5-0.5B-Instruct", False, {"display_name": None, "vendor": "HuggingFace", "source": "huggingface"}),
    (U + r".ollama\models\manifests\registry.ollama.ai\library\qwen3\8b", "x", True, {"source": "ollama"}),
    (U + r".cache\torch\hub\checkpoints\resnet18.pth", "x", True, {"source": "pytorch_hub"}),
    (U + r".cache\whisper\large-v3-turbo.pt", "x", True, {"source": "whisper"}),
    (U + r"AppData\Local\datalab\datalab\Cache\models\layout\2025_02_18", "x", True, {"source": "surya"}),
    (r"F:\Downloads\yolo11n.pt", "x", True, {"source": "manual"}),
    (r"F:\scratch\thing.pt", "x", True, {"source": "unknown"}),
    (U + r"AppData\Roaming\Cursor\User\workspaceStorage\7cd\ms-vscode.js-debug\.profile\optimization_guide_model_store\24\A\B\model.tflite", "model", True, {"product": "Cursor", "display_name": "Cursor Optimization Guide Model"}),
    (U + r"AppData\Local\Microsoft\AugLoop\Word\2.1\CloudResources\ModelResources\en-us\model.onnx", "model", True, {"display_name": "Microsoft Text Prediction"}),
    (U + r".vscode\extensions\devsense.phptools-1.0\out\models\deeprerank\model.onnx", "model", True, {"display_name": "VS Code Reranker"}),
    (r"F:\scratch\model.onnx", "model", True, {"vendor": None}),
    (r"C:\Program Files\Google\model.tflite", "model", True, {"vendor": "Google", "component": None, "display_name": None}),
    ("/srv/zoom/bin/aomhost/frames_processor/model.onnx", "model", True, {"display_name": "Zoom Frames Processor Model"}),
    ("/data/catboost_info/test", "test", False, {"display_name": "Catboost Info Test"}),
    ("", "model", False, {"vendor": None, "source": "unknown", "display_name": None}),
    (None, None, None, {"vendor": None, "source": "unknown", "display_name": None}),
]


def test_identities(spark):
    frame = spark.createDataFrame([(i, p, n, s, "clash") for i, (p, n, s, _) in enumerate(CASES)], "asset_id long, path string, name string, single boolean, vendor string")
    rows = {r["asset_id"]: r.asDict() for r in identified(frame, single="single").collect()}
    assert len(rows) == len(CASES)
    for i, (path, _, _, wanted) in enumerate(CASES):
        assert {k: rows[i][k] for k in wanted} == wanted, path


@pytest.mark.parametrize(("names", "generic"), [(("model", "model_quantized", "model.fp16", "1.2.3", "deadbeef", "", "best", "en-us"), True), (("yolo11n", "resnet18-f37072fd", "Qwen2.5-0.5B-Instruct", "large-v3-turbo", "arabic_PP-OCRv4_rec_infer", "WordCombinedFloatieLreOnlineV3"), False)])
def test_generic_names(spark, names, generic):
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in frame.select(is_generic(frame["name"])).collect()] == [generic] * len(names)
