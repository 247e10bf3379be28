"""Places where tools keep models, datasets and runs: looked up in many homes at once."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.catalogue import surviving_claims

#: Tool, kind of place, environment variables that name it before all else, default places, and files one of which must lie there.
PLACES = (
    ("huggingface", "model cache", ("HF_HUB_CACHE", "HUGGINGFACE_HUB_CACHE", "TRANSFORMERS_CACHE", "HF_HOME"), ("{cache}/huggingface", "{home}/.huggingface"), ()),
    ("ollama", "model cache", ("OLLAMA_MODELS",), ("{home}/.ollama", "{localappdata}/Ollama"), ()),
    ("torch", "model cache", ("TORCH_HOME", "TORCH_HUB"), ("{cache}/torch", "{home}/.torch"), ()),
    ("llama_cpp", "model cache", ("LLAMA_CACHE",), ("{cache}/llama.cpp", "{home}/llama.cpp/models"), ()),
    ("lmstudio", "model cache", (), ("{home}/.lmstudio/models", "{cache}/lm-studio/models"), ()),
    ("koboldcpp", "model cache", (), ("{home}/koboldcpp/models", "{home}/.koboldcpp"), ()),
    ("vllm", "model cache", ("VLLM_CACHE_ROOT",), ("{cache}/vllm",), ()),
    ("modelscope", "model cache", ("MODELSCOPE_CACHE",), ("{cache}/modelscope",), ()),
    ("kaggle", "model cache", ("KAGGLEHUB_CACHE",), ("{cache}/kagglehub",), ()),
    ("ngc", "model cache", ("NGC_HOME",), ("{home}/.ngc", "{cache}/ngc"), ()),
    ("comfyui", "image generation", ("COMFYUI_PATH", "COMFYUI_MODEL_PATH"), ("{home}/ComfyUI/models", "{documents}/ComfyUI/models"), ()),
    ("automatic1111", "image generation", (), ("{home}/stable-diffusion-webui/models", "{documents}/stable-diffusion-webui/models"), ()),
    ("invokeai", "image generation", ("INVOKEAI_ROOT",), ("{home}/invokeai/models", "{home}/.invokeai/models"), ()),
    ("textgen", "text generation", (), ("{home}/text-generation-webui/models",), ()),
    ("ultralytics", "vision", ("YOLO_CONFIG_DIR",), ("{home}/.config/Ultralytics", "{appdata}/Ultralytics", "{home}/.ultralytics"), ()),
    ("mmdetection", "vision", ("MMENGINE_HOME",), ("{cache}/mim", "{home}/.mim", "{cache}/openmim"), ()),
    ("detectron2", "vision", ("FVCORE_CACHE", "DETECTRON2_DATASETS"), ("{cache}/iopath_cache", "{home}/.torch/iopath_cache"), ()),
    ("opencv", "vision", (), ("{cache}/opencv", "{home}/.opencv"), ()),
    ("insightface", "vision", (), ("{home}/.insightface",), ()),
    ("rembg", "vision", (), ("{home}/.u2net",), ()),
    ("paddleocr", "ocr", (), ("{home}/.paddleocr", "{home}/.paddlex"), ()),
    ("easyocr", "ocr", ("EASYOCR_MODULE_PATH",), ("{home}/.EasyOCR",), ()),
    ("tesseract", "ocr", ("TESSDATA_PREFIX",), ("{home}/tessdata",), ("eng.traineddata",)),
    ("surya", "ocr", (), ("{cache}/datalab",), ()),
    ("whisper", "speech", ("WHISPER_CACHE",), ("{cache}/whisper",), ()),
    ("piper", "speech", (), ("{home}/.local/share/piper", "{appdata}/piper"), ()),
    ("tfhub", "model cache", ("TFHUB_CACHE_DIR",), ("{cache}/tfhub_modules",), ()),
    ("keras", "model cache", ("KERAS_HOME",), ("{home}/.keras",), ()),
    ("onnx", "model cache", (), ("{cache}/onnx", "{home}/.onnx"), ()),
    ("fiftyone", "datasets", ("FIFTYONE_DATABASE_DIR", "FIFTYONE_DEFAULT_DATASET_DIR"), ("{home}/fiftyone",), ()),
    ("cvat", "datasets", (), ("{documents}/cvat", "{home}/cvat-exports", "{downloads}/cvat"), ()),
    ("label_studio", "datasets", ("LABEL_STUDIO_DATA_DIR", "LABEL_STUDIO_BASE_DATA_DIR"), ("{home}/.local/share/label-studio", "{localappdata}/label-studio"), ()),
    ("roboflow", "datasets", (), ("{cache}/roboflow", "{downloads}/roboflow"), ()),
    ("wandb", "experiments", ("WANDB_DIR", "WANDB_CACHE_DIR"), ("{cache}/wandb", "{home}/wandb"), ()),
    ("mlflow", "experiments", (), ("{home}/mlruns", "{documents}/mlruns"), ()),
    ("tensorboard", "experiments", (), ("{home}/runs", "{home}/tb_logs", "{documents}/runs"), ()),
)

#: Folders of a home by the names that places use. Fixed values.
FOLDERS = {"home": "", "cache": "/.cache", "documents": "/Documents", "downloads": "/Downloads", "appdata": "/AppData/Roaming", "localappdata": "/AppData/Local"}


def wanted(spark: SparkSession, homes: list[str], environ: dict[str, str] | None = None) -> DataFrame:
    """(tool, group, path, marker) of every place in every home; what the environment names stands once, in no home."""
    rows = []
    for tool, group, variables, defaults, markers in PLACES:
        named = [environ[v] for v in variables if environ and environ.get(v)]
        paths = named + [d.format(**{k: h.rstrip("/") + f for k, f in FOLDERS.items()}) for h in homes for d in defaults]
        rows += [(tool, group, p.rstrip("/"), "/".join(markers) or None) for p in dict.fromkeys(paths)]
    return spark.createDataFrame(rows, "tool string, group string, path string, marker string")


def known_locations(spark: SparkSession, homes: list[str], environ: dict[str, str] | None = None) -> DataFrame:
    """(tool, group, path) of the places that are there, looked up on the executors; one inside another is the outer one's.

    Homes must be visible to all executors. A link counts as where it leads;
    a place that can't be looked into doesn't count.
    """

    def there(batches):
        for batch in batches:
            found = []
            for path, marker in zip(batch["path"], batch["marker"], strict=True):
                try:
                    found.append(os.path.realpath(path) if os.path.isdir(path) and (marker is None or any(os.path.exists(os.path.join(path, m)) for m in marker.split("/"))) else None)
                except OSError:
                    found.append(None)
            yield pd.DataFrame({"tool": batch["tool"], "group": batch["group"], "path": found}).dropna(subset=["path"])

    found = wanted(spark, homes, environ).repartition(8).mapInPandas(there, "tool string, group string, path string")
    once = found.groupBy("path").agg(F.min(F.struct("tool", "group")).alias("t")).select("path", "t.tool", "t.group")
    return surviving_claims(once.withColumn("claims", F.lit(True))).select("tool", "group", "path")
