"""Health findings and statistics of assets, judged from what a scan recorded.

``file_summary`` reduces an asset's file list by conditional aggregates, so no
task holds the list itself; ``findings``, ``health`` and ``statistics`` are
projections over profiles: the summary beside the asset's details.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import built_once, strings
from shelfmark.operators.catalogue import PENALTIES
from shelfmark.operators.recognise import extension_count, extension_of, has_any, name_of
from shelfmark.operators.taxonomy import family

#: Extensions by what they hold. Fixed values.
IMAGE_FILES = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp", "avif", "ppm", "pgm", "jfif")
VIDEO_FILES = ("mp4", "avi", "mov", "mkv", "webm", "mpg", "mpeg", "m4v", "wmv", "flv", "ts")
AUDIO_FILES = ("wav", "mp3", "flac", "ogg", "opus", "m4a", "aac", "wma", "aiff", "au")
LABEL_FILES = ("json", "xml", "txt", "csv", "yaml", "yml", "pkl")
CHECKPOINT_FILES = ("pt", "pth", "ckpt", "safetensors")

#: Weight extensions with the format that each is reported as. Fixed values.
WEIGHT_FORMATS = {
    "safetensors": "safetensors", "gguf": "gguf", "bin": "pytorch", "pt": "pytorch", "pth": "pytorch", "onnx": "onnx", "engine": "tensorrt", "plan": "tensorrt",
    "tflite": "tflite", "mlmodel": "coreml", "npz": "numpy", "ckpt": "checkpoint", "h5": "keras", "keras": "keras", "pdparams": "paddle",
}

#: Names and name beginnings that rules ask for. Fixed values.
TOKENIZERS = ("tokenizer.json", "tokenizer_config.json", "tokenizer.model", "vocab.json", "vocab.txt", "spiece.model", "merges.txt", "sentencepiece.bpe.model", "preprocessor_config.json")
CONFIGS = ("config.json", "adapter_config.json", "model_index.json")
READMES = ("readme", "read_me", "dataset_card", "datasetcard", "model_card", "modelcard", "index.md")
LICENCES = ("license", "licence", "copying", "notice")
UNFINISHED = (".incomplete", ".part", ".partial", ".download", ".tmp", ".crdownload", ".aria2")
TRUTHS = ("label", "ground_truth", "groundtruth", "annotation")
EVALUATIONS = ("results.json", "eval_results.json", "metrics.json", "predictions.json", "confusion_matrix.png", "all_results.json", "test_results.json", "evaluation.json")

#: Splits by the folder names that stand for them. Fixed values.
SPLITS = {
    "train": "train", "training": "train", "trainval": "train", "train2017": "train", "train2014": "train", "val": "val", "valid": "val", "validation": "val", "val2017": "val",
    "val2014": "val", "dev": "val", "test": "test", "testing": "test", "test2017": "test", "eval": "test", "unlabeled": "unlabeled", "unlabelled": "unlabeled", "raw": "unlabeled",
}

#: Tools that track runs: name, beginnings of file names, folders; the first that fits counts. Fixed values.
TRACKERS = (
    ("TensorBoard", ("events.out.tfevents",), ()),
    ("Weights & Biases", ("wandb-summary.json", "wandb-metadata.json"), ("wandb",)),
    ("MLflow", ("mlmodel", "meta.yaml"), ("mlruns", "artifacts")),
    ("Ultralytics", ("results.csv", "args.yaml"), ("weights",)),
    ("Lightning", ("hparams.yaml",), ("lightning_logs", "checkpoints")),
    ("Hydra", ("hydra.yaml", "overrides.yaml"), (".hydra",)),
    ("DVC", ("dvc.lock", "dvc.yaml"), (".dvc",)),
    ("Aim", ("run_metadata.db",), (".aim",)),
)

#: Tools that label: name, file names, folders; the first that fits counts. Fixed values.
LABELLERS = (
    ("CVAT", ("annotations.xml", "task.json", "index.json"), ("task_", ".cvat")),
    ("Label Studio", ("label_config.xml", "tasks.json", "project.json"), ("label-studio",)),
    ("Roboflow", ("readme.roboflow.txt", "readme.dataset.txt"), ()),
    ("Supervisely", ("meta.json", "key_id_map.json"), ("ann", "img")),
    ("FiftyOne", ("samples.json", "fiftyone.yml"), ("fiftyone",)),
    ("VoTT", (".vott",), ()),
    ("makesense.ai", ("labels_my-project-name.zip",), ()),
    ("Doccano", ("doccano.jsonl",), ()),
)

#: Driving families that come with point clouds, and what shows these and calibration. Fixed values.
LIDAR_FAMILIES = ("KITTI", "Waymo", "nuScenes", "Argoverse", "Lyft L5", "ONCE")
LIDAR_FOLDERS = ("velodyne", "lidar", "lidar_top", "points", "pointcloud", "velodyne_points", "lidar_points", "samples")
CALIBRATIONS = ("calib", "calibration", "calibs", "calib_cam_to_cam.txt", "calibrated_sensor.json")

#: How samples are stored: label, and a file name or an extension (with its dot) that shows it, in order. Fixed values.
STORES = (
    ("lmdb", "data.mdb"), ("tfrecord", ".tfrecord"), ("hdf5", ".h5"), ("parquet", ".parquet"), ("arrow", ".arrow"), ("sqlite", ".sqlite"), ("jsonl", ".jsonl"), ("csv", ".csv"), ("tsv", ".tsv"),
)

#: Layouts of security data, and the extensions counted for them. Fixed values.
SECURITY_FORMATS = ("network_capture", "network_flow", "intrusion_detection", "host_log", "malware", "threat_intel", "ctf")
SECURITY_COUNTS = {"captures": ("pcap", "pcapng", "cap", "erf"), "flow_files": ("binetflow", "netflow", "argus", "ipfix"), "event_logs": ("evtx", "etl"), "tables": ("csv", "tsv", "parquet"), "logs": ("log", "jsonl")}

#: Kinds of models and frameworks that need a tokenizer or a config beside the weights. Fixed values.
TEXT_MODELS = ("llm", "vision_language", "ocr", "embedding", "reranker", "multimodal")
REPOSITORIES = ("transformers", "sentence_transformers", "peft")

KNOWN_NAMES = tuple(sorted({*TOKENIZERS, *CONFIGS, *EVALUATIONS, "data.yaml", "dataset.yaml", "annotations.json", "dataset_info.json", "dataset_infos.json", "state.json", "data.mdb", *(n for _, names, _ in LABELLERS for n in names)}))
KNOWN_STEMS = tuple(sorted({*READMES, *LICENCES, *TRUTHS, "calib", *(n for _, stems, _ in TRACKERS for n in stems)}))
KNOWN_FOLDERS = tuple(sorted({*SPLITS, *LIDAR_FOLDERS, *CALIBRATIONS, *(d for _, _, folders in TRACKERS for d in folders), *(d for _, _, folders in LABELLERS for d in folders)}))

#: What a profile may hold; missing columns count as null, empty, or for ``files_loaded`` as true.
PROFILE = {
    "kind": "string", "subkind": "string", "name": "string", "haystack": "string", "framework": "string", "format": "string", "is_missing": "boolean", "files_loaded": "boolean",
    "size_bytes": "bigint", "physical_size_bytes": "bigint", "file_count": "bigint", "has_model": "boolean", "has_dataset": "boolean",
    "model_type": "string", "param_count": "bigint", "param_count_is_exact": "boolean", "quantization": "string", "context_length": "bigint", "hidden_size": "bigint", "num_layers": "bigint", "vocab_size": "bigint", "tensor_count": "bigint",
    "repo_id": "string", "revision": "string", "author": "string", "license": "string", "base_model": "string", "pipeline_tag": "string", "precision": "string",
    "lora_rank": "string", "lora_alpha": "string", "lora_dropout": "string", "target_modules": "string", "adapter_type": "string",
    "dataset_format": "string", "num_images": "bigint", "num_videos": "bigint", "num_audio_files": "bigint", "num_annotations": "bigint", "num_text_files": "bigint", "num_classes": "bigint",
    "class_names": "array<string>", "splits": "map<string,bigint>", "modalities": "array<string>", "has_lidar": "boolean", "known_dataset": "string",
    "archive_format": "string", "members_listed": "bigint", "archive_label": "string", "images_listed": "bigint", "shards_listed": "bigint", "tables_listed": "bigint", "listing_truncated": "boolean", "metadata_read": "string", "listing_error": "string",
    "names": "array<string>", "stems": "array<string>", "dirs": "array<string>", "by_extension": "map<string,bigint>", "bytes_by_extension": "map<string,bigint>",
    "shards_expected": "bigint", "shards_present": "bigint", "label_files": "bigint", "event_files": "bigint", "unfinished": "bigint", "first_unfinished": "string", "webdataset": "boolean", "version_folder": "string",
}


def _strings(values) -> Column:
    return strings(values)


def file_summary(files: DataFrame, key: str = "asset_id") -> DataFrame:
    """One row for each asset of files(key, relpath, size_bytes): what the rules ask of its file list.

    names, stems and dirs hold only what rules know, so no asset's row grows
    with its files; a first aggregate by extension is combined before the
    shuffle.
    """
    path = F.lower("relpath")
    parts, base = F.split(path, "/"), name_of(path)
    any_end = lambda c, ends: reduce(Column.__or__, [c.endswith(e) for e in ends])
    shard = F.regexp_extract(base, r"-(\d{5})-of-(\d{5})\.(safetensors|bin|gguf)$", 2)
    marked = (path.contains("label") | path.contains("annotation") | path.contains("/gt")) & any_end(path, [f".{e}" for e in LABEL_FILES])
    number = lambda c: F.sum(c.cast("bigint"))
    by_ext = files.groupBy(key, extension_of(path).alias("ext")).agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("b"), F.collect_set(F.when(base.isin(*KNOWN_NAMES), base)).alias("names"),
        F.collect_set(F.filter(_strings(KNOWN_STEMS), lambda s: F.startswith(base, s))).alias("stems"), F.collect_set(F.array_intersect(F.slice(parts, 1, F.size(parts) - 1), _strings(KNOWN_FOLDERS))).alias("dirs"),
        F.max(F.nullif(shard, F.lit("")).cast("bigint")).alias("shards_expected"), number(shard != "").alias("shards_present"), number(marked).alias("label_files"), number(path.rlike(r"events\.out\.tfevents")).alias("event_files"),
        number(any_end(base, UNFINISHED)).alias("unfinished"), F.min(F.when(any_end(base, UNFINISHED), base)).alias("first_unfinished"), F.max(path.rlike(r"[-_]\d{3,}\.tar$")).alias("webdataset"),
        F.min(F.when(parts[0].rlike(r"^v\d"), parts[0])).alias("version_folder"),
    )
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    entries = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("ext") != "", F.struct("ext", v)))))
    return by_ext.groupBy(key).agg(
        F.sum("n").alias("file_count"), F.sum("b").alias("size_bytes"), together("names").alias("names"), together(F.flatten("stems")).alias("stems"), together(F.flatten("dirs")).alias("dirs"),
        entries("n").alias("by_extension"), entries("b").alias("bytes_by_extension"), F.coalesce(F.max("shards_expected"), F.lit(0)).alias("shards_expected"), F.sum("shards_present").alias("shards_present"),
        F.sum("label_files").alias("label_files"), F.sum("event_files").alias("event_files"), F.sum("unfinished").alias("unfinished"), F.min("first_unfinished").alias("first_unfinished"), F.max("webdataset").alias("webdataset"),
        F.min("version_folder").alias("version_folder"),
    )


def prepared(profiles: DataFrame, key: str = "asset_id") -> DataFrame:
    """profiles with every column of PROFILE, typed, and f_driving, the driving family."""
    there = set(profiles.columns)
    wanted = []
    for column, kind in PROFILE.items():
        value = F.col(column).cast(kind) if column in there else F.lit(None).cast(kind)
        if kind.startswith("array"):
            value = F.coalesce(value, F.array().cast(kind))
        elif kind.startswith("map"):
            value = F.coalesce(value, F.create_map().cast(kind))
        elif kind == "boolean":
            value = F.coalesce(value, F.lit(column == "files_loaded"))
        wanted.append(value.alias(column))
    rows = profiles.select(F.col(key), *wanted).withColumn("haystack", F.lower(F.concat_ws(" ", "name", "haystack")))
    return rows.withColumn("f_driving", family("driving"))


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def is_dataset() -> Column:
    return F.col("has_dataset") | _is("kind", "dataset")


def is_model() -> Column:
    return (F.col("has_model") | _is("kind", "model", "adapter", "checkpoint")) & ~is_dataset()


def counted(declared: str, kinds: tuple[str, ...]) -> Column:
    """The declared number where there is one, else the number of files of such extensions."""
    return F.coalesce(F.nullif(F.col(declared), F.lit(0)), extension_count(kinds))


def splits_present() -> Column:
    """Canonical names of the splits that folders or the declared counts show, sorted."""
    canon = F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])
    seen = F.concat(F.col("dirs"), F.transform(F.map_keys("splits"), lambda s: F.lower(F.trim(s))))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(seen, lambda s: F.try_element_at(canon, s)))))


def tool_of(tools, by: str) -> Column:
    """The first tool one of whose names (in column ``by``) or folders is there; else null."""
    found = F.lit(None).cast("string")
    for label, names, folders in reversed(tools):
        holds = has_any(F.col(by), *names)
        if folders:
            holds = holds | has_any(F.col("dirs"), *folders)
        found = F.when(holds, F.lit(label)).otherwise(found)
    return found


@dataclass
class HealthRule:
    """A finding: its code, severity, the condition, and what to tell."""

    code: str
    severity: str
    holds: Column
    message: Column | str


@built_once
def rules() -> list[HealthRule]:
    """The standard rules over ``prepared`` profiles. Callers may add their own."""
    data, model, loaded, kind = is_dataset(), is_model(), F.col("files_loaded"), F.col("kind")
    text = lambda c: c.cast("string")
    names, stems, dirs = F.col("names"), F.col("stems"), F.col("dirs")
    weights, saved = extension_count(tuple(WEIGHT_FORMATS)), extension_count((*CHECKPOINT_FILES, "bin"))
    images, splits = counted("num_images", IMAGE_FILES), splits_present()
    named = F.coalesce(F.col("format") != "unknown", F.lit(False))
    adapter = _is("kind", "adapter") | _is("model_type", "lora")
    labelled = (F.coalesce("num_annotations", F.lit(0)) > 0) | (F.coalesce("num_classes", F.lit(0)) > 0)
    lidar = _is("f_driving", *LIDAR_FAMILIES)
    labeller, tracker = tool_of(LABELLERS, "names"), tool_of(TRACKERS, "stems")
    lacks = lambda split: data & loaded & (F.size(splits) > 0) & ~F.array_contains(splits, split)
    marks, shards, there = F.coalesce("num_annotations", F.lit(0)), F.col("shards_expected"), F.col("shards_present")
    return [
        HealthRule("asset.missing", "error", F.col("is_missing"), "not at its place any more"),
        HealthRule("asset.empty", "error", F.coalesce("file_count", F.lit(0)) == 0, "has no files"),
        HealthRule("asset.zero_bytes", "error", (F.col("file_count") > 0) & (F.coalesce("size_bytes", F.lit(0)) == 0), F.concat(text(F.col("file_count")), F.lit(" files, all of them empty"))),
        HealthRule("asset.incomplete_download", "error", loaded & (F.col("unfinished") > 0), F.concat(text(F.col("unfinished")), F.lit(" unfinished downloads, such as "), F.col("first_unfinished"))),
        HealthRule("model.no_weights", "error", model & loaded & ~named & (weights == 0), "no weights, only what goes with them"),
        HealthRule("model.missing_shards", "error", model & loaded & (shards > 0) & (there < shards), F.concat(text(there), F.lit(" of "), text(shards), F.lit(" shards"))),
        HealthRule("model.no_tokenizer", "warning", model & loaded & F.col("has_model") & _is("framework", *REPOSITORIES) & _is("model_type", *TEXT_MODELS) & ~has_any(names, *TOKENIZERS), "no tokenizer"),
        HealthRule("model.no_config", "warning", model & loaded & _is("framework", *REPOSITORIES) & ~has_any(names, *CONFIGS), "no configuration"),
        HealthRule("adapter.no_base_model", "warning", adapter & F.coalesce(F.col("base_model") == "", F.lit(True)), "doesn't say which model it adapts"),
        HealthRule("dataset.no_readme", "info", data & loaded & ~has_any(stems, *READMES), "no description"),
        HealthRule("dataset.no_license", "info", data & loaded & ~has_any(stems, *LICENCES), "no licence"),
        HealthRule("dataset.no_train_split", "warning", lacks("train"), F.concat(F.lit("splits without train: "), F.array_join(splits, ", "))),
        HealthRule("dataset.no_val_split", "warning", lacks("val"), "no validation split"),
        HealthRule("dataset.no_test_split", "info", lacks("test"), "no test split"),
        HealthRule("dataset.no_annotations", "warning", data & loaded & (images >= 1) & ~labelled & (F.coalesce("label_files", F.lit(0)) == 0) & ~has_any(names, "data.yaml", "dataset.yaml", "annotations.json"), F.concat(text(images), F.lit(" images and no labels"))),
        HealthRule("annotation.incomplete", "info", loaded & labeller.isNotNull() & (images > 0) & (marks > 0) & (marks < images * 0.9), F.concat(text(images - marks), F.lit(" of "), text(images), F.lit(" images without labels"))),
        HealthRule("driving.no_lidar", "warning", data & loaded & lidar & ~F.col("has_lidar") & ~has_any(dirs, *LIDAR_FOLDERS) & (extension_count(("pcd", "ply", "las")) == 0), F.concat(F.col("f_driving"), F.lit(" without point clouds"))),
        HealthRule("driving.no_calibration", "warning", data & loaded & lidar & ~has_any(dirs, *CALIBRATIONS) & ~has_any(stems, "calib"), "no calibration of the sensors"),
        HealthRule("security.no_labels", "info", data & loaded & _is("dataset_format", "network_capture", "network_flow") & ~has_any(stems, *TRUTHS) & (extension_count(("csv", "tsv")) == 0), "captures without labels"),
        HealthRule("experiment.no_checkpoint", "info", loaded & tracker.isNotNull() & (saved == 0), "a run's records without a checkpoint"),
        HealthRule("archive.not_listed", "warning", F.coalesce(kind == "archive", F.lit(False)) & F.coalesce(F.col("listing_error") != "", F.lit(False)), F.concat(F.lit("its members couldn't be listed: "), F.col("listing_error"))),
    ]


def findings(profiles: DataFrame, key: str = "asset_id", own: list[HealthRule] | None = None) -> DataFrame:
    """(key, code, severity, message) of each rule that holds, each code once an asset; nulls never hold."""
    found, seen = [], {}
    for r in [*rules(), *(own or [])]:
        before = seen.get(r.code, F.lit(False))
        message = r.message if isinstance(r.message, Column) else F.lit(r.message)
        holds = F.coalesce(r.holds, F.lit(False))
        found.append(F.when(holds & ~before, F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), message.alias("message"))))
        seen[r.code] = before | holds
    return prepared(profiles, key).select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


def health(profiles: DataFrame, key: str = "asset_id", own: list[HealthRule] | None = None) -> DataFrame:
    """(key, score, status): 100 less the penalties of distinct codes, 0 at least; unknown where the files weren't loaded."""
    by_code: dict[str, tuple[str, Column]] = {}
    for r in [*rules(), *(own or [])]:
        holds = F.coalesce(r.holds, F.lit(False))
        severity, before = by_code.get(r.code, (r.severity, F.lit(False)))
        by_code[r.code] = severity, before | holds
    cost = sum((F.when(holds, PENALTIES[s]).otherwise(0) for s, holds in by_code.values()), F.lit(0))
    any_ = lambda s: reduce(Column.__or__, [h for t, h in by_code.values() if t == s], F.lit(False))
    status = F.when(~F.col("files_loaded"), "unknown").when(any_("error"), "error").when(any_("warning"), "warning").otherwise("ok")
    return prepared(profiles, key).select(key, F.greatest(F.lit(0), 100 - cost).alias("score"), status.alias("status"))


def _pairs(map_: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(map_)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def _positive(c: Column) -> Column:
    return F.when(c > 0, c.cast("string"))


@built_once
def providers() -> list[tuple[str, dict[str, Column]]]:
    """(provider, its statistics as text columns; null: none) over ``prepared`` profiles; later ones override equal keys."""
    data, model, loaded = is_dataset(), is_model() & F.col("has_model"), F.col("files_loaded")
    col = lambda name: F.nullif(F.col(name).cast("string"), F.lit(""))
    many = F.array_sort(F.map_entries("by_extension"), lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1)).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    top = F.array_join(F.transform(F.slice(many, 1, 5), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    formats = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(extension_count((e,)) > 0, F.lit(f)) for e, f in WEIGHT_FORMATS.items()])))), ",")
    images, pictures = counted("num_images", IMAGE_FILES), extension_count(IMAGE_FILES)
    picture_bytes = sum((F.coalesce(F.try_element_at("bytes_by_extension", F.lit(e)), F.lit(0)) for e in IMAGE_FILES), F.lit(0))
    saved_bytes = sum((F.coalesce(F.try_element_at("bytes_by_extension", F.lit(e)), F.lit(0)) for e in CHECKPOINT_FILES), F.lit(0))
    store = F.when(pictures > 0, F.lit("imagefolder"))
    for label, shown in reversed(STORES):
        store = F.when(extension_count((shown[1:],)) > 0 if shown.startswith(".") else has_any(F.col("names"), shown), F.lit(label)).otherwise(store)
    store = F.when(F.col("webdataset"), "webdataset").when(has_any(F.col("names"), "dataset_info.json", "dataset_infos.json", "state.json"), "hf_dataset").otherwise(store)
    splits = splits_present()
    labeller, tracker = tool_of(LABELLERS, "names"), tool_of(TRACKERS, "stems")
    ran = loaded & (tracker.isNotNull() | has_any(F.col("names"), *EVALUATIONS))
    saved, archive = extension_count(CHECKPOINT_FILES), F.coalesce(F.col("kind") == "archive", F.lit(False))
    adapts = (_is("kind", "adapter") | _is("model_type", "lora")) & F.col("has_model")
    secure = data & loaded & _is("dataset_format", *SECURITY_FORMATS)
    only = lambda holds, stats: {k: F.when(holds, v) for k, v in stats.items()}
    flag = lambda c: F.when(c, F.lit("true")).otherwise(F.lit("false"))
    return [
        ("storage", {
            "files": F.coalesce("file_count", F.lit(0)).cast("string"), "size_bytes": F.coalesce("size_bytes", F.lit(0)).cast("string"),
            "on_disk_bytes": F.when((F.col("physical_size_bytes") > 0) & (F.col("physical_size_bytes") != F.col("size_bytes")), F.col("physical_size_bytes").cast("string")), "top_extensions": F.when(loaded & (F.size(F.map_keys("by_extension")) > 0), top),
        }),
        ("model", only(model, {
            "parameters": _positive(F.col("param_count")), "quantization": col("quantization"), "context_length": _positive(F.col("context_length")), "hidden_size": _positive(F.col("hidden_size")), "layers": _positive(F.col("num_layers")),
            "vocab_size": _positive(F.col("vocab_size")), "tensors": _positive(F.col("tensor_count")), "repo_id": col("repo_id"), "revision": col("revision"), "author": col("author"), "license": col("license"), "base_model": col("base_model"), "pipeline_tag": col("pipeline_tag"),
            "parameters_exact": F.when(F.col("param_count") > 0, flag(F.col("param_count_is_exact"))), "precision": F.when(F.col("precision") != "unknown", col("precision")), "tokenizer": F.when(loaded, flag(has_any(F.col("names"), *TOKENIZERS))),
            "weight_formats": F.when(loaded, F.nullif(formats, F.lit(""))), "shards": F.when(loaded & (F.col("shards_expected") > 0), F.concat(F.col("shards_present").cast("string"), F.lit("/"), F.col("shards_expected").cast("string"))),
        })),
        ("dataset", only(data, {
            "images": _positive(images), "videos": _positive(counted("num_videos", VIDEO_FILES)), "audio_files": _positive(counted("num_audio_files", AUDIO_FILES)), "annotations": _positive(F.col("num_annotations")), "text_files": _positive(F.col("num_text_files")),
            "classes": _positive(F.col("num_classes")), "class_names": F.when(F.size("class_names") > 0, F.array_join(F.slice("class_names", 1, 32), ",")), "split_counts": F.when(F.size(F.map_keys("splits")) > 0, _pairs(F.col("splits"))),
            "modalities": F.when(F.size("modalities") > 0, F.array_join("modalities", ",")), "splits": F.when(F.size(splits) > 0, F.array_join(splits, ",")), "has_readme": F.when(loaded, flag(has_any(F.col("stems"), *READMES))), "has_license": F.when(loaded, flag(has_any(F.col("stems"), *LICENCES))),
            "storage_format": F.when(loaded, store), "annotation_files": F.when(loaded, _positive(F.col("label_files"))), "avg_image_bytes": F.when(loaded & (pictures > 0), F.floor(picture_bytes / F.greatest(pictures, F.lit(1))).cast("string")),
            "version": F.concat(F.lit("v"), F.nullif(F.regexp_extract(F.coalesce("version_folder", F.lit("")), r"^v(\d+(?:\.\d+)*)", 1), F.lit(""))),
        })),
        ("adapter", only(adapts, {"base_model": col("base_model"), "r": col("lora_rank"), "lora_alpha": col("lora_alpha"), "lora_dropout": col("lora_dropout"), "target_modules": col("target_modules"), "peft_type": col("adapter_type")})),
        ("annotation", only(loaded & labeller.isNotNull(), {"annotation_tool": labeller, "images": _positive(images)})),
        ("experiment", only(ran, {"tracker": tracker, "checkpoints": _positive(saved), "checkpoint_bytes": F.when(saved > 0, saved_bytes.cast("string")), "event_files": _positive(F.col("event_files"))})),
        ("security", only(secure, {k: _positive(extension_count(kinds)) for k, kinds in SECURITY_COUNTS.items()} | {"public_dataset": col("known_dataset")})),
        ("archive", only(archive, {
            "extracted": F.lit("false"), "archive_format": col("archive_format"), "members_listed": _positive(F.col("members_listed")), "archive_kind": col("archive_label"), "images_listed": _positive(F.col("images_listed")),
            "shards_listed": _positive(F.col("shards_listed")), "tables_listed": _positive(F.col("tables_listed")), "listing_truncated": F.when(F.col("listing_truncated"), F.lit("true")), "metadata_read_in_memory": col("metadata_read"),
        })),
    ]


def statistics(profiles: DataFrame, key: str = "asset_id", own: list[tuple[str, dict[str, Column]]] | None = None) -> DataFrame:
    """(key, statistics): a map of all providers' entries; of equal keys the last provider's value that isn't null counts."""
    values: dict[str, list[Column]] = {}
    for _, entries in [*providers(), *(own or [])]:
        for name, value in entries.items():
            values.setdefault(name, []).insert(0, value)
    found = [F.struct(F.lit(name).alias("key"), F.coalesce(*v).alias("value")) for name, v in values.items()]
    return prepared(profiles, key).select(key, F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull())).alias("statistics"))
