"""Rules over directory profiles, names and listings: detection, scoring, identity, archives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import built_once, dealt, strings
from shelfmark.sources.places import kept

WEIGHTS = ("safetensors", "gguf", "pt", "pth", "ckpt", "bin", "onnx", "h5", "tflite")
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
#: Images of a folder that counts as a class. Fixed value.
CLASS_IMAGES = 10
TABLES = ("csv", "tsv", "parquet", "arrow", "jsonl")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"\.([^./]+)$", 1))


#: Folders that detectors ask for by name, in lower case.
ASKED_FOLDERS = (
    "manifests", "blobs", "train", "val", "valid", "test", "labels", "annotations", "masks", "gt", "ground_truth", "captions", "transcripts", "metadata", "configs", "config", "weights", "checkpoints", "notebooks", "experiments", "runs",
    "datasets", "dataset", "recipes", "scripts", "training", "evals", ".git", "metrics", "params", "artifacts", "tags", "ann", "img", "bdd100k", "images", "imagesets", "jpegimages", "leftimg8bit", "velodyne", "image_2", "image_3", "label_2",
    "calib", "oxts", "samples", "sweeps",
)


def directory_profiles(files: DataFrame, folders: tuple[str, ...] | None = None) -> DataFrame:
    """(dir, names, dirs, n_files, bytes, by_extension, classes, classes_in_splits) of each folder, from files(path, size_bytes).

    Names, folders and n_files are of what lies directly in it, bytes and
    by_extension of the whole subtree; classes are folders of CLASS_IMAGES
    images or more right below it, or below a folder of a split. With
    ``folders`` dirs keeps only these, so that a folder of millions of folders
    needs no row that holds all their names.

    Files are dealt once, to their own folders; what they add to the folders
    above is summed up before it is shuffled.
    """
    rows = files.where(F.contains("path", F.lit("/"))).select("path", F.lower(F.substring_index("path", "/", -1)).alias("name"), "size_bytes")
    folder = F.expr("left(path, length(path) - length(substring_index(path, '/', -1)) - 1)")
    rows = rows.select(folder.alias("dir"), "name", F.when(F.contains("name", F.lit(".")), F.substring_index("name", ".", -1)).otherwise("").alias("ext"), "size_bytes")
    sums = lambda frame: frame.groupBy("dir", "ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    merged = lambda frame, *more: frame.groupBy("dir").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("by_extension"), F.sum("b").alias("bytes"), *more)
    own = rows.repartition("dir").groupBy("dir", "ext").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"), F.collect_set("name").alias("names"))
    own = merged(own, F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.sum("n").alias("n_files"))
    nested = rows.withColumn("parts", F.split("dir", "/")).where("size(parts) > 1").withColumn("i", F.explode(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1)))))
    nested = nested.select(F.expr("substring_index(dir, '/', i)").alias("dir"), F.lower(F.element_at("parts", F.col("i") + 1)).alias("sub"), "ext", "size_bytes")
    above = merged(sums(nested)).select(F.col("dir").alias("above"), F.col("by_extension").alias("further"), F.col("bytes").alias("further_bytes"))
    held = nested.where("dir <> ''").select("dir", "sub")
    held = held.where(F.col("sub").isin(*folders)) if folders is not None else held
    children = held.distinct().groupBy("dir").agg(F.array_sort(F.collect_set("sub")).alias("dirs"))
    full = rows.where(F.col("ext").isin(*IMAGES)).groupBy("dir").count().where(f"count >= {CLASS_IMAGES}").select(F.split("dir", "/").alias("parts")).where("size(parts) > 1")
    up = F.lower(F.element_at("parts", -2)).isin("train", "val", "valid", "test")
    over = lambda n: F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - n, F.lit(0))), "/")
    holders = full.select(F.when(up, over(2)).otherwise(over(1)).alias("dir"), F.element_at("parts", -1).alias("c"), F.when(up, F.lower(F.element_at("parts", -2))).alias("s"))
    classes = holders.groupBy("dir").agg(F.count_distinct("c").alias("classes"), F.max(F.col("s").isNotNull()).alias("classes_in_splits"))
    empty, none = F.array().cast("array<string>"), F.lit(0).cast("bigint")
    both = F.map_zip_with("by_extension", "further", lambda _, x, y: F.coalesce(x, none) + F.coalesce(y, none))
    size = F.when(F.col("bytes").isNull() | F.col("further_bytes").isNull(), F.coalesce("bytes", "further_bytes")).otherwise(F.col("bytes") + F.col("further_bytes"))
    deep = own.join(above, F.col("dir") == F.col("above"), "full").select(F.coalesce("dir", "above").alias("dir"), "names", "n_files", size.alias("bytes"), F.coalesce(both, "by_extension", "further").alias("by_extension"))
    return deep.join(children, "dir", "left").join(classes, "dir", "left").select("dir", F.coalesce("names", empty).alias("names"), F.coalesce("dirs", empty).alias("dirs"), F.coalesce("n_files", F.lit(0)).alias("n_files"), "bytes", "by_extension", F.coalesce("classes", F.lit(0)).alias("classes"), F.coalesce("classes_in_splits", F.lit(False)).alias("classes_in_splits"))


def has(names: Column, *wanted: str) -> Column:
    return reduce(Column.__and__, [F.array_contains(names, w) for w in wanted])


def has_any(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, strings(wanted))


def extension_count(kinds: tuple[str, ...]) -> Column:
    return F.aggregate(strings(kinds), F.lit(0).cast("bigint"), lambda n, k: n + F.coalesce(F.try_element_at("by_extension", k), F.lit(0)))


@built_once
def detectors() -> list[tuple[str, int, str, bool, Column]]:
    """(name, band, kind, claims, rule): the higher band wins a folder; claiming ones own their subtree."""
    names, dirs = F.col("names"), F.col("dirs")
    weights, images, tables = extension_count(WEIGHTS), extension_count(IMAGES), extension_count(TABLES)
    ends = lambda *suffixes: F.exists(names, lambda n: reduce(Column.__or__, [n.endswith(s) for s in suffixes]))
    split = F.size(F.array_intersect(dirs, strings(("train", "val", "valid", "test")))) >= 2
    own, every = F.lower(name_of(F.col("dir"))), F.aggregate(F.map_values("by_extension"), F.lit(0).cast("bigint"), lambda a, b: a + b)
    videos, clips, records = extension_count(("mp4", "avi", "mov", "mkv", "webm")), extension_count(("wav", "flac", "mp3", "ogg", "m4a")), extension_count(("jsonl", "parquet"))
    here = F.size(F.filter(names, lambda n: n.rlike(r"\.(" + "|".join(TABLES) + ")$")))
    # fixed values: folders of labels, scripts that are entry points, folders and files of projects
    assembled = split | has_any(dirs, "labels", "annotations", "masks", "gt", "ground_truth", "captions", "transcripts", "metadata")
    scripts = has_any(names, "train.py", "training.py", "finetune.py", "fine_tune.py", "pretrain.py", "infer.py", "inference.py", "predict.py", "evaluate.py", "eval.py", "export.py", "benchmark.py", "distill.py", "quantize.py", "serve.py", "train.sh", "train.ipynb", "main.py")
    folders = has_any(dirs, "configs", "config", "weights", "checkpoints", "notebooks", "experiments", "runs", "datasets", "dataset", "recipes", "scripts", "training", "evals")
    needs = has_any(names, "requirements.txt", "pyproject.toml", "environment.yml", "environment.yaml", "pipfile", "setup.py", "poetry.lock", "uv.lock", "conda.yaml")
    project = (needs | has(dirs, ".git")) & (scripts.cast("int") + folders.cast("int") + (weights > 0).cast("int") >= 2)
    return [
        ("ollama_store", 100, "model", False, has(dirs, "manifests", "blobs")),
        ("hf_cache", 90, "model", True, name_of(F.col("dir")).rlike(r"^(models|datasets)--")),
        ("diffusers", 80, "model", True, has(names, "model_index.json")),
        ("sentence_transformers", 80, "model", True, has(names, "modules.json") & (has(names, "config.json") | (weights > 0))),
        ("peft_adapter", 75, "adapter", True, has_any(names, "adapter_config.json", "adapter_model.safetensors", "adapter_model.bin")),
        ("hf_repo", 70, "model", True, has(names, "config.json") & (F.exists(names, lambda n: n.rlike(r"\.safetensors$|\.onnx$|^pytorch_model.*\.bin$|^model.*\.bin$|^tf_model.*\.h5$|^flax_model.*\.msgpack$|^model\.pdparams$")) | has_any(names, "tokenizer_config.json", "preprocessor_config.json"))),
        ("tensorboard", 65, "experiment", True, F.exists(names, lambda n: n.contains("tfevents"))),
        ("wandb", 65, "experiment", True, has(names, "wandb-metadata.json")),
        ("mlflow", 65, "experiment", True, has(names, "meta.yaml") & (F.size(F.array_intersect(dirs, strings(("metrics", "params", "artifacts", "tags")))) >= 2)),
        ("ultralytics_run", 65, "experiment", True, has(names, "args.yaml")),
        ("lightning", 65, "experiment", True, name_of(F.col("dir")).rlike(r"^version_\d+$") & has_any(names, "hparams.yaml", "metrics.csv")),
        ("cvat", 62, "annotation_project", True, has_any(names, "task.json", "project.json") & has_any(names, "annotations.json", "annotations.xml")),
        ("label_studio", 62, "annotation_project", True, has_any(names, "label_studio.sqlite3", "label_config.xml", "project_config.xml")),
        ("roboflow", 62, "dataset", True, has_any(names, "readme.roboflow.txt", "readme.dataset.txt")),
        ("supervisely", 62, "annotation_project", True, has(names, "meta.json") & has(dirs, "ann", "img")),
        ("bdd100k", 60, "dataset", True, has(dirs, "bdd100k") | ((images >= 20) & (own.contains("bdd100k") | (own.contains("bdd") & has(dirs, "images", "labels"))))),
        ("yolo_dataset", 60, "dataset", True, (has_any(names, "data.yaml", "data.yml", "dataset.yaml") & (extension_count(("txt",)) > 0)) | has(dirs, "images", "labels")),
        ("pascal_voc", 60, "dataset", True, F.size(F.array_intersect(dirs, strings(("annotations", "imagesets", "jpegimages")))) >= 2),
        ("cityscapes", 60, "dataset", True, has_any(dirs, "leftimg8bit")),
        ("kitti", 60, "dataset", True, F.size(F.array_intersect(dirs, strings(("velodyne", "image_2", "image_3", "label_2", "calib", "oxts")))) >= 2),
        ("nuscenes", 60, "dataset", True, has(dirs, "samples", "sweeps")),
        ("hf_dataset", 60, "dataset", True, ends(".parquet", ".arrow") & (has_any(names, "dataset_info.json", "dataset_infos.json", "state.json") | (F.size(F.filter(names, lambda n: n.endswith(".parquet") | n.endswith(".arrow"))) >= 2))),
        ("idx_ubyte", 60, "dataset", True, F.size(F.filter(names, lambda n: n.rlike(r"idx\d-ubyte"))) >= 2),
        ("ai_project", 55, "project", False, project),
        ("image_classification", 40, "dataset", True, (images >= 20) & ((F.col("classes") >= 3) | ((F.col("classes") >= 2) & F.col("classes_in_splits")))),
        ("media_collection", 40, "dataset", True, assembled & (((videos >= 10) & (videos >= 0.6 * every)) | ((clips >= 50) & (clips >= 0.6 * every)) | ((records >= 2) & (records >= 0.6 * every)) | ((images >= 200) & (images >= 0.6 * every)))),
        ("tabular_dataset", 40, "dataset", True, (here >= 2) & (F.col("bytes") >= 512 * 1024) & (here * 2 >= F.col("n_files"))),
        ("tensorflow_savedmodel", 35, "model", True, has_any(names, "saved_model.pb", "saved_model.pbtxt")),
        ("openvino", 35, "model", True, ends(".xml") & ends(".bin")),
        ("mlx", 35, "model", True, has(names, "mlx_config.json")),
        ("paddle_inference", 35, "model", True, has_any(names, "inference.pdmodel", "model.pdmodel", "inference.json") & has_any(names, "inference.pdiparams", "model.pdiparams")),
        ("loose_weights", 20, "model", False, ends(*[f".{w}" for w in WEIGHTS])),
        ("archive", 20, "archive", False, ends(".zip", ".tar", ".tar.gz", ".tgz", ".7z", ".rar")),
    ]


def mot_folders(profiles: DataFrame) -> DataFrame:
    """(path, band, detector, kind, claims) of folders with a child that holds seqinfo.ini."""
    parts = F.split("dir", "/")
    above = profiles.where(F.array_contains("names", "seqinfo.ini") & (F.size(parts) > 1)).select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("path")).distinct()
    return above.select("path", F.lit(60).alias("band"), F.lit("mot").alias("detector"), F.lit("dataset").alias("kind"), F.lit(True).alias("claims"))


def coco_folders(facts: DataFrame) -> DataFrame:
    """(path, band, detector, kind, claims) of the folders of annotation files whose header facts(path, key, value) count images; of those below ``annotations`` the folder above."""
    folder = F.regexp_replace("path", r"(/annotations)?/[^/]*$", "")
    return facts.where("key = 'num_images'").select(folder.alias("path")).distinct().select("path", F.lit(60).alias("band"), F.lit("coco").alias("detector"), F.lit("dataset").alias("kind"), F.lit(True).alias("claims"))


def detected(profiles: DataFrame, *further: DataFrame) -> DataFrame:
    """candidate_hits() without those below a claiming folder."""
    from shelfmark.operators.catalogue import surviving_claims

    # written once: the hits are read three times, and rules cost more than all else
    return surviving_claims(kept(candidate_hits(profiles, *further), "hits"))


def candidate_hits(profiles: DataFrame, *further: DataFrame) -> DataFrame:
    """(path, detector, kind, claims) of folders that a rule takes, the best band only.

    ``further`` hits (path, band, detector, kind, claims) compete by their bands; at equal ones a rule's hit stays.
    Where the profiles say so (may_claim, see ``boundary.guarded``), detectors
    that go by a pile of files leave a folder alone.
    """
    from shelfmark.operators.boundary import GENERIC

    allowed = F.col("may_claim") if "may_claim" in profiles.columns else F.lit(True)
    hit = [F.when(rule & allowed if name in GENERIC else rule, F.struct(F.lit(-band).alias("b"), F.lit(i).alias("seq"), F.lit(name).alias("detector"), F.lit(kind).alias("kind"), F.lit(claims).alias("claims"))) for i, (name, band, kind, claims, rule) in sorted(enumerate(detectors()), key=lambda d: -d[1][1])]
    # the first that holds; out of a generator, so that no filter on it works the rules out a second time
    hits = profiles.select(F.col("dir").alias("path"), F.explode(F.array(F.coalesce(*hit))).alias("hit")).where("hit is not null")
    for i, more in enumerate(further):
        hits = hits.unionByName(more.select("path", F.struct((-F.col("band")).alias("b"), F.lit(1000 + i).alias("seq"), "detector", "kind", "claims").alias("hit")))
    if further:
        hits = hits.groupBy("path").agg(F.min("hit").alias("hit"))
    return hits.select("path", "hit.detector", "hit.kind", "hit.claims")


#: Fixed values of directory scores: names and endings that speak for or against a folder, and the scores from which it is entered and reported.
SCORED_WEIGHTS = (
    ".safetensors", ".gguf", ".ggml", ".onnx", ".pt", ".pth", ".ckpt", ".bin", ".engine", ".plan", ".tflite", ".mlmodel", ".pdparams", ".pdmodel", ".h5", ".keras", ".npz", ".msgpack",
)
MANIFESTS = (
    "config.json", "tokenizer.json", "tokenizer_config.json", "generation_config.json", "adapter_config.json", "model_index.json", "modules.json", "preprocessor_config.json", "special_tokens_map.json", "model.safetensors.index.json",
    "data.yaml", "data.yml", "dataset.yaml", "dataset_info.json", "dataset_infos.json", "dataset_dict.json", "classes.txt", "labels.txt", "metadata.jsonl", "meta.yaml", "args.yaml", "hparams.yaml", "results.csv", "wandb-metadata.json",
)
SIGNAL_FOLDERS = (
    "snapshots", "blobs", "refs", "checkpoints", "weights", "annotations", "labels", "images", "wandb", "mlruns", "runs", "lightning_logs", "tensorboard", "configs", "notebooks", "adapters", "loras", "embeddings", "tokenizer",
)
SPLIT_FOLDERS = ("train", "val", "valid", "validation", "test", "testing", "training", "eval", "dev")
CODE_NAMES = ("requirements.txt", "pyproject.toml", "environment.yml", "environment.yaml", "train.py", "infer.py", "predict.py", "evaluate.py", "export.py", "finetune.py")
DISTRACTORS = (".exe", ".msi", ".iso", ".vhd", ".vhdx", ".vmdk", ".dll", ".sys", ".cab", ".mp4", ".mkv", ".avi", ".srt", ".pdf", ".epub", ".docx", ".pptx", ".zip", ".rar")
CONTAINERS = (
    "models", "model", "datasets", "dataset", "data", "ai", "ml", "llm", "llms", "checkpoints", "weights", "huggingface", "gguf", "loras", "embeddings", "training", "experiments", "runs", "cache", ".cache", "hub", "comfyui",
    "stable-diffusion", "projects", "project", "research", "work",
)
DESCEND, REPORT = 0.30, 0.80


def directory_score(name: Column, names: Column, dirs: Column) -> Column:
    """How promising a folder is for discovery, from its name and what lies directly in it (lower-cased): at least 0, three digits."""
    listed = strings
    known = lambda column, values: F.size(F.array_intersect(column, listed(values)))
    ending = lambda ends: F.size(F.filter(names, lambda n: reduce(Column.__or__, [n.endswith(e) for e in ends])))
    cached = lambda c: c.startswith("models--") | c.startswith("datasets--")
    own, manifests, code, odd = F.lower(name), known(names, MANIFESTS), known(names, CODE_NAMES), ending(DISTRACTORS)
    terms = [
        F.when(ending(SCORED_WEIGHTS) > 0, 1.0), F.when(manifests >= 2, 0.9).when(manifests == 1, 0.5), F.when(F.exists(names, lambda n: n.startswith("events.out.tfevents")), 1.0),
        F.when(F.exists(names, lambda n: n.contains("-idx") & n.contains("ubyte")), 1.0), F.when(F.exists(dirs, cached), 1.0), F.when(has(dirs, "manifests", "blobs"), 1.0),
        F.least(F.lit(0.6), 0.3 * known(dirs, SIGNAL_FOLDERS)), F.when(known(dirs, SPLIT_FOLDERS) >= 2, 0.6), F.when(ending((".ipynb",)) > 0, 0.3), F.when(code >= 2, 0.5).when(code == 1, 0.25),
        F.when(own.isin(*CONTAINERS), 0.4), F.when(cached(own), 1.0), F.when((odd > 0) & (odd >= F.greatest(F.lit(3), F.floor(F.size(names) / 2))), -0.8),
    ]
    return F.round(F.greatest(F.lit(0.0), sum((F.coalesce(t, F.lit(0.0)) for t in terms), F.lit(0.0))), 3)


def discovered(profiles: DataFrame, least: float = REPORT) -> DataFrame:
    """(dir, score) of folders worth reporting, without those below another one: all folders of directory profiles are scored at once, so no budget cuts the search short."""
    from shelfmark.operators.catalogue import surviving_claims

    scored = profiles.select("dir", directory_score(name_of(F.col("dir")), F.col("names"), F.col("dirs")).alias("score")).where(F.col("score") >= least)
    return surviving_claims(scored.select(F.col("dir").alias("path"), F.lit(True).alias("claims"), "score")).select(F.col("path").alias("dir"), "score")


#: Markers up to which a list of them travels to each row; more of them meet the texts by equality.
MANY_MARKERS = 10_000


def marker_of(texts: DataFrame, markers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label) of the first of markers(seq, marker, label) that the lower-cased text contains; null where none does.

    Up to MANY_MARKERS of them come as one array, in order. Beyond that the
    text's substrings of the markers' lengths meet the markers in a join, so
    any number of them works.
    """
    if markers.count() <= MANY_MARKERS:
        listed = markers.agg(F.array_sort(F.collect_list(F.struct("seq", "marker", "label"))).alias("m"))
        first = F.try_element_at(F.filter("_m", lambda m: F.contains(F.lower(F.col(text)), m["marker"])), F.lit(1))
        return texts.withColumn("_m", listed.scalar()).select(key, first["label"].alias("label"))
    low, texts = F.lower(F.col(text)), texts.withColumn("_n", markers.agg(F.collect_set(F.length("marker")).alias("n")).scalar())
    pieces = F.flatten(F.transform("_n", lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1))), lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>"))))
    met = texts.select(key, F.explode(F.array_distinct(pieces)).alias("marker")).join(markers, "marker").groupBy(key).agg(F.min(F.struct("seq", "label")).alias("first"))
    return texts.select(key).join(met, key, "left").select(key, F.col("first.label").alias("label"))


def deepest_marker(paths: DataFrame, markers: DataFrame, key: str = "path") -> DataFrame:
    """(key, marker, product, position) of the deepest part of each path that names one of markers(marker, product, seq)."""
    parts = paths.select(key, F.posexplode(F.split(F.lower(F.col(key)), r"[/.\-_:]+")).alias("position", "marker"))
    best = F.max_by(F.struct("marker", "product", "position"), F.struct(F.col("position"), -F.col("seq"))).alias("best")
    return parts.join(markers, "marker").groupBy(key).agg(best).select(key, "best.marker", "best.product", "best.position")


#: Fixed values of archive rules: extensions, names and parts of paths that show what a listing holds.
PACKED = {
    "weights": ("safetensors", "gguf", "ggml", "onnx", "pt", "pth", "ckpt", "bin", "pb", "h5", "tflite", "engine", "pdparams"), "images": ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff", "gif"), "videos": ("mp4", "avi", "mov", "mkv", "webm"),
    "clips": ("wav", "mp3", "flac", "ogg", "m4a"), "captures": ("pcap", "pcapng", "cap", "erf", "snoop"), "flows": ("netflow", "binetflow", "flow", "argus", "ipfix"), "tables": ("csv", "tsv", "parquet", "arrow", "feather", "jsonl"),
    "shards": ("arrow", "parquet"), "events": ("evtx", "etl"), "sources": ("py", "ipynb", "js", "ts", "java", "cpp", "go", "rs"),
}
PACKED_NAMES = {
    "adapter": ("adapter_config.json", "adapter_model.safetensors", "adapter_model.bin", "pytorch_lora_weights.safetensors"), "declared": ("config.json", "model_index.json", "modules.json", "config.pbtxt"),
    "companions": ("tokenizer.json", "tokenizer_config.json", "preprocessor_config.json", "generation_config.json", "vocab.txt", "vocab.json", "special_tokens_map.json"), "yolo": ("data.yaml", "data.yml", "dataset.yaml"),
    "hf": ("dataset_info.json", "dataset_infos.json", "dataset_dict.json", "state.json"), "suricata": ("eve.json", "fast.log", "suricata.yaml"), "run": ("wandb-metadata.json", "meta.yaml", "mlmodel", "results.csv", "hparams.yaml", "args.yaml"),
    "hashes": ("sha256sums.txt", "md5sums.txt", "hashes.txt", "sha256.txt", "labels.csv"), "project": ("requirements.txt", "pyproject.toml", "setup.py", "package.json", "cargo.toml"),
}
PACKED_PARTS = {
    "in_images": ("images/",), "in_labels": ("labels/",), "coco": ("annotations/instances_", "annotations/captions_", "annotations/person_keypoints_"), "sequences": ("seqinfo.ini",), "tracks": ("gt/gt.txt",), "detections": ("/det/det.txt", "det/det.txt"),
    "zeek": ("conn.log", "dns.log", "http.log", "ssl.log", "notice.log"), "sysmon": ("sysmon", "security.evtx", "microsoft-windows-"), "tfevents": ("events.out.tfevents",), "wandb": ("wandb/",), "epochs": ("epoch", "checkpoint", "ckpt", "last.pt", "best.pt"),
    "families": ("trojan", "ransomware", "backdoor", "botnet", "worm", "spyware", "virusshare", "malimg", "ember", "malmem"),
    "assembled": ("train/", "val/", "valid/", "test/", "eval/", "training/", "validation/", "testing/", "labels/", "annotations/", "masks/", "ground_truth/", "gt/", "classes.txt", "labels.txt", "metadata.csv", "metadata.jsonl", "annotations.json"),
}
SAMPLE_FOLDERS = ("malware", "samples", "benign", "malicious", "goodware", "binaries", "apks")


def archive_kind(members: DataFrame, key: str = "archive") -> DataFrame:
    """(key, kind, confidence, members_listed) of archives from all their members(archive, name, size[, error]): conditional counts in one aggregate, then the first rule that fits."""
    name = F.lower(F.regexp_replace(F.translate("name", "\\", "/"), r"^\./", ""))
    base, ext = name_of(name), extension_of(name)
    folders = F.slice(F.split(name, "/"), 1, F.size(F.split(name, "/")) - 1)
    total = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    contains = lambda words: reduce(Column.__or__, [F.contains(name, F.lit(w)) for w in words])
    counts = [total(ext.isin(*kinds)).alias(k) for k, kinds in PACKED.items()] + [total(base.isin(*names)).alias(f"has_{k}") for k, names in PACKED_NAMES.items()] + [total(contains(words)).alias(f"at_{k}") for k, words in PACKED_PARTS.items()]
    counts += [total(has_any(folders, *SAMPLE_FOLDERS)).alias("samples"), total(base.rlike(r"^[0-9a-f]{32}([0-9a-f]{32})?(\.[a-z0-9]{1,8})?$")).alias("digests"), F.count("name").alias("members_listed")]
    # dealt before they are counted: a member is a narrow row, and an archive's counts are a wide one
    c = dealt(members, key).groupBy(key).agg(*counts)
    n = F.col
    score = lambda *holds: sum((h.cast("int") for h in holds), F.lit(0))
    malware = score(n("samples") >= 1, n("digests") >= 5, n("has_hashes") > 0, n("at_families") >= 3)
    run = score(n("at_tfevents") > 0, n("at_wandb") > 0, n("has_run") > 0, n("at_epochs") >= 2)
    media, most = n("images") + n("videos") + n("clips"), F.greatest("images", "videos", "clips")
    dominant = F.when(n("images") == most, "image").when(n("videos") == most, "video").otherwise("audio")
    rules = [
        ((n("weights") > 0) & (n("has_adapter") > 0), F.lit("adapter_archive"), F.lit(0.95)),
        ((n("weights") > 0) & ((n("has_declared") > 0) | (n("has_companions") > 0)), F.lit("model_archive"), F.when((n("has_declared") > 0) & (n("has_companions") > 0), 0.95).otherwise(0.85)),
        ((n("at_in_images") > 0) & (n("at_in_labels") > 0) & ((n("has_yolo") > 0) | (n("images") > 0)), F.lit("yolo_dataset_archive"), F.when(n("has_yolo") > 0, 0.95).otherwise(0.8)),
        (n("at_coco") > 0, F.lit("coco_dataset_archive"), F.lit(0.95)),
        ((n("at_sequences") > 0) & ((n("at_tracks") > 0) | (n("at_detections") > 0)), F.lit("tracking_dataset_archive"), F.lit(0.95)),
        ((n("has_hf") > 0) | (n("shards") >= 2), F.lit("hf_dataset_archive"), F.when(n("has_hf") > 0, 0.95).otherwise(0.75)),
        ((n("captures") + n("flows") + n("at_zeek") > 0) | (n("has_suricata") > 0), F.lit("network_dataset_archive"), F.when((n("captures") + n("at_zeek") > 0) | (n("has_suricata") > 0), 0.9).otherwise(0.75)),
        ((n("events") >= 2) | ((n("events") > 0) & (n("at_sysmon") > 0)), F.lit("host_log_dataset_archive"), F.lit(0.85)),
        (malware >= 2, F.lit("malware_dataset_archive"), F.lit(0.85)), (run >= 2, F.lit("training_archive"), F.lit(0.85)),
        ((media >= 25) & (n("at_assembled") > 0), F.concat(dominant, F.lit("_dataset_archive")), F.lit(0.75)), (media >= 25, F.lit("media_archive"), F.lit(0.6)),
        ((n("sources") >= 5) & (n("has_project") > 0), F.lit("code_archive"), F.lit(0.7)), (n("tables") >= 3, F.lit("tabular_dataset_archive"), F.lit(0.65)),
    ]
    found = F.struct(F.lit("archive").alias("kind"), F.when(n("members_listed") > 0, 0.4).otherwise(0.3).alias("confidence"))
    for holds, kind, confidence in reversed(rules):
        found = F.when(holds, F.struct(kind.alias("kind"), confidence.alias("confidence"))).otherwise(found)
    return c.select(key, found.alias("v"), "members_listed").select(key, "v.kind", "v.confidence", "members_listed")
