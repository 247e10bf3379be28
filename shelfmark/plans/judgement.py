"""Registered queries of health rules, statistics, detectors, scores, archive kinds, identity and incremental updates, each with its SQL.

Parts are assets and line items their files; each asset's files, kind and
details follow from its key, so the SQL can state them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import dealt, format_age, format_count, format_duration, parse_size, shorten_path
from shelfmark.operators import catalogue as C
from shelfmark.operators import dedup as D
from shelfmark.operators import health as H
from shelfmark.operators import recognise as R
from shelfmark.operators.taxonomy import classified
from shelfmark.plans.catalogue import query, t
from shelfmark.plans.export import csv_rows
from shelfmark.sources.filesystem import sizes
from shelfmark.sources.places import kept

#: The files that assets are dealt.
NAMES = (
    "README.md", "LICENSE", "config.json", "tokenizer.json", "model-00001-of-00003.safetensors", "model-00002-of-00003.safetensors", "weights/best.pt", "events.out.tfevents.1", "results.csv", "images/train/a.jpg",
    "images/val/b.png", "images/test/c.jpg", "labels/train/a.txt", "annotations/x.json", "traffic.pcap", "flows.binetflow", "velodyne/1.bin", "calib/1.txt", "model.gguf.part", "v1.0-mini/map.json",
    "data.parquet", "notes.txt", "tasks.json", "clip.mp4", "sound.wav", "log.evtx", "shard_0001.tar", "adapter_config.json", "hparams.yaml", "a.csv",
)
KINDS = ("model", "dataset", "adapter", "experiment", "archive", "checkpoint")


def chosen(values, place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (place % len(values) + 1).cast("int"))


def asset_files(spark, d) -> DataFrame:
    items = t(spark, d, "lineitem").where("l_partkey % 29 <> 0")
    size = F.when(F.col("l_partkey") % 31 == 0, 0).otherwise(F.col("l_quantity") * 1000).cast("long")
    return items.select(F.col("l_partkey").alias("asset_id"), chosen(NAMES, F.floor(F.col("l_partkey") / 6) * 11 + F.col("l_linenumber") * 7).alias("relpath"), size.alias("size_bytes"))


def asset_profiles(spark, d) -> DataFrame:
    p, kind = F.col("p_size"), chosen(KINDS, F.col("p_partkey"))
    model, data = kind.isin("model", "adapter", "checkpoint") & (p % 5 != 0), (kind == "dataset") & (p % 3 != 0)
    details = t(spark, d, "part").select(
        F.col("p_partkey").alias("asset_id"), kind.alias("kind"), F.when(p % 6 == 0, "kitti_raw").when(p % 6 == 1, "waymo").otherwise(F.col("p_name")).alias("name"), chosen(("transformers", "peft", "unknown", "ultralytics"), F.floor(F.col("p_partkey") / 6)).alias("framework"),
        F.when(p % 2 == 0, "unknown").otherwise("safetensors").alias("format"), (F.col("p_partkey") % 17 == 0).alias("is_missing"), model.alias("has_model"), data.alias("has_dataset"), F.when(model, chosen(("llm", "object_detection", "lora", "ocr"), p)).alias("model_type"),
        F.when(model & (p % 3 == 0), F.concat(F.lit("org/"), "p_name")).alias("base_model"), F.when(model, p.cast("long") * 1_000_000).alias("param_count"), (p % 2 == 1).alias("param_count_is_exact"), F.when(data, chosen(("coco", "network_capture", "malware", "network_flow"), p)).alias("dataset_format"),
        F.when(data, p % 4 * 100).alias("num_images"), F.when(data, p % 7 * 10).alias("num_annotations"), F.when(data & (p % 11 == 0), 5).alias("num_classes"), F.when((kind == "archive") & (p % 9 == 0), "BadZipFile").alias("listing_error"),
    )
    full = details.join(H.file_summary(asset_files(spark, d)), "asset_id", "left")
    return full.withColumn("physical_size_bytes", F.when(F.col("asset_id") % 2 == 1, F.floor(F.col("size_bytes") / 2)).otherwise(F.col("size_bytes")))


_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_EXT = "regexp_extract(r, '\\.([^./]+)$', 1)"
_WEIGHTS = "('safetensors', 'gguf', 'bin', 'pt', 'pth', 'onnx', 'engine', 'plan', 'tflite', 'mlmodel', 'npz', 'ckpt', 'h5', 'keras', 'pdparams')"
#: Profiles in SQL: details a, sums of files s.
PROFILES = f"""f AS (SELECT l_partkey AS id, lower({_LIST}[CAST(((l_partkey // 6) * 11 + l_linenumber * 7) % {len(NAMES)} AS INTEGER) + 1]) AS r, CASE WHEN l_partkey % 31 = 0 THEN 0 ELSE CAST(l_quantity * 1000 AS BIGINT) END AS sz FROM lineitem WHERE l_partkey % 29 <> 0),
s AS (SELECT id, count(*) AS n, CAST(sum(sz) AS BIGINT) AS b, count(*) FILTER ({_EXT} IN {_WEIGHTS}) AS weights, count(*) FILTER ({_EXT} IN ('pt', 'safetensors', 'bin')) AS saved, count(*) FILTER ({_EXT} IN ('pt', 'safetensors')) AS ck, CAST(sum(sz) FILTER ({_EXT} IN ('pt', 'safetensors')) AS BIGINT) AS ck_b,
  count(*) FILTER ({_EXT} IN ('jpg', 'png')) AS imgs, CAST(sum(sz) FILTER ({_EXT} IN ('jpg', 'png')) AS BIGINT) AS img_b, count(*) FILTER ({_EXT} = 'mp4') AS vids, count(*) FILTER ({_EXT} = 'wav') AS auds, count(*) FILTER (r LIKE '%-of-00003.safetensors') AS shards,
  count(*) FILTER (r LIKE '%label%.txt' OR r LIKE '%annotation%.json') AS marked, count(*) FILTER (r LIKE '%.part') AS parts, count(*) FILTER (r LIKE '%tfevents%') AS evs, count(*) FILTER ({_EXT} IN ('csv', 'parquet')) AS tabs, count(*) FILTER ({_EXT} = 'csv') AS csvs, count(*) FILTER ({_EXT} = 'parquet') AS parqs,
  count(*) FILTER ({_EXT} = 'pcap') AS caps, count(*) FILTER ({_EXT} = 'binetflow') AS flows, count(*) FILTER ({_EXT} = 'evtx') AS evtx,
  bool_or(r = 'readme.md') AS readme, bool_or(r = 'license') AS lic, bool_or(r = 'config.json') AS cfg, bool_or(r = 'adapter_config.json') AS acfg, bool_or(r = 'tokenizer.json') AS tok, bool_or(r LIKE '%/train/%') AS train, bool_or(r LIKE '%/val/%') AS val, bool_or(r LIKE '%/test/%') AS test,
  bool_or(r LIKE 'velodyne/%') AS velo, bool_or(r LIKE 'calib%') AS calib, bool_or(r LIKE 'tasks.json') AS tasks, bool_or(r LIKE '%tar') AS tars, bool_or(r LIKE 'v1.0%') AS v1, bool_or(r LIKE 'annotations/%') AS anns,
  CASE WHEN bool_or(r LIKE 'events.out%') THEN 'TensorBoard' WHEN bool_or(r = 'results.csv' OR r LIKE 'weights/%') THEN 'Ultralytics' WHEN bool_or(r = 'hparams.yaml') THEN 'Lightning' END AS tracker FROM f GROUP BY id),
a AS (SELECT *, kind IN ('model', 'adapter', 'checkpoint') AND p_size % 5 <> 0 AS has_model, kind = 'dataset' AND p_size % 3 <> 0 AS has_data FROM (SELECT *, {list(KINDS)}[CAST(p_partkey % 6 AS INTEGER) + 1] AS kind, CASE WHEN p_size % 6 = 0 THEN 'kitti_raw' WHEN p_size % 6 = 1 THEN 'waymo' ELSE p_name END AS nm FROM part)),
x AS (SELECT a.*, s.* EXCLUDE (id), p_partkey AS id, coalesce(n, 0) AS n0, kind IN ('model', 'adapter', 'checkpoint') AS is_model, kind = 'dataset' AS is_data, p_size % 6 < 2 AND kind = 'dataset' AS drives,
  ['transformers', 'peft', 'unknown', 'ultralytics'][CAST((p_partkey // 6) % 4 AS INTEGER) + 1] AS fw, CASE WHEN has_model THEN ['llm', 'object_detection', 'lora', 'ocr'][p_size % 4 + 1] END AS mt, CASE WHEN has_data THEN ['coco', 'network_capture', 'malware', 'network_flow'][p_size % 4 + 1] END AS df,
  CASE WHEN has_data THEN p_size % 4 * 100 ELSE 0 END AS ni, CASE WHEN has_data THEN p_size % 7 * 10 ELSE 0 END AS na, CASE WHEN has_data AND p_size % 11 = 0 THEN 5 ELSE 0 END AS nc, has_model AND p_size % 3 = 0 AS based
  FROM a LEFT JOIN s ON s.id = a.p_partkey),
g AS (SELECT *, coalesce(nullif(ni, 0), imgs, 0) AS im, coalesce(train, false) OR coalesce(val, false) OR coalesce(test, false) AS split, kind = 'adapter' OR coalesce(mt = 'lora', false) AS adapts FROM x)"""

_FINDINGS = (
    ("asset.missing", "error", "id % 17 = 0"), ("asset.empty", "error", "n0 = 0"), ("asset.zero_bytes", "error", "n0 > 0 AND b = 0"), ("asset.incomplete_download", "error", "parts > 0"),
    ("model.no_weights", "error", "is_model AND p_size % 2 = 0 AND coalesce(weights, 0) = 0"), ("model.missing_shards", "error", "is_model AND shards > 0 AND shards < 3"),
    ("model.no_tokenizer", "warning", "has_model AND fw IN ('transformers', 'peft') AND mt IN ('llm', 'ocr') AND NOT coalesce(tok, false)"), ("model.no_config", "warning", "is_model AND fw IN ('transformers', 'peft') AND NOT coalesce(cfg OR acfg, false)"),
    ("adapter.no_base_model", "warning", "adapts AND NOT based"), ("dataset.no_readme", "info", "is_data AND NOT coalesce(readme, false)"), ("dataset.no_license", "info", "is_data AND NOT coalesce(lic, false)"),
    ("dataset.no_train_split", "warning", "is_data AND split AND NOT train"), ("dataset.no_val_split", "warning", "is_data AND split AND NOT val"), ("dataset.no_test_split", "info", "is_data AND split AND NOT test"),
    ("dataset.no_annotations", "warning", "is_data AND im >= 1 AND na = 0 AND nc = 0 AND coalesce(marked, 0) = 0"), ("annotation.incomplete", "info", "coalesce(tasks, false) AND im > 0 AND na > 0 AND na < im * 0.9"),
    ("driving.no_lidar", "warning", "drives AND NOT coalesce(velo, false)"), ("driving.no_calibration", "warning", "drives AND NOT coalesce(calib, false)"), ("security.no_labels", "info", "df IN ('network_capture', 'network_flow') AND coalesce(csvs, 0) = 0"),
    ("experiment.no_checkpoint", "info", "tracker IS NOT NULL AND coalesce(saved, 0) = 0"), ("archive.not_listed", "warning", "kind = 'archive' AND p_size % 9 = 0"),
)
_FOUND = "h AS (" + " UNION ALL ".join(f"SELECT id, '{c}' AS code, '{s}' AS severity FROM g WHERE {w}" for c, s, w in _FINDINGS) + ")"


@query(f"WITH {PROFILES}, {_FOUND} SELECT id AS asset_id, code, severity FROM h")
def asset_findings(spark, d):
    return H.findings(asset_profiles(spark, d)).select("asset_id", "code", "severity")


@query(f"""WITH {PROFILES}, {_FOUND} SELECT p_partkey AS asset_id, CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'error' THEN 25 WHEN 'warning' THEN 10 WHEN 'info' THEN 3 END), 0)) AS INTEGER) AS score,
CASE WHEN bool_or(severity = 'error') THEN 'error' WHEN bool_or(severity = 'warning') THEN 'warning' ELSE 'ok' END AS status FROM part LEFT JOIN h ON id = p_partkey GROUP BY 1""")
def asset_health(spark, d):
    return H.health(asset_profiles(spark, d))


_STATISTICS = (
    ("files", "n0", "true"), ("size_bytes", "coalesce(b, 0)", "true"), ("on_disk_bytes", "b // 2", "id % 2 = 1 AND b // 2 > 0"), ("top_extensions", "e.top", "e.top IS NOT NULL"),
    ("parameters", "CAST(p_size AS BIGINT) * 1000000", "has_model AND p_size > 0"), ("parameters_exact", "p_size % 2 = 1", "has_model AND p_size > 0"), ("base_model", "'org/' || p_name", "based"), ("tokenizer", "coalesce(tok, false)", "has_model"),
    ("weight_formats", "e.formats", "has_model AND e.formats <> ''"), ("shards", "shards || '/3'", "has_model AND shards > 0"),
    ("images", "im", "im > 0 AND (is_data OR coalesce(tasks, false))"), ("videos", "vids", "is_data AND vids > 0"), ("audio_files", "auds", "is_data AND auds > 0"), ("annotations", "na", "is_data AND na > 0"), ("classes", "nc", "is_data AND nc > 0"),
    ("splits", "array_to_string(list_filter([CASE WHEN test THEN 'test' END, CASE WHEN train THEN 'train' END, CASE WHEN val THEN 'val' END], lambda v: v IS NOT NULL), ',')", "is_data AND split"), ("has_readme", "coalesce(readme, false)", "is_data"), ("has_license", "coalesce(lic, false)", "is_data"),
    ("storage_format", "CASE WHEN tars THEN 'webdataset' WHEN parqs > 0 THEN 'parquet' WHEN csvs > 0 THEN 'csv' WHEN imgs > 0 THEN 'imagefolder' END", "is_data AND (tars OR parqs > 0 OR csvs > 0 OR imgs > 0)"),
    ("annotation_files", "marked", "is_data AND marked > 0"), ("avg_image_bytes", "img_b // imgs", "is_data AND imgs > 0"), ("version", "'v1.0'", "is_data AND v1"), ("annotation_tool", "'Label Studio'", "tasks"),
    ("tracker", "tracker", "tracker IS NOT NULL"), ("checkpoints", "ck", "tracker IS NOT NULL AND ck > 0"), ("checkpoint_bytes", "ck_b", "tracker IS NOT NULL AND ck > 0"), ("event_files", "evs", "tracker IS NOT NULL AND evs > 0"),
    ("captures", "caps", "df <> 'coco' AND caps > 0"), ("flow_files", "flows", "df <> 'coco' AND flows > 0"), ("event_logs", "evtx", "df <> 'coco' AND evtx > 0"), ("tables", "tabs", "df <> 'coco' AND tabs > 0"), ("extracted", "'false'", "kind = 'archive'"),
)


@query(f"""WITH {PROFILES}, byext AS (SELECT id, {_EXT} AS ext, count(*) AS k FROM f WHERE {_EXT} <> '' GROUP BY 1, 2),
fm AS (SELECT * FROM (VALUES ('safetensors', 'safetensors'), ('pt', 'pytorch'), ('bin', 'pytorch')) v(ext, fmt)),
e AS (SELECT id AS eid, array_to_string(list(ext || '=' || k ORDER BY k DESC, ext)[1:5], ';') AS top, coalesce(string_agg(DISTINCT fmt, ',' ORDER BY fmt), '') AS formats FROM byext LEFT JOIN fm USING (ext) GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT g.id AS asset_id, '{k}' AS key, CAST({v} AS VARCHAR) AS value FROM g LEFT JOIN e ON eid = g.id WHERE {w}" for k, v, w in _STATISTICS))
def asset_statistics(spark, d):
    return H.statistics(asset_profiles(spark, d)).select("asset_id", F.explode("statistics").alias("key", "value"))


#: Layouts of folders: the detector that takes them, and their files.
LAYOUTS = (
    ("ollama_store", ("manifests/library/a", "blobs/sha256-1")), ("hf_cache", None), ("diffusers", ("model_index.json", "unet/x.txt")), ("sentence_transformers", ("modules.json", "config.json")), ("peft_adapter", ("adapter_config.json",)),
    ("hf_repo", ("config.json", "model.onnx")), ("hf_repo", ("config.json", "tokenizer_config.json")), ("tensorboard", ("events.out.tfevents.7",)), ("wandb", ("wandb-metadata.json",)), ("mlflow", ("meta.yaml", "metrics/a", "params/b")), ("ultralytics_run", ("args.yaml",)),
    ("cvat", ("task.json", "annotations.json")), ("label_studio", ("label_config.xml",)), ("roboflow", ("readme.roboflow.txt",)), ("supervisely", ("meta.json", "ann/a.json", "img/a.jpg")), ("yolo_dataset", ("data.yml", "a.txt")), ("yolo_dataset", ("images/a.jpg", "labels/a.txt")),
    ("pascal_voc", ("Annotations/a.xml", "JPEGImages/a.jpg")), ("cityscapes", ("leftImg8bit/a.png",)), ("kitti", ("velodyne/a.bin", "calib/a.txt")), ("nuscenes", ("samples/a", "sweeps/b")), ("mot", ("seq1/seqinfo.ini", "seq1/1.jpg")), ("hf_dataset", ("a.parquet", "b.parquet")),
    ("idx_ubyte", ("train-images-idx3-ubyte", "train-labels-idx1-ubyte")), ("ai_project", ("train.py", "requirements.txt", "configs/a.yaml")), ("image_classification", tuple(f"{c}/{i}.png" for c in ("cat", "dog", "owl") for i in range(10))),
    ("media_collection", (*(f"{i}.mp4" for i in range(10)), "labels/a.txt")), ("tabular_dataset", tuple(f"{i}.csv" for i in range(3))), ("tensorflow_savedmodel", ("saved_model.pb",)), ("openvino", ("model.xml", "model.bin")), ("mlx", ("mlx_config.json",)),
    ("paddle_inference", ("inference.pdmodel", "inference.pdiparams")), ("loose_weights", ("a.gguf",)), ("archive", ("a.zip",)), ("bdd100k", ("bdd100k/a.txt",)), ("coco", ("annotations/instances_val.json",)), (None, ("config.json",)), (None, ("data.yaml",)), (None, ("notes.md",)),
)


@query("SELECT p_partkey, detector FROM (SELECT p_partkey, CASE p_partkey % " + str(len(LAYOUTS)) + " " + " ".join(f"WHEN {i} THEN {repr(name) if name else 'NULL'}" for i, (name, _) in enumerate(LAYOUTS)) + " END AS detector FROM part) WHERE detector IS NOT NULL")
def folder_detectors(spark, d):
    """Each part is a folder of one layout; what takes it."""
    layouts = spark.createDataFrame([(i, p) for i, (_, files) in enumerate(LAYOUTS) for p in (files or ("refs/main",))], "layout int, file string")
    folder = F.concat(F.lit("root/"), F.when(F.col("layout") == 1, "models--org--m").otherwise("d"), F.lit("-"), F.col("p_partkey").cast("string"))
    # dealt before they become files: a part is a few bytes of a file that one task reads
    parts = dealt(t(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", (F.col("p_partkey") % len(LAYOUTS)).cast("int").alias("layout")).withColumn("dir", folder)
    files = parts.join(F.broadcast(layouts), "layout").select(F.concat_ws("/", "dir", "file").alias("path"), F.lit(300_000).cast("long").alias("size_bytes"))
    profiles = kept(R.directory_profiles(files, R.ASKED_FOLDERS), "profiles")  # written once: rules and mot_folders read them
    facts = files.where(F.col("path").endswith("/annotations/instances_val.json")).select("path", F.lit("num_images").alias("key"), F.lit("3").alias("value"))
    return R.detected(profiles, R.mot_folders(profiles), R.coco_folders(facts)).join(parts, F.col("path") == F.col("dir")).select("p_partkey", "detector")


@query("""SELECT p_partkey, CAST(greatest(0, round(CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0 END + [0, 0.5, 0.9][p_size % 3 + 1] + least(0.6, 0.3 * (p_size % 4 + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END)) + CASE WHEN p_size % 5 = 0 THEN 0.6 ELSE 0 END + CASE WHEN p_size % 7 = 0 THEN 1.3 ELSE 0 END
+ [0, 0.25, 0.5][CAST(p_partkey % 3 AS INTEGER) + 1] + CASE WHEN p_partkey % 4 = 0 THEN 0.4 WHEN p_partkey % 4 = 1 THEN 1.0 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 1.0 ELSE 0 END + CASE WHEN p_partkey % 13 = 0 THEN 2.0 ELSE 0 END - CASE WHEN p_partkey % 5 = 0 THEN 0.8 ELSE 0 END, 3)) AS DOUBLE) AS score FROM part""")
def folder_scores(spark, d):
    """Each part is a folder whose listing follows from its key; every term of the score occurs."""
    n, k = F.col("p_size"), F.col("p_partkey")
    some = lambda holds, *names: F.when(holds, F.array(*[F.lit(x) for x in names])).otherwise(F.array().cast("array<string>"))
    names = F.concat(
        some(n % 2 == 0, "a.gguf"), some(n % 3 >= 1, "config.json"), some(n % 3 == 2, "tokenizer.json"), some(n % 7 == 0, "x.ipynb", "events.out.tfevents.1"), some(k % 3 >= 1, "train.py"), some(k % 3 == 2, "requirements.txt"),
        some(k % 11 == 0, "t10k-images-idx3-ubyte"), some(k % 5 == 0, *[f"{i}.exe" for i in range(12)]),
    )
    dirs = F.concat(some(n % 4 >= 1, "weights"), some(n % 4 >= 2, "labels"), some(n % 4 == 3, "images"), some(n % 5 == 0, "train", "dev"), some(k % 13 == 0, "models--a", "datasets--b", "manifests", "blobs"))
    name = F.when(k % 4 == 0, "Models").when(k % 4 == 1, "datasets--org--x").otherwise("stuff")
    return t(spark, d, "part").select("p_partkey", R.directory_score(name, names, dirs).alias("score"))


#: Listings of archives: kind, confidence and members.
LISTINGS = (
    ("adapter_archive", 0.95, ("a/adapter_config.json", "a/x.safetensors")), ("model_archive", 0.95, ("config.json", "vocab.txt", "model.bin")), ("model_archive", 0.85, ("config.json", "model.onnx")), ("yolo_dataset_archive", 0.95, ("data.yaml", "images/a.jpg", "labels/a.txt")),
    ("yolo_dataset_archive", 0.8, ("x/images/a.jpg", "x/labels/a.txt")), ("coco_dataset_archive", 0.95, ("annotations/instances_val.json",)), ("tracking_dataset_archive", 0.95, ("s/seqinfo.ini", "s/gt/gt.txt")), ("hf_dataset_archive", 0.95, ("state.json",)), ("hf_dataset_archive", 0.75, ("a.arrow", "b.arrow")),
    ("network_dataset_archive", 0.9, ("a.pcap",)), ("network_dataset_archive", 0.75, ("a.argus",)), ("host_log_dataset_archive", 0.85, ("a.evtx", "b.evtx")), ("malware_dataset_archive", 0.85, ("samples/a", "hashes.txt")), ("training_archive", 0.85, ("events.out.tfevents.1", "hparams.yaml")),
    ("image_dataset_archive", 0.75, (*(f"train/{i}.jpg" for i in range(25)),)), ("media_archive", 0.6, (*(f"{i}.mp4" for i in range(25)),)), ("code_archive", 0.7, ("setup.py", *(f"{i}.py" for i in range(5)))), ("tabular_dataset_archive", 0.65, ("a.csv", "b.csv", "c.tsv")), ("archive", 0.4, ("a.txt", "b.txt")),
)


@query("SELECT p_partkey, kind, confidence, n AS members_listed FROM part JOIN (VALUES " + ", ".join(f"({i}, '{k}', {c}::DOUBLE, {len(m)}::BIGINT)" for i, (k, c, m) in enumerate(LISTINGS)) + f") v(i, kind, confidence, n) ON p_partkey % {len(LISTINGS)} = i")
def archive_kinds(spark, d):
    listings = spark.createDataFrame([(i, m) for i, (_, _, members) in enumerate(LISTINGS) for m in members], "i long, name string")
    members = t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(LISTINGS)).alias("i")).join(F.broadcast(listings), "i")
    return R.archive_kind(members.withColumn("size", F.lit(1)), "p_partkey")


@query("""SELECT o_orderkey, CASE WHEN n >= 1000000000 THEN printf('%.1fB', n / 1000000000) WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.1fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS n_shown,
CASE WHEN s < 1 THEN '0.0s' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS took,
CASE WHEN days >= 365 THEN (days // 365) || ' year' || CASE WHEN days // 365 = 1 THEN '' ELSE 's' END || ' ago' WHEN days >= 30 THEN (days // 30) || ' month' || CASE WHEN days // 30 = 1 THEN '' ELSE 's' END || ' ago'
  WHEN days >= 7 THEN (days // 7) || ' week' || CASE WHEN days // 7 = 1 THEN '' ELSE 's' END || ' ago' WHEN days >= 1 THEN days || ' day' || CASE WHEN days = 1 THEN '' ELSE 's' END || ' ago' WHEN days = 0 THEN 'just now' ELSE 'in the future' END AS age,
CASE WHEN length(p) <= 20 THEN p ELSE p[1:5] || '...' || right(p, 12) END AS short, CAST(floor(CAST(n AS DOUBLE) * 1024) AS BIGINT) AS parsed
FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * o_orderkey * 3 AS n, o_orderkey % 9000 AS s, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS days, '/root/' || o_orderkey || '/' || o_orderpriority || '/x' AS p FROM orders)""")
def values_shown(spark, d):
    n, now = F.col("o_orderkey") * F.col("o_orderkey") * 3, F.lit("1998-01-01").cast("timestamp")
    path = F.concat_ws("/", F.lit("/root"), F.col("o_orderkey").cast("string"), "o_orderpriority", F.lit("x"))
    return t(spark, d, "orders").select(
        "o_orderkey", format_count(n).alias("n_shown"), format_duration(F.col("o_orderkey") % 9000).alias("took"),
        format_age(F.to_date("o_orderdate").cast("timestamp"), now).alias("age"), shorten_path(path, 20).alias("short"), parse_size(F.concat(n.cast("string"), F.lit(" KiB"))).alias("parsed"),
    )


ITEMS = """(SELECT p_partkey AS asset_id, p_name AS name, CASE WHEN p_size % 3 = 0 THEN 'The ' || p_name END AS display_name, p_type AS kind, p_brand AS framework, p_retailprice AS size_bytes FROM part)"""


@query(f"""SELECT a.asset_id, coalesce(display_name, name) AS name, kind, framework, size_bytes, s_name AS architecture, coalesce(nullif(CASE WHEN s_suppkey % 2 = 0 THEN 'mit' END, ''), CASE WHEN n_regionkey % 2 = 0 THEN 'cc' END) AS license,
coalesce(nullif(CAST(n_regionkey * 10 AS BIGINT), 0), CAST(asset_id % 7 AS BIGINT)) AS num_images FROM {ITEMS} a LEFT JOIN supplier ON s_suppkey = a.asset_id LEFT JOIN nation ON n_nationkey = a.asset_id""")
def item_rows(spark, d):
    part = t(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), "p_name")).alias("display_name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("framework"), F.col("p_retailprice").alias("size_bytes"))
    models = t(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("architecture"), F.when(F.col("s_suppkey") % 2 == 0, "mit").alias("license"))
    datasets = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("asset_id"), F.when(F.col("n_regionkey") % 2 == 0, "cc").alias("license"), (F.col("n_regionkey") * 10).alias("num_images"))
    counted = part.select("asset_id", F.map_from_arrays(F.array(F.lit("images")), F.array((F.col("asset_id") % 7).cast("string"))).alias("statistics"))
    return C.items(part, models, datasets, counted).select("asset_id", "name", "kind", "framework", "size_bytes", "architecture", "license", "num_images")


@query(f"""SELECT coalesce(display_name, name) AS name, kind AS category, framework, CAST(CAST(floor(size_bytes) AS BIGINT) AS VARCHAR) AS size_bytes, CAST(asset_id AS VARCHAR) || '/x' AS path, 'a;b' AS tags, """ + ", ".join(
    f"NULL::VARCHAR AS {c}" for c in ("section", "task", "domain", "family", "subcategory", "architecture", "format", "storage_format", "parameters", "parameters_exact", "quantization", "precision", "context_length", "dataset_type", "modalities", "file_count", "images", "videos", "annotations", "classes", "splits", "health_score", "health_status", "health_findings", "drive", "root_folder", "last_modified", "repo_id", "license")
) + f", CASE WHEN CAST(floor(size_bytes) AS BIGINT) >= 1024 THEN printf('%.1f', CAST(floor(size_bytes) AS BIGINT) / 1024.0) || ' KiB' ELSE CAST(floor(size_bytes) AS BIGINT) || ' B' END AS size_human FROM {ITEMS}")
def export_rows(spark, d):
    part = t(spark, d, "part").select(
        F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("The "), "p_name")).otherwise(F.col("p_name")).alias("name"), F.col("p_type").alias("category"), F.col("p_brand").alias("framework"), F.floor("p_retailprice").cast("long").alias("size_bytes"),
        F.concat(F.col("p_partkey").cast("string"), F.lit("/x")).alias("path"), F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    return csv_rows(part)


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM p WHERE page_id % 2 = 0), seen AS (SELECT path FROM p WHERE page_id % 3 <> 0)
SELECT page_id, path NOT IN (SELECT path FROM seen) AND contains(path, '/') AND split_part(path, '/', 1) IN (SELECT root FROM r) AS is_missing FROM p""")
def soft_delete(spark, d):
    p = t(spark, d, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://", "").alias("path"), F.lit(False).alias("is_missing"))
    roots = p.where("page_id % 2 = 0").select(F.substring_index("path", "/", 1).alias("root")).distinct()
    return C.mark_missing(p, p.where("page_id % 3 <> 0").select("path"), roots).select("page_id", "is_missing")


@query("SELECT o_custkey AS asset_id, o_orderkey AS relpath, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'h' || o_totalprice END AS sha256 FROM orders")
def hash_carry_over(spark, d):
    """Orders as files scanned anew; the old rows of every second one differ in size, and of every third one none is there."""
    new = t(spark, d, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("relpath"), F.col("o_totalprice").alias("size_bytes"), F.col("o_orderdate").alias("mtime"))
    old = new.where("relpath % 3 <> 0").select("asset_id", "relpath", (F.col("size_bytes") + F.col("relpath") % 2).alias("size_bytes"), "mtime", F.concat(F.lit("h"), F.col("size_bytes").cast("string")).alias("sha256"), F.lit(None).cast("string").alias("quick_sig"))
    return C.carry_over(new, old).select("asset_id", "relpath", "sha256")


@query("""SELECT l_suppkey, CAST(sum(sz) AS BIGINT) AS logical_bytes, CAST(coalesce(sum(sz) FILTER (l_returnflag = 'N'), 0) + coalesce((SELECT sum(m) FROM (SELECT max(CAST(l_quantity AS BIGINT)) AS m FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND l_returnflag = 'R' GROUP BY l_partkey)), 0) AS BIGINT) AS physical_bytes
FROM (SELECT *, CAST(l_quantity AS BIGINT) AS sz FROM lineitem WHERE l_returnflag <> 'A') x GROUP BY l_suppkey""")
def physical_size(spark, d):
    """Line items as files of suppliers: returned ones are hard links of their part, accepted ones symbolic links."""
    files = t(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").cast("long").alias("size_bytes"), F.lit(0).alias("device"), F.col("l_partkey").alias("inode"), F.when(F.col("l_returnflag") == "R", 2).otherwise(1).alias("nlink"), (F.col("l_returnflag") == "A").alias("is_symlink"))
    return sizes(files, "l_suppkey")


@query("""SELECT asset, label, other, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY label, other) AS rank FROM (SELECT DISTINCT l_suppkey AS asset, 'uses' AS label, l_partkey AS other FROM lineitem UNION SELECT DISTINCT l_partkey, 'used by', l_suppkey FROM lineitem)) WHERE rank <= 8""")
def links_per_asset(spark, d):
    links = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.lit("uses").alias("relation"))
    return C.links_of(links, {"uses": ("uses", "used by")})


@query(r"""SELECT doc_id, hits FROM (SELECT doc_id, len(list_intersect(list_distinct(string_split_regex(lower(split_part(left(text, 8192), chr(10), 1)), '[,;\t| ]+')), ['the', 'and', 'of', 'und', 'der', 'que', 'los'])) AS hits FROM documents) WHERE hits >= 3""")
def column_sniff(spark, d):
    return t(spark, d, "documents").select("doc_id", C.known_columns(F.col("text"), ("the", "and", "of", "und", "der", "que", "los")).cast("long").alias("hits")).where("hits >= 3")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, contains(left(props, 65536), '\"k\"') AS has_k FROM events")
def json_probe(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), C.has_json_keys(F.col("props"), ("k",)).alias("has_k"))


@query("SELECT DISTINCT p_type AS value FROM part WHERE p_type <> ''")
def distinct_facets(spark, d):
    return C.facet_values(t(spark, d, "part"), "p_type")


@query("SELECT p_brand AS value, CAST(min(rank) AS INTEGER) AS rank FROM (SELECT p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_brand ILIKE 'brand#1%' ORDER BY rank LIMIT 40) GROUP BY 1")
def suggest(spark, d):
    return C.suggested(t(spark, d, "part"), "p_brand", "brand#1", F.desc("p_retailprice"), "p_partkey", 40)


#: Orders as assets, line items as their files: the digest is that of flag and status.
HASHED = """(SELECT l_orderkey AS asset_id, sha256(l_returnflag || l_linestatus || (l_partkey % 3)) AS sha256, CAST(l_quantity AS BIGINT) AS size_bytes, CAST(l_linenumber AS BIGINT) AS mtime FROM lineitem)"""
SIGNED = f"s AS (SELECT asset_id, array_to_string(list_sort(list_distinct(list(sha256))), chr(10)) AS s, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(mtime) AS mtime FROM {HASHED} GROUP BY 1)"


def hashed_files(spark, d) -> DataFrame:
    content = F.concat("l_returnflag", "l_linestatus", (F.col("l_partkey") % 3).cast("string"))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.sha2(content, 256).alias("sha256"), F.col("l_quantity").cast("long").alias("size_bytes"), F.col("l_linenumber").cast("long").alias("mtime"), F.lit(True).alias("is_payload"), F.col("l_linenumber").cast("string").alias("relpath"))


@query(f"""WITH {SIGNED} SELECT sha256(s) AS signature, count(*) AS member_count, max(bytes) AS unit_bytes, CAST(sum(bytes) - arg_max(bytes, (mtime, bytes, -asset_id)) AS BIGINT) AS wasted_bytes, arg_max(asset_id, (mtime, bytes, -asset_id)) AS keeper FROM s GROUP BY s HAVING count(*) > 1""")
def duplicate_assets(spark, d):
    return D.asset_groups(hashed_files(spark, d))


@query(f"""WITH {SIGNED}, l AS (SELECT id, len(string_split(s, chr(10))) AS n, unnest(string_split(s, chr(10))) AS item FROM (SELECT min(asset_id) AS id, s FROM s GROUP BY s)),
p AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS n_a, b.n AS n_b, count(*) AS k FROM l a JOIN l b ON a.item = b.item AND a.id < b.id GROUP BY ALL) SELECT left_id, right_id, round(k / (n_a + n_b - k), 4) AS similarity FROM p WHERE k / (n_a + n_b - k) >= 0.7""")
def near_duplicate_assets(spark, d):
    return D.near_assets(hashed_files(spark, d), 0.7)


@query(f"""WITH {SIGNED}, g AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1), w AS (SELECT sum(bytes) - arg_max(bytes, (mtime, bytes, -asset_id)) AS w FROM s GROUP BY s HAVING count(*) > 1),
f AS (SELECT sum(size_bytes) - max(size_bytes) AS w FROM {HASHED} GROUP BY sha256 HAVING NOT bool_or(asset_id IN (SELECT asset_id FROM s WHERE s IN (SELECT s FROM g)))) SELECT CAST(coalesce(sum(w), 0) AS BIGINT) AS wasted_bytes FROM (SELECT * FROM w UNION ALL SELECT * FROM f)""")
def total_waste(spark, d):
    return D.total_waste(hashed_files(spark, d))


#: The first two line items of an order as payload, the others as files that define it or document it.
DEFINED = r"""f AS (SELECT l_orderkey AS asset_id, l_linenumber, CAST(l_quantity AS BIGINT) AS size_bytes, CAST(l_linenumber AS BIGINT) AS mtime, l_linenumber <= 2 AS is_payload,
CASE WHEN l_linenumber <= 2 THEN 'w' || l_linenumber || '.bin' WHEN l_partkey % 3 = 0 THEN 'NOTES.md' ELSE 'config' || l_linenumber || '.json' END AS relpath,
sha256(CASE WHEN l_linenumber <= 2 THEN l_returnflag || l_linestatus || (l_partkey % 40) ELSE l_returnflag END) AS sha256 FROM lineitem),
p AS (SELECT asset_id, string_agg(DISTINCT sha256, chr(10) ORDER BY sha256) AS payload FROM f WHERE is_payload GROUP BY 1),
c AS (SELECT asset_id FROM p WHERE payload IN (SELECT payload FROM p GROUP BY 1 HAVING count(*) > 1)),
i AS (SELECT DISTINCT asset_id, sha256 AS item FROM f WHERE is_payload UNION SELECT asset_id, relpath || ':' || sha256 FROM f WHERE NOT is_payload AND relpath <> 'NOTES.md' AND asset_id IN (SELECT asset_id FROM c)),
s AS (SELECT asset_id, string_agg(item, chr(10) ORDER BY item) AS s, count(*) AS n FROM i GROUP BY 1)"""


def defined_files(spark, d) -> DataFrame:
    payload, part = F.col("l_linenumber") <= 2, F.col("l_partkey")
    number = F.col("l_linenumber").cast("string")
    relpath = F.when(payload, F.concat(F.lit("w"), number, F.lit(".bin"))).when(part % 3 == 0, "NOTES.md").otherwise(F.concat(F.lit("config"), number, F.lit(".json")))
    content = F.when(payload, F.concat("l_returnflag", "l_linestatus", (part % 40).cast("string"))).otherwise(F.col("l_returnflag"))
    files = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.sha2(content, 256).alias("sha256"), F.col("l_quantity").cast("long").alias("size_bytes"), F.col("l_linenumber").cast("long").alias("mtime"), relpath.alias("relpath"))
    return files.withColumn("is_payload", D.is_payload(F.col("relpath")))


@query(f"""WITH {DEFINED}, b AS (SELECT asset_id, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(mtime) AS mtime FROM f GROUP BY 1)
SELECT sha256(s) AS signature, count(*) AS member_count, max(bytes) AS unit_bytes, CAST(sum(bytes) - arg_max(bytes, (mtime, bytes, -asset_id)) AS BIGINT) AS wasted_bytes, arg_max(asset_id, (mtime, bytes, -asset_id)) AS keeper FROM s JOIN b USING (asset_id) GROUP BY s HAVING count(*) > 1""")
def duplicate_assets_by_definition(spark, d):
    return D.asset_groups(defined_files(spark, d))


@query(f"""WITH {DEFINED}, l AS (SELECT min(asset_id) AS id, any_value(n) AS n, s FROM s GROUP BY s), k AS (SELECT l.id, l.n, i.item FROM l JOIN i ON i.asset_id = l.id),
m AS (SELECT a.id AS left_id, b.id AS right_id, a.n AS n_a, b.n AS n_b, count(*) AS k FROM k a JOIN k b ON a.item = b.item AND a.id < b.id GROUP BY ALL) SELECT left_id, right_id, round(k / (n_a + n_b - k), 4) AS similarity FROM m WHERE k / (n_a + n_b - k) >= 0.8""")
def near_assets_by_definition(spark, d):
    return D.near_assets(defined_files(spark, d), 0.8)


@query("""SELECT p_partkey AS asset_id, CASE kind WHEN 'adapter_archive' THEN 'model_archive' WHEN 'model_archive' THEN 'model_archive' WHEN 'media_archive' THEN 'media_archive' WHEN 'training_archive' THEN 'training_archive' WHEN 'code_archive' THEN 'code_archive' WHEN 'archive' THEN 'unknown_archive'
WHEN 'network_dataset_archive' THEN 'security_archive' WHEN 'host_log_dataset_archive' THEN 'security_archive' WHEN 'malware_dataset_archive' THEN 'security_archive' ELSE 'dataset_archive' END AS category FROM part JOIN (VALUES """ + ", ".join(f"({i}, '{k}')" for i, (k, _, _) in enumerate(LISTINGS)) + f") v(i, kind) ON p_partkey % {len(LISTINGS)} = i")
def archive_categories(spark, d):
    """The kinds that listings show, as categories of the taxonomy."""
    profiles = t(spark, d, "part").select(F.col("p_partkey").alias("asset_id"), F.lit("archive").alias("kind"), chosen([k for k, _, _ in LISTINGS], F.col("p_partkey")).alias("subkind"), F.lit("x").alias("name"))
    return classified(profiles).select("asset_id", "category")
