"""Facts of whole folders: model hub caches, Ollama stores, YOLO and VOC datasets.

Each function takes files and gives fact rows as ``headers.facts`` does, whose
path is the folder's (for Ollama the manifest's), so that they go into one
union. Counts are aggregates over rows; only manifests, references, XML and
split lists are opened, each by the task that holds its row. A file that can't
be read gives a fact ``error`` and no other.
"""

from __future__ import annotations

import json
import os
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.headers import IMAGE, SCHEMA, SIDECAR, SPLITS, Fact, gguf

#: What is read off a folder's name ranks below files.
FOLDER = 1

#: Kinds of a hub cache by the beginning of a folder's name. Fixed values of the format.
CACHE_KINDS = {"models": "model", "datasets": "dataset", "spaces": "space"}

#: The media type of weights in a manifest, and the longest manifest. Fixed values of the format.
OLLAMA_WEIGHTS, OLLAMA_MANIFEST_BYTES = "application/vnd.ollama.image.model", 1 << 20

#: Bytes read at most of a YOLO manifest, a reference or a split list.
TEXT_BYTES = 8 << 20


def _opened(rows: DataFrame, reader: Callable[..., Iterator[Fact]], *columns: str) -> DataFrame:
    """Facts of a reader that takes the named columns, the first of which becomes the path."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch[list(columns)].itertuples(index=False):
                try:
                    found = list(reader(*row))
                except (OSError, ValueError, KeyError, TypeError, AttributeError, struct.error, ET.ParseError, RecursionError) as e:
                    found = [("error", type(e).__name__, 0, 0.0)]
                out += [(row[0], key, str(value), rank, confidence, i) for i, (key, value, rank, confidence) in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "key", "value", "source_rank", "confidence", "seq"])

    return rows.select(*columns).mapInPandas(run, SCHEMA)


def _stated(rows: DataFrame, path: str, *facts: tuple[str, Column, int, float]) -> DataFrame:
    """One fact row for each of facts (key, value, rank, confidence) that isn't null, of each row."""
    each = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit(r).alias("source_rank"), F.lit(c).alias("confidence"), F.lit(i).alias("seq")) for i, (k, v, r, c) in enumerate(facts)])
    return rows.select(F.col(path).alias("path"), F.explode(F.filter(each, lambda f: f["value"].isNotNull())).alias("f")).select("path", "f.*")


def read_text(path: str) -> str:
    with open(path, encoding="utf-8-sig", errors="replace") as f:
        return f.read(TEXT_BYTES)


# --- hub caches


def cache_name(folder: Column) -> Column:
    """(kind, repo_id, author, name) of a cache folder's name, else null; only the first -- after the kind parts author from name."""
    kinds = F.create_map(*[F.lit(x) for pair in CACHE_KINDS.items() for x in pair])
    known = f"^({'|'.join(CACHE_KINDS)})--(.+)$"
    rest = F.regexp_extract(folder, known, 2)
    author = F.when(rest.contains("--"), F.substring_index(rest, "--", 1))
    name = F.when(author.isNotNull(), F.regexp_replace(rest, r"^.*?--", "")).otherwise(rest)
    repo = F.when(author.isNotNull(), F.concat(author, F.lit("/"), name)).otherwise(rest)
    return F.when(folder.rlike(known), F.struct(F.try_element_at(kinds, F.regexp_extract(folder, known, 1)).alias("kind"), repo.alias("repo_id"), author.alias("author"), name.alias("name")))


def hub_caches(files: DataFrame) -> DataFrame:
    """Facts of each cache folder among files(path, size, mtime): repository, revision, content root and what older revisions hold.

    The revision is what refs/main names if there is such a snapshot, else the
    snapshot with the newest file, ties to the greatest name. A cache without
    snapshots gives no revision.
    """
    inside = r"^(.*/)?((?:models|datasets|spaces)--[^/]+)/(.*)$"
    rows = files.where(F.col("path").rlike(inside)).select(
        "path", "size", "mtime", F.concat(F.regexp_extract("path", inside, 1), F.regexp_extract("path", inside, 2)).alias("cache"),
        F.regexp_extract("path", inside, 2).alias("folder"), F.regexp_extract("path", inside, 3).alias("rest"),
    )
    caches = rows.select("cache", cache_name(F.col("folder")).alias("n")).distinct()
    named = _stated(
        caches.select("cache", "n.*"), "cache",
        ("repo_id", F.col("repo_id"), SIDECAR, 1.0), ("name", F.col("name"), FOLDER, 0.9), ("display_name", F.col("repo_id"), FOLDER, 1.0),
        ("author", F.col("author"), FOLDER, 1.0), ("kind", F.col("kind"), FOLDER, 1.0), ("is_hf_cache", F.lit("true"), FOLDER, 1.0),
    )
    snapshot = r"^snapshots/([^/]+)/."
    held = rows.where(F.col("rest").rlike(snapshot)).groupBy("cache", F.regexp_extract("rest", snapshot, 1).alias("revision")).agg(F.sum("size").alias("bytes"), F.max("mtime").alias("newest"))
    main = _opened(rows.where("rest = 'refs/main'").select("cache", "path"), lambda cache, path: [("main", read_text(path).strip(), SIDECAR, 1.0)], "cache", "path")
    main = main.where("key = 'main'").select(F.col("path").alias("cache"), F.col("value").alias("main"))
    ranked = held.join(main, "cache", "left").withColumn("rank", F.struct(F.coalesce(F.col("revision") == F.col("main"), F.lit(False)), "newest", "revision"))
    best = ranked.groupBy("cache").agg(F.max_by("revision", "rank").alias("best"), F.array_sort(F.collect_list(F.struct("revision", "bytes"))).alias("all"))
    old = F.filter("all", lambda r: r["revision"] != F.col("best"))
    stale = F.size(old) > 0
    told = _stated(
        best, "cache",
        ("revision", F.col("best"), FOLDER, 1.0), ("content_root", F.concat("cache", F.lit("/snapshots/"), "best"), FOLDER, 1.0),
        ("stale_revisions", F.when(stale, F.to_json(F.transform(old, lambda r: r["revision"]))), FOLDER, 1.0),
        ("stale_bytes", F.when(stale, F.aggregate(old, F.lit(0).cast("long"), lambda s, r: s + r["bytes"])), FOLDER, 1.0),
    )
    return named.unionByName(told)


# --- Ollama


def ollama_manifest(path: str, store: str, below: str) -> Iterator[Fact]:
    """Facts of a manifest of a store and of the GGUF header of its weights; below: its path below the manifests."""
    parts = below.split("/")
    tag, name, space = parts[-1], parts[-2], parts[-3] if len(parts) > 2 else ""
    shown = name if space in ("", "library") else f"{space}/{name}"
    with open(path, encoding="utf-8") as f:
        manifest = json.load(f)
    layers = [x for x in manifest.get("layers") or [] if isinstance(x, dict)]
    yield "reference", f"{shown}:{tag}", SIDECAR, 1.0
    yield "name", shown, SIDECAR, 1.0
    yield "tag", tag, SIDECAR, 1.0
    if len(parts) > 3:
        yield "registry", parts[0], SIDECAR, 1.0
    yield "size", sum(int(x.get("size") or 0) for x in layers), SIDECAR, 1.0
    weights = next((x["digest"] for x in layers if x.get("mediaType") == OLLAMA_WEIGHTS and x.get("digest")), None)
    if weights is None:
        yield "warning", "no weight layer", SIDECAR, 1.0
        return
    blob = os.path.join(store, "blobs", weights.replace(":", "-"))
    if not os.path.exists(blob):
        yield "warning", "weight blob missing", SIDECAR, 1.0
        return
    yield "weights", blob, SIDECAR, 1.0
    try:
        yield from list(gguf(blob))
    except (OSError, ValueError, struct.error):
        yield "warning", "weight blob is not readable GGUF", SIDECAR, 1.0


def ollama_models(files: DataFrame) -> DataFrame:
    """Facts of the manifests among files(path, size); empty ones and those over 1 MiB are none."""
    inside = r"^(.*)/manifests/((?:[^/]+/)+[^/]+)$"
    rows = files.where(F.col("path").rlike(inside) & F.col("size").between(1, OLLAMA_MANIFEST_BYTES))
    rows = rows.select("path", F.regexp_extract("path", inside, 1).alias("store"), F.regexp_extract("path", inside, 2).alias("below"))
    return _opened(rows, ollama_manifest, "path", "store", "below")


# --- datasets below a root


def _below(files: DataFrame) -> DataFrame:
    """files(root, path) with their place below the root, null outside, and the first split that a folder there names."""
    table = F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])
    at = F.when(F.expr("startswith(path, concat(root, '/'))"), F.expr("substring(path, length(root) + 2)"))
    parts = F.split("below", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    split = F.try_element_at(F.filter(F.transform(folders, lambda x: F.try_element_at(table, F.lower(x))), lambda x: x.isNotNull()), F.lit(1))
    return files.select("root", "path", at.alias("below")).where("below is not null").withColumn("split", split)


def _split_facts(counts: DataFrame) -> DataFrame:
    """The fact splits of counts(root, split, n): a JSON object in order of names."""
    entries = F.array_sort(F.collect_list(F.struct("split", "n")))
    return _stated(counts.groupBy("root").agg(F.to_json(F.map_from_entries(entries)).alias("splits")), "root", ("splits", F.col("splits"), SIDECAR, 1.0))


def yolo_names(text: str) -> tuple[list[str], int | None]:
    """(names, nc) of a YOLO manifest: names as a list in one line or several, or by number, then in the order of numbers."""
    plain = "\n".join(re.sub(r"(^|\s)#.*", "", line) for line in text.splitlines())
    clean = lambda x: x.strip().strip("'\"")
    count = re.search(r"^nc:\s*(\d+)\s*$", plain, re.M)
    names: list[str] = []
    if held := re.search(r"^names:\s*\[(.*?)\]", plain, re.M | re.S):
        names = [clean(x) for x in held[1].split(",") if x.strip()]
    elif held := re.search(r"^names:\s*\{(.*?)\}", plain, re.M | re.S):
        numbered = [x.split(":", 1) for x in held[1].split(",") if ":" in x]
        names = [clean(x) for _, x in sorted((int(clean(n)), x) for n, x in numbered)]
    elif held := re.search(r"^names:[ \t]*\n((?:[ \t]*(?:-|\d+[ \t]*:)[^\n]*\n?|[ \t]*\n)+)", plain, re.M):
        lines = [line.strip() for line in held[1].splitlines() if line.strip()]
        if all(line.startswith("-") for line in lines):
            names = [clean(line[1:]) for line in lines]
        else:
            names = [clean(x) for _, x in sorted((int(n), x) for n, x in (line.split(":", 1) for line in lines if not line.startswith("-")))]
    return names, int(count[1]) if count else None


def yolo_manifest(root: str, path: str) -> Iterator[Fact]:
    names, count = yolo_names(read_text(path))
    if names:
        yield "class_names", json.dumps(names), SIDECAR, 1.0
    if count is not None or names:
        yield "num_classes", count if count is not None else len(names), SIDECAR, 1.0


def yolo_datasets(files: DataFrame) -> DataFrame:
    """Facts of the roots among files(root, path) that hold a manifest: classes, label files, and images a split.

    Of several manifests the first by name counts. Label files are .txt files
    whose path holds "label".
    """
    rows = _below(files)
    manifests = rows.where(F.lower("below").isin("data.yaml", "data.yml", "dataset.yaml", "dataset.yml")).groupBy("root").agg(F.min("path").alias("path"))
    own = rows.join(manifests.select("root"), "root", "left_semi")
    labels = F.lower("path").rlike(r"\.txt$") & F.lower("path").contains("label")
    image = F.lower("path").rlike(IMAGE)
    counted = own.groupBy("root").agg(F.count_if(labels).alias("labels"), F.count_if(image).alias("images"))
    splits = own.where(image & F.col("split").isNotNull()).groupBy("root", "split").agg(F.count("*").alias("n"))
    stated = _stated(counted, "root", ("num_annotations", F.col("labels"), SIDECAR, 0.9), ("num_images", F.col("images"), SIDECAR, 0.9))
    return _opened(manifests, yolo_manifest, "root", "path").unionByName(stated).unionByName(_split_facts(splits))


def voc_objects(root: str, path: str) -> Iterator[Fact]:
    """The distinct names of objects in one annotation file."""
    for name in sorted({(x.findtext("name") or "").strip() for x in ET.parse(path).getroot().iter("object")} - {""}):
        yield "class", name, SIDECAR, 1.0


def voc_list(root: str, path: str, split: str) -> Iterator[Fact]:
    yield split, sum(1 for line in read_text(path).splitlines() if line.strip()), SIDECAR, 1.0


def voc_datasets(files: DataFrame) -> DataFrame:
    """Facts of the roots among files(root, path) that hold Annotations/*.xml: their number, classes of all of them, and lines a split list.

    Files that can't be parsed count as annotations and add no class. Of the
    lists of a split below ImageSets the last by path counts.
    """
    rows = _below(files)
    marks = rows.where(F.col("below").rlike(r"^(?:.*/)?Annotations/[^/]+\.xml$"))
    counted = _stated(marks.groupBy("root").agg(F.count("*").alias("n")), "root", ("num_annotations", F.col("n"), SIDECAR, 1.0))
    names = _opened(marks, voc_objects, "root", "path").where("key = 'class'").groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("names"))
    classes = _stated(names, "path", ("class_names", F.to_json("names"), SIDECAR, 1.0), ("num_classes", F.size("names"), SIDECAR, 1.0))
    table = F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])
    listed = r"^(?:.*/)?ImageSets/(?:.*/)?([^/]+)\.txt$"
    lists = rows.where(F.col("below").rlike(listed)).select("root", "path", F.try_element_at(table, F.lower(F.regexp_extract("below", listed, 1))).alias("of")).where("of is not null")
    lists = lists.join(marks.select("root").distinct(), "root", "left_semi").groupBy("root", "of").agg(F.max("path").alias("path"))
    lines = _opened(lists.select("root", "path", "of"), voc_list, "root", "path", "of").where("key <> 'error'")
    splits = _split_facts(lines.select(F.col("path").alias("root"), F.col("key").alias("split"), F.col("value").cast("long").alias("n")))
    return counted.unionByName(classes).unionByName(splits)
