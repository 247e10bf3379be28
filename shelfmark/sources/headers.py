"""Facts from binary headers and sidecar files: GGUF, ONNX, torch checkpoints, JSON configurations, model cards, COCO files.

Every reader opens its file once, reads a bounded head and never runs what the
file holds. ``facts`` gives rows (path, key, value, source_rank, confidence,
seq) for ``best_facts``; a file that can't be read gives a row with key
``error``. Readers open local paths, which all executors must see.
"""

from __future__ import annotations

import json
import os
import pickletools
import re
import struct
import zipfile
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, key string, value string, source_rank int, confidence double, seq int"

#: Ranks of sources: a binary header goes before a sidecar file.
BINARY, SIDECAR = 3, 2

#: Bytes read at most. Fixed values.
GGUF_HEAD, ONNX_HEAD, SIDECAR_BYTES, COCO_PARSED = 16 << 20, 256 << 10, 1 << 20, 48 << 20

#: Formats of GGUF numbers by type id, and names of its file types. Fixed values of the format.
GGUF_NUMBERS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}
GGUF_STRING, GGUF_ARRAY = 8, 9
GGUF_FILE_TYPES = {0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L", 14: "Q4_K_S", 15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M", 18: "Q6_K", 32: "BF16"}

#: Bytes of an element by the name of a torch storage class. Fixed values of the format.
STORAGE_BYTES = {"DoubleStorage": 8, "LongStorage": 8, "FloatStorage": 4, "IntStorage": 4, "HalfStorage": 2, "BFloat16Storage": 2, "ShortStorage": 2, "CharStorage": 1, "ByteStorage": 1, "BoolStorage": 1}

#: Keys of JSON files that become facts: file name to (path in the file, key, confidence). Fixed values.
JSON_FACTS = {
    "config.json": [("model_type", "architecture_type", 0.9), ("architectures.0", "architecture", 1.0), ("vocab_size", "vocab_size", 1.0), ("hidden_size", "hidden_size", 1.0), ("num_hidden_layers", "layers", 1.0), ("max_position_embeddings", "context_length", 1.0), ("torch_dtype", "dtype", 1.0), ("_name_or_path", "base_model", 0.5)],
    "adapter_config.json": [("base_model_name_or_path", "base_model", 1.0), ("peft_type", "peft_type", 1.0), ("r", "rank", 1.0), ("lora_alpha", "lora_alpha", 1.0), ("task_type", "task", 0.8)],
    "model_index.json": [("_class_name", "pipeline", 1.0), ("_diffusers_version", "library_version", 1.0)],
    "tokenizer_config.json": [("tokenizer_class", "tokenizer", 1.0), ("model_max_length", "context_length", 0.6)],
    "generation_config.json": [("max_length", "max_length", 0.8)],
    "modules.json": [("0.type", "first_module", 1.0)],
}

Fact = tuple[str, object, int, float]


class Cursor:
    """Little-endian values of a head of bytes, one after another; struct.error where the head ends."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self, code: str):
        (value,) = struct.unpack_from("<" + code, self.data, self.at)
        self.at += struct.calcsize(code)
        return value

    def text(self) -> str:
        n = self.number("Q")
        if self.at + n > len(self.data):
            raise struct.error("the head ends within a text")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        """The value; of an array, only how many items it has."""
        if kind == GGUF_STRING:
            return self.text()
        if kind != GGUF_ARRAY:
            return self.number(GGUF_NUMBERS[kind])
        inner, n = self.number("I"), self.number("Q")
        if inner in GGUF_NUMBERS:
            self.at += n * struct.calcsize(GGUF_NUMBERS[inner])
        else:
            for _ in range(n):
                self.value(inner)
        return n


def gguf(path: str) -> Iterator[Fact]:
    """Architecture, name, quantization, base model and author; param_count only if all tensor entries lie in the head."""
    with open(path, "rb") as f:
        c = Cursor(f.read(GGUF_HEAD), 4)
    if c.data[:4] != b"GGUF":
        raise ValueError("no GGUF file")
    version = c.number("I")
    count = "I" if version == 1 else "Q"
    tensors, pairs = c.number(count), c.number(count)
    found: dict = {}
    params = 0
    try:
        for _ in range(pairs):
            key = c.text()
            found[key] = c.value(c.number("I"))
        for _ in range(tensors):
            c.text()
            size = 1
            for _ in range(c.number("I")):
                size *= c.number("Q")
            c.number("I"), c.number("Q")
            params += size
    except (struct.error, KeyError):
        params = None
    yield "gguf_version", version, BINARY, 1.0
    yield "tensor_count", tensors, BINARY, 1.0
    if params is not None:
        yield "param_count", params, BINARY, 1.0
    kind = found.get("general.architecture")
    wanted = [("general.architecture", "architecture", 1.0), ("general.name", "name", 0.8), ("general.basename", "base_model", 0.9), ("general.organization", "author", 0.9), ("general.author", "author", 0.9), (f"{kind}.context_length", "context_length", 1.0), (f"{kind}.block_count", "layers", 1.0)]
    for key, name, confidence in wanted:
        if found.get(key) not in (None, ""):
            yield name, found[key], BINARY, confidence
    if (label := GGUF_FILE_TYPES.get(found.get("general.file_type"))) is not None:
        yield "quantization", label, BINARY, 1.0


def protobuf_fields(data: bytes, at: int = 0) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a message, until the data end; a field that goes on beyond them isn't given."""

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    try:
        while at < len(data):
            tag = varint()
            kind = tag & 7
            if kind == 0:
                yield tag >> 3, varint()
            elif kind == 2:
                n = varint()
                if at + n > len(data):
                    return
                at += n
                yield tag >> 3, data[at - n : at]
            elif kind in (1, 5):
                at += 8 if kind == 1 else 4
            else:
                return
    except IndexError:
        return


def onnx(path: str) -> Iterator[Fact]:
    """IR version, producer, description and operator set, as far as they come before the graph or the graph fits into the head."""
    with open(path, "rb") as f:
        fields = list(protobuf_fields(f.read(ONNX_HEAD)))
    if not fields or fields[0][0] not in range(1, 26):
        raise ValueError("no ONNX model")
    yield "framework", "onnxruntime", BINARY, 0.7
    names = {1: ("ir_version", 1.0), 2: ("producer", 1.0), 3: ("producer_version", 1.0), 6: ("description", 0.4)}
    for number, value in fields:
        if number in names and value not in (b"", 0):
            yield names[number][0], value.decode("utf-8", "replace") if isinstance(value, bytes) else value, BINARY, names[number][1]
        elif number == 8 and isinstance(value, bytes):
            part = dict(protobuf_fields(value))
            if part.get(1, b"") in (b"", b"ai.onnx") and 2 in part:
                yield "opset", part[2], BINARY, 1.0


def torch_checkpoint(path: str) -> Iterator[Fact]:
    """Framework and an estimate of parameters from the table of contents; the pickle's names are listed, never loaded."""
    yield "framework", "pytorch", BINARY, 0.5
    if not zipfile.is_zipfile(path):
        with open(path, "rb") as f:
            if f.read(1) != b"\x80":
                raise ValueError("neither a zip file nor a pickle")
        yield "container", "pickle", BINARY, 1.0
        return
    with zipfile.ZipFile(path) as z:
        members = z.infolist()
        stored = sum(m.file_size for m in members if re.search(r"/data/\d+$", m.filename))
        names: Counter = Counter()
        ultralytics = False
        for m in members:
            if m.filename.endswith("data.pkl") and m.file_size <= GGUF_HEAD:
                for op, arg, _ in pickletools.genops(z.read(m)):
                    if isinstance(arg, str):
                        ultralytics |= "ultralytics" in arg
                        if (last := arg.rsplit(" ", 1)[-1]) in STORAGE_BYTES:
                            names[last] += 1
    yield "container", "zip", BINARY, 1.0
    width = STORAGE_BYTES[names.most_common(1)[0][0]] if names else 4
    if stored:
        yield "param_count", stored // width, BINARY, 0.4
    if ultralytics:
        yield "framework", "ultralytics", BINARY, 0.95
        yield "model_type", "object_detection", BINARY, 0.9


def json_sidecar(path: str) -> Iterator[Fact]:
    """Facts of JSON_FACTS for the file's name."""
    if os.path.getsize(path) > SIDECAR_BYTES:
        raise ValueError("sidecar too long")
    with open(path, encoding="utf-8-sig") as f:
        whole = json.load(f)
    for place, key, confidence in JSON_FACTS[os.path.basename(path).lower()]:
        value = whole
        for step in place.split("."):
            if isinstance(value, list) and step.isdigit() and int(step) < len(value):
                value = value[int(step)]
            else:
                value = value.get(step) if isinstance(value, dict) else None
        if value not in (None, "", [], {}):
            yield key, json.dumps(value) if isinstance(value, (dict, list, bool)) else value, SIDECAR, confidence


def front_matter(text: str) -> tuple[dict[str, str | list[str]], str]:
    """Top-level scalars and lists of a card's YAML head, and the text below it; nested mappings are left out."""
    held = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|$)(.*)", text, re.S)
    if not held:
        return {}, text
    found: dict[str, str | list[str]] = {}
    key = None
    for line in held[1].splitlines():
        if item := re.match(r"\s*-\s+(.+)$", line):
            if key and isinstance(found.get(key, []), list):
                found.setdefault(key, []).append(item[1].strip().strip("'\""))
        elif pair := re.match(r"([A-Za-z_][\w-]*):\s*(.*)$", line):
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                found[key] = [x.strip().strip("'\"") for x in value[1:-1].split(",") if x.strip()]
            elif value:
                found[key] = value.strip("'\"")
    return found, held[2]


def model_card(path: str) -> Iterator[Fact]:
    """License, task, library, base model, tags and description of a README with YAML front matter."""
    with open(path, encoding="utf-8", errors="replace") as f:
        head, body = front_matter(f.read(SIDECAR_BYTES))
    for name, key, confidence in [("license", "license", 1.0), ("pipeline_tag", "pipeline_tag", 1.0), ("library_name", "library", 1.0), ("model_name", "name", 0.9), ("base_model", "base_model", 0.9), ("language", "language", 1.0), ("tags", "tags", 1.0), ("datasets", "datasets", 1.0)]:
        if value := head.get(name):
            yield key, ", ".join(value) if isinstance(value, list) else value, SIDECAR, confidence
    for paragraph in re.split(r"\n\s*\n", body):
        line = " ".join(paragraph.split())
        if len(line) >= 40 and not re.match(r"[#>*|<\-]|!\[|\[!\[|```|\d+\.\s", line):
            yield "description", line[:600], SIDECAR, 0.8
            break


def coco(path: str) -> Iterator[Fact]:
    """Counts, classes and kinds of annotations; files over COCO_PARSED are counted in pieces without parsing."""
    if os.path.getsize(path) > COCO_PARSED:
        counts = {b'"image_id"': 0, b'"file_name"': 0}
        with open(path, "rb") as f:
            rest = b""
            while piece := f.read(8 << 20):
                rest += piece
                # marks are shorter than 16 bytes: count those that begin before the last 15, keep these for the next piece
                cut = max(0, len(rest) - 15)
                for mark in counts:
                    counts[mark] += rest[: cut + len(mark) - 1].count(mark) if cut else 0
                rest = rest[cut:]
            for mark in counts:
                counts[mark] += rest.count(mark)
        yield "num_annotations", counts[b'"image_id"'], SIDECAR, 0.8
        yield "num_images", counts[b'"file_name"'], SIDECAR, 0.8
        return
    with open(path, encoding="utf-8-sig") as f:
        whole = json.load(f)
    if not isinstance(whole, dict) or not {"images", "annotations", "categories"} <= whole.keys():
        raise ValueError("no COCO file")
    marks = [a for a in whole["annotations"][:200] if isinstance(a, dict)]
    yield "num_images", len(whole["images"]), SIDECAR, 1.0
    yield "num_annotations", len(whole["annotations"]), SIDECAR, 1.0
    yield "class_names", json.dumps([str(c.get("name")) for c in whole["categories"]]), SIDECAR, 1.0
    for field, key in (("bbox", "has_boxes"), ("segmentation", "has_masks"), ("keypoints", "has_keypoints")):
        yield key, str(any(a.get(field) for a in marks)).lower(), SIDECAR, 1.0


#: The reader of a file by its lower-case name, the first pattern that fits.
READERS: list[tuple[str, Callable[[str], Iterator[Fact]]]] = [
    (r".*\.gguf", gguf), (r".*\.onnx", onnx), (r".*\.(pt|pth|ckpt)|pytorch_model.*\.bin", torch_checkpoint),
    ("|".join(re.escape(n) for n in JSON_FACTS), json_sidecar), (r"readme\.md|model_card\.md|modelcard\.md|dataset_card\.md|datasetcard\.md", model_card), (r"(instances|annotations|person_keypoints|_annotations).*\.json", coco),
]


def facts(files: DataFrame) -> DataFrame:
    """Fact rows of files(path); files that no reader takes give none, null paths neither."""

    def run(batches):
        for batch in batches:
            rows = []
            for path in batch["path"].dropna():
                name = os.path.basename(path).lower()
                reader = next((r for pattern, r in READERS if re.fullmatch(pattern, name)), None)
                if reader is None:
                    continue
                seq = 0
                try:
                    for key, value, rank, confidence in reader(path):
                        rows.append((path, key, str(value), rank, confidence, seq))
                        seq += 1
                except (OSError, ValueError, KeyError, TypeError, AttributeError, struct.error, zipfile.BadZipFile, RecursionError) as e:
                    rows.append((path, "error", type(e).__name__, 0, 0.0, seq))
            yield pd.DataFrame(rows, columns=["path", "key", "value", "source_rank", "confidence", "seq"])

    wanted = "|".join(f"(?:{pattern})" for pattern, _ in READERS)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return files.select("path").where(name.rlike(f"^(?:{wanted})$")).mapInPandas(run, SCHEMA)


IMAGE = r"\.(jpg|jpeg|png|bmp|webp|tif|tiff)$"

#: Names of splits by the names of folders. Fixed values.
SPLITS = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test"}


def folder_classes(files: DataFrame, root: str = "root") -> DataFrame:
    """(root, split, class_name, n_images) of image folders: files(root, path), where a class is the folder that holds an image and a split the first folder named so below the root, else null."""
    inside = F.split(F.expr(f"substring(path, length({root}) + 2)"), "/")
    rows = files.where(F.lower("path").rlike(IMAGE)).select(root, F.slice(inside, 1, F.greatest(F.size(inside) - 1, F.lit(0))).alias("folders")).where("size(folders) > 0")
    table = F.create_map(*[F.lit(x) for pair in SPLITS.items() for x in pair])
    split = F.try_element_at(F.filter(F.transform("folders", lambda x: F.try_element_at(table, F.lower(x))), lambda x: x.isNotNull()), F.lit(1))
    named = rows.select(root, split.alias("split"), F.element_at("folders", -1).alias("class_name")).where(~F.lower("class_name").isin(*SPLITS))
    return named.groupBy(root, "split", "class_name").agg(F.count("*").alias("n_images"))
