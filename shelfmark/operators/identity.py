"""Whose an asset is and what for, from its path alone: vendor, product, component, task, source, and a name where its own says nothing.

The parts of all paths are few distinct strings; these meet the marker tables
once, as a dictionary, and paths meet the dictionary by equality. What is left
is one projection over each path's parts.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import strings

#: Markers, vendor, product, source, the more specific first. A marker with a backslash names neighbouring parts.
VENDORS = (
    (("huggingface", "hf_home", "hf_hub"), "HuggingFace", "Hub Cache", "huggingface"), ((".ollama", "ollama"), "Ollama", "Ollama", "ollama"), (("lm-studio", "lmstudio", "lm studio"), "LM Studio", "LM Studio", "lm_studio"),
    (("comfyui", "comfy"), "ComfyUI", "ComfyUI", "comfyui"), (("stable-diffusion-webui", "automatic1111", "sd-webui"), "AUTOMATIC1111", "Stable Diffusion WebUI", "sd_webui"),
    (("text-generation-webui", "oobabooga"), "oobabooga", "Text Generation WebUI", "textgen"), (("gpt4all",), "Nomic", "GPT4All", "gpt4all"), (("jan", "janai"), "Jan", "Jan", "jan"),
    (("koboldcpp", "kobold"), "KoboldCpp", "KoboldCpp", "koboldcpp"), (("llama.cpp", "llamacpp"), "llama.cpp", "llama.cpp", "llama_cpp"), (("torch\\hub", "torch_hub"), "PyTorch", "PyTorch Hub", "pytorch_hub"),
    (("timm",), "timm", "timm", "timm"), (("ultralytics",), "Ultralytics", "Ultralytics", "ultralytics"), (("faster-whisper", "faster_whisper"), "SYSTRAN", "faster-whisper", "faster_whisper"),
    (("whisper",), "OpenAI", "Whisper", "whisper"), (("paddleocr", "paddlex", "paddle"), "PaddlePaddle", "PaddleOCR", "paddleocr"), (("easyocr",), "JaidedAI", "EasyOCR", "easyocr"), (("kraken",), "Kraken", "Kraken OCR", "kraken"),
    (("tesseract", "tessdata"), "Tesseract", "Tesseract OCR", "tesseract"), (("datalab", "surya"), "Datalab", "Surya OCR", "surya"), (("doctr",), "Mindee", "docTR", "doctr"), (("insightface",), "InsightFace", "InsightFace", "insightface"),
    (("deepface",), "DeepFace", "DeepFace", "deepface"), (("u2net", "rembg"), "rembg", "rembg", "rembg"), (("mediapipe",), "Google", "MediaPipe", "mediapipe"), (("spacy",), "Explosion", "spaCy", "spacy"),
    (("nltk_data", "nltk"), "NLTK", "NLTK", "nltk"), (("gensim-data", "gensim"), "Gensim", "Gensim", "gensim"), (("sentence_transformers", "sentence-transformers"), "Sentence-Transformers", "Sentence-Transformers", "sentence_transformers"),
    (("openvino",), "Intel", "OpenVINO", "openvino"), (("google\\chrome", "chrome"), "Google", "Chrome", "chrome"), (("microsoft\\edge", "msedge"), "Microsoft", "Edge", "edge"),
    (("brave-browser", "bravesoftware", "brave"), "Brave", "Brave", "brave"), (("mozilla", "firefox"), "Mozilla", "Firefox", "firefox"), (("opera software", "opera"), "Opera", "Opera", "opera"), (("vivaldi",), "Vivaldi", "Vivaldi", "vivaldi"),
    (("chromium",), "Chromium", "Chromium", "chromium"), (("microsoft vs code", "vscode", "code - insiders", ".vscode"), "Microsoft", "VS Code", "vscode"), (("cursor",), "Anysphere", "Cursor", "cursor"),
    ((".antigravity", "antigravity"), "Google", "Antigravity", "antigravity"), (("windsurf",), "Codeium", "Windsurf", "windsurf"), (("jetbrains", "intellij", "pycharm", "webstorm"), "JetBrains", "JetBrains IDE", "jetbrains"),
    (("sublime text", "sublime"), "Sublime HQ", "Sublime Text", "sublime"), (("github copilot", "copilot"), "GitHub", "Copilot", "copilot"), (("postman",), "Postman", "Postman", "postman"), (("docker",), "Docker", "Docker", "docker"),
    (("microsoft office", "office16", "office15", "\\office\\"), "Microsoft", "Office", "office"), (("onenote",), "Microsoft", "OneNote", "onenote"), (("microsoft teams", "teams"), "Microsoft", "Teams", "teams"),
    (("windows photos", "microsoft.windows.photos"), "Microsoft", "Photos", "photos"), (("powertoys",), "Microsoft", "PowerToys", "powertoys"), (("zoom",), "Zoom", "Zoom", "zoom"), (("webex",), "Cisco", "Webex", "webex"),
    (("slack",), "Slack", "Slack", "slack"), (("discord",), "Discord", "Discord", "discord"), (("telegram",), "Telegram", "Telegram", "telegram"), (("whatsapp",), "WhatsApp", "WhatsApp", "whatsapp"), (("grammarly",), "Grammarly", "Grammarly", "grammarly"),
    (("notion",), "Notion", "Notion", "notion"), (("obs-studio", "obs"), "OBS Project", "OBS Studio", "obs"), (("spotify",), "Spotify", "Spotify", "spotify"), (("dropbox",), "Dropbox", "Dropbox", "dropbox"),
    (("adobe",), "Adobe", "Creative Cloud", "adobe"), (("topaz labs", "topaz"), "Topaz Labs", "Topaz", "topaz"), (("davinci resolve", "blackmagic"), "Blackmagic", "DaVinci Resolve", "resolve"), (("capcut",), "ByteDance", "CapCut", "capcut"),
    (("krita",), "Krita", "Krita", "krita"), (("gimp",), "GIMP", "GIMP", "gimp"), (("blender",), "Blender", "Blender", "blender"), (("nvidia", "nvidia corporation"), "NVIDIA", None, "nvidia"), (("intel", "intel corporation"), "Intel", None, "intel"),
    (("realsense",), "Intel", "RealSense", "realsense"), (("ivcam",), "e2eSoft", "iVCam", "ivcam"), (("amd", "radeon"), "AMD", None, "amd"), (("qualcomm", "snapdragon"), "Qualcomm", None, "qualcomm"), (("logitech", "logi"), "Logitech", None, "logitech"),
    (("elgato",), "Elgato", None, "elgato"), (("windowsapps", "systemapps", "windows.ai"), "Microsoft", "Windows", "windows"), (("google",), "Google", None, "google"), (("microsoft",), "Microsoft", None, "microsoft"),
    (("apple",), "Apple", None, "apple"), (("samsung",), "Samsung", None, "samsung"), (("gemini",), "Google", "Gemini", "gemini"),
)

#: Markers, component, task; the first that fits.
COMPONENTS = (
    (("screen_ai", "screenai", "screen-ai"), "ScreenAI", "OCR"), (("text_recognition", "text-recognition", "rec_infer", "_rec_", "recognition"), "Text Recognition", "OCR"),
    (("text_detection", "text-detection", "det_infer", "_det_", "detection_model"), "Text Detection", "OCR"), (("layout_analysis", "layout_detect", "layout"), "Layout Analysis", "OCR"),
    (("table_rec", "table_structure", "table"), "Table Recognition", "OCR"), (("reading_order", "order_detection"), "Reading Order", "OCR"), (("handwriting", "htr"), "Handwriting Recognition", "OCR"), (("ocr", "tessdata"), "OCR", "OCR"),
    (("document_ai", "docai", "docparse"), "Document Understanding", "OCR"), (("barcode", "qrcode", "qr_code"), "Barcode Reader", None),
    (("speech_recognition", "speech-recognition", "asr", "stt", "transcription"), "Speech Recognition", "Speech Recognition"), (("rnnt", "conformer", "wav2vec", "wav2letter"), "Speech Encoder", "Speech Recognition"),
    (("text_to_speech", "text-to-speech", "tts", "vocoder", "piper", "vits"), "Speech Synthesis", "Text to Speech"),
    (("noise_suppression", "noise-suppression", "denoise", "rnnoise", "krisp", "nsnet"), "Noise Suppression", "Audio Enhancement"), (("echo_cancel", "aec"), "Echo Cancellation", "Audio Enhancement"),
    (("voice_activity", "vad_", "_vad", "silero"), "Voice Activity Detection", "Audio"), (("speaker_id", "speaker-id", "diariz", "voiceprint"), "Speaker Recognition", "Audio"),
    (("keyword_spotting", "wake_word", "wakeword", "hotword"), "Wake Word", "Audio"), (("language_id", "language_detection", "lang_id", "lid"), "Language Identification", "Speech Recognition"),
    (("virtual_background", "background_blur", "background_seg", "selfie_seg", "matting"), "Background Segmentation", "Segmentation"), (("background_removal", "rembg", "u2net"), "Background Removal", "Segmentation"),
    (("face_detection", "face_detect", "facedetect", "blazeface", "retinaface", "scrfd"), "Face Detection", "Object Detection"), (("face_recognition", "facerec", "arcface", "facenet", "face_embed"), "Face Recognition", "Embedding"),
    (("face_landmark", "landmark", "facemesh", "face_mesh"), "Face Landmarks", "Pose"), (("hand_landmark", "hand_track", "gesture"), "Hand Tracking", "Pose"),
    (("pose_estimation", "pose_landmark", "posenet", "movenet", "openpose"), "Pose Estimation", "Pose"), (("gaze", "eye_track", "eyetrack"), "Gaze Estimation", "Pose"),
    (("object_detection", "obj_detect", "yolo", "ssd_mobilenet", "efficientdet"), "Object Detection", "Object Detection"), (("segmentation", "segment_anything", "deeplab", "unet"), "Segmentation", "Segmentation"),
    (("super_resolution", "superres", "upscale", "esrgan", "waifu"), "Super Resolution", "Image Enhancement"), (("depth_estimation", "depth_anything", "midas", "monodepth"), "Depth Estimation", "Depth Estimation"),
    (("image_classification", "imagenet", "mobilenet", "efficientnet", "convnext"), "Image Classification", "Image Classification"), (("image_embedding", "image_embed", "clip"), "Image Embedding", "Embedding"),
    (("nsfw", "content_safety", "safety_checker", "moderation"), "Content Safety", None), (("scene_detect", "shot_detect"), "Scene Detection", None), (("photo_enhance", "hdr", "denoiser"), "Photo Enhancement", "Image Enhancement"),
    (("optimization_guide", "optimizationguide", "optimization-guide"), "Optimization Guide", None),
    (("intelliphp", "intellicode", "intellisense", "code_completion", "autocomplete", "completion_model"), "Code Completion", "Code Completion"),
    (("word_prediction", "wordprediction", "next_word", "text_prediction", "predictive", "augloop"), "Text Prediction", "Text Generation"), (("spell", "autocorrect", "grammar", "proofing"), "Proofing", None),
    (("translation", "translate", "opus-mt", "nmt", "marian"), "Translation", "Translation"), (("summariz", "summaris"), "Summarisation", "Summarisation"), (("sentiment",), "Sentiment Analysis", "Sentiment Analysis"),
    (("intent", "slot_filling"), "Intent Classification", "Classification"), (("embedding", "embed_model", "sentence_embed", "text_embed"), "Embedding", "Embedding"), (("rerank",), "Reranker", "Reranking"),
    (("entity", "ner_"), "Entity Recognition", "Classification"), (("safe_browsing", "safebrowsing", "phishing"), "Safe Browsing", None), (("spam", "junk_filter"), "Spam Filter", "Classification"),
    (("smart_reply", "smartreply", "suggested_replies"), "Smart Reply", "Text Generation"), (("search_ranking", "ranking_model", "ranker"), "Ranking", "Reranking"), (("recommend",), "Recommendation", None), (("anomaly",), "Anomaly Detection", None),
    (("telemetry_model", "crash_predict"), "Telemetry", None),
)

#: Parts of paths that say nothing, names that say nothing, endings of names that are left off, folders in which people put things, spellings, and words that end a name.
NOISE = (
    "appdata", "local", "locallow", "roaming", "users", "user data", "userdata", "default", "profile", "profile 1", "program files", "program files (x86)", "programdata", "windows", "system32", "syswow64", "bin", "bin64", "lib", "libs", "res",
    "resources", "cloudresources", "modelresources", "assets", "content", "contents", "app", "application", "server", "apps", "cache", "caches", ".cache", "cached", "tmp", "temp", "data", "db", "store", "storage", "files", "file", "current",
    "latest", "stable", "release", "build", "builds", "dist", "out", "output", "install", "installed", "setup", "models", "model", "ml", "ai", "mlmodels", "ml_models", "weights", "checkpoints", "checkpoint", "artifacts", "hub", "snapshots",
    "blobs", "refs", "manifests", "registry", "library", "packages", "package", "extensions", "extension", "plugins", "plugin", "modules", "node_modules", "site-packages", "python", "win32", "win64", "x64", "x86", "amd64", "arm64", "cpu", "gpu",
    "cuda", "onnx", "tflite", "tf", "torch", "pytorch", "saved_model", "variables", "assets.extra", "1", "2", "3", "v1", "v2", "v3",
)
GENERIC = (
    "model", "models", "weights", "weight", "net", "network", "graph", "frozen", "frozen_graph", "saved_model", "checkpoint", "ckpt", "final", "best", "last", "output", "export", "exported", "converted", "quantized", "quantised", "optimized",
    "optimised", "pytorch_model", "tf_model", "flax_model", "model_quantized", "model_optimized", "model_float32", "model_float16", "model_int8", "model_fp16", "model_fp32", "model_q4", "model_q8", "data", "default", "main", "base", "common",
    "shared", "generic", "unnamed", "untitled", "temp", "tmp", "test", "sample", "example", "demo", "new", "copy", "backup", "inference", "predictor", "classifier", "encoder", "decoder", "embedding",
)
VARIANTS = (
    "_quantized", "_quantised", "_optimized", "_optimised", "_dynamic", "_static", "_int8", "_uint8", "_fp16", "_fp32", "_float16", "_float32", "_q4", "_q8", "_final", "_export", "_exported", "_converted", "_opt", "_sim", "_simplified",
)
BY_HAND = ("downloads", "download", "desktop", "documents", "projects", "project", "repos", "work", "workspace", "dev", "src", "code", "onedrive", "dropbox")
CASING = (
    "OCR", "ASR", "TTS", "STT", "NLP", "AI", "ML", "VAD", "LID", "ID", "UI", "API", "GPU", "CPU", "NPU", "LLM", "VLM", "LSTM", "GRU", "CNN", "RNN", "BERT", "GPT", "ViT", "CLIP", "YOLO", "SAM", "SVM", "KNN", "HDR", "QR", "AEC", "NER", "IDS", "IoT",
    "PDF", "VS", "SD", "SDXL", "TF", "ONNX", "3D", "2D", "US", "UK",
)
ENDINGS = (
    "model", "encoder", "decoder", "recognition", "detection", "segmentation", "estimation", "classification", "generation", "removal", "suppression", "cancellation", "analysis", "completion", "prediction", "reader", "filter", "reply", "safety",
    "ranking", "tracking", "landmarks", "identification", "embedding", "reranker", "synthesis", "enhancement", "translation", "summarisation", "understanding",
)

#: A version, digest, date, GUID or locale. Fixed value.
UNINFORMATIVE = r"^(v?\d+([._-]\d+)*|[0-9a-f]{8,}|\d{4}[-_]?\d{2}[-_]?\d{2}|[{(]?[0-9a-f]{8}-[0-9a-f-]{27}[)}]?|[a-z]{2}([-_][a-z]{2,4})?)$"

#: The id of an editor's extension: it names an ecosystem, not the application that holds it. Fixed value.
EXTENSION_ID = r"^[a-z0-9][a-z0-9-]*\.[a-z0-9][a-z0-9.-]*$"

#: Letters of a shared beginning that make two words one idea. Fixed value.
STEM = 5


def _squashed(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-z0-9]+", "")


def _stem(name: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def is_generic(name: Column) -> Column:
    """Whether a name says nothing: a common word, a version or digest, variants aside."""
    stem = F.lower(_stem(F.trim(name)))
    stem = reduce(lambda s, v: F.regexp_replace(s, f"{v}$", ""), VARIANTS, stem)
    stem = F.regexp_replace(stem, r"^[ _.-]+|[ _.-]+$", "")
    return (stem == "") | F.array_contains(strings(GENERIC), stem) | stem.rlike(UNINFORMATIVE)


def prettified(part: Column) -> Column:
    """A part of a path as a phrase."""
    words = F.filter(F.split(F.trim(part), r"[\s_\-.]+"), lambda w: w != "")
    known = F.expr("map(" + ", ".join(f"'{w.lower()}', '{w}'" for w in CASING) + ", 'rnnt', 'RNN-T')")
    shown = lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), F.when((F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= 5), w), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words, shown), " ")


def _table(entries, kind: str) -> Column:
    """Marker tables as one constant array of structs, in order."""
    rows = []
    for seq, (markers, *values) in enumerate(entries):
        for m in markers:
            rows.append({"seq": seq, "marker": m, "squashed": re.sub("[^a-z0-9]+", "", m), "parts": [p for p in m.split("\\") if p], "values": values})
    rows = [r for r in rows if ("\\" in r["marker"]) == (kind == "joined")]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<seq:int,marker:string,squashed:string,parts:array<string>,values:array<string>>>")


def dictionary(words: DataFrame, vendors=VENDORS, components=COMPONENTS) -> DataFrame:
    """(part, vendors, component) of distinct lower-cased parts: the entries of vendors that a part names, and the first component.

    A marker names a part that equals it or has it as a word; from six letters
    on also one that has it anywhere, signs aside.
    """
    part = F.col("part")
    own = F.split(part, "[^a-z0-9]+")
    names = lambda m: (part == m["marker"]) | F.array_contains(own, m["marker"]) | (F.length(m["marker"]) >= 6) & (F.contains(part, m["marker"]) | F.contains(_squashed(part), m["squashed"]))
    of = F.transform(F.filter(_table(vendors, "part"), names), lambda m: m["seq"])
    fits = lambda m: F.contains(part, m["marker"]) | F.contains(_squashed(part), m["squashed"])
    first = F.try_element_at(F.filter(_table(components, "part"), fits), F.lit(1))
    return words.select("part", F.array_distinct(of).alias("vendors"), first["values"].alias("component"))


def identified(assets: DataFrame, key: str = "asset_id", path: str = "path", name: str = "name", single: str | None = None, vendors=VENDORS, components=COMPONENTS) -> DataFrame:
    """(key, vendor, product, component, task, source, display_name) of assets(key, path, name[, single]).

    The deepest part that names a vendor's entry wins, of equal ones the entry
    that comes first; ids of editors' extensions only count where nothing else
    does. The component is that of the deepest part from there on, else of the
    name, else the deepest part that says anything. display_name is null where
    the asset's own name says something, or nothing better is known. ``single``
    names a boolean column: the path is a file's, whose ending isn't searched.
    Null paths and names count as empty; keys are unique.
    """
    alone = F.coalesce(F.col(single), F.lit(False)) if single else F.lit(False)
    plain = F.translate(F.coalesce(F.col(path), F.lit("")), "\\", "/")
    tail = F.when(plain.contains(":") & (F.substring_index(plain, ":", 1) != plain) & (F.regexp_replace(plain, "^[^:]*:", "") != ""), F.regexp_replace(plain, "^[^:]*:", "")).otherwise(plain)
    rows = assets.select(F.col(key).alias("k"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.filter(F.split(tail, "/"), lambda p: p != "").alias("parts"), alone.alias("alone"), F.lower(F.translate(plain, "/", "\\")).alias("joined"))
    # a file's last part stands without its ending
    rows = rows.withColumn("parts", F.when(F.col("alone"), F.transform("parts", lambda p, i: F.when(i == F.size("parts") - 1, _stem(p)).otherwise(p))).otherwise(F.col("parts")))
    spread = rows.select("k", "alone", "joined", F.size("parts").alias("n"), F.posexplode("parts").alias("position", "shown")).withColumn("part", F.lower("shown"))
    words = spread.select("part").union(rows.select(F.lower("name"))).distinct()
    known = dictionary(words, vendors, components)
    spread = spread.join(known, "part", "left")
    pairs = F.transform(F.filter(_table(vendors, "joined"), lambda m: F.contains(F.col("joined"), m["marker"]) & F.array_contains(m["parts"], F.col("part"))), lambda m: m["seq"])
    searched = ~F.col("alone") | (F.col("position") < F.col("n") - 1) | (F.col("n") == 1)
    entry = F.array_min(F.concat(F.coalesce("vendors", F.array().cast("array<int>")), pairs))
    hit = F.when(searched & entry.isNotNull(), F.struct((~F.col("part").rlike(EXTENSION_ID)).alias("app"), F.col("position").alias("position"), (-entry).alias("entry")))
    # as many parts as the path has
    per = spread.withColumn("hit", hit).groupBy("k").agg(F.max("hit").alias("hit"), F.array_sort(F.collect_list(F.struct("position", "shown", "component"))).alias("found"))
    named = known.select(F.col("part").alias("low"), F.col("component").alias("by_name"))
    out = rows.join(per, "k", "left").withColumn("low", F.lower("name")).join(named, "low", "left")
    entries = F.from_json(F.lit(json.dumps([v for _, *v in vendors])), "array<array<string>>")
    entry = F.try_element_at(entries, 1 - F.col("hit.entry"))
    out = out.withColumns({"vendor": entry[0], "product": entry[1], "source": entry[2]})
    least = F.coalesce(F.col("hit.position"), F.greatest(F.size("parts") - 4, F.lit(0)))
    below = F.reverse(F.filter(F.coalesce("found", F.array().cast("array<struct<position:int,shown:string,component:array<string>>>")), lambda x: x["position"] >= F.col("least")))
    out = out.withColumn("least", least).withColumn("below", below)
    deepest = F.try_element_at(F.filter("below", lambda x: x["component"].isNotNull()), F.lit(1))["component"]
    out = out.withColumn("table", F.coalesce(deepest, "by_name"))
    said = F.array_compact(F.transform(F.array("vendor", "product", "name", _stem(F.col("name"))), F.lower))
    tells = lambda p: ~F.array_contains(strings(NOISE), F.lower(p)) & ~F.lower(p).rlike(UNINFORMATIVE) & ~is_generic(p) & ~F.array_contains(said, F.lower(p)) & (F.length(p) >= 3)
    other = F.try_element_at(F.filter(F.transform("below", lambda x: x["shown"]), tells), F.lit(1))
    out = out.withColumns({"component": F.when(F.col("table").isNotNull(), F.col("table")[0]).otherwise(prettified(other)), "task": F.col("table")[1]})
    hand = F.exists("parts", lambda p: F.array_contains(strings(BY_HAND), F.lower(p)))
    out = out.withColumn("source", F.coalesce("source", F.when(F.size("parts") == 0, "unknown").when(hand, "manual").otherwise("unknown")))
    return out.select(F.col("k").alias(key), "vendor", "product", "component", "task", "source", F.when(is_generic(F.col("name")) & (F.size("parts") > 0), _composed()).alias("display_name"))


def _composed() -> Column:
    """A name from vendor, product, component, task and name: the owner, what it is and does unless that was said, and ``Model`` unless it ends well. Null where only a vendor is known."""
    words = lambda c: F.split(F.lower(c), r"\s+")
    owner = F.coalesce("product", "vendor")
    repeats = F.coalesce(F.forall(words(F.col("component")), lambda w: F.contains(F.lower(owner), w)), F.lit(False))
    head = F.array_compact(F.array(owner, F.when(~repeats, F.col("component"))))
    said = words(F.array_join(head, " "))
    alike = lambda a, b: (a == b) | (F.length(a) >= STEM) & (F.length(b) >= STEM) & (F.substring(a, 1, STEM) == F.substring(b, 1, STEM))
    overlaps = F.exists(words(F.col("task")), lambda w: F.exists(said, lambda s: alike(w, s)))
    parts = F.array_compact(F.concat(head, F.array(F.when((F.size(head) == 0) | ~F.coalesce(overlaps, F.lit(False)), F.col("task")))))
    last = F.lower(F.element_at(parts, -1))
    full = F.array_join(F.when(F.exists(strings(ENDINGS), lambda e: F.endswith(last, e)), parts).otherwise(F.concat(parts, F.array(F.lit("Model")))), " ")
    stem = F.regexp_replace(_stem(F.trim("name")), r"^[ _.-]+|[ _.-]+$", "")
    only = F.col("component")
    useless = (stem == "") | F.lower(stem).rlike(UNINFORMATIVE) | F.forall(words(stem), lambda w: F.contains(F.lower(only), w))
    alone = F.when(useless, only).otherwise(F.concat(only, F.lit(" "), prettified(stem)))
    phrase = F.when(F.size(parts) == 0, None).when((F.size(parts) == 1) & F.col("product").isNull(), F.when(only.isNotNull(), alone)).otherwise(full)
    spaced = F.split(phrase, r"\s+")
    return F.array_join(F.filter(spaced, lambda w, i: (i == 0) | (F.lower(w) != F.lower(F.get(spaced, i - 1)))), " ")
