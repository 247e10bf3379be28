"""Which folders may be one asset on the strength of a pile of files: the guard of generic detectors.

A folder's own rule is a projection over its profile; what it needs from below,
how many of its children have folders of their own, is one aggregate by parent,
as each profile knows its children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.units import strings
from shelfmark.operators.dedup import PAYLOAD
from shelfmark.operators.recognise import name_of

#: Folders that hold assets and aren't one, folders in which applications keep their state, parts of the names of such, and files that only a dataset's root has.
CONTAINERS = (
    "downloads", "download", "desktop", "documents", "my documents", "pictures", "videos", "music", "onedrive", "dropbox", "google drive", "my drive", "public", "users", "home", "shared", "temp", "tmp", "new folder", "appdata", "roaming", "local",
    "locallow", "programs", "packages", "projects", "project", "repos", "repositories", "repo", "git", "source", "src", "code", "work", "workspace", "dev", "sandbox", "playground", "models", "model", "datasets", "dataset", "data", "checkpoints",
    "checkpoint", "weights", "ai", "ml", "llm", "llms", "cache", "caches", ".cache", "hub", "training", "experiments", "runs", "output", "outputs", "results",
)
STATE = (
    "log", "logs", "telemetry", "crashes", "crashreports", "crashdumps", "diagnostics", "dumps", "minidumps", "sessions", "settingslogs", "history", "subagents", "workspacestorage", "globalstorage", "localstorage", "sessionstorage", "localstate",
    "eventlog", "journal", "traces", ".claude", ".codex", ".cursor", ".aider", ".continue", ".gemini", ".antigravity", ".copilot", ".ollama-ui",
)
STATE_TOKENS = ("mcp-logs", "crashpad", "sentry", "chatsessions", "chat-sessions")
MANIFESTS = (
    "data.yaml", "data.yml", "dataset.yaml", "dataset_info.json", "dataset_infos.json", "dataset_dict.json", "classes.txt", "labels.txt", "metadata.jsonl", "manifest.json", "manifest.jsonl", "annotations.json", "state.json", "_stats.json",
    "stats.json",
)

#: Names of splits by the names of folders. Fixed values.
SPLITS = ("train", "training", "val", "valid", "validation", "dev", "test", "testing")

#: Detectors that infer an asset from a pile of files.
GENERIC = ("image_classification", "media_collection", "tabular_dataset")


def in_application_state(path: Column, state: tuple[str, ...] = STATE, tokens: tuple[str, ...] = STATE_TOKENS) -> Column:
    """Whether any part of a path names an application's state."""
    parts = F.transform(F.split(path, r"[/\\]"), lambda p: F.lower(F.trim(p)))
    return F.exists(parts, lambda p: F.array_contains(strings(state), p) | F.exists(strings(tokens), lambda t: F.contains(p, t)))


def guarded(profiles: DataFrame, containers: tuple[str, ...] = CONTAINERS, state: tuple[str, ...] = STATE, tokens: tuple[str, ...] = STATE_TOKENS, manifests: tuple[str, ...] = MANIFESTS) -> DataFrame:
    """profiles(dir, names, dirs, ...) with branching, refused and may_claim.

    branching counts the folders right below that have folders themselves.
    refused says why a generic detector may not claim the folder, in this order:
    it is the root of a drive, lies in an application's state, is a container by
    its name, or its children have their own structure; null where it may. Two
    folders of splits, or a manifest, make a dataset of what would be refused
    for its name or structure, and so does a weight or data file in it.
    """
    parent = F.regexp_replace("dir", "/?[^/]*$", "")
    below = profiles.where(F.size("dirs") > 0).groupBy(parent.alias("dir")).agg(F.count("*").alias("branching"))
    rows = profiles.join(below, "dir", "left").withColumn("branching", F.coalesce("branching", F.lit(0)))
    root = F.col("dir").rlike(r"^([A-Za-z]:)?/?$")
    splits = F.size(F.filter("dirs", lambda d: F.array_contains(strings(SPLITS), d)))
    dataset = (splits >= 2) | F.arrays_overlap("names", strings(manifests))
    payload = F.exists("names", lambda n: F.exists(strings(PAYLOAD), lambda e: F.endswith(n, e)))
    own = F.lower(F.trim(name_of(F.col("dir"))))
    refused = (
        F.when(root, "drive root").when(in_application_state(F.col("dir"), state, tokens), "application state").when(dataset | payload, None)
        .when(F.array_contains(strings(containers), own), "container").when(F.col("branching") >= 2, "structured children")
    )
    return rows.withColumn("refused", refused).withColumn("may_claim", F.col("refused").isNull())
