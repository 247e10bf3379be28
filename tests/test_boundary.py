"""What generic detectors may claim, on layouts of folders."""

import pytest

from shelfmark.operators.boundary import guarded
from shelfmark.operators.recognise import ASKED_FOLDERS, candidate_hits, directory_profiles
from shelfmark.operators.catalogue import surviving_claims


@pytest.fixture(scope="module")
def found(spark):
    """(detector by folder, reason by folder) of a list of (path, bytes)."""

    def of(files):
        profiles = guarded(directory_profiles(spark.createDataFrame([(f"/t/{p}", n) for p, n in files], "path string, size_bytes long")))
        hits = {r["path"].removeprefix("/t/"): r["detector"] for r in surviving_claims(candidate_hits(profiles)).collect()}
        return hits, {r["dir"].removeprefix("/t/"): r["refused"] for r in profiles.collect()}

    return of


def images(folder, n, prefix="i"):
    return [(f"{folder}/{prefix}{k}.png", 500) for k in range(n)]


def test_state_of_applications_is_no_dataset(found):
    files = [(f".claude/projects/some-project/{n}.jsonl", 800_000) for n in "abc"] + [(f".codex/sessions/2026/05/21/{n}.jsonl", 800_000) for n in "ab"] + [(f"AppData/Roaming/Code/User/globalStorage/chats/{n}.jsonl", 800_000) for n in "ab"]
    files += [("IdeaIC2024/log/state.json", 2), ("IdeaIC2024/log/events.csv", 300_000), ("IdeaIC2024/log/metrics.csv", 300_000), ("mcp-logs-ide/x/a.csv", 600_000), ("mcp-logs-ide/x/b.csv", 600_000)]
    hits, why = found(files)
    assert hits == {} and why[".codex/sessions/2026/05/21"] == "application state" == why["IdeaIC2024/log"] == why["mcp-logs-ide/x"]


def test_containers_and_structured_children_are_left_alone(found):
    files = [(f"Downloads/{n}.csv", 400_000) for n in "ab"] + [("lib/coco-a/annotations/x.txt", 1), ("lib/coco-b/annotations/x.txt", 1)]
    files += [(f"datasets/{s}/{k}.png", 5) for s in ("train", "val") for k in range(3)] + [("Models/w.gguf", 9), ("corpus/data.yaml", 5), ("corpus/a/b/c.txt", 1), ("corpus/d/e/f.txt", 1)]
    hits, why = found(files)
    assert "Downloads" not in hits
    assert (why["Downloads"], why["lib"], why["datasets"], why["Models"], why["corpus"]) == ("container", "structured children", None, None, None)


def test_a_pile_in_its_own_folder_is_a_dataset(found):
    files = [(f"NLP-Project/data/civil/base/{n}.jsonl", 300_000) for n in ("articles", "clauses")] + [("NLP-Project/requirements.txt", 9), ("NLP-Project/train.py", 9), ("NLP-Project/data/civil/base/_stats.json", 9)]
    files += images("traffic", 400, "frame") + [("traffic/labels/frame0.txt", 9)] + images("work/figs", 20, "fig_") + images("Screenshots", 400, "Screenshot ")
    files += [("Android Course/lesson%d.mp4" % k, 2048) for k in range(30)]
    files += [f for p in ("train", "val") for c in ("ants", "bees") for f in images(f"hymenoptera_data/{p}/{c}", 20)]
    hits, _ = found(files)
    assert hits["NLP-Project/data/civil/base"] == "tabular_dataset" and hits["traffic"] == "media_collection" and hits["hymenoptera_data"] == "image_classification"
    assert not {"work/figs", "Screenshots", "Android Course"} & set(hits)


def test_a_folder_of_many_folders_keeps_the_asked_ones(spark):
    files = [(f"r/set/o{i}/{n}", 5) for i in range(300) for n in ("Config.json", "model.safetensors")] + [("r/set/Labels/a.txt", 1), ("r/set/x.JPG", 2), ("r/runs/version_1/hparams.yaml", 3), ("top.txt", 4)]
    frame = spark.createDataFrame(files, "path string, size_bytes long")
    rows = {r["dir"]: r for r in directory_profiles(frame, ASKED_FOLDERS).collect()}
    assert rows["r/set"]["dirs"] == ["labels"] and rows["r"]["dirs"] == ["runs"] and rows["r/set"]["names"] == ["x.jpg"]
    assert (rows["r/set"]["n_files"], rows["r/set"]["bytes"], rows["r/set"]["by_extension"]) == (1, 3003, {"jpg": 1, "json": 300, "safetensors": 300, "txt": 1})
    assert (rows["r"]["n_files"], rows["r"]["names"], rows["r"]["bytes"], rows["r/set/o7"]["names"]) == (0, [], 3006, ["config.json", "model.safetensors"])
    hits = lambda profiles: sorted(tuple(r) for r in candidate_hits(profiles).collect())
    assert hits(directory_profiles(frame, ASKED_FOLDERS)) == hits(directory_profiles(frame)) and len(directory_profiles(frame).where("dir = 'r/set'").first()["dirs"]) == 301


def test_folder_detectors_makes_its_profiles_once_in_many_tasks(spark, tiny, monkeypatch):
    from shelfmark.operators import recognise
    from shelfmark.plans.judgement import folder_detectors

    made, tasks, plain = spark.sparkContext.accumulator(0), [], recognise.directory_profiles

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    def profiles(files, folders):
        tasks.append(files.rdd.getNumPartitions())
        frame = plain(files, folders)
        return frame.mapInArrow(counted, frame.schema)

    wanted = {tuple(r) for r in folder_detectors(spark, tiny).collect()}
    monkeypatch.setattr(recognise, "directory_profiles", profiles)
    assert {tuple(r) for r in folder_detectors(spark, tiny).collect()} == wanted and len(wanted) > 150
    monkeypatch.undo()
    parts = spark.read.parquet(f"{tiny}/part.parquet").count()
    assert parts < made.value < 3 * parts and tasks[0] >= int(spark.conf.get("spark.sql.shuffle.partitions"))
