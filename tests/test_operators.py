import json
import random
import struct
import tarfile
import zipfile

from pyspark.sql import functions as F

from shelfmark.functions import units
from shelfmark.operators import catalogue, dedup, recognise, search
from shelfmark.sources import filesystem
from shelfmark.streaming import watch


def test_sizes_and_paths(spark):
    df = spark.createDataFrame([("1.5 GiB",), ("2k",), ("10 kB",), ("x",), ("",), (None,), ("1.2345678 GB",), ("2000000000000000 b",), ("1 eb",)], "s string")
    assert [r[0] for r in df.select(units.parse_size(df.s)).collect()] == [1610612736, 2000, 10000, None, None, None, 1234567800, 2000000000000000, None]
    df = spark.createDataFrame([(1 << 50, "a" * 70), (-1536, "b"), (494_032_768, None), (999, "")], "n long, p string")
    shown = df.select(units.format_bytes(df.n), units.format_count(df.n), units.shorten_path(df.p, 30)).collect()
    assert [r[0] for r in shown] == ["1.0 PiB", "-1.5 KiB", "471.1 MiB", "999 B"] and shown[2][1] == "494.0M" and shown[1][1] == "-1.5K" and shown[0][2] == "a" * 9 + "..." + "a" * 18
    df = spark.createDataFrame([(0.42,), (12.0,), (95.0,), (3725.0,)], "s double")
    assert [r[0] for r in df.select(units.format_duration(df.s)).collect()] == ["0.4s", "12s", "1m 35s", "1h 2m"]
    df = spark.createDataFrame([(512,), (1536,), (3 << 20,)], "n long")
    assert [r[0] for r in df.select(units.format_bytes(df.n)).collect()] == ["512 B", "1.5 KiB", "3.0 MiB"]
    df = spark.createDataFrame([("a/b/c",), ("a",)], "p string")
    assert [r[0] for r in df.select(units.ancestors(df.p)).collect()] == [["a", "a/b"], []]


def test_sizes_in_every_unit(spark):
    units_of = ("KiB", "MiB", "GiB", "TiB", "PiB")
    sizes = [m * 1024**i // 4 + e for i in range(1, 6) for m in (4, 5, 7, 9, 11, 401, 4003, 4095) for e in (-1, 0, 1) if m * 1024**i // 4 + e >= 1024**i and (not e or m * 1024**i < 2**53)]
    wanted = []
    for n in sizes:
        i = max(i for i in range(1, 6) if n >= 1024**i)
        wanted.append(f"{n / 1024**i:.1f} {units_of[i - 1]}")
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(units.format_bytes(df.n)).collect()] == wanted


def test_claims_match_a_parent_first_walk(spark):
    rng = random.Random(3)
    paths = sorted({"/".join(rng.choice("ab") for _ in range(rng.randint(1, 5))) for _ in range(60)})
    claims = {p: rng.random() < 0.3 for p in paths}
    kept = []
    for p in sorted(paths, key=lambda p: p.count("/")):
        if not any(claims[k] and p.startswith(k + "/") for k in kept):
            kept.append(p)
    df = spark.createDataFrame(list(claims.items()), "path string, claims boolean")
    assert sorted(r[0] for r in catalogue.surviving_claims(df).select("path").collect()) == sorted(kept)


def test_similar_sets_against_brute_force(spark):
    rng = random.Random(5)
    sets = {i: {rng.randint(0, 30) for _ in range(rng.randint(1, 12))} for i in range(60)}
    sets |= {100 + i: s | {99} for i, s in sets.items()}
    first = {i for i, s in sets.items() if not any(sets[j] == s for j in sets if j < i)}  # equal sets are one
    wanted = {(a, b) for a in first for b in first if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, item long")
    assert {(r[0], r[1]) for r in dedup.similar_sets(df, 0.6).collect()} == wanted


def test_query_language():
    q = search.parse('bare "two words" drive:F -tag:old size:>1k max:2KiB year:1999 nosuch:x', ("drive",))
    assert q.terms == ["bare", "two words", "nosuch:x"] and q.facets == {"drive": ["F"]} and q.not_tags == ["old"]
    assert q.sizes == [(">", 1000.0), ("<", 2048.0)] and q.year == 1999


def test_tree_walk_detection_and_archives(spark, tmp_path):
    model, data = tmp_path / "m" / "repo", tmp_path / "d"
    (model / "sub").mkdir(parents=True)
    data.mkdir()
    (model / "config.json").write_text("{}")
    header = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    (model / "model.safetensors").write_bytes(struct.pack("<Q", len(header)) + header + bytes(24))
    (model / "sub" / "x.bin").write_bytes(b"1")
    with zipfile.ZipFile(data / "a.zip", "w") as z:
        z.writestr("images/1.jpg", "x")
        z.writestr("labels/1.txt", "x")
    with tarfile.open(data / "b.tar", "w") as t:
        t.add(model / "config.json", "c.py")
    (data / "broken.zip").write_bytes(b"no")
    entries = filesystem.walk(spark, str(tmp_path))
    assert entries.count() == 6
    hits = recognise.detected(recognise.directory_profiles(entries.select("path", "size_bytes")))
    found = {r["path"]: r["detector"] for r in hits.collect()}
    assert found[str(model)] == "hf_repo" and str(model / "sub") not in found and found[str(data)] == "archive"
    members = filesystem.archive_members(entries.where(F.col("name").rlike("zip|tar")))
    kinds = {r["archive"].rsplit("/", 1)[1]: r["kind"] for r in recognise.archive_kind(members.where("error is null")).collect()}
    assert kinds == {"a.zip": "yolo_dataset_archive", "b.tar": "archive"}
    facts = filesystem.safetensors_facts(entries.where(F.col("name").endswith("safetensors"))).first()
    assert (facts["param_count"], facts["tensor_count"], facts["truncated"]) == (6, 1, False)
    sized = filesystem.sizes(entries.withColumn("k", F.lit(1)), "k").first()
    assert sized["logical_bytes"] == sized["physical_bytes"]
    assert filesystem.quick_signatures(entries.select("path")).where("quick_sig is null").count() == 0


def test_debounce_and_stream(spark, tmp_path):
    stamps = [0, 1, 2, 10, 11, 12, 13, 14, 15, 16]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(stamps)], "k long, event_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    assert sorted(r["n_events"] for r in watch.sessions(df, "k", 5).collect()) == [3, 7]
    assert [r["n_events"] for r in watch.capped_sessions(df, "k", 5, 4).orderBy("batch").collect()] == [3, 4, 3]
    noise = spark.createDataFrame([("a/x.py", "b/y.py"), ("a/.git/z", None), ("q.tmp", None)], "path string, dest string").withColumn("ts", F.current_timestamp())
    assert sorted(r["path"] for r in watch.quiet_events(noise).collect()) == ["a/x.py", "b/y.py"]
    df.withColumn("path", F.lit("p")).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("k long, event_id long, ts timestamp, path string").parquet(str(tmp_path / "in"))
    watch.apply_incrementally(stream, lambda batch, n: seen.append(batch.count()), str(tmp_path / "check")).awaitTermination(120)
    assert sum(seen) == len(stamps)


def test_any_number_of_markers(spark):
    texts = spark.createDataFrame([(1, "xx m00500 yy m00499"), (2, "M10000"), (3, "none"), (4, None), (5, "")], "id long, t string")
    for n in (501, 10_001):
        markers = spark.range(n).select("id", F.format_string("m%05d", "id").alias("marker"), F.concat(F.lit("label "), F.col("id").cast("string")).alias("label")).withColumnRenamed("id", "seq")
        found = dict(recognise.marker_of(texts, markers, "id", "t").collect())
        assert found == {1: "label 499", 2: "label 10000" if n > 10_000 else None, 3: None, 4: None, 5: None}
    paths = spark.createDataFrame([("a/m00500/m10000/x",)], "path string")
    named = spark.range(10_001).select(F.format_string("m%05d", "id").alias("marker"), F.lit("p").alias("product"), F.col("id").alias("seq"))
    assert [tuple(r) for r in recognise.deepest_marker(paths, named).collect()] == [("a/m00500/m10000/x", "m10000", "p", 2)]


def test_archives_are_listed_whole(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(4001):
            z.writestr(f"train/{i}.jpg", "")
        z.writestr("adapter_config.json", "{}")
        z.writestr("adapter_model.safetensors", "")
    with tarfile.open(tmp_path / "cut.tar.gz", "w:gz") as t:
        for i in range(50):
            (tmp_path / "f").write_bytes(random.Random(i).randbytes(4000))
            t.add(tmp_path / "f", f"{i}.bin")
    whole = (tmp_path / "cut.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("many.zip", "cut.tar.gz")], "path string")
    members = filesystem.archive_members(files)
    kinds = {r["archive"].rsplit("/", 1)[1]: r for r in recognise.archive_kind(members).collect()}
    assert kinds["many.zip"]["kind"] == "adapter_archive" and kinds["many.zip"]["members_listed"] == 4003
    assert 10 < kinds["cut.tar.gz"]["members_listed"] < 50 and members.where("error is not null").count() == 1


def test_search_in_the_row(spark):
    docs = spark.createDataFrame([(1, "The cat; the-dog c++"), (2, "catalogue of THE dogs"), (3, ""), (4, None), (5, "breathe")], "id long, text string")
    assert [r[0] for r in search.match_all(docs, "text", "id", ["the", "do"]).orderBy("id").collect()] == [1, 2]
    scores = dict(search.bm25(docs, "text", "id", ["the", "cat"]).collect())
    assert set(scores) == {1, 2} and scores[1] > scores[2] > 0


def test_passages_of_any_length(spark):
    texts = ["one two three four five six seven eight", "xone two threex", "three four five six sevenx", "seven", "", None, "a  b c d"]
    known = ["two three", "one", "four five six seven", "three four five six seven eight", "wo three four fiv", "b c d", "a  b c", "nine"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    given = spark.createDataFrame(list(enumerate(known)), "item_id long, text string")
    found = sorted(map(tuple, search.passages(docs, "doc_id", "text", given, "item_id", "text").collect()))
    assert found == sorted((i, j) for i, k in enumerate(known) for j, t in enumerate(texts) if t is not None and k in t)


def test_health_and_statistics(spark):
    from shelfmark.operators import health

    files = [(1, "model-00001-of-00004.safetensors", 10), (1, "config.json", 1), (2, "images/train/a.jpg", 5), (2, "images/train/b.jpg", 7), (2, "README.md", 1), (3, "events.out.tfevents.9", 4), (3, "x.gguf.part", 0)]
    summary = health.file_summary(spark.createDataFrame(files, "asset_id long, relpath string, size_bytes long"))
    details = spark.createDataFrame([(1, "model", "transformers", "llm", True), (2, "dataset", None, None, False), (3, "experiment", None, None, False), (4, "adapter", None, None, False)], "asset_id long, kind string, framework string, model_type string, has_model boolean")
    profiles = details.join(summary, "asset_id", "left")
    found = {}
    for r in health.findings(profiles).collect():
        found.setdefault(r["asset_id"], set()).add(r["code"])
    assert found == {
        1: {"model.missing_shards", "model.no_tokenizer"}, 2: {"dataset.no_license", "dataset.no_val_split", "dataset.no_test_split", "dataset.no_annotations"},
        3: {"asset.incomplete_download", "experiment.no_checkpoint"}, 4: {"asset.empty", "adapter.no_base_model", "model.no_weights"},
    }
    scores = {r["asset_id"]: (r["score"], r["status"]) for r in health.health(profiles).collect()}
    assert scores == {1: (65, "error"), 2: (74, "warning"), 3: (72, "error"), 4: (40, "error")}
    own = [health.HealthRule("asset.empty", "error", F.lit(True), "twice"), health.HealthRule("own.rule", "info", F.col("asset_id") == 2, "own")]
    assert {r["asset_id"]: r["score"] for r in health.health(profiles, own=own).collect()} == {1: 40, 2: 46, 3: 47, 4: 40}
    stats = {r["asset_id"]: r["statistics"] for r in health.statistics(profiles).collect()}
    assert stats[1]["shards"] == "1/4" and stats[1]["tokenizer"] == "false" and stats[2]["images"] == "2" and stats[2]["avg_image_bytes"] == "6" and stats[2]["splits"] == "train" and stats[3]["tracker"] == "TensorBoard"
    assert health.findings(profiles.withColumn("files_loaded", F.lit(False))).where("code like 'dataset%'").count() == 0


def test_incremental_tables(spark):
    assets = spark.createDataFrame([("r/a", False), ("r/b", True), ("q/c", False)], "path string, is_missing boolean")
    marked = catalogue.mark_missing(assets, spark.createDataFrame([("r/b",)], "path string"), spark.createDataFrame([("r",), ("r",)], "root string"))
    assert sorted(map(tuple, marked.collect())) == [("q/c", False), ("r/a", True), ("r/b", False)]
    assert catalogue.fingerprints(spark.createDataFrame([(1, "a", None), (2, None, "a")], "g long, x string, y string"), "g", [F.col("x"), F.col("y")]).select("fingerprint").distinct().count() == 2
