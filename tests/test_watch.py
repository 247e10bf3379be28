"""Streams of file events: listings that are compared, batches that are debounced, a catalogue that follows."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from shelfmark.sources.changes import FLUSH, changes
from shelfmark.streaming import debounce, watch

EVENTS = "key string, path string, ts timestamp, kind string"


@pytest.fixture(scope="module", autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", debounce.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def replayed(spark, folder, quiet, most, delay="1 hour"):
    """Runs over what lies in folder/in, from where the last run ended."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    rows = debounce.debounced(stream, quiet, most, delay)
    query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    return spark.read.parquet(f"{folder}/out")


def test_debounce_equals_capped_sessions_over_restarts(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.lit("modified").alias("kind"), "event_id")
    cut = events.selectExpr("*", "ntile(3) OVER (ORDER BY ts) AS k")
    for k in (1, 2, 3):
        cut.where(f"k = {k}").drop("k", "event_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        seen = replayed(spark, tmp_path, 1800, 7200).count()
    newest = events.agg(F.max("ts")).first()[0]
    events.select("key").distinct().select("key", F.lit("").alias("path"), F.lit(newest).alias("ts"), F.lit("flush").alias("kind")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = replayed(spark, tmp_path, 1800, 7200)
    assert rows.count() > seen  # what was pending at the end came with the flush
    found = sorted(tuple(r) for r in debounce.batches_of(rows).select("key", "batch", "first_us", "last_us", "n_events").collect())
    assert found == sorted(tuple(r) for r in watch.capped_sessions(events, "key", 1800, 7200).select("key", "batch", "first_us", "last_us", "n_events").collect())
    last = rows.groupBy("key").agg(F.max("events_seen").alias("n"), (F.max("batches_seen") - F.max("batch")).alias("one"))
    assert {r["key"]: (r["n"], r["one"]) for r in last.collect()} == {r["key"]: (r["count"], 1) for r in events.groupBy("key").count().collect()}


def test_bursts_repeats_and_caps(spark, tmp_path):
    at = lambda s: f"timestamp_seconds({s})"
    burst = spark.range(300).selectExpr("'burst' AS key", "concat('f', id) AS path", f"{at('1000 + id * 0.001')} AS ts", "'created' AS kind")
    repeats = spark.range(50).selectExpr("'same' AS key", "'config.json' AS path", f"{at('1000 + id * 0.01')} AS ts", "'modified' AS kind")
    steady = spark.range(60).selectExpr("'steady' AS key", "concat('part-', id) AS path", f"{at('1000 + id')} AS ts", "CASE WHEN id % 2 = 0 THEN 'modified' END AS kind")
    odd = spark.sql(f"SELECT CAST(NULL AS STRING) AS key, CAST(NULL AS STRING) AS path, {at(1000)} AS ts, 'created' AS kind UNION ALL SELECT 'x', 'y', NULL, 'created' UNION ALL SELECT 'idle', 'z', {at(2000)}, 'tick'")
    burst.union(repeats).union(steady).union(odd).coalesce(1).write.parquet(f"{tmp_path}/in")
    rows = replayed(spark, tmp_path, 2, 30, "1 second")
    found = {(r["key"], r["batch"]): (r["n_events"], r["n_paths"]) for r in debounce.batches_of(rows).collect()}
    # a burst is one batch, a path stands once in it, and what never goes quiet is cut at the cap; the tick of another key closed all
    assert found == {("burst", 0): (300, 300), ("same", 0): (50, 1), ("steady", 0): (30, 30), ("steady", 1): (30, 30), ("", 0): (1, 1)}


def test_state_holds_blocks_of_events(spark, tmp_path):
    at = lambda s: f"timestamp_seconds({s})"
    spark.range(5000).selectExpr("'k' AS key", "concat('f', id % 40) AS path", f"{at('10000 + id * 0.5')} AS ts", "'modified' AS kind").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
    query = debounce.debounced(stream, 60, 600, "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 100  # one a slot of time, not one an event
    spark.createDataFrame([("k", "", None, "flush")], EVENTS).withColumn("ts", F.expr(at(12600))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows = replayed(spark, tmp_path, 60, 600)
    assert sorted((r["batch"], r["n_events"], r["n_paths"]) for r in debounce.batches_of(rows).collect()) == [(0, 1200, 40), (1, 1200, 40), (2, 1200, 40), (3, 1200, 40), (4, 200, 40)]
    assert rows.agg(F.sum("n")).first()[0] == 5000 and rows.agg(F.max("events_seen")).first()[0] == 5000


def listed(spark, roots, tmp_path, **options):
    """The changes since the last call."""
    query = changes(spark, roots, f"{tmp_path}/state", **options).writeStream.format("parquet").option("path", f"{tmp_path}/seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    rows = spark.read.schema(EVENTS).parquet(f"{tmp_path}/seen")
    newest = rows.agg(F.max("ts")).first()[0]
    return sorted((os.path.relpath(r["path"], tmp_path) if r["path"] else "", r["kind"]) for r in rows.where(F.col("ts") == newest).collect())


def write(path, text="x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_files_made_moved_and_deleted_come_out_once(spark, tmp_path):
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    for path in (f"{a}/m/one.bin", f"{a}/m/deep/two.bin", f"{a}/top.txt", f"{b}/n/three.bin"):
        write(path)
    assert listed(spark, [a, b], tmp_path) == [("", "tick"), ("", "tick")]  # where changes start from
    write(f"{a}/new/four.bin")
    write(f"{a}/top.txt", "longer")
    os.rename(f"{a}/m/one.bin", f"{b}/n/one.bin")
    shutil.rmtree(f"{a}/m/deep")
    wanted = [("", "tick"), ("", "tick"), ("a/m/deep/two.bin", "deleted"), ("a/m/one.bin", "deleted"), ("a/new/four.bin", "created"), ("a/top.txt", "modified"), ("b/n/one.bin", "created")]
    assert listed(spark, [a, b], tmp_path) == wanted
    assert listed(spark, [a, b], tmp_path) == [("", "tick"), ("", "tick")]
    shutil.rmtree(f"{a}/new")  # a whole top folder
    assert listed(spark, [a, b], tmp_path) == [("", "tick"), ("", "tick"), ("a/new/four.bin", "deleted")]
    assert len([x for x in os.listdir(f"{tmp_path}/state") if x.startswith("plan-")]) <= 2
    write(f"{tmp_path}/state/{FLUSH}")
    assert listed(spark, [a, b], tmp_path) == [("", "flush"), ("", "flush")]


def test_first_listing_as_created(spark, tmp_path):
    write(f"{tmp_path}/a/m/one.bin")
    assert listed(spark, [f"{tmp_path}/a"], tmp_path, initial="all") == [("", "tick"), ("a/m/one.bin", "created")]


def test_a_catalogue_follows_its_folders(spark, tmp_path, monkeypatch):
    from shelfmark import library
    from shelfmark.streaming.service import Watch

    root, out = f"{tmp_path}/in", f"{tmp_path}/cat"
    for i in range(3):
        write(f"{root}/m{i}/config.json", '{"model_type": "bert"}')
        write(f"{root}/m{i}/model.safetensors", "x" * (100 + i))
    library.scan(spark, [root], out)
    assets = lambda: {r["name"]: (r["action"], r["is_missing"]) for r in library.table(spark, out, "assets").collect()}
    watch_ = Watch(spark, out, 1, 5)
    watch_.drain()  # the first listing
    assert watch_.status()["batches"] == 0 and watch_.roots() == [root]
    write(f"{root}/m1/model.safetensors", "y" * 500)
    write(f"{root}/m1/.git/index", "noise")
    watch_.drain()
    assert assets() == {"m0": ("kept", False), "m1": ("updated", False), "m2": ("kept", False)}
    assert [watch_.status()[k] for k in ("batches", "paths", "updated", "errors")] == [1, 1, 1, 0]
    number = library.Store(spark, out).manifest().number
    watch_.drain()  # nothing changed, nothing is written
    assert library.Store(spark, out).manifest().number == number
    # a batch that fails is kept, and the next one goes in
    write(f"{root}/m9/config.json", '{"model_type": "bert"}')
    write(f"{root}/m9/model.safetensors")
    with monkeypatch.context() as m:
        m.setattr(library, "rescan", lambda *a, **k: 1 / 0)
        watch_.drain()
    assert watch_.status()["errors"] == 1 and "m9" not in assets()
    failed = os.listdir(f"{out}/_watch/failed")
    assert len(failed) == 1 and "ZeroDivisionError" in open(f"{out}/_watch/failed/{failed[0]}/reason").read()
    shutil.rmtree(f"{root}/m2")
    write(f"{root}/m8/config.json", '{"model_type": "bert"}')
    write(f"{root}/m8/model.safetensors")
    assert watch_.catch_up() and not watch_.catch_up()
    assert assets()["m2"] == ("missing", True) and assets()["m8"][0] == "inserted" and assets()["m9"][0] == "inserted"  # the root was scanned


def test_running_until_asked_to_stop(spark, tmp_path):
    import threading
    import time

    from shelfmark import library
    from shelfmark.streaming.service import Watch

    root, out = f"{tmp_path}/in", f"{tmp_path}/cat"
    write(f"{root}/m0/config.json", '{"model_type": "bert"}')
    write(f"{root}/m0/model.safetensors", "x" * 100)
    library.scan(spark, [root], out)
    watch_ = Watch(spark, out, 0.5, 5)
    told = {}
    thread = threading.Thread(target=lambda: told.update(watch_.run(0.5)))
    thread.start()
    try:
        deadline = time.time() + 90
        while not os.path.exists(f"{out}/_watch/checkpoint/commits/0") and time.time() < deadline:  # the first listing
            time.sleep(0.5)
        write(f"{root}/m0/model.safetensors", "x" * 300)  # just before the stop: still taken in
        assert watch_.status()["running"] and watch_.request_stop()
    finally:
        watch_.request_stop()
        thread.join(180)
    assert not thread.is_alive() and not told["running"] and told["batches"] >= 1 and told["errors"] == 0
    assert library.table(spark, out, "assets").first()["size_bytes"] == 322
