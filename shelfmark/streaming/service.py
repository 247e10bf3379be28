"""A catalogue that follows its folders: listings are compared, changes debounced, and what they touch is scanned again."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark import library
from shelfmark.sources.changes import FLUSH, changes
from shelfmark.sources.versions import Store
from shelfmark.streaming.debounce import PROVIDER, debounced
from shelfmark.streaming.watch import is_quiet, rescan_targets

QUIET_SECONDS, MOST_SECONDS = 2.0, 30.0

#: Seconds between two runs that catch up with what happened while nothing watched.
CATCH_UP_SECONDS = 900

NONE = {"running": False, "pid": None, "roots": [], "batches": 0, "paths": 0, "inserted": 0, "updated": 0, "missing": 0, "errors": 0, "last_batch_at": None, "caught_up_at": None, "stream": ""}


class Watch:
    """The watcher of a catalogue's folder. Its files lie in ``_watch`` there: listings, the checkpoint, the status, batches that failed.

    A batch that fails is kept in ``_watch/failed`` with its paths and reason,
    is counted, and doesn't stop the stream. The catalogue and the watched
    folders must be visible to driver and executors.
    """

    def __init__(self, spark: SparkSession, folder: str, quiet_seconds: float = QUIET_SECONDS, most_seconds: float = MOST_SECONDS, exclude: str = ""):
        self.spark, self.folder, self.exclude = spark, folder, exclude
        self.quiet, self.most = quiet_seconds, most_seconds
        self.store = Store(spark, folder)
        self.own = f"{folder.rstrip('/')}/_watch"
        self._busy = threading.Lock()

    def roots(self) -> list[str]:
        """The enabled roots of the catalogue; RuntimeError where there are none."""
        found = [r["root"] for r in library.table(self.spark, self.folder, "roots").where("enabled").select("root").orderBy("root").collect()]
        if not found:
            raise RuntimeError("no folders to watch; scan some first")
        return found

    def status(self) -> dict:
        """What the watcher does and has done."""
        return NONE | json.loads(self.store.text(f"{self.own}/status.json") or "{}")

    def _tell(self, **news) -> dict:
        told = self.status() | news
        self.store.put(f"{self.own}/status.json", json.dumps(told))
        return told

    def request_stop(self) -> bool:
        """Asks a watcher, of any process, to stop; True if one is running."""
        self.store.put(f"{self.own}/stop", "")
        return self.status()["running"]

    def _stream(self) -> DataFrame:
        if not self.status()["stream"]:
            self._tell(stream=uuid.uuid4().hex)
        if "RocksDB" not in self.spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
        listings = self.own.removeprefix("file://")
        seen = changes(self.spark, self.roots(), f"{listings}/listings", exclude=self.exclude)
        excluded = tuple(x.strip().lower() for x in self.exclude.split(",") if x.strip())
        told = seen.where(F.col("path").isNull() | (is_quiet(F.col("path"), excluded) if excluded else is_quiet(F.col("path"))))
        # each listing has one time, later than all before: nothing is late
        return debounced(told, self.quiet, self.most, "0 seconds")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Scans what a micro-batch of debounced paths touches; one that went in before changes nothing."""
        # a thread of its own: scans have large plans, and a stream's thread has little stack left
        with self._busy, ThreadPoolExecutor(1) as one:
            one.submit(self._apply, batch, number).result()

    def _apply(self, batch: DataFrame, number: int) -> None:
        paths = batch.select("path").where("path <> ''").distinct()
        n = paths.count()
        if not n:
            return
        stream = self.status()["stream"]
        try:
            assets = library.present(self.spark, self.folder).select(F.col("path").alias("root"))
            roots = library.table(self.spark, self.folder, "roots").where("enabled").select("root")
            targets = [r["target"] for r in rescan_targets(paths, assets, roots).orderBy("target").collect()]  # bounded by rescan_targets, or the roots
            made = library.rescan(self.spark, self.folder, targets, self.exclude, f"watch-{stream}", number)
            actions = {r["action"]: r["count"] for r in library.table(self.spark, self.folder, "assets").groupBy("action").count().collect()} if made else {}
            told = self.status()
            self._tell(batches=told["batches"] + made, paths=told["paths"] + n * made, last_batch_at=time.time(), **{k: told[k] + actions.get(k, 0) for k in ("inserted", "updated", "missing")})
        except Exception as e:  # noqa: BLE001  whatever it was, the next batch is to be tried
            paths.write.mode("overwrite").parquet(f"{self.own}/failed/{stream}-{number}/paths")
            self.store.put(f"{self.own}/failed/{stream}-{number}/reason", f"{type(e).__name__}: {e}")
            self._tell(errors=self.status()["errors"] + 1, last_batch_at=time.time())

    def start(self, seconds: float = 1.0) -> StreamingQuery:
        """Watches from now on, in a stream that the caller stops."""
        return self._written().trigger(processingTime=f"{seconds} seconds").start()

    def _written(self):
        return self._stream().writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.own}/checkpoint")

    def drain(self) -> None:
        """Lists once, takes in what changed since the last listing and all that is pending, and ends. The first listing ever is what later ones are compared with."""
        flag = f"{self.own}/listings/{FLUSH}"
        self.store.put(flag, "")
        try:
            flushed = False
            while not flushed:  # a run that finds a batch unfinished does that one again, as it was planned, and no other
                query = self._written().trigger(availableNow=True).start()
                query.awaitTermination()
                plans = [n for n in self.store.names(f"{self.own}/listings") if n.startswith("plan-") and n.endswith(".json")]
                newest = max(plans, key=lambda n: int(n[5:-5]), default=None)
                flushed = newest is None or json.loads(self.store.text(f"{self.own}/listings/{newest}"))["flush"]
        finally:
            self.store.delete(flag)

    def catch_up(self, least_seconds: float = CATCH_UP_SECONDS) -> bool:
        """drain(), unless a watcher runs or the last one was too recent; True if it ran."""
        told = self.status()
        if told["running"] or told["caught_up_at"] and time.time() - told["caught_up_at"] < least_seconds:
            return False
        self.drain()
        self._tell(caught_up_at=time.time())
        return True

    def run(self, seconds: float = 1.0, ready: Callable[[list[str]], None] | None = None) -> dict:
        """Watches until request_stop() or an interrupt, takes in what is pending, and returns the status."""
        self.store.delete(f"{self.own}/stop")
        query = self.start(seconds)
        self._tell(running=True, pid=os.getpid(), roots=self.roots())
        if ready:
            ready(self.roots())
        try:
            while not self.store.exists(f"{self.own}/stop"):
                if query.awaitTermination(1):
                    break
        except KeyboardInterrupt:
            pass
        finally:
            with self._busy:  # a batch that goes in just now is waited for
                query.stop()
            self.store.delete(f"{self.own}/stop")
            self.drain()
            self._tell(running=False, pid=None)
        return self.status()
