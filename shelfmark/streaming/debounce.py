"""Debounced batches of a stream of file events: a pending set and two timers a key.

A batch of a key is what came until nothing came for a while (quiet), or until
its first event is old enough (cap). Events are taken in order of event time:
they wait until the watermark has passed them, so batches don't depend on how
the stream was cut into micro-batches, nor on a restart in between.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an event is; a tick only moves time on, a flush closes all that its key has pending.
KINDS = ("created", "modified", "deleted", "tick", "flush")

#: One row a batch and path. events_seen and batches_seen count the key's up to and with the batch.
OUTPUT = "key string, batch long, path string, n long, first_us long, last_us long, n_events long, events_seen long, batches_seen long"

#: Spark's state store for processors with timers and maps.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NEVER = (1 << 63) - 1

#: Events that are held before they are written to state in blocks, or handed out.
BLOCK_ROWS = 1 << 17


def packed(table: pa.Table) -> bytes:
    """A block of rows as one value of state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pa.Table:
    return pa.ipc.open_stream(value).read_all()


class Debounce(StatefulProcessor):
    """Frames (key, path, us, kind) to frames of OUTPUT.

    State holds blocks, not events: (us, path) of a slot of time that the
    watermark hasn't passed, and (path, n) of the open batch. So what an event
    costs is its part of a block, in memory are those of one slot, those up to BLOCK_ROWS,
    and the distinct paths of a batch when it closes.
    """

    def __init__(self, quiet_seconds: float, most_seconds: float):
        self.quiet, self.most = int(quiet_seconds * 1e6), int(most_seconds * 1e6)
        self.slot = max(1, self.most // 4)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, nth long", "rows binary")
        self.pending = handle.getListState("pending", "rows binary")
        self.open = handle.getValueState("open", "first_us long, last_us long, n_events long")
        self.counters = handle.getValueState("counters", "events_seen long, batches_seen long")
        self.timer = handle.getValueState("timer", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        flush, held, slots = False, [], self._slots()
        for frame in rows:
            flush = flush or bool((frame["kind"] == "flush").any())
            events = frame[~frame["kind"].isin(("tick", "flush"))]
            held.append(pa.table({"us": pa.array(events["us"], pa.int64()), "path": pa.array(events["path"], pa.string())}))
            if sum(map(len, held)) >= BLOCK_ROWS:
                self._wait(held, slots)
                held = []
        self._wait(held, slots)
        yield from self._settled(key, NEVER if flush else timerValues.getCurrentWatermarkInMs() * 1000, slots)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        yield from self._settled(key, timerValues.getCurrentWatermarkInMs() * 1000, self._slots())

    def _slots(self) -> Counter:
        """How many blocks wait in each slot of time."""
        return Counter(slot for slot, _ in self.waiting.keys()) if self.waiting.exists() else Counter()

    def _wait(self, held: list[pa.Table], slots: Counter) -> None:
        """Adds a block to each slot of time that the events lie in."""
        table = pa.concat_tables(held).sort_by("us") if held else []
        if len(table):
            slot = table["us"].to_numpy() // self.slot
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1).tolist(), len(slot)]
            for begin, end in zip(cuts, cuts[1:]):
                at = int(slot[begin])
                self.waiting.updateValue((at, slots[at]), (packed(table.slice(begin, end - begin)),))
                slots[at] += 1

    def _settled(self, key, until_us: int, slots: Counter) -> Iterator[pd.DataFrame]:
        """Takes in what stands up to the watermark, hands out the batches that this closes, and sets the timer for what comes next."""
        now = self.open.get() if self.open.exists() else None
        self.seen, self.batches = self.counters.get() if self.counters.exists() else (0, 0)
        before, after, held, done = self.batches, NEVER, [], []
        for at in sorted(slots):
            if at * self.slot > until_us:
                after = min(after, at * self.slot)
                break
            table = pa.concat_tables([unpacked(self.waiting.getValue((at, i))[0]) for i in range(slots[at])]).sort_by("us")
            for i in range(slots[at]):
                self.waiting.removeKey((at, i))
            us = table["us"].to_numpy()
            ready = int(np.searchsorted(us, until_us, "right"))
            if ready < len(us):
                self.waiting.updateValue((at, 0), (packed(table.slice(ready)),))
                after = int(us[ready])
            us = us[:ready]
            gaps, numbers, i = np.flatnonzero(np.diff(us) >= self.quiet) + 1, np.empty(ready, np.int64), 0
            while i < ready:
                if now and us[i] >= self._closes(now):
                    done.append(now)
                    now = None
                first = now[0] if now else int(us[i])
                gap = int(np.searchsorted(gaps, i, "right"))
                # up to the cap, or to what comes after a quiet time
                end = max(i + 1, min(int(np.searchsorted(us, first + self.most)), int(gaps[gap]) if gap < len(gaps) else ready))
                now = (first, int(us[end - 1]), (now[2] if now else 0) + end - i)
                numbers[i:end] = self.batches + len(done)
                i = end
            held.append(pa.table({"batch": numbers, "path": table["path"].slice(0, ready), "n": np.ones(ready, np.int64)}))
            if sum(map(len, held)) >= BLOCK_ROWS:
                yield from self._told(key, held, done)
                held, done = [], []
        if now and until_us >= self._closes(now):
            done.append(now)
            now = None
        yield from self._told(key, held, done)
        if now:
            self.open.update(tuple(now))
        elif self.open.exists():
            self.open.clear()
        if self.batches > before:
            self.counters.update((self.seen, self.batches))
        self._wake(min(after, self._closes(now) if now else NEVER))

    def _closes(self, batch) -> int:
        return min(batch[1] + self.quiet, batch[0] + self.most)

    def _told(self, key, held: list[pa.Table], done: list[tuple]) -> Iterator[pd.DataFrame]:
        """Hands out the batches done, from number self.batches on; what is held of the open one after them goes to state."""
        if done and self.pending.exists():  # the first of them began in an earlier call
            held = held + [self._numbered(unpacked(rows), self.batches) for (rows,) in self.pending.get()]
            self.pending.clear()
        if held:
            rows = pa.concat_tables(held).group_by(["batch", "path"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["batch", "path", "n"])
            still = pc.greater_equal(rows["batch"], self.batches + len(done))
            if pc.any(still).as_py():
                self.pending.appendValue((packed(rows.filter(still).select(["path", "n"])),))
            rows = rows.filter(pc.invert(still))
            if len(rows):
                nth = rows["batch"].to_numpy() - self.batches
                first, last, n = np.array(done, np.int64).T
                seen = self.seen + np.cumsum(n)
                yield pd.DataFrame({
                    "key": key[0], "batch": nth + self.batches, "path": rows["path"].to_pandas(), "n": rows["n"].to_numpy(), "first_us": first[nth], "last_us": last[nth], "n_events": n[nth], "events_seen": seen[nth],
                    "batches_seen": nth + self.batches + 1,
                })
        self.seen, self.batches = self.seen + sum(n for _, _, n in done), self.batches + len(done)

    @staticmethod
    def _numbered(rows: pa.Table, batch: int) -> pa.Table:
        return pa.table({"batch": np.full(len(rows), batch, np.int64), "path": rows["path"], "n": rows["n"]})

    def _wake(self, us: int) -> None:
        """One timer a key, at the time given; a timer runs once the watermark has reached it."""
        at = NEVER if us == NEVER else -(-us // 1000)
        old = self.timer.get()[0] if self.timer.exists() else None
        if at == old:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at != NEVER:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def debounced(events: DataFrame, quiet_seconds: float = 2.0, most_seconds: float = 30.0, delay: str = "10 minutes") -> DataFrame:
    """Batches (OUTPUT) of a stream events(key, path, ts, kind), to be written in append mode.

    Times are event times. Events of one key further back than ``delay``
    behind the newest of the stream are late and dropped, as in any stream with
    a watermark. A null key, path or kind counts as an empty string, and as an
    event; null times are dropped. Repeated events count in n and n_events,
    and a path stands once in a batch. The session needs the state store PROVIDER.
    """
    keyed = events.where("ts is not null").select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), F.coalesce("path", F.lit("")).alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("kind", F.lit("modified")).alias("kind"))
    timed = keyed.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(Debounce(quiet_seconds, most_seconds), OUTPUT, "Append", "EventTime")


def batches_of(rows: DataFrame) -> DataFrame:
    """(key, batch, first_us, last_us, n_events, n_paths) of debounced rows, once each."""
    return rows.groupBy("key", "batch", "first_us", "last_us", "n_events").agg(F.count("*").alias("n_paths"))
