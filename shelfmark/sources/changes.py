"""Changes of watched folders as a stream: each trigger lists them anew and is compared with the last listing."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.parse
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from shelfmark.sources.filesystem import FileEntryReader, Tree

SCHEMA = "key string, path string, ts timestamp, kind string"

#: A file of this name in the state's folder makes the next listing end with a flush of each root.
FLUSH = "flush"


class Listing(InputPartition):
    def __init__(self, root: str, top: str, deep: bool, start: int, end: int, flush: bool):
        self.root, self.top, self.deep, self.start, self.end, self.flush = root, top, deep, start, end, flush


class FileChanges(DataSource):
    """``spark.readStream.format("fs_changes").load(roots)``: (key, path, ts, kind), key being the root.

    A file that is new, differs in size or time of change, or is gone, comes
    once as created, modified or deleted; a move is both of its ends. Each
    root also gives a tick, so that time goes on where nothing changes. Options: state
    (a folder that driver and executors share), initial (``all``: files of the
    first listing come as created; else it is where changes start from), and
    those of fs_entries. Listings are kept by their offset, so a micro-batch
    that runs again gives the same changes. Roots and top folders are listed in parallel.
    """

    @classmethod
    def name(cls) -> str:
        return "fs_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FileChangeReader(dict(self.options))


class FileChangeReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.state = options["state"]
        self.all_at_first = options.get("initial") == "all"
        self.last = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        """Milliseconds of the clock, which rise from one trigger to the next and over restarts."""
        self.last = max(self.last + 1, time.time_ns() // 1_000_000)
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[Listing]:
        """A partition for each root and each of its top folders, those that are gone included, as listed when the offset was first planned."""
        plan = os.path.join(self.state, f"plan-{end['at']}.json")
        if not os.path.exists(plan):
            os.makedirs(self.state, exist_ok=True)
            now = self._tops() | {(top, root) for top, root in self._planned(start["at"])}
            _kept(plan, json.dumps({"tops": sorted(now), "flush": os.path.exists(os.path.join(self.state, FLUSH))}))
        with open(plan, encoding="utf-8") as f:
            held = json.load(f)
        return [Listing(root, top, bool(top), start["at"], end["at"], held["flush"]) for top, root in held["tops"]]

    def read(self, part: Listing) -> Iterator[tuple]:
        before = dict(self._listing(part.start, part)) if part.start else {}
        place = self._place(part.end, part)
        if not os.path.exists(place):
            found, unread = {}, []
            for path, _, size, mtime, *_, error in FileEntryReader(self.options).read(Tree(part.top or part.root, part.deep)):
                if error is None:
                    found[path] = [size, mtime]
                elif error != "FileNotFoundError":
                    unread.append(path)
            # what can't be read just now isn't gone
            found |= {p: v for p, v in before.items() if p not in found and any(p == x or p.startswith(x + "/") for x in unread)}
            _kept(place, "".join(json.dumps([p, *v]) + "\n" for p, v in sorted(found.items())))
        ts = datetime.fromtimestamp(part.end / 1000, UTC)
        if part.start or self.all_at_first:
            after = dict(self._listing(part.end, part))
            for path in sorted(before.keys() | after.keys()):
                if before.get(path) != after.get(path):
                    yield part.root, path, ts, "created" if path not in before else "deleted" if path not in after else "modified"
        if not part.top:
            yield part.root, None, ts, "flush" if part.flush else "tick"

    def commit(self, end: dict) -> None:
        """Listings before the one committed aren't needed any more."""
        for name in os.listdir(self.state):
            if (m := re.match(r"(?:plan-|list-)(\d+)", name)) and int(m[1]) < end["at"]:
                os.remove(os.path.join(self.state, name))

    def stop(self) -> None:
        pass

    def _tops(self) -> set[tuple[str, str]]:
        """(top folder, its root), and ("", root) for the files that lie in a root itself."""
        roots = [r.rstrip("/") or "/" for r in self.options["path"].split(",") if r]
        return {(t.root if t.deep else "", r) for r in roots for t in FileEntryReader({**self.options, "path": r}).partitions()}

    def _planned(self, at: int) -> list[list[str]]:
        """The partitions of an earlier offset."""
        try:
            with open(os.path.join(self.state, f"plan-{at}.json"), encoding="utf-8") as f:
                return [x for x in json.load(f)["tops"]]
        except FileNotFoundError:
            return []

    def _place(self, at: int, part: Listing) -> str:
        return os.path.join(self.state, f"list-{at}-{urllib.parse.quote((part.top or part.root) + ('' if part.deep else '/.'), safe='')}")

    def _listing(self, at: int, part: Listing) -> Iterator[tuple[str, list]]:
        """What was listed; nothing for a folder that wasn't there yet."""
        try:
            with open(self._place(at, part), encoding="utf-8") as f:
                for line in f:
                    path, *facts = json.loads(line)
                    yield path, facts
        except FileNotFoundError:
            return


def _kept(path: str, text: str) -> None:
    """Writes a file at once: whoever reads it sees all of it."""
    with open(own := f"{path}.{os.getpid()}.{time.time_ns()}.new", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(own, path)


def changes(spark: SparkSession, roots: list[str], state: str, **options: str) -> DataFrame:
    """The stream of changes below the roots."""
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("fs_changes").options(state=state, **options).load(",".join(roots))
