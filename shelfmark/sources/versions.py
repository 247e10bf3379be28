"""Tables of a catalogue in buckets.

A version is a manifest: for each table its schema and the folder that holds
each bucket. Publishing writes the buckets that it replaces under a new
number; all others stay where they are. The manifest comes last, so a failed
write leaves the version before, and it names the last batch of each stream
that went in, so a batch that comes again is told.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"

#: Buckets of a new catalogue.
BUCKETS = 32


@dataclass
class Manifest:
    number: int = 0
    buckets: int = BUCKETS
    tables: dict[str, dict[str, str]] = field(default_factory=dict)
    schemas: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)


class Store:
    """The folder of a catalogue, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, f"{folder.rstrip('/')}/versions"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, *parts: object) -> str:
        return "/".join([self.folder, *map(str, parts)])

    def names(self, place: str) -> list[str]:
        path = self._path(place)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        """Numbers of whole versions, ascending."""
        return sorted(int(n) for n in self.names(self.folder) if n.isdigit() and self._fs.exists(self._path(self.at(n, MANIFEST))))

    def manifest(self, number: int | None = None) -> Manifest | None:
        """The last whole version's, or that of a number; None where there is none."""
        numbers = self.numbers()
        if not numbers:
            return None
        return Manifest(**json.loads(self.text(self.at(number or numbers[-1], MANIFEST))))

    def exists(self, place: str) -> bool:
        return self._fs.exists(self._path(place))

    def delete(self, place: str) -> None:
        self._fs.delete(self._path(place), True)

    def text(self, place: str) -> str | None:
        """A small file's text; None where there is none."""
        if not self.exists(place):
            return None
        stream = self._fs.open(self._path(place))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, place: str, text: str) -> None:
        """Writes a small file; readers see the old one or all of the new one."""
        new = self._path(f"{place}.{uuid.uuid4().hex}.new")
        out = self._fs.create(new)
        out.write(text.encode())
        out.close()
        self._fs.delete(self._path(place), False)
        self._fs.rename(new, self._path(place))

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table of the last whole version, or some buckets of it; ValueError where there is no catalogue."""
        held = self.manifest()
        if held is None:
            raise ValueError(f"no catalogue in {self.folder.removesuffix('/versions')}")
        schema = StructType.fromJson(json.loads(held.schemas[name])) if name in held.schemas else StructType()
        places = [p for b, p in held.tables.get(name, {}).items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def draft(self) -> Draft:
        return Draft(self)

    def forget(self, manifests: list[Manifest]) -> None:
        """Deletes what only the first of these versions, in ascending order, holds."""
        if len(manifests) > 1:
            kept = {p for m in manifests[1:] for t in m.tables.values() for p in t.values()}
            for place in {p for t in manifests[0].tables.values() for p in t.values()} - kept:
                self._fs.delete(self._path(place), True)
            self._fs.delete(self._path(self.at(manifests[0].number, MANIFEST)), False)


class Draft:
    """A version in the making."""

    def __init__(self, store: Store):
        self.store, self.before = store, store.manifest() or Manifest()
        self.number = self.before.number + 1
        self.buckets = self.before.buckets
        store._fs.delete(store._path(store.at(self.number)), True)  # what a failed write left

    def scratch(self, name: str, frame: DataFrame) -> DataFrame:
        """``frame`` written beside the tables, for this version's use only."""
        place = self.store.at(self.number, "_scratch", name)
        frame.write.parquet(place)
        return self.store.spark.read.schema(frame.schema).parquet(place)

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.coalesce(key, F.lit(0)), F.lit(self.buckets)).cast("int")

    def publish(self, tables: dict[str, tuple[DataFrame, Column, set[int] | None]], applied: dict[str, int] | None = None) -> Manifest:
        """Writes (rows, key of the bucket, buckets that these rows replace or None for all) of each table, and marks the version as whole.

        A replaced bucket without rows is empty from now on; tables that aren't
        named stay. Of older versions the one before stays, for readers that
        are at it.
        """
        store, made = self.store, Manifest(self.number, self.buckets, {k: dict(v) for k, v in self.before.tables.items()}, dict(self.before.schemas), self.before.applied | (applied or {}))
        for name, (rows, key, replaced) in tables.items():
            place = store.at(self.number, name)
            # a large bucket is dealt over several tasks and files
            rows.withColumn("bucket", self.bucket(key)).repartition("bucket", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(4))).write.partitionBy("bucket").parquet(place)
            new = {n.removeprefix("bucket="): f"{place}/{n}" for n in store.names(place) if n.startswith("bucket=")}
            old = {} if replaced is None else {b: p for b, p in made.tables.get(name, {}).items() if int(b) not in replaced}
            if not set(new).isdisjoint(old):
                raise ValueError(f"rows of {name} lie in buckets that aren't replaced")
            made.tables[name], made.schemas[name] = old | new, rows.schema.json()
        store._fs.delete(store._path(store.at(self.number, "_scratch")), True)
        store.put(store.at(self.number, MANIFEST), json.dumps(made.__dict__))
        store.forget([store.manifest(n) for n in store.numbers()[-3:]] if len(store.numbers()) > 2 else [])
        return made
