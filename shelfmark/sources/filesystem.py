"""Reading trees, archives and binary headers."""

from __future__ import annotations

import fnmatch
import itertools
import json
import lzma
import os
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, name string, size_bytes long, mtime double, inode long, device long, nlink int, is_symlink boolean, error string"

#: Members that are listed together.
LISTED_ROWS = 10_000


class Tree(InputPartition):
    def __init__(self, root: str, deep: bool):
        self.root, self.deep = root, deep


class FileEntries(DataSource):
    """``spark.read.format("fs_entries").load(root)``: one row a file, one partition a top folder.

    Options: exclude (folder names, comma-separated), exclude_files (globs),
    depth. The paths must be visible to all executors. A folder that can't be
    read gives a row with its error.
    """

    @classmethod
    def name(cls) -> str:
        return "fs_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileEntryReader(dict(self.options))


class FileEntryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [r for r in options["path"].split(",") if r]
        self.excluded = {x.strip().lower() for x in options.get("exclude", "").split(",") if x.strip()}
        self.globs = [x for x in options.get("exclude_files", "").split(",") if x]
        self.depth = int(options.get("depth", 40))

    def partitions(self) -> list[Tree]:
        out = []
        for root in self.roots:
            out.append(Tree(root, False))
            try:
                out += [Tree(e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and e.name.lower() not in self.excluded]
            except OSError:
                pass  # the root's own partition reports it
        return out

    def read(self, part: Tree):
        waiting, seen = [(part.root, 0)], set()
        while waiting:
            folder, depth = waiting.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                yield (folder, os.path.basename(folder), None, None, None, None, None, None, type(e).__name__)
                continue
            for e in entries:
                try:
                    s = e.stat(follow_symlinks=False)
                except OSError as x:  # gone since the folder was read
                    yield (e.path, e.name, None, None, None, None, None, None, type(x).__name__)
                    continue
                if e.is_dir(follow_symlinks=False):
                    known = (s.st_dev, s.st_ino)
                    if part.deep and depth < self.depth and e.name.lower() not in self.excluded and known not in seen:
                        seen.add(known)
                        waiting.append((e.path, depth + 1))
                elif not any(fnmatch.fnmatch(e.name, g) for g in self.globs):
                    yield (e.path, e.name, s.st_size, s.st_mtime, s.st_ino, s.st_dev, s.st_nlink, e.is_symlink(), None)


def walk(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(FileEntries)
    return spark.read.format("fs_entries").options(**options).load(root)


def sizes(files: DataFrame, key: str) -> DataFrame:
    """(key, logical_bytes, physical_bytes): symbolic links count nowhere, and hard links once a key in the second."""
    real = files.where("not is_symlink")
    once = real.where("nlink > 1").groupBy(key, "device", "inode").agg(F.max("size_bytes").alias("size_bytes")).select(key, "size_bytes")
    physical = real.where("nlink <= 1").select(key, "size_bytes").unionAll(once).groupBy(key).agg(F.sum("size_bytes").alias("physical_bytes"))
    return real.groupBy(key).agg(F.sum("size_bytes").alias("logical_bytes")).join(physical, key)


def archive_members(files: DataFrame) -> DataFrame:
    """(archive, name, size, error) of all members of zip and tar files(path), from their tables of contents; an archive that can't be read on gives a row with its error behind those listed so far."""

    def members(path: str):
        try:
            if zipfile.is_zipfile(path):
                with zipfile.ZipFile(path) as z:
                    for i in z.infolist():
                        if not i.is_dir():
                            yield (path, i.filename.removeprefix("./"), i.file_size, None)
            else:
                with tarfile.open(path) as t:
                    for m in t:
                        if m.isfile():
                            yield (path, m.name.removeprefix("./"), m.size, None)
                        t.members = []  # else every header stays in memory
        except (OSError, EOFError, NotImplementedError, RuntimeError, ValueError, tarfile.TarError, zipfile.BadZipFile, zlib.error, lzma.LZMAError) as e:
            yield (path, None, None, type(e).__name__)

    def listed(batches):
        for batch in batches:
            rows = itertools.chain.from_iterable(members(path) for path in batch["path"])
            while some := list(itertools.islice(rows, LISTED_ROWS)):
                yield pd.DataFrame(some, columns=["archive", "name", "size", "error"]).astype({"size": "Int64"})

    return files.select("path").mapInPandas(listed, "archive string, name string, size long, error string")


def safetensors_facts(files: DataFrame) -> DataFrame:
    """(path, param_count, tensor_count, truncated, error) from the headers of safetensors files(path)."""

    def read(path: str) -> tuple:
        try:
            with open(path, "rb") as f:
                (n,) = struct.unpack("<Q", f.read(8))
                if n > 100 << 20:
                    return path, None, None, None, "header too long"
                header = json.loads(f.read(n))
            tensors = [t for k, t in header.items() if k != "__metadata__"]
            count = 0
            for t in tensors:
                size = 1
                for d in t["shape"]:
                    size *= d
                count += size
            end = max([t["data_offsets"][1] for t in tensors], default=0)
            return path, count, len(tensors), end > os.path.getsize(path) - 8 - n, None
        except (OSError, ValueError, KeyError, struct.error) as e:
            return path, None, None, None, type(e).__name__

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([read(p) for p in batch["path"]], columns=["path", "param_count", "tensor_count", "truncated", "error"]).astype({"param_count": "Int64", "tensor_count": "Int64", "truncated": "boolean"})

    return files.select("path").mapInPandas(run, "path string, param_count long, tensor_count long, truncated boolean, error string")


def quick_signatures(files: DataFrame, piece: int = 4 << 20) -> DataFrame:
    """files with quick_sig: a digest of size, head and tail; null where a file can't be read."""

    def of(path: str) -> str | None:
        import hashlib

        try:
            size = os.path.getsize(path)
            h = hashlib.blake2b(size.to_bytes(8, "little"), digest_size=16)
            with open(path, "rb") as f:
                h.update(f.read(piece if size > 2 * piece else -1))
                if size > 2 * piece:
                    f.seek(-piece, os.SEEK_END)
                    h.update(f.read(piece))
            return h.hexdigest()
        except OSError:
            return None

    return files.withColumn("quick_sig", F.pandas_udf(lambda paths: paths.map(of), "string")("path"))


def full_digests(files: DataFrame, piece: int = 4 << 20) -> DataFrame:
    """files with sha256: the digest of the whole file, read in pieces; null where it can't be read."""

    def of(path: str) -> str | None:
        import hashlib

        try:
            h = hashlib.sha256()
            with open(path, "rb") as f:
                while part := f.read(piece):
                    h.update(part)
            return h.hexdigest()
        except OSError:
            return None

    return files.withColumn("sha256", F.pandas_udf(lambda paths: paths.map(of), "string")("path"))
