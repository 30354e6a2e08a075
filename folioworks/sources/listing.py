"""Listing of directory trees as a Spark data source, and hashing of large files.

A partition is a subtree, walked by its task: excluded folders are not entered,
links are not followed or listed, what cannot be read is passed over.  The trees
must be mounted under the same path on all executors.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.paths import EXCLUDED_DIRS, glob_regex

#: Subtrees that the driver looks for, and how deep; bytes that are hashed at once; files of an Arrow batch.
SUBTREES, DEPTH, READ, FILES = 256, 3, 1 << 20, 2000
SUFFIX = re.compile(r".+\.([^.]+)")


@dataclass
class Subtree(InputPartition):
    """A folder below the root; without ``deep`` only the files in it."""

    relative: str
    deep: bool


@dataclass
class Walk:
    root: str
    extensions: frozenset[str] | None
    excludes: list[re.Pattern[str]] = field(default_factory=list)

    def wanted(self, relative: str) -> bool:
        return not any(p.match(relative) for p in self.excludes)

    def entries(self, relative: str) -> tuple[list[str], list[tuple[str, os.DirEntry]]]:
        """Folders to enter and files to list in one folder, as relative paths."""
        folders, files = [], []
        try:
            with os.scandir(os.path.join(self.root, relative)) as found:
                for e in found:
                    own = f"{relative}/{e.name}" if relative else e.name
                    try:
                        if e.is_symlink() or not self.wanted(own):
                            continue
                        if e.is_dir(follow_symlinks=False):
                            if e.name.lower() not in EXCLUDED_DIRS:
                                folders.append(own)
                        elif e.is_file(follow_symlinks=False):
                            suffix = SUFFIX.fullmatch(e.name)
                            if self.extensions is None or (suffix[1].lower() if suffix else "") in self.extensions:
                                files.append((own, e))
                    except OSError:
                        continue
        except OSError:
            pass
        return sorted(folders), files

    def rows(self, tree: Subtree) -> Iterator[tuple]:
        waiting = [tree.relative]
        while waiting:
            folders, files = self.entries(waiting.pop())
            if tree.deep:
                waiting += folders
            for own, e in files:
                try:
                    st = e.stat(follow_symlinks=False)
                except OSError:
                    continue
                suffix = SUFFIX.fullmatch(e.name)
                yield "file:" + os.path.join(self.root, own), own, e.name, suffix[1].lower() if suffix else "", st.st_size, datetime.fromtimestamp(st.st_mtime, UTC)


class TreeReader(DataSourceReader):
    def __init__(self, walk: Walk) -> None:
        self.walk = walk

    def partitions(self) -> list[InputPartition]:
        """Subtrees of about equal depth: folders are opened until there are many, or they are deep."""
        done, open_ = [Subtree("", False)], [("", 0)]
        while open_ and len(done) + len(open_) < SUBTREES:
            here, depth = open_.pop(0)
            for folder in self.walk.entries(here)[0]:
                if depth + 1 < DEPTH:
                    open_.append((folder, depth + 1))
                    done.append(Subtree(folder, False))
                else:
                    done.append(Subtree(folder, True))
        # what was not opened is walked whole by its task
        rest = {here for here, _ in open_}
        return [Subtree(t.relative, t.deep or t.relative in rest) for t in done]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = [("path", pa.string()), ("relative_path", pa.string()), ("file_name", pa.string()), ("extension", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*held, strict=True), kinds, strict=True)], schema=pa.schema(kinds))

        for row in self.walk.rows(partition):
            held.append(row)
            if len(held) == FILES:
                yield batch()
                held = []
        if held:
            yield batch()


class FileTree(DataSource):
    """``spark.read.format("file_tree")`` with the options ``root``, ``extensions`` and ``excludes`` (JSON lists)."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, relative_path string, file_name string, extension string, size bigint, mtime timestamp"

    def reader(self, schema: StructType) -> DataSourceReader:
        extensions = json.loads(self.options.get("extensions", "null"))
        excludes = [re.compile(glob_regex(p)) for p in json.loads(self.options.get("excludes", "[]"))]
        return TreeReader(Walk(local_path(self.options["root"]), None if extensions is None else frozenset(extensions), excludes))


def local_path(root: str) -> str:
    """The path of a mounted folder; other stores are not walked."""
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"{root} is not a mounted folder")
    return os.path.abspath("/" + root.removeprefix("file:").lstrip("/"))


def list_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """``path, relative_path, file_name, extension, size, mtime`` of the files below a mounted root; all extensions without a choice."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("root", root).option("excludes", json.dumps(excludes or []))
    return (reader.option("extensions", json.dumps([*extensions])) if extensions is not None else reader).load()


def hash_files(files: DataFrame) -> DataFrame:
    """``files(path, ...)`` with ``sha256`` of their bytes, read ``READ`` at a time; null where a file cannot be read."""

    @F.arrow_udf("string")
    def digest(paths: pa.Array) -> pa.Array:
        def one(path: str | None) -> str | None:
            try:
                with open(local_path(path), "rb") as f:
                    own = hashlib.sha256()
                    while part := f.read(READ):
                        own.update(part)
                    return own.hexdigest()
            except (OSError, TypeError, AttributeError):
                return None

        return pa.array([one(p) for p in paths.to_pylist()], pa.string())

    # folders differ in size, so files are dealt anew
    return files.repartition(F.xxhash64("path")).withColumn("sha256", digest(F.col("path")))
