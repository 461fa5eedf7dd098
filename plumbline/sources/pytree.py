"""A data source of Python source trees: every .py file below a directory, those with leading underscores or dots too."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes and files that one task reads, about.
TASK_BYTES, TASK_FILES = 32 << 20, 2_000
#: Directories that the driver lists itself; beyond them each directory is a task that lists what is below it.
DRIVER_DIRECTORIES = 2_000
#: How the problem of a file that could not be read begins.
UNREADABLE = "cannot be read: "


class Work(InputPartition):
    """Files to read, or a directory to walk."""

    def __init__(self, root: str, paths: list[str], below: str | None = None):
        self.root, self.paths, self.below = root, paths, below


def _entries(directory: str) -> tuple[list[tuple[str, int]], list[str]]:
    """The .py files of a directory with their sizes, and its directories (no links). One that cannot be listed has none."""
    files: list[tuple[str, int]] = []
    directories: list[str] = []
    try:
        with os.scandir(directory) as found:
            for e in found:
                if e.is_dir(follow_symlinks=False):
                    directories.append(e.path)
                elif e.name.endswith(".py") and not e.is_dir():
                    try:
                        files.append((e.path, e.stat().st_size))
                    except OSError:  # a dangling link: reading it tells
                        files.append((e.path, 0))
    except OSError:
        return [], []
    return sorted(files), sorted(directories)


class PyTreeReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Work]:
        """Files dealt into tasks by size, in the order of their directories; what lies below directories that the driver does not list itself is a task for each."""
        if not os.path.isdir(self.root):
            return [Work(os.path.dirname(self.root), [self.root])]
        out: list[Work] = [Work(self.root, [])]
        size, at = 0, 0
        todo = [self.root]
        while at < len(todo) and at < DRIVER_DIRECTORIES:
            files, directories = _entries(todo[at])
            todo += directories
            for path, n in files:
                if out[-1].paths and (size + n > TASK_BYTES or len(out[-1].paths) >= TASK_FILES):
                    out.append(Work(self.root, []))
                    size = 0
                out[-1].paths.append(path)
                size += n
            at += 1
        return out + [Work(self.root, [], d) for d in todo[at:]]

    def read(self, partition: Work) -> Iterator[tuple]:
        """A file that cannot be read is a row with its problem, so the others go on."""
        todo, paths = [] if partition.below is None else [partition.below], iter(partition.paths)
        while True:
            for p in paths:
                try:
                    with open(p, "rb") as f:
                        content, problem = f.read(), None
                except OSError as e:
                    content, problem = None, f"{UNREADABLE}{type(e).__name__}: {e}"
                yield p, partition.root, content, problem
            if not todo:
                return
            files, directories = _entries(todo.pop())
            paths, todo = iter([p for p, _ in files]), todo + directories[::-1]


class PyTree(DataSource):
    """spark.read.format("pytree").load(directory): path, root, content, problem. A single file may be given too."""

    @classmethod
    def name(cls) -> str:
        return "pytree"

    def schema(self) -> str:
        return "path string, root string, content binary, problem string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PyTreeReader(os.path.abspath(self.options["path"]))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """The .py files below a directory that driver and executors can both reach."""
    spark.dataSource.register(PyTree)
    return spark.read.format("pytree").load(os.path.abspath(path))
