"""S1 as a data source: a walk over a tree of folders that says what it could not read and goes on.

``spark.read.format("notes").load(root)`` after ``register(spark)`` gives (``path``, ``text``, ``error``): a row for every markdown
file, and one, without a text, for every folder or file that cannot be read. Top levels are listed when the scan is
planned, until there is work for all tasks; the rest is walked by the tasks.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Files that a task reads, where a level has many.
FILES = 1_000
#: Rows of a batch are handed on from so many bytes of text.
BATCH_BYTES = 8 << 20


def _error(problem: Exception) -> str:
    """What went wrong, without the path, which stands beside it."""
    return f"{type(problem).__name__}: {os.strerror(problem.errno)}" if getattr(problem, "errno", None) else type(problem).__name__


class Work(InputPartition):
    """What one task does: folders to walk, files to read, and errors found while planning."""

    def __init__(self, folders: list[str], files: list[str], errors: list[tuple[str, str]]):
        self.folders, self.files, self.errors = folders, files, errors


class TreeReader(DataSourceReader):
    """Regular files with the extension ``.md``, below folders whose names do not begin with a dot. Links are not followed."""

    def __init__(self, options: dict):
        self.root = options["path"]
        self.tasks = int(options.get("tasks", "64"))
        self.texts = options.get("texts", "true") == "true"

    def _system(self):
        from pyarrow import fs
        return fs.FileSystem.from_uri(self.root)

    def entries(self, system, folder: str) -> tuple[list[str], list[str]]:
        """Folders and markdown files in a folder."""
        from pyarrow import fs
        folders, files = [], []
        for e in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda e: e.path):
            if isinstance(system, fs.LocalFileSystem) and os.path.islink(e.path):
                continue
            if e.type == fs.FileType.Directory and not e.base_name.startswith("."):
                folders.append(e.path)
            elif e.type == fs.FileType.File and e.base_name.endswith(".md") and e.base_name != ".md":
                files.append(e.path)
        return folders, files

    def partitions(self) -> list[Work]:
        system, root = self._system()
        level, files, errors = [root], [], []
        while level and len(level) < self.tasks:
            deeper = []
            for folder in level:
                try:
                    inner, found = self.entries(system, folder)
                    deeper += inner
                    files += found
                except OSError as problem:
                    errors.append((folder, _error(problem)))
            level = deeper
        share = -(-len(level) // self.tasks) or 1
        work = [Work(level[i: i + share], [], []) for i in range(0, len(level), share)]
        step = max(1, min(FILES, -(-len(files) // self.tasks)))
        work += [Work([], files[i: i + step], []) for i in range(0, len(files), step)]
        return work + [Work([], [], errors)]

    def _rows(self, work: Work) -> Iterator[dict]:
        system, _ = self._system()
        for path, error in work.errors:
            yield {"path": path, "text": None, "error": error}
        folders, files = list(reversed(work.folders)), list(work.files)
        while folders or files:
            for path in files:
                try:
                    text = None
                    if self.texts:
                        with system.open_input_stream(path) as file:
                            text = file.read().decode("utf-8", "replace")
                    yield {"path": path, "text": text, "error": None}
                except OSError as problem:
                    yield {"path": path, "text": None, "error": _error(problem)}
            files = []
            if folders:
                folder = folders.pop()
                try:
                    inner, files = self.entries(system, folder)
                    folders += reversed(inner)
                except OSError as problem:
                    yield {"path": folder, "text": None, "error": _error(problem)}

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("path", pa.string()), ("text", pa.string()), ("error", pa.string())])
        rows, size = [], 0
        for row in self._rows(partition):
            rows.append(row)
            size += 200 + len(row["text"] or "")
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)


class NoteTree(DataSource):
    """The ``notes`` format. Options: ``tasks`` to deal the walk to, ``texts`` (false: only paths and errors)."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "path string, text string, error string"

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def scan(spark: SparkSession, root: str, texts: bool = True, source: type[NoteTree] = NoteTree) -> DataFrame:
    """(``path``, ``text``, ``error``) of everything under a root."""
    spark.dataSource.register(source)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format(source.name()).option("tasks", str(tasks)).option("texts", str(texts).lower()).load(root)


def notes(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``text``) of every note under a root that can be read."""
    return scan(spark, root).where("error IS NULL").select("path", "text")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(``path``, ``error``) of folders that cannot be listed; no file is opened."""
    return scan(spark, root, texts=False).where("error IS NOT NULL").select("path", "error")
