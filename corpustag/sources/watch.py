"""A folder of notes as a stream of versions, files edited in place included.

``spark.readStream.format("note_folder").load(root)`` after ``register(spark)``. The offset is the place of the last
file in the order of (modification time, path). A file that is edited gets a later time and is read again.
"""

from __future__ import annotations

import bisect
import datetime as dt
import os
import pickle
import sys
import time
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, version_ts timestamp, op string, text string, own boolean"
#: Files read by one task, as long as there are not more tasks than ``TASKS``; then they read more.
FILES, TASKS = 256, 2_048
#: Rows of a batch are handed on from so many bytes of text.
BATCH_BYTES = 8 << 20


class Files(InputPartition):
    """Some files, packed as the driver holds those of all tasks, and whether the stream sees them in its first batch."""

    def __init__(self, files: list[tuple[int, str]], op: str):
        parts = [path.rpartition("/") for _, path in files]
        folders = {folder: k for k, folder in enumerate(dict.fromkeys(p[0] for p in parts))}
        self.packed = zlib.compress(pickle.dumps((
            [t for t, _ in files], list(folders), [folders[p[0]] for p in parts], "\0".join(p[2] for p in parts))), 6)
        self.op = op

    @property
    def files(self) -> list[tuple[int, str]]:
        times, folders, places, names = pickle.loads(zlib.decompress(self.packed))
        return [(t, f"{folders[k]}/{name}") for t, k, name in zip(times, places, names.split("\0"))] if times else []


class Listing:
    """Files as (modification time, path), in this order, without an object per file: a table of folders, and a string of all names."""

    def __init__(self):
        self.folders: list[str] = []
        self.names = bytearray()
        self.at, self.times, self.of = array("q", [0]), array("q"), array("q")
        self.order = np.zeros(0, np.int64)

    def add(self, mtime: int, folder: str, name: str) -> None:
        if not self.folders or self.folders[-1] != folder:
            self.folders.append(folder)
        self.names += name.encode()
        self.at.append(len(self.names))
        self.times.append(mtime)
        self.of.append(len(self.folders) - 1)

    def _path(self, i: int) -> str:
        return f"{self.folders[self.of[i]]}/{self.names[self.at[i]:self.at[i + 1]].decode()}"

    def sorted(self) -> Listing:
        times = np.frombuffer(self.times, np.int64) if self.times else np.zeros(0, np.int64)
        self.order = np.argsort(times, kind="stable")
        own = times[self.order]
        edges = np.flatnonzero(np.diff(own, prepend=own[:1] - 1, append=own[-1:] + 1))
        for a, z in zip(edges[:-1], edges[1:]):
            if z - a > 1:  # files of the same time go by path
                self.order[a:z] = sorted(self.order[a:z].tolist(), key=self._path)
        return self

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, k: int) -> tuple[int, str]:
        i = int(self.order[k])
        return self.times[i], self._path(i)


class FolderReader(DataSourceStreamReader):
    """Versions of the markdown files under a root.

    A listing is compared with the offset, so no version that is there to be read is missed; one that is overwritten before it
    is read is not seen, the newer one is, and comes again with the next listing. Hidden folders are skipped, as are folders and files
    that cannot be read. Files changed within the last ``settle`` seconds wait for the next listing, as others of the same time may follow.
    The listing that gave an offset also gives the files up to it, so a trigger lists the folder once; it is held until the batch is over.
    """

    def __init__(self, options: dict):
        self.root = options["path"]
        self.settle = float(options.get("settle", "0"))
        self.files = int(options["filespertask"]) if "filespertask" in options else None
        self.found = Listing()

    def initialOffset(self) -> dict:
        return {"mtime": -1, "path": ""}

    @staticmethod
    def _entries(system, folder: str) -> Iterator[tuple[str, bool, int]]:
        """Names in a folder, whether they are folders, and modification times of files; of a local folder one after the other."""
        from pyarrow import fs
        if not isinstance(system, fs.LocalFileSystem):
            for e in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if e.type in (fs.FileType.Directory, fs.FileType.File):
                    yield e.base_name, e.type == fs.FileType.Directory, e.mtime_ns
            return
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_dir():
                        yield e.name, True, 0
                    elif e.name.endswith(".md") and e.is_file():
                        e.name.encode()
                        yield e.name, False, e.stat().st_mtime_ns
                except (OSError, UnicodeError):
                    continue

    def _listed(self) -> Listing:
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(self.root)
        found, folders = Listing(), [root]
        newest = time.time_ns() - int(self.settle * 1e9)
        while folders:
            folder = folders.pop().rstrip("/")
            try:
                for name, is_folder, mtime in self._entries(system, folder or "/"):
                    if is_folder:
                        if not name.startswith("."):
                            folders.append(f"{folder}/{name}")
                    elif name.endswith(".md") and mtime <= newest:
                        found.add(mtime, folder, name)
            except OSError:
                continue
        return found.sorted()

    def latestOffset(self) -> dict:
        self.found = self._listed()
        return {"mtime": self.found[-1][0], "path": self.found[-1][1]} if len(self.found) else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        first, last = (start["mtime"], start["path"]), (end["mtime"], end["path"])
        listed = self.found if len(self.found) and self.found[-1] == last else self._listed()
        a, z = bisect.bisect_right(listed, first), bisect.bisect_right(listed, last)
        share = self.files or max(FILES, -(-(z - a) // TASKS))
        op = "create" if start["mtime"] < 0 else "modify"
        return [Files([listed[k] for k in range(i, min(i + share, z))], op) for i in range(a, z, share)] or [Files([], op)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        system, _ = fs.FileSystem.from_uri(self.root)
        kind = pa.schema([("path", pa.string()), ("version_ts", pa.timestamp("us", "UTC")), ("op", pa.string()), ("text", pa.string()),
                          ("own", pa.bool_())])
        rows, size = [], 0
        for mtime, path in partition.files:
            try:
                with system.open_input_stream(path) as file:
                    text = file.read().decode("utf-8", "replace")
            except OSError:
                continue
            at = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=mtime // 1000)
            rows.append({"path": path, "version_ts": at, "op": partition.op, "text": text, "own": None})
            size += 200 + len(text)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, kind)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    def commit(self, end: dict) -> None:
        self.found = Listing()


class NoteFolder(DataSource):
    """The ``note_folder`` format. Options: ``settle`` (seconds), ``filesPerTask`` (if not given, 256, and more than that from 2,048 tasks on)."""

    @classmethod
    def name(cls) -> str:
        return "note_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NoteFolder)


def read_folder(spark: SparkSession, root: str, settle: float = 1.0) -> DataFrame:
    """A stream over the notes under a root; the first batch is the full scan."""
    register(spark)
    return spark.readStream.format("note_folder").option("settle", str(settle)).load(root)
