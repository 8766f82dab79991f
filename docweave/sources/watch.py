"""A watched folder as a stream: files come once they have stopped growing, each
exactly once across restarts, and move to another folder when their batch is done.

A Python data source: an offset names the files of its batch with size and time,
so the checkpoint says what a batch was. A repeated batch finds a file where it
lies now, in the folder or in ``done``. Offsets stay small, as a batch takes at
most ``maxFiles`` and files of finished batches have moved away. A file of the same
name that comes again is another file.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "name string, size long, content binary"
_SPLIT = "\x1f"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


#: files and bytes that one task reads
_FILES, _BYTES = 256, 32 << 20


class _Taken(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.done = options["path"], options.get("done")
        self.wait, self.most = float(options.get("stableseconds", 1)), int(options.get("maxfiles", 1000))

    def _listed(self) -> dict[str, str]:
        """Files by name: name, size and time as one key."""
        fs, base = _open(self.folder)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        return {f.base_name: _SPLIT.join((f.base_name, str(f.size), str(f.mtime_ns))) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": []}

    def latestOffset(self) -> dict:  # noqa: N802
        """The files that did not change while it waited."""
        before = self._listed()
        if before:
            time.sleep(self.wait)
        now = self._listed()
        stable = sorted(k for n, k in now.items() if before.get(n) == k)
        return {"files": stable[: self.most]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old = set(start["files"])
        groups: list[list[str]] = []
        held = 0
        for k in (k for k in end["files"] if k not in old):
            size = int(k.split(_SPLIT)[1])
            if not groups or len(groups[-1]) >= _FILES or held + size > _BYTES:
                groups.append([])
                held = 0
            groups[-1].append(k)
            held += size
        return [_Taken(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for key in partition.keys:
            yield self._content(key)

    def _content(self, key: str) -> tuple:
        name, size, _ = key.split(_SPLIT)
        for place in (self.folder, self.done):
            if place:
                fs, base = _open(place)
                try:
                    with fs.open_input_stream(f"{base}/{name}") as f:
                        return (name, int(size), f.read())
                except FileNotFoundError:
                    continue
        raise FileNotFoundError(f"{name} is neither in the folder nor among those done")

    def commit(self, end: dict) -> None:
        """The batch is written: its files move to ``done``, where one is given."""
        if not self.done:
            return
        fs, base = _open(self.folder)
        _, to = _open(self.done)
        fs.create_dir(to, recursive=True)
        here = self._listed()
        names = [n for n, key in ((k.split(_SPLIT)[0], k) for k in end["files"]) if here.get(n) == key]
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda n: fs.move(f"{base}/{n}", f"{to}/{n}"), names))


class WatchedFolder(DataSource):
    """``spark.readStream.format("docweave_folder").option("done", ...).load(folder)``;
    ``stableSeconds`` and ``maxFiles`` (of a batch) may be given."""

    @classmethod
    def name(cls) -> str:
        return "docweave_folder"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802, ANN001
        return FolderReader(dict(self.options))


def watch_folder(spark: SparkSession, folder: str, done: str | None = None, *, stable_seconds: float = 1, max_files: int = 1000):  # noqa: ANN201
    """The stream of a folder's files: name, size, content."""
    spark.dataSource.register(WatchedFolder)
    reader = spark.readStream.format(WatchedFolder.name()).option("stableSeconds", stable_seconds).option("maxFiles", max_files)
    return (reader.option("done", done) if done else reader).load(folder)
