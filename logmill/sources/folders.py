"""A data source that lists files, also those that Spark's file readers leave out.

Planning expands folders level by level until there are enough of them (``FOLDERS``) or
the tree ends. Those of the last level are dealt to at most ``FOLDERS`` partitions, whose
tasks list them and all below them; each folder above is a partition of its own. So the
files of a tree are never in one place, and no file is opened. Any store that pyarrow
reaches can be listed (local and shared folders, object stores, HDFS with its client library).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

FOLDERS = 256


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The store of a path or address, the path within it, and what goes before paths of the result."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file:"
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/"), "file:"
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def entries(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    return sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda e: e.path)


@dataclass
class Folders(InputPartition):
    paths: list[str]
    below: bool


class FolderReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool) -> None:
        self.path, self.recursive = path, recursive

    def partitions(self) -> list[Folders]:
        store, root, _ = store_of(self.path)
        if not self.recursive:
            return [Folders([root], False)]
        listed, level = [], [root]
        while level and len(listed) + len(level) < FOLDERS:
            listed += level
            level = [e.path for folder in level for e in entries(store, folder) if e.type == fs.FileType.Directory]
        dealt = [level[i::FOLDERS] for i in range(min(FOLDERS, len(level)))]
        return [*(Folders([f], False) for f in listed), *(Folders(part, True) for part in dealt)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        store, _, before = store_of(self.path)
        folders = list(partition.paths)
        while folders:
            for entry in entries(store, folders.pop()):
                if entry.type == fs.FileType.File:
                    yield before + entry.path, entry.base_name, entry.size, entry.mtime
                elif entry.type == fs.FileType.Directory and partition.below:
                    folders.append(entry.path)


class FolderListing(DataSource):
    """``spark.read.format("folder_listing").option("recursive", "true").load(path)``:
    (path, name, size_bytes, modified) of every file."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, name string, size_bytes long, modified timestamp"

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("recursive", "false").lower() == "true")
