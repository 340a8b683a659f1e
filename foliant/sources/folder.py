"""A folder of documents as a Python data source: its parts are walked by tasks, and what can't be read is a row with a reason.

    spark.dataSource.register(FolderSource)
    spark.read.format("document_folder").option("path", "/docs").load()

The folder must be one that all executors see under the same path. Object stores, which have no links and no depth, are read by
files.scan() with Spark's own file source."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file_path string, length bigint, modified timestamp, content binary, reason string"
SUFFIXES = (".md", ".markdown", ".txt")
MOST_BYTES, DEPTH, LINKS = 1 << 20, 50, 5
#: Folders are split until there are so many parts.
PARTS = 64


@dataclass
class Part(InputPartition):
    """A folder with its depth, and whether all below it belongs to the part or only its own files."""

    folder: str
    depth: int
    deep: bool


def links_before(path: str, most: int) -> int:
    """How many links lead from a path to what is no link; at most `most` + 1 are followed."""
    n = 0
    while os.path.islink(path) and n <= most:
        path = os.path.join(os.path.dirname(path), os.readlink(path))
        n += 1
    return n


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = os.path.realpath(options["path"])
        self.depth = int(options.get("depth", DEPTH))
        self.most_bytes = int(options.get("most_bytes", MOST_BYTES))
        self.links = int(options.get("links", LINKS))
        self.parts = int(options.get("parts", PARTS))
        if not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {options['path']}")

    def folders(self, folder: str) -> list[str]:
        """Folders right below one, by name, without those that cannot be listed or that links lead to round about or outside."""
        try:
            found = sorted(e.path for e in os.scandir(folder) if e.is_dir())
        except OSError:
            return []
        return [f for f in found if not self.refused(f)]

    def refused(self, path: str) -> str | None:
        """Why a file or folder is not followed."""
        if os.path.islink(path):
            if links_before(path, self.links) > self.links:
                return "link_depth"
            real = os.path.realpath(path)
            if not os.path.exists(real):
                return "broken_link"
            if os.path.commonpath([real, self.root]) != self.root:
                return "outside"
            if os.path.isdir(real) and os.path.commonpath([os.path.realpath(os.path.dirname(path)), real]) == real:
                return "link_loop"
        return None

    def partitions(self) -> list[Part]:
        """The folder, split level by level into folders, of which each is a part, until there are enough; names only are read here."""
        level, done, depth = [self.root], [], 0
        while level and len(level) + len(done) < self.parts and depth < self.depth - 1:
            below = [f for folder in level for f in self.folders(folder)]
            if not below:
                break
            done += [Part(f, depth, False) for f in level]
            level, depth = below, depth + 1
        return done + [Part(f, depth, True) for f in level]

    def read(self, partition: Part) -> Iterator[tuple]:
        work = [(partition.folder, partition.depth)]
        while work:
            folder, depth = work.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as error:
                yield self.failed(folder, error)
                continue
            for entry in entries:
                wanted = entry.name.lower().endswith(SUFFIXES)
                reason = self.refused(entry.path)
                if reason:
                    if wanted or reason != "broken_link":
                        yield (entry.path, None, None, None, reason)
                elif entry.is_dir():
                    if depth + 1 >= self.depth:
                        yield (entry.path, None, None, None, "too_deep")
                    elif partition.deep:
                        work.append((entry.path, depth + 1))
                elif wanted and entry.is_file():
                    yield self.file(entry.path)

    def file(self, path: str) -> tuple:
        from datetime import datetime, timezone

        real = os.path.realpath(path)
        try:
            found = os.stat(real)
            at = datetime.fromtimestamp(found.st_mtime, timezone.utc)
            if found.st_size > self.most_bytes:
                return (real, found.st_size, at, None, "too_large")
            with open(real, "rb") as file:
                data = file.read(self.most_bytes + 1)
        except OSError as error:
            return self.failed(real, error)
        try:
            data.decode()
        except UnicodeDecodeError:
            return (real, len(data), at, None, "not_text")
        return (real, len(data), at, data, None)

    @staticmethod
    def failed(path: str, error: OSError) -> tuple:
        return (path, None, None, None, f"unreadable: {error.strerror}")


class FolderSource(DataSource):
    """Options: path, depth (levels of files below the folder), most_bytes, links (length of a chain of links), parts."""

    @classmethod
    def name(cls) -> str:
        return "document_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options)
