"""Files of a folder as a Spark data source: listed and read in tasks, one row per file whatever its state.

Neither the driver nor the planner lists anything. Each of `slices` tasks walks the upper `depth` levels of the folder, and of
what it finds at them it takes the entries whose path falls to it by hash: a file is read, a folder below the last of
these levels is walked to its end. A folder of any number of files is so dealt over all tasks, and each deep folder is
listed by one.
"""

from __future__ import annotations

import fnmatch
import re
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "folder_files"
SCHEMA = "path string, modificationTime timestamp, length bigint, content binary, problem string"


def globs(pattern: str) -> list[str]:
    """A pattern with {a,b} choices as patterns without."""
    choice = re.search(r"\{([^{}]*)\}", pattern)
    return [g for one in choice[1].split(",") for g in globs(pattern[: choice.start()] + one + pattern[choice.end() :])] if choice else [pattern]


def hidden(name: str) -> bool:
    """Names that Spark's own file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


@dataclass
class Slice(InputPartition):
    """Of `of` parts the one of number `number`; files changed after `after` and up to `until`, in nanoseconds."""

    number: int
    of: int
    after: int | None = None
    until: int | None = None


class Folder:
    """What both readers share: the options, whose names Spark gives in lower case, and the rows of one slice."""

    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("maxbytes", 25 * 1024 * 1024))
        self.patterns, self.content = globs(options.get("pattern", "*")), options.get("content", "true").lower() == "true"
        self.slices, self.depth, self.settle = int(options.get("slices", 16)), int(options.get("depth", 2)), float(options.get("settle", 2))

    def opened(self):
        """The file system, the root's path in it, and what stands before such a path in a URI."""
        from pyarrow import fs

        # Spark writes file:/x, which is file:///x
        system, root = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", self.uri))
        root = root.rstrip("/")
        local = isinstance(system, fs.LocalFileSystem)
        return system, root, "file:" if local else self.uri.rstrip("/").removesuffix(root)

    def check(self) -> None:
        from pyarrow import fs

        system, root, _ = self.opened()
        if system.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(f"no such path: {self.uri}")

    def rows(self, part: Slice) -> Iterator[tuple]:
        from pyarrow import fs

        system, root, prefix = self.opened()
        mine = lambda path: zlib.crc32(path.encode()) % part.of == part.number

        def of_file(info) -> Iterator[tuple]:
            if not any(fnmatch.fnmatchcase(info.base_name, p) for p in self.patterns):
                return
            if part.until is not None and not part.after < (info.mtime_ns or 0) <= part.until:
                return
            content, problem = None, None
            try:
                if info.type != fs.FileType.File:
                    problem = "not a file that can be read"
                elif self.content and info.size <= self.most:
                    with system.open_input_stream(info.path, compression=None) as stream:
                        content = stream.read()
            except OSError as error:
                problem = f"unreadable: {type(error).__name__}"
            when = None if info.mtime_ns is None else datetime.fromtimestamp(info.mtime_ns / 1e9, UTC)
            yield prefix + info.path, when, info.size, content, problem

        # folders yet to be listed, each with its level; those beyond `depth` are wholly this task's own
        top = system.get_file_info(root)
        if top.type == fs.FileType.File:
            yield from of_file(top) if mine(top.path) else ()
            return
        waiting = [(root, 1)]
        while waiting:
            folder, level = waiting.pop()
            try:
                found = system.get_file_info(fs.FileSelector(folder))
            except OSError as error:
                if level > self.depth or mine(folder):
                    yield prefix + folder, None, None, None, f"unreadable folder: {type(error).__name__}"
                continue
            for info in found:
                if hidden(info.base_name):
                    continue
                if info.type == fs.FileType.Directory:
                    if level != self.depth or mine(info.path):
                        waiting.append((info.path, level + 1))
                elif level > self.depth or mine(info.path):
                    yield from of_file(info)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = Folder(options)

    def partitions(self):
        self.folder.check()
        return [Slice(k, self.folder.slices) for k in range(self.folder.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.folder.rows(partition)


class FolderStream(DataSourceStreamReader):
    """An offset is a moment: a batch has the files last changed between two moments, so nothing is listed to plan one and
    the same two moments give the same files again."""

    def __init__(self, options: dict):
        self.folder = Folder(options)

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.folder.settle * 1e9)}

    def partitions(self, start: dict, end: dict):
        return [Slice(k, self.folder.slices, start["until"], end["until"]) for k in range(self.folder.slices)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.folder.rows(partition)


class FolderFiles(DataSource):
    """Options: path; pattern (of the name; *, ?, [], {a,b}); content (false: names and sizes only); maxBytes (larger files
    come without content); slices (tasks); depth (levels that all tasks list); settle (for a stream: seconds that a file
    must have been left alone, more than the clocks differ). A file that is written again later comes again; one moved in
    with a time of change before the last batch is not seen."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> str:
    """The format's name, known to the session."""
    spark.dataSource.register(FolderFiles)
    return NAME


def can_list(path: str) -> bool:
    """Whether tasks can reach the path by themselves: a local path or the scheme of a store that Arrow opens."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return scheme is None or scheme[1].lower() in ("file", "s3", "gs", "gcs", "abfs", "abfss")
