"""A data source over folders of files that opens text files and reads only their first characters.

The folder is listed once, where the query is planned; names are dealt to tasks, and a task reads each of
its files in small pieces until the wanted number of characters is decoded. So memory does not depend on
the size of a file, and a file of any size gives its head.

Defined results: undecodable bytes are dropped before characters are counted, line ends become ``\\n``; a file
without one of the suffixes, an empty one, and one that is gone or closed to us by the time it is opened have an
empty head; a folder without files gives no rows, a missing folder is an error. Names starting with ``_`` are files
like any other.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "file_heads"
FILES_PER_TASK = 2_000


def open_folder(uri: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before such a path to get a full name)."""
    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").strip("/"), "file:"
    system, root = fs.FileSystem.from_uri(uri)
    whole = uri.rstrip("/")
    return system, root.rstrip("/"), whole[: len(whole) - len(root.rstrip("/"))]


def head_of(stream, max_chars: int) -> str:
    """The first characters of a binary stream, read piece by piece."""
    return io.TextIOWrapper(stream, encoding="utf-8", errors="ignore").read(max_chars)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class HeadsReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.uri = options["path"]
        self.max_chars = int(options["max_chars"])
        self.suffixes = tuple("." + s for s in options["suffixes"].lower().split(","))
        self.recursive = options.get("recursive", "false").lower() == "true"

    def partitions(self) -> list[Files]:
        system, root, _ = open_folder(self.uri)
        found = system.get_file_info(fs.FileSelector(root, recursive=self.recursive))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File)
        return [Files(files[at : at + FILES_PER_TASK]) for at in range(0, len(files), FILES_PER_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, prefix = open_folder(self.uri)
        for path, length in partition.files:
            head = ""
            if path.lower().endswith(self.suffixes) and self.max_chars > 0:
                try:
                    with system.open_input_stream(path) as stream:
                        head = head_of(stream, self.max_chars)
                except (FileNotFoundError, PermissionError):
                    head = ""
            yield prefix + path, length, head


class FileHeads(DataSource):
    """Options: ``path``, ``max_chars``, ``suffixes`` (comma-joined, without dots), ``recursive``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, length long, head string"

    def reader(self, schema) -> HeadsReader:
        return HeadsReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileHeads)
