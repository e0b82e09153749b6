"""A data source of files: names, sizes and first lines, listed in tasks.

Spark's own file sources pass over files of no bytes and read contents before a size is known; this one has a row for each file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, bytes long, header string, problem string"
BATCH = 4096


def open_store(path: str):
    """(file system, root) of a path or URI; s3a and s3n are read as s3. A path without scheme is local."""
    from pyarrow import fs

    if not re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", path):
        return fs.LocalFileSystem(), os.path.abspath(path).rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].strip("/")
    store, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return store, root.rstrip("/")


def hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def first_line(store, path: str, most: int) -> tuple[str | None, str | None]:
    """(line, problem): the first line of a file, without a byte order mark; of one that has none, is longer than `most` bytes or isn't UTF-8, why."""
    got = b""
    try:
        with store.open_input_stream(path) as f:
            while not (cut := re.search(rb"[\r\n]", got)) and len(got) <= most and (more := f.read(8192)):
                got += more
        line = (got[: cut.start()] if cut else got).decode("utf-8-sig")
    except UnicodeDecodeError:
        return None, "not text"
    except OSError as e:
        return None, f"not read: {type(e).__name__}"
    if not cut and len(got) > most:
        return None, "first line too long"
    return (line, None) if line.strip() else (None, "first line blank")


class Prefixes(InputPartition):
    """Folders to walk and files (name, bytes) already seen, below a root."""

    def __init__(self, folders: list[str], files: list[tuple[str, int]]):
        self.folders, self.files = folders, files


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.heads = options["path"], options.get("headers", "false").lower() == "true"
        self.group, self.most = int(options.get("group", "64")), int(options.get("headerbytes", str(1 << 20)))

    def partitions(self) -> list[InputPartition]:
        """A partition for each `group` of the root's folders, and for each 16 times as many of its own files."""
        from pyarrow import fs

        store, root = open_store(self.path)
        own = [f for f in store.get_file_info(fs.FileSelector(root)) if not hidden(f.base_name)]
        folders = sorted(f.base_name for f in own if f.type == fs.FileType.Directory)
        files = sorted((f.base_name, f.size) for f in own if f.type == fs.FileType.File)
        wide = 16 * self.group
        parts = [Prefixes(folders[i : i + self.group], []) for i in range(0, len(folders), self.group)] + [Prefixes([], files[i : i + wide]) for i in range(0, len(files), wide)]
        return parts or [Prefixes([], [])]  # Spark reads a source of no partitions as one of None

    def walk(self, store, root: str, part: Prefixes) -> Iterator[tuple[str, int]]:
        """Files of a partition, a folder at a time, so that a task holds the names of one folder."""
        from pyarrow import fs

        yield from part.files
        left = list(reversed(part.folders))
        while left:
            below = left.pop()
            for f in store.get_file_info(fs.FileSelector(f"{root}/{below}")):
                if hidden(f.base_name):
                    continue
                if f.type == fs.FileType.Directory:
                    left.append(f"{below}/{f.base_name}")
                elif f.type == fs.FileType.File:
                    yield f"{below}/{f.base_name}", f.size

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, root = open_store(self.path)
        rows = []
        for name, size in self.walk(store, root, partition):
            line, problem = (None, "no bytes") if not size else first_line(store, f"{root}/{name}", self.most) if self.heads else (None, None)
            rows.append((name, size, line, problem))
            if len(rows) == BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)


def batch(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["name", "bytes", "header", "problem"])


class FileListing(DataSource):
    """Options: path; headers (false) to read first lines; group (64), the folders of a partition; headerbytes (1 MiB), the longest first line."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError("file_listing needs a path")
        return ListingReader(dict(self.options))


def listing(spark: SparkSession, path: str, headers: bool = False, group: int = 64) -> DataFrame:
    """(name, bytes, header, problem) of all files below a folder, by name relative to it; hidden files and folders are passed over.

    The driver lists the root only; tasks list a group of its folders each and read first lines where asked. problem says
    why a header is null: no bytes, first line blank or too long, not text, not read; a file that fails isn't an error.
    """
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").options(path=path, headers=str(headers).lower(), group=str(group)).load()
