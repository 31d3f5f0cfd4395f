"""Files as a Spark data source: a partition reads a group of files of about equal bytes, each with the reader that its extension is registered for.

    register(spark, READERS | {".own": (read_own, LINE)})
    spark.read.format("located_lines").option("groupBytes", 1 << 26).load("/data")

Rows are lines (path, line_index, text, location), and one row with a reason for each file that can't be read. Whatever is wrong with a file is its reason, and the
others of its group are read. The driver lists files, a path and a length each; contents are read in tasks alone, one file at a time, so a task
holds the largest file of its group and not the group. A task that is lost is run again from its paths.

Files are listed and opened by pyarrow's file systems: local folders, HDFS and the object stores that they know. What only Spark's own readers reach, and
texts too large for a row, are for read_documents().
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import LINE_END
from .files import BINARY, LINE, PROBE, READERS, ROW_MOST, TOO_LARGE, outcome, read_html

NAME = "located_lines"
SCHEMA = "path string, line_index long, text string, location string, reason string"
_ARROW = pa.schema([("path", pa.string()), ("line_index", pa.int64()), ("text", pa.string()), ("location", pa.string()), ("reason", pa.string())])
#: Bytes of files in a partition; lines that a task hands over at once.
GROUP_BYTES, ROWS = 1 << 27, 10_000
_EXTENSION = re.compile(r"\.*[^.].*?(\.[^.]*)", re.S)
_LINE_END = re.compile(LINE_END)


@dataclass
class Group(InputPartition):
    """The files of a partition, with their lengths."""

    files: Sequence[tuple[str, int]]


def grouped(files: Sequence[tuple[str, int]], most: int) -> list[list[tuple[str, int]]]:
    """Files in order of path, cut into groups of at most `most` bytes; a larger file is a group by itself. Every file counts a byte more, so that no group has empty ones without end."""
    out: list[list[tuple[str, int]]] = []
    size = 0
    for path, length in sorted(files):
        if not out or size + length + 1 > most:
            out.append([])
            size = 0
        out[-1].append((path, length))
        size += length + 1
    return out


def extension_of(path: str) -> str:
    """extension(), of a Python text."""
    found = _EXTENSION.fullmatch(path.rsplit("/", 1)[-1])
    return found[1].lower() if found else ""


def read_text(content: bytes) -> list[str]:
    """Lines as lines(decoded()) gives them."""
    parts = _LINE_END.split(content.decode("utf-8", "replace"))
    return parts if parts[-1] else parts[:-1]


class _Reader(DataSourceReader):
    def __init__(self, folder: str, readers: dict, group: int, most: int):
        self.folder, self.readers, self.group, self.most = folder, readers, group, most

    def partitions(self) -> list[Group]:
        where, path = fs.FileSystem.from_uri(self.folder)
        found = where.get_file_info(fs.FileSelector(path, recursive=True)) if where.get_file_info(path).type == fs.FileType.Directory else [where.get_file_info(path)]
        inside = lambda p: p[len(path) :].strip("/").split("/")
        files = [(x.path, x.size) for x in found if x.type == fs.FileType.File and not any(part[:1] in ("_", ".") for part in inside(x.path))]
        return [Group(files) for files in grouped(files, self.group)] or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(self.folder)
        for path, length in partition.files:
            found, unit, reason = self._one(where, path, length)
            if reason is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, None, None, None, reason), _ARROW, strict=True)], schema=_ARROW)
            for a in range(0, len(found or ()), ROWS):
                some = found[a : a + ROWS]
                numbers = range(a, a + len(some))
                columns = [[path] * len(some), list(numbers), some, [f"{unit} {k + 1}" for k in numbers], [None] * len(some)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    def _one(self, where: fs.FileSystem, path: str, length: int) -> tuple[list[str] | None, str, str | None]:
        """Lines, unit and reason of a file. What is gone or may not be opened has a reason as well; a store that doesn't answer makes the task fail, and Spark runs it again."""
        own = self.readers.get(extension_of(path))
        if length > self.most:
            return None, LINE, TOO_LARGE
        try:
            with where.open_input_stream(path, compression=None) as stream:
                content = stream.read()
        except (FileNotFoundError, PermissionError) as e:
            return None, LINE, f"no se pudo extraer el texto ({type(e).__name__})"
        if (own is None or own[0] is read_html) and b"\0" in content[:PROBE]:
            return None, LINE, BINARY
        read, unit = own or (read_text, LINE)
        found, reason = outcome(read, content)
        return found, unit, reason


class LocatedLines(DataSource):
    """The source over the readers of READERS; register() makes one for a caller's own."""

    readers = READERS
    called = NAME

    @classmethod
    def name(cls) -> str:
        return cls.called

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise ValueError(f"{self.called} needs a folder or a file to load")
        return _Reader(self.options["path"], self.readers, int(self.options.get("groupBytes", GROUP_BYTES)), int(self.options.get("maxBytes", ROW_MOST)))


def register(spark: SparkSession, readers: dict | None = None, name: str = NAME) -> str:
    """Make the source known to the session, under a name, with readers by extension (function from bytes to lines, unit of locations). Options: groupBytes, maxBytes. Gives the name."""
    kind = type("LocatedLines", (LocatedLines,), {"readers": READERS if readers is None else readers, "called": name, "__module__": "__main__"})
    spark.dataSource.register(kind)
    return name
