"""Records between separators as a Spark data source: ``spark.read.format("tagged_records")``.

Options: ``path`` (a file, or a folder whose files are read; any address that pyarrow opens), ``separator``, and
``field.<name>`` with a pattern whose first group is the field's value. Option keys are not case sensitive, so names of fields are
lower case. A file is one task and is read in blocks, so a record has to fit in memory, a file doesn't. Large single
files are better read with ``read_tagged_export``, which Spark splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK = 1 << 20


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def opened(path: str):
    """The file system of an address, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def pieces(blocks: Iterator[bytes], separator: bytes) -> Iterator[bytes]:
    """What stands between separators, also those that lie across two blocks."""
    rest = b""
    for block in blocks:
        *whole, rest = (rest + block).split(separator)
        yield from whole
    yield rest


class RecordReader(DataSourceReader):
    def __init__(self, path: str, separator: str, fields: dict[str, str]):
        self.path, self.separator, self.fields = path, separator, fields

    def partitions(self) -> list[FilePartition]:
        from pyarrow import fs

        system, path = opened(self.path)
        if system.get_file_info(path).type == fs.FileType.File:
            return [FilePartition(self.path)]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        head = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else self.path.split(path)[0]
        return [FilePartition(head + f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition is None:  # an empty folder
            return
        system, path = opened(partition.path)
        patterns = [re.compile(p) for p in self.fields.values()]
        with system.open_input_stream(path) as f:
            blocks = iter(lambda: f.read(BLOCK), b"")
            pos = 0
            for raw in pieces(blocks, self.separator.encode()):
                value = raw.decode("utf-8", "replace")
                if value.strip():
                    hits = [p.search(value) for p in patterns]
                    yield (partition.path, pos, value, *[(h.group(1).strip() or None) if h else None for h in hits])
                    pos += 1


class TaggedRecords(DataSource):
    """src_file, pos (place in the file, from 0), value, and one string column for each field, null where its pattern isn't found."""

    @classmethod
    def name(cls) -> str:
        return "tagged_records"

    def fields(self) -> dict[str, str]:
        return {k.lower().removeprefix("field."): v for k, v in self.options.items() if k.lower().startswith("field.")}

    def schema(self) -> str:
        return ", ".join(["src_file string", "pos bigint", "value string", *[f"`{c}` string" for c in self.fields()]])

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"], self.options.get("separator", "\n\n"), self.fields())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TaggedRecords)
