"""Paper directories as a data source: reading lists the folders, writing lays out planned files.

    spark.read.format("paperdir").load(root)              -> (dir_name, title_key, date_prefix, has_notes)
    planned.write.format("paperdir").mode("append").save(root)   planned: (path, content, only_if_missing)

A file is written under another name and renamed, so a task that runs again does no harm.
``only_if_missing`` files that are there stay as they are. Paths may not leave the root.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

CATALOG = "dir_name string, title_key string, date_prefix string, has_notes boolean"


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{os.path.abspath(path)}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = store_of(self.path)
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.type == fs.FileType.Directory:
                dated = re.match(r"(\d{8})-(.*)", info.base_name, re.DOTALL)
                notes = store.get_file_info(f"{info.path}/notes.md").type == fs.FileType.File
                yield (info.base_name, dated[2] if dated else info.base_name, dated[1] if dated else None, notes)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> _Written:
        from pyarrow import fs

        store, root = store_of(self.path)
        n = 0
        for row in rows:
            parts = row["path"].split("/")
            if ".." in parts or row["path"].startswith("/"):
                raise ValueError(f"a path outside the root: {row['path']}")
            to = "/".join([root, *parts])
            if row["only_if_missing"] and store.get_file_info(to).type == fs.FileType.File:
                continue
            store.create_dir(to.rpartition("/")[0], recursive=True)
            at = f"{to}.{uuid.uuid4().hex}"
            with store.open_output_stream(at) as file:
                file.write(bytes(row["content"]))
            store.move(at, to)
            n += 1
        return _Written(n)

    def commit(self, messages: list) -> None:
        pass

    def abort(self, messages: list) -> None:
        pass


class PaperDirectory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paperdir"

    def schema(self) -> str:
        return CATALOG

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PaperDirectory)
