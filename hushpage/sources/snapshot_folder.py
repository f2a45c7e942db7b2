"""Folders of snapshot files with a manifest of SHA-256 sums, as a Python data source: what does not match never becomes a page.

``manifest.json`` in the folder is ``{"files": [{"name": "a.json", "sha256": "..."}]}``; names are relative to it. Every listed file, and every other
file beside them, gives one row, so that nothing goes unnoticed. Files are read by the tasks, by whatever path or address pyarrow can
open, and only their names by the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hushpage.sources.pages import SNAPSHOT_SCHEMA, element_rows

MANIFEST = "manifest.json"


def _open(path: str):
    """(filesystem, path in it) of a local path or an address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Names of a task's files with the sums that they must have; null for files that no manifest lists."""

    names: list[tuple[str, str | None]]


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("mostbytes", 1 << 26))
        self.together = max(1, int(options.get("filespertask", 1)))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = _open(self.path)
        with system.open_input_stream(f"{root}/{MANIFEST}") as file:
            listed = {f["name"]: f["sha256"].lower() for f in json.loads(file.read())["files"]}
        there = (f.path[len(root) + 1 :] for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File)
        names = sorted((listed | {n: None for n in there if n not in listed and n != MANIFEST}).items())
        return [Files(names[i : i + self.together]) for i in range(0, len(names), self.together)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = _open(self.path)
        for name, expected in partition.names:
            if expected is None:
                yield name, None, None, "UNLISTED", None
                continue
            try:
                with system.open_input_file(f"{root}/{name}") as file:
                    size = file.size()
                    content = file.read() if size <= self.most else None
            except OSError:
                yield name, expected, None, "MISSING", None
                continue
            found = None if content is None else hashlib.sha256(content).hexdigest()
            status = "TOO_LARGE" if content is None else None if found == expected else "WRONG_CHECKSUM"
            yield name, expected, found, status, content if status is None else None


class SnapshotFolder(DataSource):
    """(file, expected, sha256, error, content); content only of files whose sum is right.

    Options: path; ``filesPerTask`` (1); ``mostBytes``, beyond which a file is not read (64 MiB).
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot_folder"

    def schema(self) -> str:
        return "file string, expected string, sha256 string, error string, content binary"

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader({k.lower(): v for k, v in self.options.items()})


def read_snapshot_folder(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """(elements, quarantine) of a folder: element rows as sources.pages.read_snapshots gives them, and (file, error) of files that were held
    back: UNLISTED, MISSING, TOO_LARGE, WRONG_CHECKSUM, or MALFORMED where a right file is no snapshot."""
    spark.dataSource.register(SnapshotFolder)
    files = spark.read.format("snapshot_folder").options(**options).load(path)
    read = F.from_json(F.col("content").cast("string"), SNAPSHOT_SCHEMA)
    rows = files.withColumn("page", read).withColumn("error", F.coalesce("error", F.when(F.col("page.elements").isNull(), "MALFORMED")))
    pages = rows.where("error IS NULL").select(F.col("file").alias("source"), "page.*")
    return element_rows(pages), rows.where("error IS NOT NULL").select("file", "error")
