"""Folder listings made by tasks.

A run is a folder whose state is told by files in it, some of them empty: data
scans skip empty files, and a listing on the driver does not grow with a cluster.
Here one task lists the folders under a root, these are dealt out, and every
task lists its own. Only names travel, as rows. Works alike with a classic and
a Connect session; the tasks need a file system that ``pyarrow`` knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "folder string, name string, is_folder boolean, bytes long, modified long"
BATCH = 1024


def _entries(uri: str) -> list:
    """What is in a folder: files and folders; nothing if it does not exist."""
    from pyarrow.fs import FileSelector, FileSystem
    fs, path = FileSystem.from_uri(uri)
    return fs.get_file_info(FileSelector(path, allow_not_found=True))


def _uri(path: str) -> str:
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else "file://" + path


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """``folder, name, is_folder, bytes, modified`` (ms): the entries of every
    folder under ``root``, empty files too; names that begin with ``_`` or ``.`` are none of the caller's."""
    root = _uri(root.rstrip("/"))

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType
        for batch in batches:
            for _ in range(batch.num_rows):
                names = [e.base_name for e in _entries(root) if e.type == FileType.Directory and e.base_name[0] not in "_."]
                for at in range(0, len(names), BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(names[at:at + BATCH], pa.string())], names=["folder"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = [e for e in _entries(f"{root}/{folder}") if e.base_name[0] not in "_."]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder] * len(found), pa.string()), pa.array([e.base_name for e in found], pa.string()),
                     pa.array([e.type == FileType.Directory for e in found], pa.bool_()), pa.array([e.size or 0 for e in found], pa.int64()),
                     pa.array([(e.mtime_ns or 0) // 1_000_000 for e in found], pa.int64())],
                    names=["folder", "name", "is_folder", "bytes", "modified"])

    found = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string")
    return found.repartition(F.col("folder")).mapInArrow(inside, SCHEMA)
