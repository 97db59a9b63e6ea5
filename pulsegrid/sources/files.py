"""Files that tasks read by ranges of bytes and write themselves, on any file system that Arrow knows by its address."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of an address as Spark writes it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_range(path: str, start: int, length: int) -> bytes:
    system, at = located(path)
    with system.open_input_file(at) as f:
        return f.read_at(length, start)


class Target:
    """A file that appears under its name when it is complete, so that a task that is tried again does no harm."""

    def __init__(self, path: str):
        self.system, self.path = located(path)
        self.system.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.system.open_output_stream(self.draft)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        self.system.move(self.draft, self.path)


def save_files(files: DataFrame, folder: str, suffix: str = ".mda") -> int:
    """Writes (name, content) as ``folder``/name + suffix, each in the task that holds it; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = Target(f"{folder.rstrip('/')}/{name}{suffix}")
                target.write(content)
                target.close()
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    rows = files.select(F.col("name").cast("string"), F.col("content").cast("binary"))
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
