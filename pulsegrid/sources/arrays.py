"""Array files: a little-endian header of 32-bit integers (type code, bytes per entry, number of sizes, sizes), then the
values, first index fastest. An older form begins with the number of sizes and holds complex values."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Target, read_range, save_files

__all__ = ["array_files", "array_headers", "decode", "encode", "read_arrays", "read_recording", "save_files", "write_arrays"]

# fixed values of the format: code, name, bytes
TYPES = {-1: ("complex64", 8), -2: ("uint8", 1), -3: ("float32", 4), -4: ("int16", 2), -5: ("int32", 4), -6: ("uint16", 2)}
CODES = {name: (code, width) for code, (name, width) in TYPES.items()}
KINDS = {"complex64": "<c8", "uint8": "u1", "float32": "<f4", "int16": "<i2", "int32": "<i4", "uint16": "<u2"}
MOST_SIZES = 50
#: No header is longer.
HEADER = 4 * (3 + MOST_SIZES)


def parse_header(data: bytes) -> tuple[str, tuple[int, ...], int]:
    """Name of the type, sizes and the header's length; ValueError if it isn't a header."""
    head = np.frombuffer(data, "<i4", min(3, len(data) // 4))
    if not len(head) or head[0] == 0 or head[0] < -6:
        raise ValueError("this is no array file")
    if head[0] > 0:
        name, count, at = "complex64", int(head[0]), 4
    else:
        if len(head) < 3:
            raise ValueError("the header is cut short")
        name, count, at = TYPES[int(head[0])][0], int(head[2]), 12
    if not 1 <= count <= MOST_SIZES or len(data) < at + 4 * count:
        raise ValueError("the number of sizes is out of range")
    sizes = tuple(int(n) for n in np.frombuffer(data, "<i4", count, at))
    if min(sizes) < 0:
        raise ValueError("a size is negative")
    return name, sizes, at + 4 * count


def decode(data: bytes) -> tuple[tuple[int, ...], np.ndarray]:
    """Sizes and values in linear order, as doubles (real parts of complex ones); ValueError if values are missing."""
    name, sizes, at = parse_header(data)
    if len(data) < at + prod(sizes) * CODES[name][1]:
        raise ValueError("the file is shorter than its header says")
    return sizes, np.frombuffer(data, KINDS[name], prod(sizes), at).real.astype(float)


def header(sizes: tuple[int, ...], name: str) -> bytes:
    code, width = CODES[name]
    return np.array([code, width, len(sizes), *sizes], "<i4").tobytes()


def stored(values: np.ndarray, name: str) -> bytes:
    """Numbers as the type has them, cut toward zero and wrapped into integer types."""
    if name not in ("float32", "complex64"):
        values = np.trunc(values).astype(np.int64)
    return values.astype(KINDS[name]).tobytes()


def encode(values: np.ndarray, sizes: tuple[int, ...], name: str = "float32") -> bytes:
    """The file of values in linear order."""
    if prod(sizes) != len(values):
        raise ValueError(f"{len(values)} values don't fill {sizes}")
    return header(sizes, name) + stored(values, name)


def array_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, sizes, start, cells) of the array files under ``path``: only their first bytes are read. A missing path,
    a header that is none and a file that is shorter than its header says are errors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                kind, sizes, start = parse_header(read_range(name, 0, min(HEADER, length)))
                if length < start + prod(sizes) * CODES[kind][1]:
                    raise ValueError(f"{name} is shorter than its header says")
                rows.append((name, kind, list(sizes), start, prod(sizes)))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "kind", "sizes", "start", "cells"])

    return files.mapInArrow(run, "path string, kind string, sizes array<int>, start long, cells long")


def read_arrays(spark: SparkSession, path: str, chunk: int = 1 << 18, keep_complex: bool = False) -> DataFrame:
    """(path, sizes, idx, value) of every cell of the array files under ``path``, and im, the imaginary part, with
    ``keep_complex``. Files are cut into ranges of ``chunk`` cells, which tasks read from the files by their bytes, so
    one large file is many tasks."""
    parts = array_headers(spark, path).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("cells") - 1, F.lit(0)), F.lit(chunk).cast("long"))))
    parts = parts.filter("cells > 0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                width, n = CODES[r["kind"]][1], min(chunk, r["cells"] - r["first"])
                values = np.frombuffer(read_range(r["path"], r["start"] + r["first"] * width, n * width), KINDS[r["kind"]])
                sizes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(r["sizes"])), pa.array(np.tile(np.array(r["sizes"], np.int32), n)))
                cols = [pa.array([r["path"]] * n), sizes, pa.array(np.arange(r["first"], r["first"] + n)), pa.array(values.real.astype(float)), pa.array(values.imag.astype(float))]
                names = ["path", "sizes", "idx", "value", "im"]
                yield pa.RecordBatch.from_arrays(cols if keep_complex else cols[:4], names=names if keep_complex else names[:4])

    return parts.mapInArrow(run, "path string, sizes array<int>, idx long, value double" + (", im double" if keep_complex else ""))


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """(channel, t, x) of recordings of channels by samples."""
    cells = read_arrays(spark, path)
    m = F.element_at("sizes", 1)
    return cells.select((F.col("idx") % m).cast("int").alias("channel"), F.floor(F.col("idx") / m).cast("long").alias("t"), F.col("value").alias("x"))


def array_files(cells: DataFrame, name_col: str, sizes: tuple[int, ...], kind: str = "float32") -> DataFrame:
    """(name, content): the files of small arrays (name, idx, value), cells that aren't there are 0. Larger ones go to
    ``write_arrays``."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        values = np.zeros(prod(sizes))
        values[t["idx"].to_numpy()] = t["value"].to_numpy()
        return pd.DataFrame({"name": [t["name"].iloc[0]], "content": [encode(values, sizes, kind)]})

    rows = cells.select(F.col(name_col).cast("string").alias("name"), "idx", F.col("value").cast("double").alias("value"))
    return rows.groupBy("name").applyInPandas(run, "name string, content binary")


def write_arrays(cells: DataFrame, name_col: str, sizes: tuple[int, ...], folder: str, kind: str = "float32", im_col: str | None = None) -> int:
    """Writes arrays (name, idx, value, and the imaginary part of complex ones) as ``folder``/name.mda, each as a stream from
    the task that has its sorted cells, so that a file may be larger than a task's memory; how many. Cells that aren't
    there are 0, and of equal cells one counts; a cell outside the array is an error."""
    total, gap = prod(sizes), 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, own, at, files = None, None, 0, 0

        def fill(upto: int) -> None:
            nonlocal at
            while at < upto:
                n = min(gap, upto - at)
                target.write(stored(np.zeros(n), kind))
                at += n

        for b in batches:
            names = np.array(b.column(0).to_pylist(), object)
            edges = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))).tolist() if len(names) else []
            for x, y in zip(edges, [*edges[1:], len(names)], strict=True):
                if names[x] != own:
                    if target is not None:
                        fill(total)
                        target.close()
                    own, at, files = names[x], 0, files + 1
                    target = Target(f"{folder.rstrip('/')}/{own}.mda")
                    target.write(header(sizes, kind))
                idx = b.column(1).to_numpy()[x:y]
                values = b.column(2).to_numpy()[x:y] + (1j * b.column(3).to_numpy()[x:y] if im_col else 0)
                if idx[0] < 0 or idx[-1] >= total:
                    raise ValueError(f"{own} has a cell outside {sizes}")
                last = np.append(idx[1:] != idx[:-1], True) & (idx >= at)
                idx, values = idx[last], values[last]
                for i in range(0, len(idx), gap):
                    part, v = idx[i : i + gap], values[i : i + gap]
                    runs = np.flatnonzero(np.concatenate(([True], np.diff(part) != 1)))
                    for p, q in zip(runs, np.append(runs[1:], len(part)), strict=True):
                        fill(int(part[p]))
                        target.write(stored(v[p:q], kind))
                        at += q - p
        if target is not None:
            fill(total)
            target.close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["n"])

    im = [F.col(im_col).cast("double").alias("im")] if im_col else []
    rows = cells.select(F.col(name_col).cast("string").alias("name"), F.col("idx").cast("long").alias("idx"), F.col("value").cast("double").alias("value"), *im)
    rows = rows.repartition("name").sortWithinPartitions("name", "idx")
    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
