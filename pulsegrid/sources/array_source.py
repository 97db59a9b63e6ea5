"""Array files as a data source: ``spark.dataSource.register(ArraySource)``, then

    spark.read.format("mda").load(folder)
    cells.write.format("mda").option("sizes", "64,1000").option("kind", "float32").mode("append").save(folder)

Reading gives (path, sizes, idx, value), and im with the option complex. A partition is a range of ``chunk`` cells of one
file; with the option pushdown, and spark.sql.python.filterPushdown.enabled, those outside the idx or the path of a filter
aren't planned. Writing takes (name, idx, value), and im of complex
numbers, in any order and from any number of tasks: each writes its cells where they belong in the file's bytes.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .arrays import CODES, HEADER, KINDS, header, parse_header, stored
from .files import located, read_range


@dataclass
class Range(InputPartition):
    """Cells ``first`` to ``first + count`` of a file."""

    path: str
    kind: str
    sizes: tuple[int, ...]
    start: int
    first: int
    count: int


class ArrayReader(DataSourceReader):
    def __init__(self, options, names: list[str]):
        self.path, self.chunk, self.names = options["path"], int(options.get("chunk", 1 << 18)), names
        self.low, self.high, self.only = 0, None, None

    def _files(self) -> Iterator[tuple[str, int]]:
        """The address and the length of every file, in the form in which the path was given."""
        system, at = located(self.path)
        head = self.path[: len(self.path) - len(at)] if self.path.endswith(at) else ""
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"PATH_NOT_FOUND: {self.path} does not exist")
        every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        for f in sorted(every, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                yield head + f.path, f.size

    def partitions(self) -> list[Range]:
        out = []
        for path, length in self._files():
            if self.only not in (None, path):
                continue
            kind, sizes, start = parse_header(read_range(path, 0, min(HEADER, length)))
            cells = prod(sizes)
            if length < start + cells * CODES[kind][1]:
                raise ValueError(f"{path} is shorter than its header says")
            high = cells if self.high is None else min(cells, self.high)
            low = self.low // self.chunk * self.chunk
            out += [Range(path, kind, sizes, start, i, min(self.chunk, cells - i)) for i in range(low, high, self.chunk)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p, width = partition, CODES[partition.kind][1]
        values = np.frombuffer(read_range(p.path, p.start + p.first * width, p.count * width), KINDS[p.kind])
        for i in range(0, p.count, 1 << 16):
            v = values[i : i + (1 << 16)]
            n, dims = len(v), len(p.sizes)
            sizes = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), pa.array(np.tile(np.array(p.sizes, np.int32), n)))
            cols = {"path": pa.array([p.path] * n), "sizes": sizes, "idx": pa.array(np.arange(p.first + i, p.first + i + n)), "value": pa.array(v.real.astype(float)), "im": pa.array(v.imag.astype(float))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in self.names], names=self.names)


class PushingReader(ArrayReader):
    def pushFilters(self, filters: list[Filter]):
        """Bounds of idx and a path leave ranges out of the plan; Spark still applies the filters to the rest."""
        for f in filters:
            if f.attribute == ("idx",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    top = f.value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
                if isinstance(f, EqualTo):
                    self.low = max(self.low, f.value)
            elif f.attribute == ("path",) and isinstance(f, EqualTo):
                self.only = f.value
            yield f


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class ArrayWriter(DataSourceArrowWriter):
    """Every task writes into the same drafts, at the places of its cells, so a task that is tried again writes the same
    bytes; the commit adds headers and gives the files their names. That needs a folder of a mounted file system."""

    def __init__(self, options, schema: StructType, overwrite: bool):
        system, self.folder = located(options["path"].rstrip("/"))
        if not isinstance(system, fs.LocalFileSystem):
            raise ValueError("only a mounted file system has files that several tasks can write; see write_arrays")
        missing = {"name", "idx", "value"} - set(schema.names)
        if missing or "sizes" not in options:
            raise ValueError(f"arrays need sizes, and columns name, idx and value: {sorted(missing)} aren't there")
        self.sizes = tuple(int(n) for n in options["sizes"].split(","))
        self.kind = options.get("kind", "float32")
        self.width = CODES[self.kind][1]
        self.columns = {c: schema.names.index(c) for c in ("name", "idx", "value", "im") if c in schema.names}
        self.overwrite, self.mark = overwrite, uuid.uuid4().hex
        self.lead = header(self.sizes, self.kind)
        os.makedirs(self.folder, exist_ok=True)

    def _draft(self, name: str) -> str:
        return f"{self.folder}/.{name}.{self.mark}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        total, names, handles = prod(self.sizes), set(), {}
        try:
            for b in iterator:
                column = b.column(self.columns["name"]).cast(pa.string()).dictionary_encode()
                code = column.indices.to_numpy()
                idx = b.column(self.columns["idx"]).to_numpy()
                values = b.column(self.columns["value"]).cast(pa.float64()).to_numpy(zero_copy_only=False)
                if "im" in self.columns:
                    values = values + 1j * b.column(self.columns["im"]).cast(pa.float64()).to_numpy(zero_copy_only=False)
                if len(idx) and (idx.min() < 0 or idx.max() >= total):
                    raise ValueError(f"a cell lies outside {self.sizes}")
                order = np.lexsort((idx, code))
                code, idx, raw = code[order], idx[order], stored(values[order], self.kind)
                edges = np.flatnonzero(np.concatenate(([True], (np.diff(idx) != 1) | (np.diff(code) != 0)))) if len(idx) else []
                for x, y in zip(edges, [*edges[1:], len(idx)], strict=True):
                    name = column.dictionary[int(code[x])].as_py()
                    if name not in handles:
                        if len(handles) >= 256:
                            os.close(handles.pop(next(iter(handles))))
                        handles[name] = os.open(self._draft(name), os.O_WRONLY | os.O_CREAT, 0o644)
                        names.add(name)
                    os.pwrite(handles[name], raw[x * self.width : y * self.width], len(self.lead) + int(idx[x]) * self.width)
        finally:
            for h in handles.values():
                os.close(h)
        return Written(sorted(names))

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for f in os.listdir(self.folder):
                if f.endswith(".mda"):
                    os.remove(f"{self.folder}/{f}")
        for name in sorted({n for m in messages if m for n in m.names}):
            handle = os.open(self._draft(name), os.O_WRONLY)
            os.pwrite(handle, self.lead, 0)
            os.truncate(handle, len(self.lead) + prod(self.sizes) * self.width)  # cells that nobody wrote are 0
            os.close(handle)
            os.replace(self._draft(name), f"{self.folder}/{name}.mda")

    def abort(self, messages: list[Written | None]) -> None:
        for f in os.listdir(self.folder):
            if f.endswith(self.mark):
                os.remove(f"{self.folder}/{f}")


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mda"

    def schema(self) -> str:
        return "path string, sizes array<int>, idx long, value double" + (", im double" if self.options.get("complex", "false").lower() == "true" else "")

    def reader(self, schema: StructType) -> ArrayReader:
        pushes = self.options.get("pushdown", "false").lower() == "true"
        return (PushingReader if pushes else ArrayReader)(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options, schema, overwrite)
