"""What the corpus operators share: reading tables, cutting lineage, size-checked
joins, connected components, and vectorised hashing of words in Arrow text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import checkpoint_dir, cut

MASK = (1 << 64) - 1
#: Text is hashed in slices of about so many bytes; only a longer document makes a longer slice.
SLICE_BYTES = 1 << 19
#: A table of at most so many short rows may be broadcast; beyond it, joins shuffle.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Arrow batches of whole documents must stay small: so many rows, and so many bytes or a single longer document. Lower
    values of the user's stay. The settings are read when a plan runs, so they can't be put back before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) <= size:
        spark.conf.set(key, str(size))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """A broadcast hint if ``df`` (already cut, so cheap to go over) has at most ``rows`` rows and, of tables with texts
    or arrays, at most BROADCAST_BYTES by ``size``, the bytes of a row; else ``df``, for a shuffled join."""
    if size is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    got = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if got["n"] <= rows and got["b"] <= BROADCAST_BYTES else df


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edge table (a, b): component is the least node reachable.

    Alternating large-star and small-star steps; every round is one grouped minimum and one join, and is
    written to the checkpoint folder. Hot nodes are pre-aggregated before the shuffle, and where a hub's edges meet its
    minimum, adaptive execution splits the skewed join. Null ends are ignored. The rounds needed grow with the logarithm
    of the nodes; should ``rounds`` not do, an error is raised.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u is not null and v is not null and u <> v")
    e, before = cut(e.distinct()), None
    for turn in range(rounds + 1):
        mark = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before or not mark["n"]:
            break
        if turn == rounds:
            raise RuntimeError(f"components are unfinished after {rounds} rounds")
        before = mark
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(roots.distinct())


def filtered(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """The rows of ``docs`` for which what ``judge`` appends fulfils the condition, with the columns that they had: those
    that no operator reads go by other names meanwhile, so that none is replaced."""
    names = {c: c if c in ("doc_id", "text", "lang", "source") else f"_own{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in names.items()))
    return judge(plain).filter(condition).select(*(F.col(name).alias(c) for c, name in names.items()))


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers live on between tasks, and an executor's count together."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def sized_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing -----------------------------------------------------------------------------------------------------


# fixed values: the two multipliers and three shifts of a published 64-bit finaliser
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: The low bytes of an 8-byte chunk that a span reaches.
_REACH = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)
FAN = 8


def byte_chunks(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place of ``buf``, as a number; zeros follow its end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray(len(buf) + 1, "<u8", padded, 0, (1,))


def runs(first: np.ndarray, count: np.ndarray, step: int = 1) -> np.ndarray:
    """first, first + step, ... of each row, ``count`` of them."""
    return (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step + np.repeat(first, count)


def _fold_runs(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One number for each run of ``count`` (at least 1) values, by a tree of FAN branches; a single value stays."""
    while (count > 1).any():
        nodes = -(-count // FAN)
        heads = np.cumsum(count) - count
        at = runs(heads, nodes, FAN)
        left = np.repeat(heads + count, nodes) - at
        alone = np.repeat(count == 1, nodes)
        out = values[at]
        out[~alone] = mix(out[~alone] ^ _LENGTH)
        for k in range(1, FAN):
            on = np.flatnonzero(left > k)
            if not len(on):
                break
            out[on] = mix(out[on] ^ values[at[on] + k])
        values, count = out, nodes
    return values


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, folded: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes (A-Z as a-z if ``folded``) have equal hashes wherever they stand.

    A span's chunks of 8 bytes are scrambled one into the other, long spans as a tree of them. Different spans of equal
    length up to 8 bytes never collide; others do as random 64-bit numbers would.
    """
    chunks = byte_chunks(_FOLD[buf] if folded else buf)
    n = np.asarray(ends - starts, np.int64)
    h = chunks[starts] & _REACH[np.minimum(n, 8)]
    long = np.flatnonzero(n > 8)
    if len(long):
        count = (n[long] + 7) // 8
        values = chunks[runs(starts[long], count, 8)]
        values[np.cumsum(count) - 1] &= _REACH[n[long] - 8 * (count - 1)]
        h[long] = _fold_runs(values, count)
    return mix(mix(h) ^ (n.astype(np.uint64) * _LENGTH))


def same_bytes(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the ``n`` bytes from ``at_x`` on equal those from ``at_y`` on; ``x`` and ``y`` are byte_chunks."""
    same = ((x[at_x] ^ y[at_y]) & _REACH[np.minimum(n, 8)]) == 0
    todo = np.flatnonzero(same & (n > 8))
    for k in range(8, 64, 8):
        todo = todo[n[todo] > k]
        same[todo] = ((x[at_x[todo] + k] ^ y[at_y[todo] + k]) & _REACH[np.minimum(n[todo] - k, 8)]) == 0
        todo = todo[same[todo]]
    for i in todo[n[todo] > 64].tolist():
        at = np.arange(0, n[i], 8)
        same[i] = not ((x[at_x[i] + at] ^ y[at_y[i] + at]) & _REACH[np.minimum(n[i] - at, 8)]).any()
    return same


#: The white space of ``[\x20\x09-\x0D]``.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray, offs: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs without ``blank`` bytes; no run crosses documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~blank[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    firsts = offs[:-1][offs[:-1] < offs[1:]]
    start[firsts] = solid[firsts]
    lasts = offs[1:][offs[:-1] < offs[1:]] - 1
    end[lasts] = solid[lasts]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offs, starts, "right") - 1


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in the bytes), nulls as empty texts; every slice has
    whole documents and about ``limit`` bytes at most, or a single longer document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def binary_column(rows: np.ndarray) -> pa.Array:
    """A binary column with a row of bytes for each row of a 2-d array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offs = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def fixed_rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The 2-d array behind a binary column whose rows all have ``width`` values."""
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros((0, width), dtype)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].view(dtype).reshape(-1, width)
