"""Features of clips: their coordinates on their channel's axes.

``vectors``: channel, t, wave (array<double>, of one length in a channel).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import cut
from .kmeans import matrix

#: A channel's clips are dealt to tasks of about so many, each of which sums its own products.
GRAM_ROWS = 20_000
#: Waves of more numbers than this aren't multiplied with each other but with a few directions, again and again.
WIDE = 1024
#: More directions than axes are asked for, rounds, and what is left of an axis when it is right.
EXTRA, ROUNDS, REST = 8, 300, 1e-10
#: Partial sums that one task adds up.
FAN = 64


def _added(parts: DataFrame, column: str, fan: int = FAN) -> DataFrame:
    """(channel, ``column``) of parts (channel, salt, ``column``, bytes of doubles): their sums, at most ``fan`` to a task."""
    kind = dict(parts.dtypes)["channel"]

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, float) for x in t.column(column).to_pylist())
        return pa.table({"channel": t.column("channel")[:1], "salt": t.column("salt")[:1], column: pa.array([total.tobytes()], pa.binary())})

    schema = f"channel {kind}, salt long, {column} binary"
    most = parts.select("channel", "salt").agg(F.max("salt")).first()[0] or 0
    while most:
        parts = parts.withColumn("salt", F.floor(F.col("salt") / fan)).groupBy("channel", "salt").applyInArrow(add, schema)
        most //= fan
    return parts.select("channel", column)


def _signed(axes: np.ndarray) -> list[list[float]]:
    """Rows whose largest entry is positive."""
    return (axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]).tolist()


def principal_axes(vectors: DataFrame, components: int, wide: int = WIDE) -> DataFrame:
    """(channel, axes): the leading eigenvectors of the sums of products, without subtracting a mean; the largest entry
    of each is positive. Fewer axes than ``components`` only if the waves are shorter. Waves of more than ``wide`` numbers
    take rounds of products with a few directions, so a task never holds a square of their length."""
    salts = vectors.groupBy("channel").agg(F.ceil(F.count("*") / GRAM_ROWS).cast("int").alias("_salts"), F.max(F.size("wave")).alias("_d"))
    dealt = vectors.join(salts, "channel").select("channel", "wave", F.pmod(F.xxhash64("t"), F.col("_salts")).cast("long").alias("salt"), "_d")
    kind = dict(vectors.dtypes)["channel"]

    def products(t: pa.Table) -> pa.Table:
        x = matrix(t.column("wave"))
        return pa.table({"channel": t.column("channel")[:1], "salt": t.column("salt")[:1], "gram": pa.array([(x.T @ x).tobytes()], pa.binary())})

    def axes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for g in b.column("gram").to_pylist():
                d = int(np.sqrt(len(g) // 8))
                found.append(_signed(np.linalg.eigh(np.frombuffer(g, float).reshape(d, d))[1][:, ::-1][:, :components].T))
            yield pa.RecordBatch.from_arrays([b.column("channel"), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["channel", "axes"])

    schema = f"channel {kind}, axes array<array<double>>"
    short = dealt.filter(F.col("_d") <= wide)
    grams = cut(short.groupBy("channel", "salt").applyInArrow(products, f"channel {kind}, salt long, gram binary"))
    found = _added(grams, "gram").mapInArrow(axes, schema)
    long = dealt.filter(F.col("_d") > wide)
    return found.unionByName(_iterated(cut(long), components, schema)) if long.limit(1).count() else found


def _iterated(rows: DataFrame, components: int, schema: str) -> DataFrame:
    """The axes of rows (channel, salt, wave) by block power iteration with Ritz vectors. A task has its waves and the
    directions of their channel."""
    kind = dict(rows.dtypes)["channel"]
    tasks = cut(rows.select("channel", "salt").distinct())
    state = cut(rows.groupBy("channel").agg(F.max("_d").alias("d")).withColumns({"q": F.lit(None).cast("binary"), "rest": F.lit(1.0)}))

    def directions(q: bytes | None, d: int) -> np.ndarray:
        k = min(components + EXTRA, d)
        return np.linalg.qr(np.random.default_rng(d).normal(size=(d, k)))[0] if q is None else np.frombuffer(q, float).reshape(d, -1)

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"channel": left.column("channel")[:0] if left.num_rows else right.column("of")[:0], "salt": pa.array([], pa.int64()), "z": pa.array([], pa.binary())})
        x, r = matrix(left.column("wave")), right.to_pylist()[0]
        return pa.table({"channel": left.column("channel")[:1], "salt": left.column("salt")[:1], "z": pa.array([(x.T @ (x @ directions(r["q"], r["d"]))).tobytes()], pa.binary())})

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, rest = [], []
            for r in b.to_pylist():
                q, z = directions(r["q"], r["d"]), np.frombuffer(r["z"], float).reshape(r["d"], -1)
                small = q.T @ z
                values, w = np.linalg.eigh((small + small.T) / 2)
                values, w = values[::-1], w[:, ::-1]
                off = np.sqrt(((z @ w - (q @ w) * values) ** 2).sum(0))[:components].max() / max(values[0], 1e-300)
                rest.append(float(off))
                # right: the Ritz vectors themselves, else the next directions
                out.append((q @ w if off <= REST or q.shape[1] == r["d"] else np.linalg.qr(z)[0]).tobytes())
                rest[-1] = 0.0 if q.shape[1] == r["d"] else rest[-1]
            yield pa.RecordBatch.from_arrays([b.column("channel"), b.column("d"), pa.array(out, pa.binary()), pa.array(rest)], names=["channel", "d", "q", "rest"])

    done = state.limit(0)
    for _ in range(ROUNDS):
        here = tasks.join(state, "channel").select("channel", "salt", "d", "q").toDF("of", "part", "d", "q")
        parts = cut(rows.groupBy("channel", "salt").cogroup(here.groupBy("of", "part")).applyInArrow(product, f"channel {kind}, salt long, z binary"))
        state = cut(_added(parts, "z").join(state, "channel").select("channel", "d", "q", "z").mapInArrow(turn, f"channel {kind}, d int, q binary, rest double"))
        done = done.unionByName(state.filter(F.col("rest") <= REST).select(*done.columns))
        state = cut(state.filter(F.col("rest") > REST))
        if not state.limit(1).count():
            break
    else:
        raise RuntimeError(f"axes haven't settled in {ROUNDS} rounds: two of them are worth the same")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_signed(np.frombuffer(r["q"], float).reshape(r["d"], -1)[:, :components].T) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("channel"), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["channel", "axes"])

    return done.mapInArrow(last, schema)


def pca_features(vectors: DataFrame, components: int) -> DataFrame:
    """(channel, t, f): each wave's coordinates on its channel's axes."""
    on = F.transform("axes", lambda a: F.aggregate(F.zip_with("wave", a, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v))
    return vectors.join(principal_axes(vectors, components), "channel").select("channel", "t", on.alias("f"))
