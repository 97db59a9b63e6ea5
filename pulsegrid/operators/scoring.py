"""How well templates fit at every start: 2 * sum(a * k) - sum(k * k), which is sum(a * a) - sum((a - k) ** 2).

Samples are packed into blocks of time with a halo; a neuron's channels of a block meet in one task, which sums their
correlations, so no row is a channel's share of a start. ``kernels``: neuron_id, channel, k, v.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import cut, light

#: Starts of a block, and places from which on a kernel is applied by transforms.
STARTS, LONG = 50_000, 96
#: Samples that the neurons and blocks which share a task have together, about; and samples of one from which on all have their own.
SHARED, OWN = 500_000, 100_000


def packed(samples: DataFrame, size: int, block: int) -> DataFrame:
    """(channel, block, at, x, last): each block's samples, those of the ``size - 1`` after its last start too; last is the
    last t."""
    b, back = F.floor(F.col("t") / block), F.floor(F.greatest(F.col("t") - (size - 1), F.lit(0)) / block)
    rows = samples.filter("channel is not null and t is not null").select("channel", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"), F.explode(F.sequence(back, b)).alias("block"))
    return rows.groupBy("channel", "block").agg(F.collect_list("t").alias("at"), F.collect_list("x").alias("x"), F.max("t").alias("last"))


def _shapes(kernels: DataFrame) -> DataFrame:
    """(neuron_id, channel, p): the places and values of each kernel."""
    return kernels.groupBy("neuron_id", "channel").agg(F.collect_list(F.struct("k", F.col("v").cast("double").alias("v"))).alias("p"))


def correlated(rows: Iterable[pa.Table], start: int, count: int, size: int) -> np.ndarray:
    """The sum over the tables of one row (at, x, p) of the correlations at ``count`` starts from ``start``; long kernels by transforms, of
    which only the sum is transformed back."""
    total = np.zeros(count)
    wide = count + size - 1
    n = 1 << int(wide + size - 2).bit_length() if size >= LONG else 0
    spectrum = np.zeros(n // 2 + 1, complex)
    for row in rows:
        at, x, p = (row.column(c)[0] for c in ("at", "x", "p"))
        values, kernel = np.zeros(wide), np.zeros(size)
        when = at.values.to_numpy() - start
        on = when < wide
        values[when[on]] = x.values.to_numpy()[on]
        places = p.values
        kernel[places.field("k").to_numpy()] = places.field("v").to_numpy()
        if size >= LONG:
            spectrum += np.fft.rfft(values, n) * np.conj(np.fft.rfft(kernel, n))
        else:
            total += np.correlate(values, kernel, "valid")
    return np.fft.irfft(spectrum, n)[:count] if size >= LONG else total


def _spans(blocks: DataFrame, shapes: DataFrame) -> DataFrame:
    """(neuron_id, block, last, size): the blocks in which a neuron's channels have samples, the last of these and how many."""
    pairs = shapes.select("neuron_id", "channel").distinct()
    rows = blocks.select("channel", "block", "last", F.size("at").alias("size")).join(pairs, "channel")
    return rows.groupBy("neuron_id", "block").agg(F.max("last").alias("last"), F.sum("size").alias("size"))


def _groups(spans: DataFrame) -> int:
    """Among how many groups the neurons and blocks are dealt: 0, each its own, if one of them is large."""
    total, most = spans.agg(F.sum("size"), F.max("size")).first()
    return 0 if (most or 0) > OWN else -(-(total or 0) // SHARED) or 1


def _scored(spans: DataFrame, data: DataFrame, groups: int, size: int, block: int, n: int, emit, schema: str) -> DataFrame:
    """For every (neuron_id, block) of ``spans`` what ``emit`` makes of its row, its number of starts and the sum of
    correlations of the rows of ``data`` (neuron_id, block, at, x, p). Those of a group go through one call."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return emit(None, 0, 0, np.zeros(0))
        right = right.combine_chunks()
        key = list(zip(right.column("of").to_pylist(), right.column("in").to_pylist(), strict=True))
        rows: dict = {}
        for i, k in enumerate(key):
            rows.setdefault(k, []).append(i)
        out = []
        for row in left.to_pylist():
            start = row["block"] * block
            count = max(0, min(block, row["last"] - start + 1, n - size - start))  # starts t < n - size
            own = (right.slice(i, 1) for i in rows.get((row["neuron_id"], row["block"]), ()))
            out.append(emit(row, start, count, correlated(own, start, count, size) if count else np.zeros(0)))
        return pa.concat_tables(out)

    data = data.toDF("of", "in", "at", "x", "p")
    deal = (lambda a, b: [F.pmod(F.xxhash64(F.col(a).cast("long"), F.col(b).cast("long")), F.lit(groups)).alias("group")]) if groups else lambda a, b: [F.col(a), F.col(b)]
    return spans.groupBy(*deal("neuron_id", "block")).cogroup(data.groupBy(*deal("of", "in"))).applyInArrow(run, schema)


def energy(kernels: DataFrame) -> DataFrame:
    """(neuron_id, energy): the sum of the squares of each kernel."""
    return kernels.groupBy("neuron_id").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def sliding_dot(samples: DataFrame, kernels: DataFrame, size: int, block: int = STARTS) -> DataFrame:
    """(neuron_id, t, dot): for every start t < N - size of a recording of N samples, as far as the neuron's channels go,
    the sum over channels and places of sample times kernel; a channel that ends early is silent from then on."""
    blocks, shapes = cut(packed(samples, size, block)), _shapes(kernels)
    n = int(blocks.agg(F.max("last")).first()[0] or -1) + 1

    def emit(row, start: int, count: int, dot: np.ndarray) -> pa.Table:
        return pa.table({"neuron_id": pa.array([row["neuron_id"] if row else 0] * count, pa.int64()), "t": np.arange(start, start + count), "dot": dot})

    spans = _spans(blocks, shapes)
    return _scored(spans, blocks.join(shapes, "channel").select("neuron_id", "block", "at", "x", "p"), _groups(spans), size, block, n, emit, "neuron_id long, t long, dot double")


def match_scores(samples: DataFrame, kernels: DataFrame, size: int, block: int = STARTS) -> DataFrame:
    """(neuron_id, t, score) over all channels that the kernels have."""
    dot = sliding_dot(samples, kernels, size, block)
    return dot.join(energy(kernels), "neuron_id").select("neuron_id", "t", (2 * F.col("dot") - F.col("energy")).alias("score"))


def gated_scores(samples: DataFrame, kernels: DataFrame, patches: DataFrame, size: int, block: int = STARTS) -> DataFrame:
    """(neuron_id, t, patch_score, full_score): the score over the neuron's patch (neuron_id, channel), and where that is
    above 0 the score over all channels, else the patch's again. The other channels' samples are only looked at in
    blocks in which a start passes the gate."""
    own = patches.select("neuron_id", "channel").distinct()
    marked = kernels.join(own.withColumn("near", F.lit(True)), ["neuron_id", "channel"], "left").withColumn("near", F.coalesce("near", F.lit(False)))
    square = F.col("v") * F.col("v")
    power = marked.groupBy("neuron_id").agg(F.sum(square).cast("double").alias("energy"), F.sum(F.when(F.col("near"), square).otherwise(0)).cast("double").alias("near_energy"))
    blocks, shapes = cut(packed(samples, size, block)), _shapes(marked)
    n = int(blocks.agg(F.max("last")).first()[0] or -1) + 1
    near = own.join(shapes, ["neuron_id", "channel"])
    spans = _spans(blocks, shapes)
    groups = _groups(spans)
    spans = spans.join(power, "neuron_id")

    def gate(row, start: int, count: int, dot: np.ndarray) -> pa.Table:
        score = 2 * dot - (row["near_energy"] if row else 0.0)
        return pa.table({"neuron_id": pa.array([row["neuron_id"]] if row else [], pa.int64()), "block": pa.array([row["block"]] if row else [], pa.int64()), "last": pa.array([row["last"]] if row else [], pa.int64()), "more": pa.array([row["energy"] - row["near_energy"]] if row else [], pa.float64()), "hit": pa.array([bool((score > 0).any())] if row else [], pa.bool_()), "scores": pa.array([score.tobytes()] if row else [], pa.binary())})

    data = blocks.join(near, "channel").select("neuron_id", "block", "at", "x", "p")
    gated = cut(_scored(spans, data, groups, size, block, n, gate, "neuron_id long, block long, last long, more double, hit boolean, scores binary"))
    far = shapes.join(own, ["neuron_id", "channel"], "left_anti")
    hits = light(gated.filter("hit").select("neuron_id", "block"))
    rest = blocks.join(far, "channel").join(hits, ["neuron_id", "block"], "left_semi").select("neuron_id", "block", "at", "x", "p")

    def full(row, start: int, count: int, dot: np.ndarray) -> pa.Table:
        patch = np.frombuffer(row["scores"], float) if count else np.zeros(0)
        every = np.where(patch > 0, patch + 2 * dot - (row["more"] if row else 0.0), patch)
        return pa.table({"neuron_id": pa.array([row["neuron_id"] if row else 0] * count, pa.int64()), "t": np.arange(start, start + count), "patch_score": patch, "full_score": every})

    schema = "neuron_id long, t long, patch_score double, full_score double"
    passed = _scored(gated.filter("hit"), rest, groups, size, block, n, full, schema)

    def unchanged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n_ = len(row["scores"]) // 8
                yield from full(row, row["block"] * block, n_, np.zeros(n_)).to_batches()

    return passed.unionByName(gated.filter("not hit").mapInArrow(unchanged, schema))


def gate_hits(scores: DataFrame) -> DataFrame:
    """(neuron_id, hits): how many starts pass the gate."""
    return scores.groupBy("neuron_id").agg(F.count_if(F.col("patch_score") > 0).alias("hits"))
