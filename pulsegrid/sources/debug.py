"""What scoring a neuron works with, as array files to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scoring, spatial
from ..plans.sorting import Sorted
from .array_source import ArraySource

__all__ = ["neuron_arrays", "save_debug"]


def _places(channels: DataFrame, name: str) -> DataFrame:
    """(channel, ``name``): channels numbered from 0 in ascending order; a row a channel."""
    return channels.distinct().select("channel", (F.row_number().over(Window.orderBy("channel")) - 1).cast("long").alias(name))


def neuron_arrays(samples: DataFrame, done: Sorted, neuron: int, size: int) -> dict[str, tuple[tuple[int, ...], DataFrame]]:
    """Sizes and cells (idx, value) of: shape, the neuron's template (channels by places); patch_shape, that of its patch's
    channels; patch_data, their samples; convolution, the sums of sample times template at every start."""
    every = _places(samples.select("channel"), "m")
    patch = _places(spatial.neuron_patches(done.neurons.filter(F.col("neuron_id") == neuron), done.edges).select(F.col("member").alias("channel")), "p")
    kernel = done.templates.filter(F.col("neuron_id") == neuron).select("neuron_id", F.col("member").alias("channel"), "k", "v")
    own = kernel.join(patch, "channel")
    channels, members = every.count(), patch.count()
    length = int(samples.agg(F.max("t")).first()[0] or -1) + 1
    dot = scoring.sliding_dot(samples.join(F.broadcast(patch.select("channel")), "channel", "left_semi"), own.select("neuron_id", "channel", "k", "v"), size)  # a patch's channels
    return {
        "shape": ((channels, size), kernel.join(every, "channel").select((F.col("m") + channels * F.col("k")).alias("idx"), F.col("v").alias("value"))),
        "patch_shape": ((members, size), own.select((F.col("p") + members * F.col("k")).alias("idx"), F.col("v").alias("value"))),
        "patch_data": ((members, length), samples.join(patch, "channel").select((F.col("p") + members * F.col("t")).alias("idx"), F.col("x").cast("double").alias("value"))),
        "convolution": ((1, length), dot.select(F.col("t").alias("idx"), F.col("dot").alias("value"))),
    }


def save_debug(samples: DataFrame, done: Sorted, neuron: int, size: int, folder: str) -> None:
    """Writes them as ``folder``/neuron-NAME.mda, each from as many tasks as have its cells."""
    samples.sparkSession.dataSource.register(ArraySource)
    for name, (sizes, cells) in neuron_arrays(samples, done, neuron, size).items():
        rows = cells.select(F.lit(f"{neuron}-{name}").alias("name"), F.col("idx").cast("long").alias("idx"), "value")
        rows.write.format("mda").option("sizes", ",".join(map(str, sizes))).mode("append").save(folder)
