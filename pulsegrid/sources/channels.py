"""Recordings as tables partitioned by channel, so that a patch reads its own channels only. A table of few channels has a
folder for each; one of many has PARTS folders that channels are dealt to by a hash, and is sorted by channel in its files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .folders import light

#: Folders of its own that a table has for its keys at most, values that a filter names one by one, and folders of larger tables.
FOLDERS, PARTS = 1000, 64


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _save(rows: DataFrame, folder: str, keys: list[str], stretch: list[Column]) -> None:
    """By ``keys`` and t. A folder costs a task as much as thousands of rows, so many keys share some."""
    if rows.select(*keys).distinct().limit(FOLDERS + 1).count() > FOLDERS:
        rows, own = rows.withColumn("part", _part(keys[0])), ["part"]
    else:
        own = keys
    dealt = rows.repartition(*own, *stretch).sortWithinPartitions(*dict.fromkeys([*own, *keys, "t"]))
    dealt.write.mode("overwrite").partitionBy(*own).parquet(folder)


def _save_once(rows: DataFrame, folder: str, keys: list[str]) -> None:
    """The same for ``rows`` that take long to make: they are made once."""
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        _save(rows, folder, keys, [])
    finally:
        rows.unpersist()


def split_into_channels(samples: DataFrame, folder: str) -> None:
    """One partition a channel, or PARTS of many channels; a long one is several files, since rows are dealt by it and by
    stretch of time."""
    _save(samples, folder, ["channel"], [F.floor(F.col("t") / 10_000_000)])


def read_channels(spark: SparkSession, folder: str, channels: list[int] | DataFrame | None = None) -> DataFrame:
    """The samples of some or all channels, named by a list or by a table's column channel; Spark reads the partitions of
    those alone."""
    samples = spark.read.parquet(folder)
    dealt = "part" in samples.columns
    if channels is None:
        return samples.drop("part")
    if isinstance(channels, DataFrame) or len(channels) > FOLDERS:
        wanted = channels if isinstance(channels, DataFrame) else spark.createDataFrame([(c,) for c in channels], StructType([StructField("channel", samples.schema["channel"].dataType)]))
        wanted = wanted.select(F.col("channel").cast(samples.schema["channel"].dataType)).distinct()
        return samples.join(light(wanted.withColumn("part", _part("channel")) if dealt else wanted), ["part", "channel"] if dealt else ["channel"], "left_semi").drop("part")
    if dealt:
        kind = StructType([StructField("channel", samples.schema["channel"].dataType)])
        parts = [r[0] for r in spark.createDataFrame([(c,) for c in channels], kind).select(_part("channel")).distinct().collect()]
        samples = samples.filter(F.col("part").isin(parts))
    return samples.filter(F.col("channel").isin(channels)).drop("part")


def save_spike_times(labels: DataFrame, folder: str) -> None:
    """(channel, t, label) by channel and cluster."""
    _save_once(labels.select("channel", "label", "t"), folder, ["channel", "label"])


def save_scores(scores: DataFrame, folder: str) -> None:
    _save_once(scores, folder, ["neuron_id"])
