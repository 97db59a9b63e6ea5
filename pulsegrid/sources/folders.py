"""Fresh folders that all executors share, and what is kept in them between jobs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows of a few numbers each may be broadcast.
LIGHT_ROWS = 100_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; with a local master one of our own where it is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        import tempfile

        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def shared_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of our own that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def light(df: DataFrame) -> DataFrame:
    """A broadcast hint if ``df``, which has been cut and holds a few numbers a row, has at most LIGHT_ROWS rows; else
    ``df``, for a shuffled join."""
    return F.broadcast(df) if df.limit(LIGHT_ROWS + 1).count() <= LIGHT_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
