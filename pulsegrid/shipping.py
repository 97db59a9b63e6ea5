"""Sends the package to workers that don't have it installed."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from .sources.files import Target, located
from .sources.folders import shared_folder


def ship(spark: SparkSession) -> str:
    """Puts the package as a zip beside the checkpoints and on the path of all workers that start from now on; the zip's
    place. Call it before the first job, unless the package is installed there or came with --py-files."""
    top = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    at = f"{shared_folder(spark, 'package')}/pulsegrid.zip"
    target = Target(at)
    target.write(packed.getvalue())
    target.close()
    spark.sparkContext.addPyFile(at if "://" in at or at.startswith("file:") else located(at)[1])
    return at
