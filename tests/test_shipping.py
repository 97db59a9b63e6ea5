import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {at!r}).getOrCreate()
from pulsegrid.shipping import ship
ship(spark)
from pulsegrid.operators import series
rows = spark.createDataFrame([(0, t, float(t % 3)) for t in range(9)], "channel long, t long, x double")
print("FIT", series.monotone(rows).count())
"""


def test_workers_get_the_package(tmp_path):
    """The package is on the driver's path alone."""
    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root, at=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "FIT 9" in done.stdout, done.stderr[-2000:]
