"""The steps of an analysis as commands: ``python -m pulsegrid.cli COMMAND PATHS... --setting=value``.

split RECORDING CHANNELS         an array file of channels by samples as a table partitioned by channel
calibrate LARGEST CALIBRATION    curves for all sizes up to the largest
analyse CHANNELS LOCATIONS CALIBRATION RESULTS   events, features, labels, neurons and templates
scores CHANNELS RESULTS SCORES   every neuron's scores at every start

``--channel`` and ``--neuron`` restrict the last two to one channel's or neuron's results; all others are settings.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import parse
from .plans import calibration, sorting
from .sources import arrays, channels, results


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """(channel, px, py) of an array file of channels by two or more coordinates, of which the first two count."""
    cells = arrays.read_arrays(spark, path)
    m = F.element_at("sizes", 1)
    rows = cells.select((F.col("idx") % m).cast("int").alias("channel"), F.floor(F.col("idx") / m).alias("axis"), "value")
    return rows.groupBy("channel").agg(F.max(F.when(F.col("axis") == 0, F.col("value"))).alias("px"), F.max(F.when(F.col("axis") == 1, F.col("value"))).alias("py"))


def run(spark: SparkSession, args: list[str]) -> None:
    """Runs a command; an unknown one, or a wrong number of paths, is an error."""
    own = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    own.add_argument("--channel", type=int)
    own.add_argument("--neuron", type=int)
    chosen, rest = own.parse_known_args(args)
    (command, *paths), settings = parse(rest)
    wanted = {"split": 2, "calibrate": 2, "analyse": 4, "scores": 3}
    if command not in wanted or len(paths) != wanted[command]:
        raise ValueError(f"{command} {paths}: the commands and their paths are {wanted}")
    if command == "split":
        channels.split_into_channels(arrays.read_recording(spark, paths[0]), paths[1])
    elif command == "calibrate":
        sizes = spark.createDataFrame([(n,) for n in calibration.size_grid(int(paths[0]), settings.size_step)], "n long")
        calibration.save(calibration.calibrate(sizes, settings.curve_trials, settings.curve_length, settings.seed), paths[1])
    elif command == "analyse":
        curves = calibration.collected(calibration.load(spark, paths[2]))
        done = sorting.sort_events(channels.read_channels(spark, paths[0]), read_locations(spark, paths[1]), curves, settings)
        if chosen.channel is not None:  # the others' events and templates aren't computed
            here = F.col("channel") == chosen.channel
            done.events, done.features, done.labels, done.neurons = (t.filter(here) for t in (done.events, done.features, done.labels, done.neurons))
            done.templates = done.templates.join(done.neurons.select("neuron_id"), "neuron_id", "left_semi")
        results.save_results(done, paths[3])
    else:
        done = results.read_results(spark, paths[1])
        if chosen.neuron is not None:
            done.neurons, done.templates = (t.filter(F.col("neuron_id") == chosen.neuron) for t in (done.neurons, done.templates))
        channels.save_scores(sorting.score_all(channels.read_channels(spark, paths[0]), done, settings), paths[2])


if __name__ == "__main__":
    run(SparkSession.builder.getOrCreate(), sys.argv[1:])
