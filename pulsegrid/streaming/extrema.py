"""Local extrema of an unbounded stream of samples, with a bounded state: each channel's last 2 * radius + 1 samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.detect import sliding_max


def stream_extrema(samples: DataFrame, radius: int, late: str = "error") -> DataFrame:
    """(channel, t, x) of a stream (channel long, t long, x double) in which each channel's samples come in order of t.
    A sample is decided once the ``radius`` samples after it are there; the last ones of a stream that ends are not
    events, as in a batch.

    A sample that comes too late, or twice, finds its neighbours decided. ``late`` says what becomes of it: an "error"
    ends the stream; "drop" leaves it out, as sources need that may deliver twice; "divert" gives it back among the
    events, and the column late tells them apart. Of samples with one t in one batch the first counts.
    """
    if radius < 1:
        raise ValueError("a stream needs a radius of 1 or more")
    if late not in ("error", "drop", "divert"):
        raise ValueError(f"late must be error, drop or divert, not {late!r}")

    def run(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old_t, old_x = state.get if state.exists else ([], [])
        new = pd.concat(list(frames)).sort_values("t", kind="stable")
        behind = new.duplicated("t") | (new["t"] <= old_t[-1] if len(old_t) else False)
        if behind.any() and late == "error":
            raise ValueError(f"channel {key[0]} has a sample that is late or repeated")
        odd, new = new[behind], new[~behind]
        t, x = np.array([*old_t, *new["t"]], np.int64), np.array([*old_x, *new["x"]], float)
        a, first = np.abs(x), max(radius, len(old_t) - radius)
        found = np.zeros(0, np.int64)
        # what the state holds from before has been decided up to its last radius samples
        if len(x) - radius > first:
            top, i = sliding_max(a, radius), np.arange(first, len(x) - radius)
            found = i[(a[i] > top[i - radius]) & (a[i] >= top[i + 1])]
        state.update((t[-2 * radius :].tolist(), x[-2 * radius :].tolist()))
        events = pd.DataFrame({"channel": np.full(len(found), key[0], np.int64), "t": t[found], "x": x[found]})
        if late == "divert":
            events = pd.concat([events.assign(late=False), odd[["channel", "t", "x"]].assign(late=True)])
        yield events

    return samples.groupBy("channel").applyInPandasWithState(run, "channel long, t long, x double" + (", late boolean" if late == "divert" else ""), "t array<long>, x array<double>", "append", GroupStateTimeout.NoTimeout)
