"""Settings of an analysis, and their command-line form."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """``detect_on``: whether a channel's own samples are searched for events, or those of its patch's first member."""

    adjacency_radius: float = 100.0
    clip_size: int = 80
    critical_time_radius: int = 150
    num_features: int = 3
    clusters: int = 25
    split_threshold: float = 0.9
    max_iterations: int = 5000
    curve_length: int = 1000
    curve_trials: int = 1000
    size_step: float = 1.02
    detect_on: str = "self"
    seed: int = 1

    def __post_init__(self):
        if self.detect_on not in ("self", "patch_first"):
            raise ValueError(f"detect_on must be self or patch_first, not {self.detect_on!r}")
        if self.clip_size < 1 or self.critical_time_radius < 0:
            raise ValueError("clip_size must be positive and critical_time_radius not negative")


def parse(args: list[str]) -> tuple[list[str], Settings]:
    """Positional arguments and settings of ``--name=value`` options. An unknown or valueless option is an error; the
    last of equal options counts."""
    parser = argparse.ArgumentParser(allow_abbrev=False)
    parser.add_argument("positional", nargs="*")
    for f in fields(Settings):
        parser.add_argument("--" + f.name.replace("_", "-"), type=type(f.default), default=f.default)
    found = vars(parser.parse_args(args))
    return found.pop("positional"), Settings(**found)
