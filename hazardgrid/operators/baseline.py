"""A stored baseline kept up with new accidents: only samples that one of them can have changed are measured again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import spatial


def touched(samples: DataFrame, key: str, new: DataFrame, radius: float) -> DataFrame:
    """The ``samples(key, px, py)`` with one of the accidents ``new(x, y)`` in reach."""
    near = spatial.radius_join(samples, new.select("x", "y").distinct(), radius)
    return samples.join(near.select(key).distinct(), key, "left_semi")


def refreshed(stored: DataFrame, samples: DataFrame, key: str, new: DataFrame, radius: float, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stored(key, ...)`` with the samples that ``new`` touches as ``measure`` finds them now, and the rest as
    they are. Measures of a sample must depend on what lies within ``radius`` only; then the rows are
    those of a full rebuild. ``measure`` may drop samples, new ones are added."""
    changed = touched(samples, key, new, radius)
    return stored.join(changed.select(key), key, "left_anti").unionByName(measure(changed))
