"""Streaming twins of the windowed detectors, with a state for each series.

A stream carries (id, step, value, mu, sd0): online points with their series'
history fit. Points may come in any micro-batch and, within a bound on gaps, out
of order: a series keeps those that arrive early until the ones before them have
come, and answers with one row a point, in order. Nothing is shared between
series, and the state of one is a few numbers and its early points.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.session import ship

STATE = "next long, up double, down double, peak double, level double, weight double, steps array<bigint>, values array<double>"
OUTPUT = "id long, step long, cusum double, cusum_now double, ewma double"


def squash(ratio: float) -> float:
    return 1 / (1 + math.exp(-2 * (ratio - 1)))


def advance(state: tuple, z: float, drift: float = 0.5, growth: float = 0.84, alpha: float = 0.05) -> tuple[tuple, tuple[float, float, float]]:
    """One point on: the next (next, up, down, peak, level, weight), and the channels."""
    step, up, down, peak, level, weight = state
    up, down = max(0.0, up + z - drift), max(0.0, down - z - drift)
    peak = max(peak, up, down)
    level, weight = (1 - alpha) * level + alpha * z, (1 - alpha) * weight + 1
    scale = growth * math.log(max(step + 1, 2)) + 1e-9
    ewma = math.tanh(abs(level) * math.sqrt(max(weight, 1.0)) / 3)
    return (step + 1, up, down, peak, level, weight), (squash(peak / scale), squash(max(up, down) / scale), ewma)


def _series(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterable[pd.DataFrame]:
    *state, steps, values = kept.get if kept.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0, [], [])
    waiting, out = dict(zip(steps, values)), []
    for b in batches:
        waiting |= dict(zip(b["step"].tolist(), ((b["value"] - b["mu"]) / b["sd0"]).tolist()))
    while state[0] in waiting:
        step = state[0]
        state, channels = advance(tuple(state), waiting.pop(step))
        out.append((key[0], step, *channels))
    early = sorted(s for s in waiting if s > state[0])
    kept.update((*state, early, [waiting[s] for s in early]))
    yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])


def detect(points: DataFrame) -> DataFrame:
    """(id, step, cusum, cusum_now, ewma) of a stream of points, one row each, append mode."""
    ship(points.sparkSession)
    return points.groupBy("id").applyInPandasWithState(_series, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
