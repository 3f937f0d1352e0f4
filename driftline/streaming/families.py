"""Any grouped family as a stream, point for point the batch's rows.

A stream carries (id, time, value, hist_len): a series' history first or last,
in any order and any micro-batch, and its online points. A series keeps what has
come of its history and of the points after it. Once the history is whole, each
point that closes the row of points is answered, in order, by the family's own
function on history and points so far; families are causal, so the row of a
point does not change when later ones come. The state of a series is its values
(some thousands of numbers); nothing is shared between series.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftline.session import ship

STATE = "done long, times array<bigint>, values array<double>"


def stream(points: DataFrame, family: tuple) -> DataFrame:
    """(id, step, channels) of a stream of points, one row an online point, append mode. family: (names, rows), a family without a panel."""
    ship(points.sparkSession)
    names, rows = family

    def answered(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterable[pd.DataFrame]:
        done, times, values = kept.get if kept.exists else (0, [], [])
        known, border = dict(zip(times, values)), 0
        for b in batches:
            known |= dict(zip(b["time"].tolist(), b["value"].tolist()))
            border = int(b["hist_len"].iloc[0]) if len(b) else border
        n = 0
        while n in known:
            n += 1
        out = pd.DataFrame(columns=["id", "step", *names])
        if n > border + done:
            x = np.array([known[t] for t in range(n)], float)
            got = np.asarray(rows(x[:border], x[border:]), float).reshape(n - border, len(names))[done:]
            out = pd.DataFrame(got, columns=names)
            out.insert(0, "step", np.arange(done, n - border))
            out.insert(0, "id", key[0])
            done = n - border
        at = sorted(known)
        kept.update((done, at, [known[t] for t in at]))
        yield out.astype({"id": "int64", "step": "int64"} | {c: "float64" for c in names})

    schema = "id long, step long, " + ", ".join(f"{c} double" for c in names)
    return points.groupBy("id").applyInPandasWithState(answered, schema, STATE, "append", GroupStateTimeout.NoTimeout)
