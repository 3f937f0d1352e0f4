"""Families put side by side, row by row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zip_join(families: dict[str, DataFrame]) -> DataFrame:
    """(id, step, {family}_{channel}) of families (id, step, channels) over the same steps.

    A series' rows of each family are packed into one array, in order of step;
    arrays are joined on the series and zipped by position. So what is shuffled
    is one row a series and family, joins need no step, and a series (thousands
    of rows at most) is what a task holds. Series missing from a family are left
    out; a step missing from one has nulls there.
    """
    packed = []
    for name, df in families.items():
        own = [c for c in df.columns if c not in ("id", "step")]
        rows = F.sort_array(F.collect_list(F.struct("step", *(F.col(c).alias(f"{name}_{c}") for c in own))))
        packed.append((name, [f"{name}_{c}" for c in own], df.groupBy("id").agg(rows.alias(name))))
    both = reduce(lambda a, b: a.join(b, "id"), (p[2] for p in packed))
    at = both.select("id", F.explode(F.arrays_zip(*(p[0] for p in packed))).alias("r"))
    return at.select("id", F.coalesce(*(F.col(f"r.{n}.step") for n, _, _ in packed)).alias("step"), *(F.col(f"r.{n}.{c}").alias(c) for n, cols, _ in packed for c in cols))
