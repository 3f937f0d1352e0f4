"""Families made of whole series against their windows and joins, and what the joined tables' plans send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import queries, studies
from driftline.operators import arrays, families, grouped, retro
from driftline.plans import fits
from driftline.plans.panel import from_table
from driftline.plans.staged import rendered
from driftline.session import table


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    series = {1: np.cumsum(rng.normal(size=500)) * 0.1 + rng.normal(size=500), 2: rng.standard_t(3, 1500) + 5, 3: rng.normal(size=40), 4: rng.normal(size=20)}
    rows = [(i, t, float(v)) for i, x in series.items() for t, v in enumerate(x)]
    return table(from_table(spark.createDataFrame(rows, "s long, t long, v double"), "s", ["t"], "v", 0.6))


def points(panel):
    return rendered(fits.fitted(panel, fits.trend), families.views()[:1])


@pytest.mark.parametrize("made, windows", [
    (arrays.multiscale(), lambda p: queries.channels(p, "channels_multiscale")),
    (arrays.mass(), lambda p: queries.channels(p, "channels_mass")),
    (arrays.rolling_acf(), lambda p: queries.channels(p, "channels_acf")),
    (arrays.retro(), lambda p: retro.retro(points(p))),
], ids=["multiscale", "mass", "acf", "retro"])
def test_whole_series_give_the_windows_rows(panel, made, windows):
    got, want = ({(r["id"], r["step"]): r for r in df.collect()} for df in (grouped.alone(panel, made), windows(panel)))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        for c in made[0]:
            assert got[k][c] == (None if row[c] is None else pytest.approx(row[c], abs=1e-8)), (k, c)


@pytest.mark.parametrize("name, columns", [("channels_joint", 535), ("frequency", 102)])
def test_joined_tables_send_only_values(spark, name, columns):
    made = studies.queries()[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(made.columns) == columns and plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan
    assert made.agg(F.count("*")).first()[0] > 0
