"""The whitened battery made of whole series against its windows, and what its plans send."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import queries, studies
from driftline.operators import grouped, innovations
from driftline.plans.panel import from_table
from driftline.plans.staged import rendered
from driftline.session import table
from driftline.streaming import white


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    series = {1: np.cumsum(rng.normal(size=400)) * 0.1 + rng.normal(size=400), 2: rng.standard_t(3, 2200), 3: rng.normal(size=30), 4: np.ones(60), 5: rng.normal(size=5)}
    rows = [(i, t, float(v)) for i, x in series.items() for t, v in enumerate(x)]
    return table(from_table(spark.createDataFrame(rows, "s long, t long, v double"), "s", ["t"], "v", 0.6))


def agree(got, want, names):
    got, want = ({(r["id"], r["step"]): [r[c] for c in names] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        assert got[k] == pytest.approx([0.0 if v is None else v for v in row], abs=1e-6, rel=1e-8), k


def test_whole_series_give_the_windows_battery_tests_and_odds(panel):
    rows = table(innovations.streams(panel))
    stages, names = innovations.battery()
    windows = rendered(rows, stages).where("step >= 0").select("id", "step", *(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col(c))).alias(c) for c in names))
    agree(grouped.alone(panel, white.battery()), windows, names)
    all119 = studies.white(panel)
    assert all119.columns == ["id", "step", *white.columns()]
    for front, part in (("u", windows), ("test", innovations.tests(rows)), ("odds", innovations.odds(rows))):
        own = [c for c in part.columns if c not in ("id", "step")]
        agree(all119, part.select("id", "step", *(F.col(c).alias(f"{front}_{c}") for c in own)), [f"{front}_{c}" for c in own])


def test_students_scores_and_calibration_are_those_of_the_rows(panel):
    rows = table(innovations.streams(panel, innovations.student_scores))
    odds = innovations.odds(rows)
    agree(studies.white(panel, innovations.student_scores), odds.select("id", "step", *(F.col(c).alias(f"odds_{c}") for c in innovations.ODDS)), [f"odds_{c}" for c in innovations.ODDS])
    want = innovations.calibrated(innovations.streams(panel.where("id < 3"), tail=100_000), 200)
    agree(grouped.alone(panel.where("id < 3"), white.calibrated(200)), want, [c for c in want.columns if c not in ("id", "step")])


@pytest.mark.parametrize("name", ["white_asinh", "white_student", "white_calibrated", "white_battery"])
def test_only_values_are_sent(spark, name):
    made = (queries.queries() | studies.queries())[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ExistingRDD" not in plan
