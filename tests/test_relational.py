"""Relational verbs, files, augmentation and per-series statistics on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import augment, forensics, grouped, innovations, relational, retro
from driftline.plans.panel import from_table, with_breaks
from driftline.sources import files


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    rows = [(i, t, float(np.round(rng.normal(i), 1))) for i in range(3) for t in range(160 + 10 * i)]
    base = from_table(spark.createDataFrame(rows, "s long, t long, v double"), "s", ["t"], "v", 0.5)
    return with_breaks(base, F.col("id") == 2, F.lit(40)).cache()


def parts(panel, i):
    rows = panel.where(F.col("id") == i).orderBy("time").collect()
    return np.array([r["value"] for r in rows if r["period"] == 1]), np.array([r["value"] for r in rows if r["period"] == 2])


def test_two_sample_distances(panel):
    for r in relational.two_sample(panel).collect():
        h, o = parts(panel, r["id"])
        grid = np.unique(np.concatenate([h, o]))
        fh, fo = ((np.searchsorted(np.sort(x), grid, "right") / len(x)) for x in (h, o))
        assert r["ks"] == pytest.approx(np.abs(fh - fo).max(), abs=1e-12)
        assert r["w1"] == pytest.approx((np.abs(fh - fo)[:-1] * np.diff(grid)).sum(), abs=1e-9)


def test_ranks_against_history(panel):
    for i in range(3):
        h, o = parts(panel, i)
        got = relational.rank_against_history(panel).where(F.col("id") == i).orderBy("step").collect()
        assert [r["below"] for r in got] == np.searchsorted(np.sort(h), o, "left").tolist()
        assert [r["upto"] for r in got] == np.searchsorted(np.sort(h), o, "right").tolist()


def test_split_scan_tries_every_split(panel):
    rows = panel.where("period = 2").select("id", "step", "value")
    got = {(r["id"], r["step"]): r for r in retro.split_scan(rows, "value", [10, 30]).collect()}
    x = parts(panel, 1)[1][:30]
    best = max(abs(x[:k].mean() - x[k:].mean()) / np.sqrt(x[:k].var() / k + x[k:].var() / (30 - k)) for k in range(5, 26))
    assert got[1, 29]["gap"] == pytest.approx(best, abs=1e-9) and got[1, 28]["gap"] == got[1, 9]["gap"] and got[1, 8]["gap"] == 0
    assert got[1, 35]["gap"] == got[1, 29]["gap"]


def test_scans_go_on_as_far_as_each_series(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=9000)
    x[2000:] += 3
    sizes = {1: 2400, 2: 9000, 3: 7}
    rows = [(i, k, float(v)) for i, n in sizes.items() for k, v in enumerate(x[:n])]
    got = {(r["id"], r["step"]): r for r in retro.split_scan(spark.createDataFrame(rows, "id long, step long, value double"), "value").collect()}
    assert len(got) == sum(sizes.values()) and got[3, 6]["gap"] == 0
    for i, n in ((1, 2400), (2, 2400), (2, 9000)):
        t = max(k for k in innovations.scan_steps(n))
        gaps = [abs(x[:k].mean() - x[k:t].mean()) / np.sqrt(x[:k].var() / k + x[k:t].var() / (t - k)) for k in range(5, t - 4)]
        assert got[i, n - 1]["gap"] == pytest.approx(max(gaps), rel=1e-8) and max(gaps) > 20


def test_the_cadence_of_a_plan_is_that_of_a_loop(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 17, 60, 5000, 10**9)], "n long").select("n", retro.cadence(F.col("n")).alias("c")).collect()
    assert all(r["c"] == innovations.scan_steps(r["n"]) for r in rows)


def test_scan_steps_grow():
    assert innovations.scan_steps(60) == [*range(1, 18), 19, 21, 23, 25, 28, 31, 34, 38, 42, 47, 52, 58]


def test_bins_are_closed_on_the_left(spark):
    df = spark.createDataFrame([(19.0,), (20.0,), (49.9,), (50.0,), (None,)], "x double")
    assert [r[0] for r in df.select(relational.cut(F.col("x"), [20, 50, 100])).collect()] == [None, "20-50", "20-50", "50-100", None]


def test_robust_z_uses_controls_only(spark):
    rows = [(k, "a", float(k), 0) for k in range(5)] + [(9, "a", 100.0, 1), (10, "b", 1.0, 0), (11, "b", 2.0, 1)]
    got = {r["id"]: r["z"] for r in relational.robust_z(spark.createDataFrame(rows, "id long, bin string, x double, broken int"), "x", "bin", F.col("broken") == 0, 3).collect()}
    assert got[9] == pytest.approx(98 / 1.4826) and got[10] is None and got[11] is None


def test_winsorising_fills_and_clips(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(101)] + [(200, float("inf")), (201, None)], "id long, x double")
    got = {r["id"]: r["x"] for r in relational.winsorised(df, ["x"]).collect()}
    assert got[0] == 1 and got[100] == 99 and got[200] == got[201] == 50


def test_files_keep_a_panel(panel):
    for kind in ("parquet", "csv"):
        back = files.through(panel, kind)
        assert back.dtypes == [("id", "bigint"), ("time", "int"), ("value", "double"), ("period", "int")]
        assert back.exceptAll(panel.select("id", F.col("time").cast("int"), "value", "period")).count() == 0


def test_cuts_windows_and_mirrors(panel):
    cuts = augment.boundary_cuts(panel)
    assert cuts.where("period = 1 and step >= 0").count() == 0 and {r[0] // 10 % 10 for r in cuts.select("id").distinct().collect()} <= {0, 1, 2}
    assert augment.windows(panel.where("period = 2"), 32, 8).where("size(values) != 32").count() == 0
    assert augment.mirrored(panel).agg(F.sum("value")).first()[0] == pytest.approx(-panel.agg(F.sum("value")).first()[0])


def test_partial_autocorrelations_of_a_first_order_series():
    got = forensics.pacf(np.array([0.6**k for k in range(1, 6)]))
    assert got == pytest.approx([0.6, 0, 0, 0, 0], abs=1e-12)


def test_batteries_are_finite_from_the_first_point_on(panel):
    got = forensics.prefix_battery(panel).where("id = 2").orderBy("step").collect()
    assert any(v != 0 for v in got[0][2:]) and all(np.isfinite(v) for r in got for v in r)
    assert forensics.series_features(panel).count() == 3
