"""Process statistics, relational verbs, learners, score rules and made-up panels on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import augment, dynamics, learn, metrics, relational, views
from driftline.plans.panel import from_table


def one(spark, x):
    rows = [(1, t, float(v)) for t, v in enumerate(x)]
    panel = from_table(spark.createDataFrame(rows, "s long, t long, v double"), "s", ["t"], "v", 1.0)
    return dynamics.dynamics(panel).first()


def arma(seed, n, phi=0.0, theta=0.0, second=0.0):
    e = np.random.default_rng(seed).normal(size=n)
    x = np.zeros(n)
    for t in range(n):
        x[t] = e[t] + (theta * e[t - 1] + phi * x[t - 1] if t else 0.0) + (second * x[t - 2] if t > 1 else 0.0)
    return x


def test_dynamics_tell_processes_apart(spark):
    series = {1: arma(1, 3000), 2: arma(2, 3000, phi=0.6), 3: arma(3, 3000, theta=0.6), 4: arma(4, 3000, phi=0.4, second=0.35), 5: np.cumsum(arma(5, 3000)), 6: np.random.default_rng(6).standard_t(4, 3000), 7: np.zeros(3000), 9: np.arange(30.0)}
    e, s2 = np.random.default_rng(8).normal(size=3000), 1.0
    for t in range(3000):
        e[t] *= math.sqrt(s2)
        s2 = 0.1 + 0.2 * e[t] ** 2 + 0.7 * s2
    series[8] = e
    rows = [(i, t, float(v), 1, t - 3000) for i, x in series.items() for t, v in enumerate(x)]
    got = dynamics.dynamics(spark.createDataFrame(rows, "id long, time long, value double, period int, step long")).cache()
    by = {r["id"]: r for r in got.collect()}
    kinds = {r["id"]: r for r in dynamics.kinds(got).collect()}
    assert [kinds[i]["linear"] for i in (1, 2, 3, 4)] == ["WN", "AR1", "MA1", "AR2"] and all(kinds[i]["margin"] > 0 for i in (1, 2, 3, 4))
    assert by[2]["arma_p"] == 1 and by[2]["arma_q"] == 0 and by[3]["ma1_theta"] == pytest.approx(0.6, abs=0.05) and by[4]["ar_order"] == 2
    assert by[5]["adf_t"] > -3.5 > by[1]["adf_t"] and by[5]["dfa"] > 1.3 and abs(by[1]["dfa"] - 0.5) < 0.15
    assert 2.5 < by[6]["t_freedom"] < 6.5 and by[1]["t_freedom"] > 15 and kinds[6]["innovation"] in ("t<3", "t3-5", "t5-10")
    assert by[8]["rank_arch"] > 30 > by[1]["rank_arch"] and abs(by[8]["garch_alpha"] - 0.2) < 0.08 and abs(by[8]["garch_beta"] - 0.7) < 0.15 and kinds[8]["volatility"] == "clustered"
    assert by[1]["pair_dependence"] < by[2]["pair_dependence"] and by[2]["sample_entropy"] < by[1]["sample_entropy"]
    assert by[7]["n"] == 3000 and by[7]["adf_t"] is None and by[9]["n"] == 30


def test_recursions_in_blocks_are_recursions():
    x, keep = np.random.default_rng(1).normal(size=200), np.array([-0.9, 0.0, 0.5])
    for row, k in zip(dynamics._decayed(x, keep), keep):
        y, want = 0.0, []
        for a in x:
            y = a + k * y
            want.append(y)
        assert row == pytest.approx(want, abs=1e-12)


def test_unit_root_statistic_is_least_squares():
    x = arma(7, 300, phi=0.8)
    d = np.diff(x)
    design = np.array([[x[t], *(d[t - j] for j in range(1, 5)), 1.0] for t in range(4, 299)])
    y = np.array([d[t] for t in range(4, 299)])
    coef = np.linalg.lstsq(design, y, rcond=None)[0]
    s2 = ((y - design @ coef) ** 2).sum() / (len(y) - 6)
    assert dynamics.unit_root_t(x) == pytest.approx(coef[0] / math.sqrt(s2 * np.linalg.inv(design.T @ design)[0, 0]), rel=1e-6)


def test_two_sample_tests_against_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(size=60), 1), np.round(rng.normal(0.5, 1, 40), 1)
    rows = [("x", 0, float(v)) for v in a] + [("x", 1, float(v)) for v in b] + [("y", 0, 1.0), ("y", 1, 1.0), ("z", 1, 2.0), ("x", 1, None)]
    got = {r["n"]: r for r in relational.two_sample_tests(spark.createDataFrame(rows, "n string, g int, v double"), "v", F.col("g"), "n").collect()}
    r = got["x"]
    u = sum((y > x) + 0.5 * (y == x) for x in a for y in b)
    grid = np.concatenate([a, b])
    assert r["u"] == u and r["ks"] == pytest.approx(max(abs((a <= v).mean() - (b <= v).mean()) for v in grid))
    ties = sum(c**3 - c for c in np.unique(grid, return_counts=True)[1])
    z = (abs(u - 1200) - 0.5) / math.sqrt(200 * (101 - ties / (100 * 99)))
    assert r["mw_p"] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-5)
    lam = math.sqrt(24) * r["ks"]
    assert r["ks_p"] == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200)), abs=1e-9)
    assert got["y"]["ks"] == 0 and got["y"]["ks_p"] == 1 and got["y"]["mw_p"] == pytest.approx(1, abs=1e-6) and "z" not in got


def test_verbs_with_nulls_ties_and_nothing(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 1, None), ("b", 1, 3.0), (None, 1, 4.0), ("a", 1, 0.5)], "k string, o int, v double")
    assert {(r["k"], r["o"], r["v"]) for r in relational.first_by_key(df, "k", ["o", "v"]).collect()} == {("a", 1, None), ("b", 1, 3.0), (None, 1, 4.0)}
    index = spark.createDataFrame([("b",), ("c",)], "k string")
    assert {(r["k"], r["v"]) for r in relational.reindexed(df, index, "k").collect()} == {("b", 3.0), ("c", None)}
    h = {r["bin"]: r["n"] for r in relational.fixed_histogram(df, "v", 4, 0.0, 4.0).collect()}
    assert h == {0: 1, 1: 1, 2: 0, 3: 2}
    both = relational.suffixed_join([("", df.where("k = 'b'")), ("_2", df.where("k = 'b'"))], "k")
    assert both.columns == ["k", "o", "v", "o_2", "v_2"] and both.first()["v_2"] == 3.0
    name, margin = relational.least_of(["o", "v"])
    assert df.where("k = 'b'").select(name.alias("c"), margin.alias("m")).first() == ("o", 2.0)
    assert df.select(relational.replaced(F.col("k"), "a", "none").alias("r")).where("r = 'none'").count() == 3
    empty = df.where("1 = 0")
    for made in (relational.first_by_key(empty, "k", ["o"]), relational.reindexed(empty, index.where("1 = 0"), "k"), relational.described(empty, ["v"]), relational.two_sample_tests(empty, "v", F.col("o"), "k"), relational.mixture(empty, "v", "o", "k")):
        assert made.count() == 0
    assert relational.described(df, ["v"]).first()["n"] == 4


def test_a_mixture_is_found(spark):
    rng = np.random.default_rng(3)
    b = np.concatenate([rng.normal(0, 3.0, 1200), rng.normal(size=800)])
    rows = [("w", 1, float(v)) for v in b] + [("w", 0, float(v)) for v in rng.normal(size=2000)] + [("s", k % 2, float(v)) for k, v in enumerate(rng.normal(size=2000))]
    got = {r["k"]: r for r in relational.mixture(spark.createDataFrame(rows, "k string, g int, v double"), "v", "g", "k").collect()}
    assert 0.4 <= got["w"]["share"] <= 0.8 and got["w"]["gain"] > 100 > 40 > got["s"]["gain"]


def test_won_by_kind_against_pairs(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(40):
        for s in range(10):
            rows.append((i, s, int(i < 10 and s >= 4), float(np.round(rng.random() + 0.3 * (i < 10 and s >= 4), 1))))
    kinds = spark.createDataFrame([(i, "even" if i % 2 == 0 else "odd") for i in range(40)], "id long, kind string")
    got = {r["kind"]: r for r in relational.won_by_kind(spark.createDataFrame(rows, "id long, step long, target int, score double"), kinds, 20).collect()}
    for kind, p in (("even", 0), ("odd", 1)):
        each = []
        for i in range(p, 10, 2):
            won = [(x > y) + 0.5 * (x == y) for j, s, t, x in rows if j == i and t for k, s2, _, y in rows if k >= 10 and s2 == s]
            each.append(sum(won) / len(won))
        assert got[kind]["series"] == 5 and got[kind]["auc"] == pytest.approx(sum(each) / 5)


def test_holds_are_their_recursions(spark):
    rng = np.random.default_rng(5)
    x, e = rng.random(80), 3 * rng.random(80)
    df = spark.createDataFrame([(1, t, float(a), float(b)) for t, (a, b) in enumerate(zip(x, e))], "id long, step long, score double, error double")
    gate = peak = 0.0
    for r, t in zip(learn.held(df, exit_rows=5, exit_share=0.9).orderBy("step").collect(), range(80)):
        gate, peak = max(x[t], gate * (0.99 if e[t] < 1.5 else 0.999)), max(x[t], peak * 0.999)
        mean = x[max(0, t - 4) : t + 1].mean()
        peak = mean if mean < 0.9 * peak else peak
        assert (r["gated"], r["entry_exit"]) == pytest.approx((gate, peak), abs=1e-9)
    known = spark.createDataFrame([(1, 0.2), (1, 0.4), (1, 0.9)], "id long, score double")
    assert learn.calibrated(df.limit(1), known).first()["score"] == pytest.approx(x[0] - 0.4)


@pytest.fixture(scope="module")
def channels(spark):
    rng, rows = np.random.default_rng(6), []
    for i in range(60):
        for s in range(20):
            y = int(i % 2 and s >= 8)
            rows.append((i, s, y, float(1 / (1 + math.exp(-(1.5 * y + rng.normal())))), float(rng.random())))
    return spark.createDataFrame(rows, "id long, step long, target int, good double, noise double").cache()


def test_learners_find_the_channel_that_tells(spark, channels, tmp_path):
    names, auc = ["good", "noise"], lambda df: metrics.ts_auc(df).first()["ts_auc"]
    base = auc(channels.withColumnRenamed("good", "score"))
    ranked = learn.ranker(channels, names)
    assert ranked.select("id", "step").distinct().count() == ranked.count() and auc(ranked) > base - 0.05
    special = learn.specialists(channels, names, (0, 10))
    assert special.count() == learn.folds(channels).where("fold = 0").count() and auc(special) > base - 0.15
    table = {r["name"]: r["ts_auc"] for r in learn.holdout(channels, names).collect()}
    assert set(table) == {"model", "good", "noise"} and table["good"] > table["noise"] and table["model"] > table["noise"]
    learn.saved(channels, names, f"{tmp_path}/model")
    again = learn.loaded(f"{tmp_path}/model", channels, names)
    assert again.count() == channels.count() and auc(again) > base - 0.05
    assert learn.importances(channels, names)[0][0] == "good"
    groups = learn.rank_groups(channels, 20).groupBy("step", "chunk").count().collect()
    assert len(groups) == 60 and sum(r["count"] for r in groups) == channels.count()


def test_separation_sees_what_labels_say(spark):
    rng = np.random.default_rng(7)
    rows = [(i, i % 2, float(rng.normal() + 1.5 * (i % 2)), float(rng.normal())) for i in range(300)]
    got = {r["labels"]: r["auc"] for r in learn.separation(spark.createDataFrame(rows, "id long, y int, a double, b double"), ["a", "b"], "y").collect()}
    assert got["given"] > 0.8 and 0.35 < got["permuted"] < 0.65


def test_first_order_moving_average_and_volatility_are_the_best_of_a_fine_grid():
    x = arma(11, 900, theta=0.45)
    theta, var = dynamics.moving_average(x)

    def spread(t):
        e, out = 0.0, []
        for v in x:
            e = v - t * e
            out.append(e)
        return np.var(out[20:])

    assert var == pytest.approx(spread(theta), rel=1e-9) and var <= min(spread(t) for t in np.linspace(-0.95, 0.95, 381)) * (1 + 1e-7)
    assert abs(dynamics.moving_average(np.random.default_rng(0).normal(size=900))[0]) < 0.1 and abs(dynamics.moving_average(np.cumsum(x))[0]) < 1
    e, s2 = np.random.default_rng(12).normal(size=1500), 1.0
    for t in range(1500):
        e[t] *= math.sqrt(s2)
        s2 = 0.1 + 0.15 * e[t] ** 2 + 0.75 * s2
    alpha, beta, gain = dynamics.volatility(e)

    def cost(a, b):
        v = np.mean(e**2) + 1e-12
        s, total = (1 - a - b) * v / (1 - b), 0.0
        for k in range(len(e)):
            s = (1 - a - b) * v + a * (e[k - 1] ** 2 if k else v) + b * s
            total += 0.5 * (math.log(s) + e[k] ** 2 / s)
        return total

    flat = cost(0.0, 0.0)
    assert gain == pytest.approx(flat - cost(alpha, beta), abs=1e-6)
    assert gain >= max(flat - cost(a, b) for a in np.arange(0.02, 0.5, 0.06) for b in np.arange(0, 0.95, 0.05) if a + b < 0.999) - 1e-6


def test_statistics_of_processes_by_definition():
    rng = np.random.default_rng(21)
    x = rng.integers(0, 6, 200).astype(float)
    assert dynamics.midranks(x) == pytest.approx([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    y = np.concatenate([rng.normal(0, 1, 30), rng.normal(6, 1, 12)])
    s = np.sort(y)
    j = min(range(2, 40), key=lambda k: s[:k].var() * k + s[k:].var() * (42 - k))
    left = math.sqrt((s[:j].var() * j + s[j:].var() * (42 - j)) / 42)
    assert dynamics.two_levels(y) == pytest.approx(((s[j:].mean() - s[:j].mean()) / left, 1 - j / 42)) and j == 30
    assert dynamics.bimodality(y) > 5 / 9 > dynamics.bimodality(rng.normal(size=400))
    wave = np.sin(2 * np.pi * np.arange(240) / 12) + 0.3 * rng.normal(size=240)
    g, logp, period, share = dynamics.highest_peak(wave)
    power = [abs(sum(v * np.exp(-2j * np.pi * k * t / 240) for t, v in enumerate(wave - wave.mean()))) ** 2 for k in range(1, 120)]
    assert g == pytest.approx(max(power) / sum(power)) and period == 12 and logp == pytest.approx(math.log10(119) + 118 * math.log10(1 - g))
    assert share == pytest.approx(sum(power[17:22]) / sum(power[0:40]))
    known = dynamics._t_ratios()
    two = lambda p: (2 * p - 1) / math.sqrt(2 * p * (1 - p))  # noqa: E731  the quantile of Student's t of two degrees
    assert np.interp(0.5, *known) == pytest.approx(two(0.99) / two(0.75), rel=2e-3)
    assert dynamics.tail_freedom(np.array([two(p) for p in (np.arange(20000) + 0.5) / 20000]), known) == pytest.approx(2, rel=0.02)
    assert dynamics.tail_freedom(rng.uniform(size=500), known) == 1e6
    signs = np.sign(wave)
    n, a = 240, int((signs > 0).sum())
    mean = 1 + 2 * a * (n - a) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    assert dynamics.runs_score(wave) == pytest.approx((1 + (signs[1:] != signs[:-1]).sum() - mean) / math.sqrt(var))


def test_kinds_of_volatility_are_told_apart_after_standardising(spark):
    rng = np.random.default_rng(31)
    calm = np.repeat(rng.permutation([0.4, 3.0] * 10), 150)[:3000] * rng.normal(size=3000)
    garch, s2 = rng.normal(size=3000), 1.0
    for t in range(3000):
        garch[t] *= math.sqrt(s2)
        s2 = 0.05 + 0.25 * garch[t] ** 2 + 0.7 * s2
    series = {1: rng.normal(size=3000), 2: calm, 3: garch}
    rows = [(i, t, float(v), 1, t - 3000) for i, x in series.items() for t, v in enumerate(x)]
    made = dynamics.dynamics(spark.createDataFrame(rows, "id long, time long, value double, period int, step long")).cache()
    kinds, by = {r["id"]: r for r in dynamics.kinds(made).collect()}, {r["id"]: r for r in made.collect()}
    assert [kinds[i]["volatility"] for i in (1, 2, 3)] == ["const", "regime", "clustered"]
    assert by[3]["white_kurt"] < by[3]["res_kurt"] / 2 and kinds[3]["innovation"] in ("gauss", "t10-30") and by[1]["white_kurt"] == by[1]["res_kurt"]
    assert by[2]["variance_gap"] > by[1]["variance_gap"] and abs(by[2]["variance_high_share"] - 0.5) < 0.15


def test_sampled_steps_and_ordered_windows(spark):
    from driftline.plans import fits

    panel = from_table(spark.createDataFrame([(i, t, float((t * 37 + i) % 101)) for i, n in ((1, 400), (2, 90)) for t in range(n)], "s long, t long, v double"), "s", ["t"], "v", 0.5)
    kept = {i: [r["step"] for r in augment.sampled_steps(panel.where("period = 2")).where(F.col("id") == i).orderBy("step").collect()] for i in (1, 2)}
    assert kept[2] == list(range(45)) and kept[1][:3] == [0, 1, 2] and kept[1][-1] == 199 and len(kept[1]) < 60
    rows = views.ordered_window(panel, fits.moments(panel), rows=4).where("id = 1").orderBy("step").collect()
    x = np.array([r["value"] for r in panel.where("id = 1").orderBy("time").collect()])
    z = (x[200:] - x[:200].mean()) / x[:200].std()
    for t in (0, 2, 50):
        last = z[max(0, t - 3) : t + 1]
        pad = [0.0] * (4 - len(last))
        assert [rows[t][f"w{k}"] for k in range(4)] == pytest.approx([*pad, *last]) and [rows[t][f"o{k}"] for k in range(4)] == pytest.approx([*sorted(last), *pad])
