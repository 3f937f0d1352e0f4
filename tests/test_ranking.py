"""The list-wise ranker against loops over pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import learn, metrics, ranking


def test_derivatives_are_those_of_all_pairs():
    rng = np.random.default_rng(2)
    s, y = np.round(rng.normal(size=60), 1), rng.integers(0, 2, 60)
    loss = lambda s: sum(np.log1p(np.exp(s[j] - s[i])) for i in np.flatnonzero(y == 1) for j in np.flatnonzero(y == 0))
    first, second = ranking.derivatives(s, y)
    for k in range(0, 60, 7):
        e = np.zeros(60)
        e[k] = 1e-4
        assert first[k] == pytest.approx((loss(s + e) - loss(s - e)) / 2e-4, abs=1e-5)
        assert second[k] == pytest.approx((loss(s + e) - 2 * loss(s) + loss(s - e)) / 1e-8, abs=1e-2)
    fine = rng.normal(size=3000)
    y = rng.integers(0, 2, 3000)
    whole, some = ranking.derivatives(fine, y, 10_000)[0], ranking.derivatives(fine, y, 256)[0]
    assert np.abs(whole - some).max() < 0.01 * np.abs(whole).max()
    assert all(len(d) == 3 and not d.any() for d in ranking.derivatives(np.zeros(3), np.ones(3, int)))


def test_a_split_is_the_best_of_all(spark):
    rng = np.random.default_rng(3)
    x, g, h = rng.integers(0, 6, (200, 2)), rng.normal(size=200), rng.random(200)
    sums = np.zeros((2, 6, 2))
    for c in range(2):
        for b in range(6):
            sums[c, b] = g[x[:, c] == b].sum(), h[x[:, c] == b].sum()
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(((gain(x[:, c] <= b) + gain(x[:, c] > b), c, b) for c in range(2) for b in range(5)))
    assert ranking.best_split(sums, 1.0) == best[1:]
    assert list(ranking.walked(np.array([[0, 5], [3, 5], [3, 1]]), [(0, 2), (1, 0), (1, 3)], 2)) == [1, 3, 2]


@pytest.fixture(scope="module")
def channels(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(120):
        tau = int(rng.integers(0, 40)) if i % 2 else 99
        for t in range(40):
            y = int(t >= tau)
            hill = rng.normal() * (2.5 if y else 1.0)  # the class is told by how far from zero: no line ranks it
            rows.append((i, t, y, float(hill + t), float(rng.normal() + 0.3 * y), None if i % 17 == 0 else float(rng.normal())))
    df = spark.createDataFrame(rows, "id long, step long, target int, hill double, lean double, noise double")
    return df.withColumn("hill", F.col("hill") - F.col("step")).cache()


def test_trees_on_pairs_rank_what_a_line_does_not(channels):
    names = ["hill", "lean", "noise"]
    made = ranking.listwise(channels, names, rounds=8)
    rows = made.collect()
    assert len(rows) == channels.count() and len({(r["id"], r["step"]) for r in rows}) == len(rows)
    auc = lambda df: metrics.ts_auc(df).first()["ts_auc"]
    assert auc(made) > auc(learn.ranker(channels, names)) + 0.05
    by_fold = {}
    for r in rows:
        by_fold.setdefault(r["id"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in by_fold.values())


def test_chunks_of_a_crowded_step_and_no_rows(spark, channels):
    names = ["hill", "lean"]
    some = ranking.listwise(channels, names, rounds=2, most=30)
    assert some.count() == channels.count()
    groups, _ = ranking.grouped(channels, names, 8, 30, 5)
    assert groups.agg(F.max(F.size("id"))).first()[0] <= 60
    assert ranking.listwise(channels.where("id < 0"), names, rounds=1).count() == 0


def test_rows_of_a_crowded_step_meet_over_all_its_records(channels):
    names = ["hill", "lean"]
    by = lambda df: {(r["id"], r["step"]): r["score"] for r in df.collect()}
    one, many = by(ranking.listwise(channels, names, rounds=2)), by(ranking.listwise(channels, names, rounds=2, most=30))
    assert max(abs(one[k] - many[k]) for k in one) < 1e-9 and len(set(one.values())) > 10


def test_derivatives_lose_no_digits_to_many_scores():
    rng = np.random.default_rng(5)
    s, y = rng.normal(size=2000) * 3, rng.integers(0, 2, 2000)
    for direct, nodes in zip(ranking.derivatives(s, y, 2000), ranking.derivatives(s, y, 256)):
        assert np.abs(direct - nodes).max() < 1e-9
