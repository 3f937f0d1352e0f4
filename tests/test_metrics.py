"""The ranked metric by hand and against the pairwise definition."""

import numpy as np
import pytest

from driftline.operators import metrics


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, step long, score double, target int")


def auc(spark, rows):
    return metrics.ts_auc(frame(spark, rows)).first()["ts_auc"]


def test_ties_count_half(spark):
    assert auc(spark, [(1, 0, 1.0, 1), (2, 0, 1.0, 0), (3, 0, 0.0, 0)]) == pytest.approx(0.75)


def test_equal_scores_are_a_coin(spark):
    assert auc(spark, [(i, 0, 0.3, i % 2) for i in range(5)]) == pytest.approx(0.5)


def test_steps_of_one_class_are_skipped(spark):
    assert auc(spark, [(1, 0, 0.1, 1), (2, 0, 0.2, 1), (1, 1, 0.3, 0)]) == 0.5


def test_steps_weigh_by_pairs(spark):
    rows = [(1, 0, 1.0, 1), (2, 0, 0.0, 0)]
    rows += [(i, 1, 0.5, i % 2) for i in range(4)]
    assert auc(spark, rows) == pytest.approx((1 + 4 * 0.5) / 5)


def test_against_pairs_on_a_ragged_panel(spark):
    rng, rows = np.random.default_rng(3), []
    for i in range(40):
        y = int(rng.integers(2))
        rows += [(i, s, float(np.round(rng.random(), 1)), y) for s in range(int(rng.integers(5, 30)))]
    won = total = 0.0
    for s in range(30):
        here = [(r[2], r[3]) for r in rows if r[1] == s]
        pos, neg = [x for x, y in here if y], [x for x, y in here if not y]
        total += len(pos) * len(neg)
        won += sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert auc(spark, rows) == pytest.approx(won / total, abs=1e-12)


def test_earnings_are_the_mean_share_of_pairs_won(spark):
    rows = [(1, 0, 0.9, 1), (2, 0, 0.9, 0), (3, 0, 0.1, 0), (4, 0, 0.5, 1), (1, 1, 0.2, 1), (2, 1, 0.4, 0), (3, 1, 0.2, 0), (5, 2, 0.3, 1)]
    won = {}
    for i, s, score, y in rows:
        against = [x for _, t, x, z in rows if t == s and z != y]
        if against:
            wins = sum(0.5 if x == score else float((score > x) == (y == 1)) for x in against)
            won.setdefault(i, []).append(wins / len(against))
    got = {r["id"]: r["earned"] for r in metrics.earnings(frame(spark, rows)).collect()}
    assert got == pytest.approx({i: sum(v) / len(v) for i, v in won.items()}) and set(got) == {1, 2, 3, 4}
