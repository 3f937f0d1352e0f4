"""Values of queries that SQL does not give, against loops."""

import math

import numpy as np
import pytest

from driftline import queries
from driftline.operators import innovations, learn
from driftline.plans.panel import from_table, lineitem_panel

SMALL = "/root/testdata/sf0.001"


def cusum(x, drift=0.25):
    up = down = 0.0
    out = []
    for v in x:
        up, down = max(0.0, up + v - drift), max(0.0, down - v - drift)
        out.append(max(up, down))
    return np.array(out)


def mean(x, alpha):
    m, out = 0.0, []
    for v in x:
        m += alpha * (v - m)
        out.append(m)
    return np.array(out)


def test_dependence_channels(spark):
    rows = queries.dependence_channels(spark, SMALL).where("id = 3").orderBy("step").toPandas()
    points = lineitem_panel(spark, SMALL).where("id = 3").orderBy("time").toPandas()
    h, o = (points[points["period"] == p]["value"].to_numpy() for p in (1, 2))
    z, n = (np.concatenate([h, o]) - h.mean()) / h.std(), len(h)
    lags = np.array([[z[t - j] for j in range(1, 6)] for t in range(5, len(z))])
    coef = np.linalg.lstsq(lags[: n - 5], z[5:n], rcond=None)[0]
    u = np.concatenate([np.zeros(5), z[5:] - lags @ coef])
    u /= u[5:n].std()

    def product(x, k):
        ref = np.array([x[t] * x[t - k] for t in range(5 + k, n)])
        return (np.array([x[t] * x[t - k] for t in range(n, len(x))]) - ref.mean()) / ref.std()

    q, a = {k: product(u, k) for k in range(1, 11)}, {k: product(np.abs(u), k) for k in (1, 2, 5)}
    clip = lambda x: np.clip(x, -50, 50)
    for k in (1, 2, 3, 5, 10):
        assert np.allclose(rows[f"dep{k}_cusum"], clip(cusum(q[k])), atol=1e-6)
        assert np.allclose(rows[f"dep{k}_fast"], mean(q[k], 0.02), atol=1e-6) and np.allclose(rows[f"dep{k}_slow"], mean(q[k], 0.005), atol=1e-6)
    for k in (1, 2, 5):
        assert np.allclose(rows[f"abs{k}_cusum"], clip(cusum(a[k])), atol=1e-6) and np.allclose(rows[f"abs{k}_ewma"], mean(a[k], 0.01), atol=1e-6)
    assert np.allclose(rows["port_fast"], clip(199 * sum(mean(q[k], 0.01) ** 2 for k in q)), atol=1e-5)
    assert np.allclose(rows["port_slow"], clip(666 * sum(mean(q[k], 0.003) ** 2 for k in q)), atol=1e-5)
    assert rows.shape[1] == 2 + 23


def test_interactions_of_one_row(spark):
    v = {"ks": 0.4, "dmean": -1.5, "dlogsd": 0.7, "half_mean": 0.3, "half_logsd": -0.2, "a_ks": 0.1, "a_dmean": 0.2, "a_dlogsd": -0.9, "a_half_mean": -0.6, "a_half_logsd": 0.1, "scan": 0.8}
    r = learn.interactions(spark.createDataFrame([(1, 0, *v.values())], ["id", "step", *v])).first()
    raw, asinh, half, a_half = 1.5, 0.9, 0.5, 0.7
    inner = max(half, a_half, 2 * 0.3)
    want = {"outer_raw": raw, "outer_asinh": asinh, "inner": inner, "quiet_raw": raw * 0.2, "quiet_asinh": asinh * 0.2, "net_raw": raw - inner, "net_asinh": asinh - inner, "damped_raw": raw * math.exp(-1.0), "damped_asinh": asinh * math.exp(-1.4), "balance": inner - 0.5 * (raw + asinh)}
    assert {c: r[c] for c in want} == pytest.approx(want)


def test_calibration_by_the_end_of_the_history(spark):
    rng = np.random.default_rng(14)
    x = np.concatenate([rng.normal(size=700), rng.normal(0.4, 1.3, size=120)])
    panel = from_table(spark.createDataFrame([(1, t, float(v)) for t, v in enumerate(x)], "s long, t long, v double"), "s", ["t"], "v", 0.8)
    rows = innovations.streams(panel, tail=100_000).cache()
    nu = rows.orderBy("step").toPandas()
    h, o = nu[nu["step"] < 0]["nu"].to_numpy(), nu[nu["step"] >= 0]["nu"].to_numpy()
    part = len(h) // 2
    late, got = np.clip(h[-part:], -4.5, 4.5), innovations.calibrated(rows).orderBy("step").toPandas()
    made = {"mean_cusum": cusum, "mean_fast": lambda v: mean(v, 0.02), "mean_slow": lambda v: mean(v, 0.005), "scale_fast": lambda v: mean((v * v - 1) / math.sqrt(2), 0.02), "prefix": lambda v: np.cumsum(v) / np.sqrt(np.arange(1, len(v) + 1))}
    for name, f in made.items():
        null = np.clip(f(late), -60, 60)
        assert np.allclose(got[name], np.clip((np.clip(f(o), -60, 60) - null.mean()) / (null.std() + 1e-6), -30, 30), atol=1e-5), name
