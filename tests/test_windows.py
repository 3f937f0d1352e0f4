"""Window expressions of the channel families against plain loops, on a history of 1,000 points and 999 online steps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import families, forensics
from driftline.plans import fits
from driftline.plans.panel import online
from driftline.plans.staged import decayed_max, ewma, means, rendered


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(8)
    x = rng.standard_t(5, size=1999)
    for t in range(1, len(x)):
        x[t] += 0.3 * x[t - 1]
    x[1500:] = 1.7 * x[1500:] + 0.4
    return x[:1000], x[1000:]


@pytest.fixture(scope="module")
def whole(spark, data):
    rows = [(1, t, float(v), 1000, 999, 1 if t < 1000 else 2, t - 1000, 0) for t, v in enumerate(np.concatenate(data))]
    return spark.createDataFrame(rows, "id long, time long, value double, hist_len long, onl_len long, period int, step long, target int").cache()


def columns(df, names):
    rows = df.where("id = 1").orderBy("step").select(*names).collect()
    return {n: np.array([r[n] for r in rows], float) for n in names}


def smoothed(x, alpha, start=0.0):
    out, v = [], start
    for a in x:
        v = (1 - alpha) * v + alpha * a
        out.append(v)
    return np.array(out)


def squash(r):
    return 1 / (1 + np.exp(-2 * (r - 1)))


def detrended(data):
    h, o = data
    slope, level = np.polyfit(np.arange(len(h)), h, 1)
    rest = h - slope * np.arange(len(h)) - level
    sd = math.sqrt((rest**2).sum() / (len(h) - 1))
    rho = (rest[1:] * rest[:-1]).sum() / (rest**2).sum()
    most = min(max(4 + 0.5 * math.sqrt(max((rest**4).mean() / sd**4 - 3, 0)), 4), 8)
    z = np.clip((o - slope * (len(h) + np.arange(len(o))) - level) / sd, -most, most)
    return z, rho, z / math.sqrt((1 + rho) / (1 - rho)), (h[-1] - slope * (len(h) - 1) - level) / sd


def test_page_hinkley_and_the_other_views(whole, data):
    z, rho, raw, before = detrended(data)
    w = (z - rho * np.concatenate([[before], z[:-1]])) / math.sqrt(1 - rho * rho)
    got = columns(rendered(online(whole, fits.trend(whole)), families.monitor()[0]), ["raw_page_hinkley", "whitened_page_hinkley", "absolute_page_hinkley_now", "whitened_cusum"])
    for name, x, drift, law, now in (("raw_page_hinkley", raw, 0.05, 1, 0), ("whitened_page_hinkley", w, 0.05, 1, 0), ("absolute_page_hinkley_now", abs(w) - 0.7979, 0.05, 1, 1), ("whitened_cusum", w, 0.5, 0, 0)):
        up = down = peak = 0.0
        for t, v in enumerate(x):
            up, down = max(0.0, up + v - drift), max(0.0, down - v - drift)
            peak = max(peak, up, down)
            n = max(t + 1, 2)
            scale = (math.sqrt(n) if law else 0.84 * math.log(n)) + 1e-9
            assert got[name][t] == pytest.approx(squash((max(up, down) if now else peak) / scale), abs=1e-8)


def test_multiscale(whole, data):
    x = detrended(data)[2]
    names = families.multiscale()[1]
    got = columns(rendered(online(whole, fits.trend(whole)), families.multiscale()[0]), names)
    for s in families.SCALES:
        a = 2 / (s + 1)
        m, v, weight = smoothed(x, a), smoothed(x * x, a, 1.0), 1 - (1 - a) ** np.arange(1, len(x) + 1)
        ripe = np.sqrt(np.minimum(weight * (2 - a), 1))
        mean, var = abs(m) / math.sqrt(a / (2 - a)) * ripe, abs(np.log(np.maximum(v, 1e-9))) / math.sqrt(2 * a / (2 - a)) * ripe
        assert np.allclose(got[f"now_mean_{s}"], mean, atol=1e-8) and np.allclose(got[f"now_var_{s}"], var, atol=1e-8)
        assert np.allclose(got[f"peak_mean_{s}"], np.maximum.accumulate(mean), atol=1e-8) and np.allclose(got[f"peak_var_{s}"], np.maximum.accumulate(var), atol=1e-8)


def z_of(data):
    h, o = data
    return tuple((x - h.mean()) / (h.std() + 1e-12) for x in (h, o))


def test_rolling_autocorrelations(whole, data):
    zh, zo = z_of(data)
    lags, windows = (1, 2, 30), (50, 200)
    stages, names = families.rolling_acf(lags, windows)
    got = columns(rendered(online(whole, fits.acf_reference(whole, lags)), stages), names)
    z = np.concatenate([zh, zo])
    for w in windows:
        den = smoothed(zo * zo, 1 / w, 1.0)
        for k in lags:
            num = smoothed(zo * z[len(zh) - k : len(z) - k], 1 / w)
            assert np.allclose(got[f"acf{k}_{w}"], np.clip(num / den, -1.5, 1.5) - np.corrcoef(zh[:-k], zh[k:])[0, 1], atol=1e-8)


def test_likelihood_ratios_of_trailing_windows(whole, data):
    zh, zo = z_of(data)
    stages, names = families.glr()
    got = columns(rendered(online(whole, fits.moments(whole)), stages), names)
    before = np.concatenate([zh[-1:], zo[:-1]])
    for t in (0, 6, 100, 998):
        best = [0.0, 0.0, 0.0]
        for m in (8, 16, 32, 64, 128, 256):
            x, y = zo[max(0, t + 1 - m) : t + 1], before[max(0, t + 1 - m) : t + 1]
            v, r = max((x * x).mean(), 1e-6), np.clip((x * y).sum() / (x * x).sum(), -0.99, 0.99)
            each = [abs(x.sum()) / math.sqrt(len(x)), 0.5 * len(x) * (v - 1 - math.log(v)), -0.5 * len(x) * math.log(1 - r * r)]
            best = [max(a, b) for a, b in zip(best, each)]
            assert [got[f"glr_{k}{m}"][t] for k in ("mean", "scale", "dep")] == pytest.approx(each, abs=1e-7)
        assert [got[f"glr_{k}_max"][t] for k in ("mean", "scale", "dep")] == pytest.approx(best, abs=1e-7)


def test_tails(whole, data):
    zh, zo = z_of(data)
    stages, names = families.tails()
    assert len(names) == 40
    got = columns(rendered(online(whole, fits.tail_reference(whole)), stages), names)
    a, h = abs(zo), abs(zh)
    q = np.quantile(h, [0.9, 0.975, 0.995])
    hi, lo = np.quantile(zh, [0.975, 0.025])
    out = (a > q[0]).astype(float)
    parts = {"t1": out - 0, "t2": a > q[1], "t3": a > q[2], "t4": np.maximum(a - q[0], 0) / ((h[h > q[0]] - q[0]).mean() + 1e-9), "t5": zo > hi, "t6": zo < lo, "t7": out * np.concatenate([[0], out[:-1]])}
    less = {"t1": 0.1, "t2": 0.025, "t3": 0.005, "t4": 0.1, "t5": 0.025, "t6": 0.025, "t7": 0.01}
    for w in families.TAIL_WINDOWS:
        for k, x in parts.items():
            assert np.allclose(got[f"{k}_{w}"], np.clip(smoothed(np.asarray(x, float), 1 / w) - less[k], -20, 20), atol=1e-8), (k, w)
        blocks = [h[i : i + w].max() for i in range(0, max(len(h) - w, 1), max(w // 2, 1))]
        top, most = 0.0, []
        for v in a:
            top = max(top * (1 - 0.5 / w), v)
            most.append(top / np.median(blocks) - 1)
        assert np.allclose(got[f"t8_{w}"], np.clip(most, -20, 20), atol=1e-8)


def test_trailing_features(whole, data):
    _, z = z_of(data)
    stages, names = families.trailing()
    rows = rendered(online(whole, fits.moments(whole)), stages).orderBy("step").select(*names).collect()
    for t in (0, 4, 9, 10, 11, 40, 998):
        r = rows[t]
        assert r["prefix"] == pytest.approx(z[: t + 1].sum() / math.sqrt(t + 1), abs=1e-8)
        assert (r["deviation"] is None) == (t < 10) and (t < 10 or r["deviation"] == pytest.approx(z[t] - z[t - 10 : t].mean(), abs=1e-9))
        assert r["velocity10"] == pytest.approx(z[t] - z[t - 10] if t >= 10 else 0.0, abs=1e-9) and r["velocity30"] == pytest.approx(z[t] - z[t - 30] if t >= 30 else 0.0, abs=1e-9)
        assert [r[f"lag{k}"] for k in range(1, 9)] == pytest.approx([z[t - k] if t >= k else None for k in range(1, 9)], abs=1e-9)
        if t >= 5:
            assert (r["mean5"], r["sd5"]) == pytest.approx((z[t - 5 : t].mean(), z[t - 5 : t].std()), abs=1e-9)
        assert r["diff1"] == pytest.approx(3 * (z[t] - z[t - 1]) if t else 0.0, abs=1e-9)


def test_wide_mass_battery(whole, data):
    zh, zo = z_of(data)
    stages, names = families.mass(families.WIDE_MASS_WINDOWS, shapes=True)
    assert len(names) == 216
    some = ["skew_z50", "kurt_z50", "skew_a5", "kurt_d1000", "gap_c25", "exc2_500"]
    got = columns(rendered(online(whole, fits.mass_reference(whole, shapes=True)), stages), some)
    reps = {"z": (zh, zo), "a": (abs(zh), abs(zo)), "d": (np.diff(zh, prepend=zh[0]), np.diff(np.concatenate([zh[-1:], zo])))}
    for kind, k, w in (("skew", "z", 50), ("kurt", "z", 50), ("skew", "a", 5), ("kurt", "d", 1000)):
        h, x = reps[k]
        m = [smoothed(x**n, 1 / w) for n in range(1, 5)]
        v = np.maximum(m[1] - m[0] ** 2, 1e-9)
        ref = ((h - h.mean()) / (h.std() + 1e-9)) ** (3 if kind == "skew" else 4)
        made = (m[2] - 3 * m[0] * v - m[0] ** 3) / (v**1.5 + 1e-9) if kind == "skew" else (m[3] - 4 * m[0] * m[2] + 6 * m[0] ** 2 * m[1] - 3 * m[0] ** 4) / (v**2 + 1e-9)
        assert np.allclose(got[f"{kind}_{k}{w}"], np.clip(made - ref.mean(), -20, 20), atol=1e-5), kind
    assert np.allclose(got["exc2_500"], smoothed((abs(zo) > np.quantile(abs(zh), 0.95)).astype(float), 1 / 500) - 0.05, atol=1e-9)


def test_mass_against_what_came_before_its_windows(whole, data):
    zh, zo = z_of(data)
    stages, names = families.mass_lagged()
    assert len(names) == 90
    some = ["lgap_z10", "lgap_a50", "lgap_c250", "llvr_z500", "llvr_d25", "lgap_s100", "exc1_10"]
    got = columns(rendered(online(whole, fits.mass_reference(whole)), stages), some)
    reps = {"z": (zh, zo), "a": (abs(zh), abs(zo)), "d": (np.diff(zh, prepend=zh[0]), np.diff(np.concatenate([zh[-1:], zo]))), "s": (np.sign(zh), np.sign(zo)), "c": (np.zeros_like(zh), np.cumsum(zo) / np.sqrt(np.arange(1, len(zo) + 1)))}
    for name in some[:-1]:
        kind, k, w = name[:4], name.split("_")[1][0], int(name.split("_")[1][1:])
        h, x = reps[k]
        hm, hv = h.mean(), h.var() + 1e-9
        one, two, r1, r2 = 0.0, 0.0, hm, hv + hm * hm
        for t, v in enumerate(x):
            one, two = one + (v - one) / w, two + (v * v - two) / w
            m, s = (r1, max(r2 - r1 * r1, 1e-9)) if t >= 25 else (hm, hv)
            want = (one - m) / math.sqrt(s / w) if kind == "lgap" else math.log(max(two - one * one, 1e-9) / s)
            assert got[name][t] == pytest.approx(np.clip(want, -20, 20), abs=1e-5), (name, t)
            if t >= w:
                r1, r2 = r1 + (x[t - w] - r1) / 500, r2 + (x[t - w] ** 2 - r2) / 500


def test_divergences_against_counts(whole, data):
    h, o = data
    stages, names = forensics.divergences()
    assert len(names) == 8
    got = columns(rendered(online(whole, forensics.bin_reference(whole)), stages), names)
    edges = np.quantile(h, np.arange(1, 32) / 32)
    where = lambda x: (edges[None] < x[:, None]).sum(axis=1)
    smooth = lambda x: (lambda p: p / p.sum())(np.bincount(where(x), minlength=32) / len(x) + 1e-9)
    ph, bins = smooth(h), where(h)
    centre = np.array([np.median(h[bins == b]) for b in range(32)]) / (h.std() + 1e-12)
    for t in (1, 50, 101, 999):
        for n, part in (("prefix", o[:t]), ("window", o[max(0, t - 100) : t])):
            p = smooth(part)
            m = (p + ph) / 2
            want = {"js": ((p * np.log(p / m)).sum() + (ph * np.log(ph / m)).sum()) / 2, "hellinger": math.sqrt(max(0, 1 - np.sqrt(p * ph).sum())), "wasserstein": (abs(np.cumsum(p) - np.cumsum(ph))[:-1] * np.diff(centre)).sum(), "entropy": -(p * np.log(p)).sum() + (ph * np.log(ph)).sum()}
            for k, v in want.items():
                assert got[f"{k}_{n}"][t - 1] == pytest.approx(v, abs=1e-7), (k, n, t)


def test_normal_quantiles_by_expression(spark):
    from statistics import NormalDist

    from driftline.plans.staged import probit

    ps = [1e-9, 1e-6, 0.001, 0.02, 0.03, 0.3, 0.5, 0.77, 0.97, 0.98, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").selectExpr(f"{probit('p')} AS z").collect()
    assert [r["z"] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-8)


def test_exponential_means_and_decayed_maxima_of_any_length(spark):
    x = np.sin(np.arange(50_000.0)) + np.arange(50_000) % 7
    rows = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)] + [(2, -1, 9.0), (2, 0, None), (2, 1, 4.0)], "id long, step long, x double").repartition(5)
    got = rendered(rows, [{"fast": ewma("x", 1 / 3), "slow": f"2 * {ewma('x * x', 0.001, 1.0)}"}, {"top": decayed_max("abs(x)", 0.98), "after": ewma("fast", 0.5)}])
    got = {i: [r for r in got.where(f"id = {i}").orderBy("step").collect()] for i in (1, 2)}
    fast, slow, top, after = [], [], [], []
    f, s, m, a = 0.0, 1.0, 0.0, 0.0
    for v in x:
        f, s, m = f + (v - f) / 3, s + 0.001 * (v * v - s), max(0.98 * m, abs(v))
        a += 0.5 * (f - a)
        for out, y in ((fast, f), (slow, 2 * s), (top, m), (after, a)):
            out.append(y)
    for name, want in (("fast", fast), ("slow", slow), ("top", top), ("after", after)):
        assert np.abs(np.array([r[name] for r in got[1]]) - want).max() < 1e-9, name
    assert [r["fast"] for r in got[2]] == pytest.approx([0, 0, 4 / 3])


def test_exponential_means_of_blocks_are_the_loop():
    x = np.random.default_rng(0).normal(size=(3, 1000))
    for alpha, start, block in ((0.3, 0.0, 128), (0.01, 2.0, 7), (1.0, 5.0, 64)):
        y, want = np.full(3, start), []
        for k in range(1000):
            y = (1 - alpha) * y + alpha * x[:, k]
            want.append(y)
        assert np.abs(means(x, alpha, start, block) - np.array(want).T).max() < 1e-12
    assert means(np.empty((2, 0)), 0.1).shape == (2, 0)
