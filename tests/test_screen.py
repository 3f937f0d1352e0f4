"""The screen of hidden breaks against loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.operators import screen
from driftline.plans.panel import from_table, with_breaks

WIDTH = 80


@pytest.fixture(scope="module")
def panel(spark):
    rng, rows = np.random.default_rng(9), []
    for i in range(24):
        x = rng.normal(size=400)
        if i % 2 == 0 and i % 4:  # these breaks turn neighbours' squares, not what the rule looks at
            for t in range(251, 400):
                x[t] = np.sign(x[t]) * (0.6 * abs(x[t - 1]) + 0.5 * abs(x[t]))
        rows += [(i, t, float(v)) for t, v in enumerate(x)]
    made = from_table(spark.createDataFrame(rows, "s long, t long, v double"), "s", ["t"], "v", 0.4)
    return with_breaks(made, F.col("id") % 2 == 0, F.lit(90) - F.col("id"), factor=1.0).cache()


def test_cases_windows_and_statistics(panel):
    found = screen.cases(panel, WIDTH).cache()
    cases = {(r["case"], r["place"]): r for r in found.collect()}
    assert {c for c, p in cases if p == 0} == set(range(0, 24, 2)) and all(cases[c, p]["id"] % 2 == 1 and cases[c, p]["cut"] == 90 - c for c, p in cases if p)
    assert len(cases) == 36
    got = screen.statistics(screen.sides(panel, found, WIDTH)).collect()
    values = {i: np.array([r["value"] for r in panel.where(f"id = {i}").orderBy("time").collect()]) for i in {r["id"] for r in cases.values()}}
    assert len(got) == 72
    for r in got[:20]:
        c = cases[r["case"], r["place"]]
        cut = 160 + c["cut"]
        v = values[c["id"]][cut : cut + WIDTH] if r["after"] else values[c["id"]][cut - WIDTH : cut]
        z = (v - v.mean()) / (v.std() + 1e-12)
        d, corr = np.diff(z), lambda a, b: np.corrcoef(a, b)[0, 1]
        want = {f"ac{k}": corr(z[:-k], z[k:]) for k in screen.LAGS} | {
            "vol_ac1": corr(z[:-1] ** 2, z[1:] ** 2), "abs_ac5": corr(abs(z[:-5]), abs(z[5:])), "diff_sd": d.std(), "diff_kurt": pd.Series(d).kurt(), "turning": corr(d[:-1], d[1:]), "bend": corr(z[1:], z[:-1] ** 2),
            "q95": np.quantile(abs(z), 0.95), "q99": np.quantile(abs(z), 0.99), "crossing": (np.diff(np.sign(z)) != 0).mean(), "long_var": np.var([z[i : i + 50].mean() for i in range(0, WIDTH - 50, 10)]),
            "mean": v.mean(), "sd": v.std(), "kurt": pd.Series(v).kurt(),
        }
        assert {c: r[c] for c in want} == pytest.approx(want, abs=1e-8)


def test_spectra_and_excess(panel):
    found = screen.cases(panel, WIDTH)
    rows = screen.sides(panel, found, WIDTH).cache()
    one = rows.where("case = 2 and place = 0 and after = 1").orderBy("pos").toPandas()["value"].to_numpy()
    z = (one - one.mean()) / one.std()
    power = np.array([abs(sum(v * w * np.exp(-2j * np.pi * k * t / WIDTH) for t, (v, w) in enumerate(zip(z, np.hanning(WIDTH))))) ** 2 for k in range(1, WIDTH // 2 + 1)])
    share = power / power.sum()
    r = screen.spectra(rows).where("case = 2 and place = 0 and after = 1").first()
    assert [r[c] for c in screen.SPECTRUM] == pytest.approx([share[:5].sum(), share[5:13].sum(), share[26:].sum(), -(share * np.log(share)).sum(), share.max()], abs=1e-6)
    changes = screen.judged(screen.statistics(rows), screen.STATISTICS).cache()
    table = {(r["hidden"], r["name"]): r for r in screen.excess(changes, screen.STATISTICS).collect()}
    local = changes.toPandas()
    for hidden in (True, False):
        part = local[local["hidden"] == hidden]
        b, c = part[part["broken"] == 1]["vol_ac1"], part[part["broken"] == 0]["vol_ac1"]
        r = table[hidden, "vol_ac1"]
        assert (r["breaks"], r["controls"]) == (len(b), len(c)) and r["ratio"] == pytest.approx(b.std() / c.std()) and r["far_break"] == pytest.approx((b.abs() > 2 * c.std()).mean())
    assert local["hidden"].any()
