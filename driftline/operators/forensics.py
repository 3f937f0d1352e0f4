"""Statistics that describe a series, one row each, and batteries that compare a prefix with the history."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.special import ndtri
from driftline.operators.families import monitor as family_monitor
from driftline.operators.grouped import _by_series
from driftline.operators.innovations import scan_steps
from driftline.plans.staged import Stage, back, d, upto
from driftline.session import ship


def acf(x: np.ndarray, most: int) -> np.ndarray:
    c = x - x.mean()
    v = float(c @ c) or 1.0
    return np.array([c[k:] @ c[: len(c) - k] / v for k in range(1, most + 1)])


def pacf(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations from autocorrelations, order by order."""
    phi, out = np.zeros(0), []
    for k in range(len(r)):
        top = r[k] - (phi @ r[:k][::-1] if k else 0.0)
        below = 1 - (phi @ r[:k] if k else 0.0)
        a = top / below if abs(below) > 1e-12 else 0.0
        phi = np.append(phi - a * phi[::-1], a)
        out.append(a)
    return np.array(out)


def hurst(x: np.ndarray) -> float:
    """Slope of the rescaled range against the length, on doubling lengths."""
    sizes, values = [], []
    n = 16
    while n <= len(x) // 2:
        blocks = x[: len(x) // n * n].reshape(-1, n)
        c = np.cumsum(blocks - blocks.mean(axis=1, keepdims=True), axis=1)
        values.append(np.log(((c.max(axis=1) - c.min(axis=1)) / (blocks.std(axis=1) + 1e-12)).mean() + 1e-12))
        sizes.append(np.log(n))
        n *= 2
    return float(np.polyfit(sizes, values, 1)[0]) if len(sizes) > 1 else 0.5


def permutation_entropy(x: np.ndarray, order: int = 3) -> float:
    """Entropy of the order patterns of neighbours, as a share of its largest value."""
    if len(x) < order:
        return 0.0
    codes = np.lib.stride_tricks.sliding_window_view(x, order).argsort(axis=1, kind="stable") @ (order ** np.arange(order))
    p = np.unique(codes, return_counts=True)[1] / (len(x) - order + 1)
    return float(-(p * np.log(p)).sum() / np.log(float(np.prod(np.arange(1, order + 1)))))


def hill(x: np.ndarray, share: float = 0.1) -> float:
    """Tail index of |x| from its largest values."""
    top = np.sort(np.abs(x))[::-1][: max(2, int(len(x) * share))]
    return float(1 / max(np.log((top[:-1] + 1e-12) / (top[-1] + 1e-12)).mean(), 1e-12))


FEATURES = [f"acf{k}" for k in range(1, 6)] + [f"pacf{k}" for k in range(1, 6)] + ["ljung_box", "arch", "variance_ratio", "spectral_slope", "fisher_g", "hurst", "permutation_entropy", "hill"]


def series_features(panel: DataFrame, period: int = 1) -> DataFrame:
    """(id, features) of one period of each series."""
    ship(panel.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("time")["value"].to_numpy(float)
        n, r = len(x), acf(x, min(10, max(5, len(x) - 1)))
        power = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
        k = np.arange(1, len(power) + 1)
        five = x[: n // 5 * 5].reshape(-1, 5).sum(axis=1)
        row = [*r[:5], *pacf(r)[:5], n * (n + 2) * float((r**2 / (n - np.arange(1, len(r) + 1))).sum()), n * float((acf((x - x.mean()) ** 2, 5) ** 2).sum()), float(five.var() / (5 * x.var() + 1e-12)), float(np.polyfit(np.log(k), np.log(power + 1e-12), 1)[0]), float(power.max() / (power.sum() + 1e-12)), hurst(x), permutation_entropy(x), hill(x - x.mean())]
        return pd.DataFrame([[pdf["id"].iloc[0], *row]], columns=["id", *FEATURES])

    rows = panel.where(F.col("period") == period).select("id", "time", "value")
    return rows.groupBy("id").applyInPandas(one, "id long, " + ", ".join(f"{c} double" for c in FEATURES))


def detrended(h: np.ndarray, o: np.ndarray, clipped: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """History and online values less the history's line, by its deviation around it; clipped at the winsor limit if wanted.

    Histories of fewer than 16 points are taken as they are.
    """
    n = len(h)
    if n < 16:
        level, slope, sd, kurt = 0.0, 0.0, 1.0, 0.0
    else:
        at = np.arange(n) - (n - 1) / 2
        slope = float(at @ h / (at @ at))
        rest = h - h.mean() - slope * at
        level, sd = h.mean() + slope * (n - 1) / 2, max(float(np.sqrt(rest @ rest / (n - 1))), 1e-9)
        kurt = float(np.clip((rest**4).mean() / sd**4 - 3, -2, 50)) if n > 32 else 0.0
    zh = (h - level - slope * (np.arange(n) - n + 1)) / sd
    zo = (o - level - slope * (np.arange(len(o)) + 1)) / sd
    most = float(np.clip(4 + 0.5 * np.sqrt(max(kurt, 0.0)), 4, 8))
    return (np.clip(zh, -most, most), np.clip(zo, -most, most)) if clipped else (zh, zo)


def _held(made: dict[int, list[float]], n: int, width: int) -> np.ndarray:
    """Rows made after some numbers of points, each held until the next; zeros before the first."""
    at = np.array([0, *sorted(made)])
    rows = np.array([np.zeros(width), *(made[t] for t in sorted(made))]).reshape(-1, width)
    return rows[np.searchsorted(at, np.arange(1, n + 1), "right") - 1]


def _along(x: np.ndarray, k: int) -> float:
    """Correlation of a sequence with itself k points on; 0 where it is too short or does not vary."""
    if len(x) < k + 3:
        return 0.0
    pair = np.stack([x[:-k], x[k:]])
    pair = pair - pair.mean(axis=1, keepdims=True)
    sd = np.sqrt(np.square(pair).mean(axis=1))
    return float((pair[0] * pair[1]).mean() / sd.prod()) if sd.min() >= 1e-9 else 0.0


def _wider(a, b):
    return np.log((a + 1e-9) / (b + 1e-9))


QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
PREFIX = [f"dq{int(100 * q)}" for q in QUANTILES] + ["dmean", "dlogsd", "skew", "kurt", "ks", "dlogmad", "dacf1", "dacf2", "dacf5", "dabs", "rank_mean", "rank_logsd", "tail_mean", "tail_logsd", "half_mean", "half_logsd"]
PREFIX2 = ["dq10", "dq90", "cvm", "ad", "levene", "diff_logsd", "diff_acf", "diff_abs", "tail10_mean", "tail10_logsd", "tail25_mean", "tail25_logsd", "tail100_mean", "tail100_logsd", "above95", "below5", "sign", "sign_acf", "slope_t", "abs_slope_t"]


class Reference:
    """A history, standardised, as what prefixes are compared with."""

    def __init__(self, z: np.ndarray):
        self.sorted, self.mean, self.sd, self.abs = np.sort(z), z.mean(), z.std(), np.abs(z).mean()
        self.quantile = {q: np.quantile(z, q) for q in (*QUANTILES, 0.1, 0.9)}
        off, step = np.abs(z - np.median(z)), np.diff(z)
        self.mad, self.off = np.median(off), off.mean()
        self.acf = {k: _along(z, k) for k in (1, 2, 5)}
        self.step_sd = step.std() if len(step) > 2 else 1.0
        self.step_acf, self.step_abs, self.positive = _along(step, 1), np.abs(step).mean() if len(step) else 0.0, (z > 0).mean()

    def share(self, x: np.ndarray, side: str) -> np.ndarray:
        """The share of the history under each value."""
        return np.searchsorted(self.sorted, x, side) / len(self.sorted)

    def first(self, z: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The 21 statistics PREFIX of each prefix, a row an end; none grows with its length under no break."""
        p, n = Prefixes(z, ends), ends
        mean, sd = p.spread(z)
        u = p.off(z) / np.sqrt(sd * sd + 1e-12)[:, None]
        middle = (self.share(z, "left") + self.share(z, "right")) / 2 * len(self.sorted)
        g_mean, g_sd = p.spread(ndtri(np.clip((middle + 0.5) / (len(self.sorted) + 1), 1e-6, 1 - 1e-6)))
        tail_mean, tail_sd = p.spread(z, n - np.maximum(n // 4, 5))
        (a_mean, a_sd), (b_mean, b_sd), whole = p.spread(z, upto=n // 2), p.spread(z, n // 2), n >= 6
        ks = np.abs(np.where(p.inside, p.ordered(self.share(z, "right")) - p.even, 0.0)).max(axis=1)
        return np.column_stack([
            *(p.quantile(q) - self.quantile[q] for q in QUANTILES), mean - self.mean, _wider(sd, self.sd), p.mean(u**3), p.mean(u**4) - 3, ks,
            _wider(p.median_off(), self.mad), *(p.along(z, k) - self.acf[k] for k in (1, 2, 5)), p.mean(np.abs(z)) - self.abs,
            g_mean, np.log(g_sd + 1e-9), tail_mean - self.mean, _wider(tail_sd, self.sd), np.where(whole, b_mean - a_mean, 0.0), np.where(whole, _wider(b_sd, a_sd), 0.0),
        ])

    def second(self, z: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The 20 statistics PREFIX2 of each prefix, a row an end."""
        p, n = Prefixes(z, ends), ends
        under = p.ordered(self.share(z, "right"))
        gap = np.square(np.where(p.inside, under - p.even, 0.0))
        step, stepped = np.diff(z), Prefixes(np.diff(z), ends - 1)
        some = lambda x: np.where(n > 3, x, 0.0)
        steps = [some(_wider(stepped.spread(step)[1], self.step_sd)), some(stepped.along(step, 1) - self.step_acf), some(_wider(stepped.mean(np.abs(step)), self.step_abs))]
        tails = [x for w in (10, 25, 100) for m, s in (p.spread(z, n - w),) for x in (m - self.mean, _wider(s, self.sd))]
        return np.column_stack([
            *(p.quantile(q) - self.quantile[q] for q in (0.1, 0.9)), p.mean(gap), np.minimum(p.mean(gap / np.maximum(under * (1 - under), 1e-3)), 10.0),
            _wider(p.mean(np.abs(z - p.quantile(0.5)[:, None])), self.off), *steps, *tails, p.mean(z > self.quantile[0.95]) - 0.05, p.mean(z < self.quantile[0.05]) - 0.05,
            p.mean(z > 0) - self.positive, p.along(np.sign(z), 1), p.trend_t(z), p.trend_t(np.abs(z)),
        ])


class Prefixes:
    """The first so many points of a sequence for each of several ends, as rows that count up to their end: statistics of all at once.

    What is asked of a sequence x (as long as the one the prefixes are of, or a
    table with a row an end) is of its part in each prefix.
    """

    def __init__(self, z: np.ndarray, ends: np.ndarray):
        self.ends, self.places = ends, np.arange(len(z))
        self.inside = self.places < ends[:, None]
        self.even = (self.places + 1) / np.maximum(ends, 1)[:, None]
        rank = np.empty(len(z), int)
        rank[np.argsort(z, kind="stable")] = self.places
        self.order = np.sort(np.where(self.inside, rank, len(z)), axis=1)
        self.sorted = self.ordered(z)

    def ordered(self, x: np.ndarray) -> np.ndarray:
        """x in ascending order, a row an end, for an x that does not fall where the sequence rises; what is beyond a prefix is its last value."""
        return np.sort(x)[np.minimum(self.order, len(x) - 1)] if len(x) else np.zeros(self.order.shape)

    def mean(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.inside, x, 0.0).sum(axis=1) / np.maximum(self.ends, 1)

    def off(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.inside, x - self.mean(x)[:, None], 0.0)

    def spread(self, x: np.ndarray, since: np.ndarray | int = 0, upto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of a prefix, or of its part since and up to some place (0 where there is none)."""
        part = self.inside & (self.places >= np.broadcast_to(since, len(self.ends))[:, None])
        part = part if upto is None else part & (self.places < upto[:, None])
        n = np.maximum(part.sum(axis=1), 1)
        mean = np.where(part, x, 0.0).sum(axis=1) / n
        return mean, np.sqrt(np.square(np.where(part, x - mean[:, None], 0.0)).sum(axis=1) / n)

    def quantile(self, q: float, rows: np.ndarray | None = None) -> np.ndarray:
        """Quantiles of the prefixes, or of rows in ascending order, between neighbours in proportion."""
        rows, place, k = self.sorted if rows is None else rows, q * np.maximum(self.ends - 1, 0), np.arange(len(self.ends))
        low = np.floor(place).astype(int)
        a, b = rows[k, low], rows[k, np.minimum(low + 1, np.maximum(self.ends - 1, 0))]
        return a + (place - low) * (b - a)

    def median_off(self) -> np.ndarray:
        """The median distance from the median."""
        off = np.abs(self.sorted - self.quantile(0.5)[:, None])
        return self.quantile(0.5, np.sort(np.where(self.inside, off, np.inf), axis=1))

    def along(self, x: np.ndarray, k: int) -> np.ndarray:
        """_along() of x in each prefix."""
        if len(x) < k + 3:
            return np.zeros(len(self.ends))
        pairs = self.places[k:] < self.ends[:, None]
        n = np.maximum(self.ends - k, 1)
        off = [np.where(pairs, v - (np.where(pairs, v, 0.0).sum(axis=1) / n)[:, None], 0.0) for v in (x[: len(x) - k], x[k:])]
        sd = [np.sqrt(np.square(v).sum(axis=1) / n) for v in off]
        known = (self.ends >= k + 3) & (np.minimum(*sd) >= 1e-9)
        return np.where(known, (off[0] * off[1]).sum(axis=1) / n / np.where(known, sd[0] * sd[1], 1.0), 0.0)

    def trend_t(self, x: np.ndarray) -> np.ndarray:
        """Student's t of a straight line through x in each prefix, at most 12; 0 for fewer than 8 points."""
        n, off = self.ends.astype(float), self.off(x)
        sxx, sxy = np.maximum(n * (n * n - 1) / 12, 1.0), (off * (self.places - (n[:, None] - 1) / 2)).sum(axis=1)
        rest = np.maximum(np.square(off).sum(axis=1) - sxy * sxy / sxx, 0.0)
        return np.where(n < 8, 0.0, np.clip(sxy / sxx / (np.sqrt(rest / np.maximum(n - 2, 1) / sxx) + 1e-12), -12, 12))


#: Points of prefixes that are in one table at a time, about.
TABLE = 1 << 18


def _at_ends(made, z: np.ndarray, ends: list[int]) -> np.ndarray:
    """made(z up to the last end, ends), some ends at a time, so that a table is bounded however long the sequence is."""
    parts, at = [], 0
    while at < len(ends):
        to = at + 1
        while to < len(ends) and (to + 1 - at) * ends[to] <= TABLE:
            to += 1
        parts.append(made(z[: ends[to - 1]], np.array(ends[at:to])))
        at = to
    return np.concatenate(parts)


def prefix_battery(panel: DataFrame | None, second: bool = False):
    """A prefix of the online part against the history, 21 ways (second: 20 others), made at scan steps and held between them."""
    names = PREFIX2 if second else PREFIX

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        zh, zo = detrended(h, o)
        ref = Reference(zh)
        at = scan_steps(len(o))
        return _at_ends(ref.second if second else ref.first, zo, at)[np.searchsorted(at, np.arange(1, len(o) + 1), "right") - 1] if at else np.empty((0, len(names)))

    return _by_series(panel, names, rows)


SPECTRAL = [f"band{k}" for k in range(8)] + ["entropy", "peak", "log_power", "band_max", "band_sum", "cosine"]


def spectral(panel: DataFrame | None, size: int = 64, bands: int = 8):
    """The spectrum of the last points against the history's own: 14 channels, made at scan steps and held between them."""

    def shape(rows: np.ndarray) -> tuple[np.ndarray, ...]:
        power = np.square(np.abs(np.fft.rfft(rows * np.hanning(size), axis=1)))[:, 1:]
        total = power.sum(axis=1) + 1e-12
        p = power / total[:, None]
        k = p.shape[1]
        return p.reshape(len(p), bands, -1).sum(axis=2), -(p * np.log(p + 1e-12)).sum(axis=1) / np.log(k), p.argmax(axis=1) / k, np.log(total)

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        zh, zo = detrended(h, o, clipped=True)
        every = np.concatenate([np.zeros(max(size - len(zh), 0)), zh, zo])
        windows = np.lib.stride_tricks.sliding_window_view(every, size)
        first = len(windows) - len(zo)  # the window that ends at the first online point
        known = windows[: len(zh) - size + 1 : size // 2] if len(zh) >= size else windows[:1]
        b, e, p, t = shape(known)
        centre, wide = b.mean(axis=0), b.std(axis=0) + 1e-3
        ent, ent_wide = e.mean(), e.std() + 1e-3
        if len(zh) < size:
            wide, ent_wide = np.full(bands, 0.1), 0.1
        at = np.array(scan_steps(len(zo)), int)
        if not len(at):
            return np.empty((0, len(SPECTRAL)))
        b2, e2, p2, t2 = shape(windows[first + at - 1])
        off = (b2 - centre) / wide
        cosine = b2 @ centre / (np.linalg.norm(b2, axis=1) * np.linalg.norm(centre) + 1e-12)
        made = np.column_stack([off, (e2 - ent) / ent_wide, p2 - p.mean(), t2 - t.mean(), np.abs(off).max(axis=1), np.abs(b2 - centre).sum(axis=1), cosine])
        return _held(dict(zip(at.tolist(), made)), len(zo), len(SPECTRAL))

    return _by_series(panel, SPECTRAL, rows)


FORECAST = ["fast", "slow", "peak", "error"]


def forecaster(panel: DataFrame | None, lags: int = 8, trailing: int = 10, ridge: float = 1.0, ahead: int = 1):
    """Is the next value as predictable as the history was: standardised errors, smoothed fast and slow, their peak, and as they are.

    What is predicted is the deviation from the trailing mean, from its last
    values and the mean and spread of five of them, by a ridge regression on the
    series' own history. ahead: how many steps before the predicted one they end.
    """

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        zh, zo = detrended(h, o, clipped=True)
        z, n = np.concatenate([zh, zo]), len(zh)
        error = np.zeros(len(zo))
        start = lags + trailing + ahead - 1
        if len(z) > start:
            before = np.lib.stride_tricks.sliding_window_view(z, trailing).mean(axis=1)[:-1]
            d = z[trailing:] - before
            past = np.lib.stride_tricks.sliding_window_view(d, lags)[:-1, ::-1]
            x = np.column_stack([past, past[:, :5].mean(axis=1), past[:, :5].std(axis=1), np.ones(len(past))])
            x, y, known = x[: len(x) - ahead + 1], d[lags + ahead - 1 :], max(n - start, 0)
            coef, sigma = np.zeros(x.shape[1]), 1.0
            if known > 40:
                a = x[:known]
                coef = np.linalg.solve(a.T @ a + ridge * np.eye(a.shape[1]), a.T @ y[:known])
                sigma = float((y[:known] - a @ coef).std()) + 1e-6
            made = np.abs(y - x @ coef) / sigma
            error[max(start - n, 0) :] = np.minimum(made[max(n - start, 0) :], 8.0)
        fast, slow = (_smoothed(error, a, 1.0) for a in (0.10, 0.02))
        return np.column_stack([fast, slow, np.maximum.accumulate(np.maximum(fast, 0.0)) if len(fast) else fast, error])

    return _by_series(panel, FORECAST, rows)


def _smoothed(x: np.ndarray, alpha: float, start: float) -> np.ndarray:
    out, v = np.empty(len(x)), start
    for i, a in enumerate(x.tolist()):
        v += alpha * (a - v)
        out[i] = v
    return out


def increments(family: tuple) -> tuple:
    """A family on the steps from each value to the next; the first online step is that from the last history value."""
    names, rows = family
    return names, lambda h, o: rows(np.diff(h), np.diff(np.concatenate([h[-1:], o])))


def raw_view(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The raw and the whitened view of detrended, clipped online values, as in families.views()."""
    z, rest = detrended(h, o, clipped=True)[1], detrended(h, o)[0]
    c = rest - rest.mean()
    rho = float(np.clip(c[1:] @ c[:-1] / (c @ c), -0.95, 0.95)) if len(h) > 32 and c @ c > 0 else 0.0
    white = (z - rho * np.concatenate([rest[-1:], z[:-1]])) / np.sqrt(max(1 - rho * rho, 1e-6))
    return z / np.sqrt(max((1 + rho) / (1 - rho), 1e-6)), white


def monitor(panel: DataFrame | None):
    """The nine detectors of families.monitor(), peaks and present values, from running sums of a whole series: the streams' form of them."""
    names = family_monitor()[1]

    def reflected(x: np.ndarray) -> np.ndarray:
        total = np.cumsum(x)
        return total - np.minimum(np.minimum.accumulate(total), 0.0)

    def squash(r: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-2 * (r - 1)))

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        raw, white = raw_view(h, o)
        views = {"raw": raw, "whitened": white, "absolute": np.abs(white) - 0.7979}
        t, out = np.arange(1, len(o) + 1), {}
        for v, x in views.items():
            for name, drift, scale in (("cusum", 0.5, 0.84 * np.log(np.maximum(t, 2))), ("page_hinkley", 0.05, np.sqrt(np.maximum(t, 2)))):
                now = np.maximum(reflected(x - drift), reflected(-x - drift))
                out[f"{v}_{name}"], out[f"{v}_{name}_now"] = (squash(a / (scale + 1e-9)) for a in (np.maximum.accumulate(now), now))
            mean = _smoothed(x, 0.02, 0.0)
            off = x - np.concatenate([[0.0], mean[:-1]])[: len(x)]
            now = np.where(t >= 20, np.abs(np.log(np.maximum(_smoothed(0.98 * off * off, 0.02, 1.0), 1e-12))), 0.0)
            out[f"{v}_variance_ratio"] = squash(np.maximum.accumulate(now) / 0.55) if len(now) else now
            out[f"{v}_variance_ratio_now"] = np.where(t >= 20, squash(now / 0.55), 0.5)
        return np.column_stack([out[c] for c in names])

    return _by_series(panel, names, rows)


BINNED = [f"{t}_{w}" for w in ("prefix", "window") for t in ("ks", "mann_whitney", "levene", "fligner")]


def binned_tests(panel: DataFrame | None, bins: int = 64, window: int = 100):
    """Two-sample tests on the history's quantile bins, of the prefix and of the last window: eight channels."""

    def counts(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """How many of the first t values lie in each bin, for t from 0 on."""
        one = np.zeros((len(x) + 1, bins))
        one[np.arange(1, len(x) + 1), np.searchsorted(edges, x)] = 1
        return one.cumsum(axis=0)

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        inner, centre = np.arange(1, bins) / bins, np.median(h)
        off_h, off_o = np.abs(h - centre), np.abs(o - centre)
        edges, off_edges = np.quantile(h, inner), np.quantile(off_h, inner)
        p, q = counts(h, edges)[-1] / len(h), counts(off_h, off_edges)[-1] / len(h)
        seen, seen_off, total = counts(o, edges), counts(off_o, off_edges), np.concatenate([[0.0], np.cumsum(off_o)])
        t, out = np.arange(1, len(o) + 1), []
        for begin in (np.zeros(len(o), int), np.maximum(t - window, 0)):
            n = (t - begin)[:, None]
            a, b = (seen[t] - seen[begin]) / n, (seen_off[t] - seen_off[begin]) / n
            place = lambda x: np.cumsum(x) - x / 2
            out += [np.abs(a.cumsum(axis=1) - p.cumsum()).max(axis=1), a @ place(p) - 0.5, (total[t] - total[begin]) / n[:, 0] / (off_h.mean() + 1e-12) - 1, b @ place(q) - 0.5]
        return np.column_stack(out)

    return _by_series(panel, BINNED, rows)


SPLITS = ["best", "place", "mean", "variance", "recent", "excess"]


def every_split(panel: DataFrame | None, least: int = 10, recent: int = 200, block: int = 256):
    """Likelihood ratio of another mean and variance since any step, least points ago or more: six channels in one table a block of steps."""

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        z = (o - h.mean()) / np.sqrt(h.var() + 1e-12)
        a, b, out = np.concatenate([[0.0], np.cumsum(z)]), np.concatenate([[0.0], np.cumsum(z * z)]), np.zeros((len(z), 6))
        for at in range(0, len(z), block):
            t = np.arange(at, min(len(z), at + block))[:, None]
            k = np.arange(t[-1, 0] + 1)[None]
            n = t + 1 - k
            ok = n >= least
            m = np.where(ok, n, 1)
            mean = (a[t + 1] - a[k]) / m
            var = np.maximum((b[t + 1] - b[k]) / m - mean * mean, 1e-9)
            by_mean, by_var = (np.where(ok, 0.5 * m * x, -np.inf) for x in (mean * mean, var - 1 - np.log(var)))
            both = by_mean + by_var
            place = both.argmax(axis=1)
            late = np.where(n <= recent, both, -np.inf).max(axis=1)
            best, found = both.max(axis=1), t[:, 0] + 1 >= least
            null = 0.5 * np.log(np.maximum(t[:, 0] + 1, 2))
            made = np.column_stack([np.tanh(best / 20), place / np.maximum(t[:, 0], 1), np.tanh(by_mean.max(axis=1) / 20), np.tanh(by_var.max(axis=1) / 20), np.tanh(late / 20), np.tanh((best - null) / 20)])
            out[t[found, 0]] = made[found]
        return out

    return _by_series(panel, SPLITS, rows)


BINS = 32


def bin_reference(panel: DataFrame) -> DataFrame:
    """(id, e1.., h0.., g0..): inner quantile edges of each history, the smoothed share of it in each bin, and the step from each bin's
    median to the next one's, in its deviations."""
    h = panel.where("period = 1").select("id", "value")
    edges = h.groupBy("id").agg(*(F.percentile("value", F.lit(k / BINS)).alias(f"e{k}") for k in range(1, BINS)), (F.stddev_pop("value") + 1e-12).alias("bin_sd"))
    at = sum(((F.col("value") > F.col(f"e{k}")).cast("int") for k in range(1, BINS)), F.lit(0))
    binned = h.join(edges, "id").withColumn("b", at)
    shares = binned.groupBy("id").agg(
        *(((F.avg((F.col("b") == k).cast("double")) + 1e-9) / (1 + BINS * 1e-9)).alias(f"h{k}") for k in range(BINS)),
        *(F.coalesce(F.percentile(F.when(F.col("b") == k, F.col("value")), F.lit(0.5)), F.lit(0.0)).alias(f"c{k}") for k in range(BINS)),
    )
    both = edges.join(shares, "id")
    return both.select("id", *(f"e{k}" for k in range(1, BINS)), *(f"h{k}" for k in range(BINS)), *(((F.col(f"c{k + 1}") - F.col(f"c{k}")) / F.col("bin_sd")).alias(f"g{k}") for k in range(BINS - 1)))


_BIN_SQL = "(" + " + ".join(f"CASE WHEN value > e{j} THEN 1 ELSE 0 END" for j in range(1, BINS)) + ")"
BIN_REFERENCE_SQL = (
    "edges AS (SELECT id, stddev_pop(value) + CAST(1e-12 AS DOUBLE) AS bin_sd, " + ", ".join(f"quantile_cont(value, {k / BINS}) AS e{k}" for k in range(1, BINS)) + " FROM panel WHERE period = 1 GROUP BY id), "
    f"binned AS (SELECT p.value, e.*, {_BIN_SQL} AS b FROM panel p JOIN edges e ON p.id = e.id WHERE period = 1), "
    "shares AS (SELECT id, first(bin_sd) AS bin_sd, " + ", ".join(f"first(e{k}) AS e{k}" for k in range(1, BINS)) + ", "
    + ", ".join(f"(avg(CASE WHEN b = {k} THEN 1.0 ELSE 0.0 END) + CAST(1e-9 AS DOUBLE)) / CAST({1 + BINS * 1e-9!r} AS DOUBLE) AS h{k}, coalesce(quantile_cont(CASE WHEN b = {k} THEN value END, 0.5), 0) AS c{k}" for k in range(BINS))
    + " FROM binned GROUP BY id), "
    "fits AS (SELECT * EXCLUDE (bin_sd), " + ", ".join(f"(c{k + 1} - c{k}) / bin_sd AS g{k}" for k in range(BINS - 1)) + " FROM shares)"
)


def divergences(window: int = 100) -> tuple[list[Stage], list[str]]:
    """Jensen-Shannon, Hellinger, Wasserstein and entropy differences of the prefix and the last window from the history's bins. Fits: bin_reference."""
    at: Stage = {"b": " + ".join(f"CASE WHEN value > e{k} THEN 1 ELSE 0 END" for k in range(1, BINS))}
    count: Stage = {f"n{k}": upto(f"sum(CASE WHEN b = {k} THEN {d(1.0)} ELSE {d(0.0)} END)") for k in range(BINS)}
    smooth = lambda n, total: f"({n} / {total} + {d(1e-9)}) / {d(1 + BINS * 1e-9)}"
    share = {f"p{k}": smooth(f"n{k}", "(step + 1)") for k in range(BINS)} | {f"w{k}": smooth(back(f"n{k}", window), f"least(step + 1, {window})") for k in range(BINS)}
    under: Stage = {}
    for v in ("p", "w", "h"):
        under |= {f"{v}s{k}": " + ".join(f"{v}{j}" for j in range(k + 1)) for k in range(BINS - 1)}
    plus = lambda f, n=BINS: " + ".join(f(k) for k in range(n))
    outs: Stage = {}
    for v, n in (("p", "prefix"), ("w", "window")):
        half = lambda a, k, v=v: f"{a}{k} * ln({a}{k} / ({d(0.5)} * ({v}{k} + h{k})))"
        outs |= {
            f"js_{n}": f"{d(0.5)} * ({plus(lambda k: half(v, k))} + {plus(lambda k: half('h', k))})",
            f"hellinger_{n}": f"sqrt(greatest(0, 1 - ({plus(lambda k, v=v: f'sqrt({v}{k} * h{k})')})))",
            f"wasserstein_{n}": plus(lambda k, v=v: f"abs({v}s{k} - hs{k}) * g{k}", BINS - 1),
            f"entropy_{n}": f"({plus(lambda k: f'h{k} * ln(h{k})')}) - ({plus(lambda k, v=v: f'{v}{k} * ln({v}{k})')})",
        }
    return [at, count, share, under, outs], list(outs)


DIVERGENCES = divergences()[1]


def divergence_rows(panel: DataFrame | None, window: int = 100):
    """(id, step, the channels of divergences()): the same by running counts as one table a series, without a fit of its own."""

    def rows(h: np.ndarray, o: np.ndarray) -> np.ndarray:
        edges = np.quantile(h, np.arange(1, BINS) / BINS)
        mine, theirs = np.searchsorted(edges, h), np.searchsorted(edges, o)
        smooth = lambda share: (share + 1e-9) / (1 + BINS * 1e-9)
        q = smooth(np.bincount(mine, minlength=BINS) / len(h))
        middle = np.array([np.median(h[mine == k]) if (mine == k).any() else 0.0 for k in range(BINS)])
        gap, n = np.diff(middle) / (h.std() + 1e-12), np.arange(1, len(o) + 1)
        seen = np.concatenate([np.zeros((1, BINS)), np.cumsum(theirs[:, None] == np.arange(BINS), axis=0)])
        begun, out = np.maximum(n - window, 0), []
        for counts, total in ((seen[1:], n), (seen[1:] - seen[begun], n - begun)):
            p = smooth(counts / total[:, None])
            m, whole = (p + q) / 2, (p * np.log(p)).sum(axis=1)
            out += [
                ((p * np.log(p / m)).sum(axis=1) + (q * np.log(q / m)).sum(axis=1)) / 2, np.sqrt(np.maximum(0, 1 - np.sqrt(p * q).sum(axis=1))),
                np.abs(np.cumsum(p, axis=1) - np.cumsum(q))[:, :-1] @ gap, (q * np.log(q)).sum() - whole,
            ]
        return np.column_stack(out)

    return _by_series(panel, DIVERGENCES, rows)
