"""Channel families that are recurrences with a closed form over window frames.

Each function gives the stages of a family and the columns that are its
channels. The rows are a series' online steps, joined with the fits named in the
docstring; every window is over (id, step), so one exchange and one sort carry a
whole family, however wide.
"""

from __future__ import annotations

import math

from driftline.plans.staged import Stage, back, before, clip, d, decayed_max, ewma, lag, last, probit, reflected, squash, upto

Family = tuple[list[Stage], list[str]]


def baseline(alpha: float = 0.05) -> Family:
    """Exponential mean against the history's, in its own standard errors. Fits: moments."""
    keep = d(1 - alpha)
    stages = [
        {"level_now": f"{ewma('value', alpha)} + power({keep}, step + 1) * mu", "n_eff": f"(1 - power({keep}, step + 1)) / {d(alpha)}"},
        {"ratio": "abs(level_now - mu) / (3 * sd1 / sqrt(greatest(n_eff, 1)))"},
        {"score": "1 - 2 / (exp(2 * least(ratio, 300)) + 1)"},
    ]
    return stages, ["score"]


VIEWS = ("raw", "whitened", "absolute")


def views() -> list[Stage]:
    """The three views of a detrended, winsorised observation. Fits: trend."""
    return [
        {"z": "greatest(least((value - (level + slope * (step + 1))) / sd, winsor), -winsor)"},
        {"prev": f"coalesce({lag('z')}, prev0)"},
        {"whitened": "(z - rho * prev) / white", "raw": "z / infl"},
        {"absolute": f"abs(whitened) - {d(0.7979)}"},
    ]


def _cusum(v: str, drift: float, growth: float, law: str, name: str) -> list[Stage]:
    grown = "ln(greatest(step + 1, 2))" if law == "log" else "sqrt(greatest(step + 1, 2))"
    return [
        {f"{v}_{name}_u": upto(f"sum({v} - {d(drift)})"), f"{v}_{name}_d": upto(f"sum(-{v} - {d(drift)})")},
        {f"{v}_{name}_x": f"greatest({reflected(f'{v}_{name}_u')}, {reflected(f'{v}_{name}_d')})", f"{v}_{name}_s": f"{d(growth)} * {grown} + {d(1e-9)}"},
        {f"{v}_{name}_p": upto(f"max({v}_{name}_x)")},
        {f"{v}_{name}": squash(f"{v}_{name}_p / {v}_{name}_s"), f"{v}_{name}_now": squash(f"{v}_{name}_x / {v}_{name}_s")},
    ]


def _variance_ratio(v: str, alpha: float = 0.02, scale: float = 0.55, warmup: int = 20) -> list[Stage]:
    n = f"{v}_variance_ratio"
    return [
        {f"{n}_m": ewma(v, alpha)},
        {f"{n}_e": f"{v} - coalesce({lag(f'{n}_m')}, 0)"},
        {f"{n}_v": ewma(f"{d(1 - alpha)} * {n}_e * {n}_e", alpha, 1.0)},
        {f"{n}_c": f"CASE WHEN step + 1 >= {warmup} THEN abs(ln(greatest({n}_v, {d(1e-12)}))) END"},
        {f"{n}_p": f"coalesce({upto(f'max({n}_c)')}, 0)"},
        {n: squash(f"{n}_p / {d(scale)}"), f"{n}_now": f"CASE WHEN step + 1 >= {warmup} THEN {squash(f'{n}_c / {d(scale)}')} ELSE {d(0.5)} END"},
    ]


def zipped(*lists: list[Stage]) -> list[Stage]:
    """Stages of independent columns side by side, so that they share projections."""
    out: list[Stage] = []
    for n in range(max(map(len, lists))):
        out.append({k: e for one in lists if n < len(one) for k, e in one[n].items()})
    return out


def monitor() -> Family:
    """Nine detector peaks and nine current values: three views by three detectors. Fits: trend."""
    detectors = [x for v in VIEWS for x in (_cusum(v, 0.5, 0.84, "log", "cusum"), _cusum(v, 0.05, 1.0, "sqrt", "page_hinkley"), _variance_ratio(v))]
    names = [f"{v}_{x}{s}" for v in VIEWS for x in ("cusum", "page_hinkley", "variance_ratio") for s in ("", "_now")]
    return [*views(), *zipped(*detectors)], names


def strongest() -> Family:
    """The largest of the raw view's three peaks. Fits: trend."""
    stages, _ = monitor()
    return [*stages, {"score": "greatest(raw_cusum, raw_page_hinkley, raw_variance_ratio)"}], ["score"]


SCALES = (5, 10, 20, 50, 100, 200)


def multiscale(v: str = "raw") -> Family:
    """Exponential means and spreads on six scales, now and at their peak: 24 channels. Fits: trend."""
    parts = []
    for s in SCALES:
        a = 2.0 / (s + 1.0)
        se_m, se_v = math.sqrt(a / (2 - a)), math.sqrt(2 * a / (2 - a))
        ripe = f"sqrt(least((1 - power({d(1 - a)}, step + 1)) * {d(2 - a)}, 1))"
        parts.append([
            {f"ms_m{s}": ewma(v, a), f"ms_v{s}": ewma(f"{v} * {v}", a, 1.0)},
            {f"now_mean_{s}": f"abs(ms_m{s}) / {d(se_m)} * {ripe}", f"now_var_{s}": f"abs(ln(greatest(ms_v{s}, {d(1e-9)}))) / {d(se_v)} * {ripe}"},
            {f"peak_mean_{s}": upto(f"max(now_mean_{s})"), f"peak_var_{s}": upto(f"max(now_var_{s})")},
        ])
    return [*views(), *zipped(*parts)], [f"{k}_{x}_{s}" for k in ("now", "peak") for s in SCALES for x in ("mean", "var")]


def standardised() -> list[Stage]:
    """z by the history's mean and population deviation. Fits: moments."""
    return [{"z": "(value - mu) / sd0"}, {"zp": f"coalesce({lag('z')}, last_z)"}]


MASS_WINDOWS = (10, 25, 50, 100, 250, 500)
_REPS = {"z": "z", "a": "abs(z)", "q": "z * z", "d": "z - zp", "c": "zc / sqrt(step + 1)", "s": "sign(z)"}


#: The wide mass battery: two more memories, and two more moments.
WIDE_MASS_WINDOWS = (5, 10, 25, 50, 100, 250, 500, 1000)


def mass(windows: tuple[int, ...] = MASS_WINDOWS, shapes: bool = False) -> Family:
    """Six representations by their memories, gap and log variance ratio, and three exceedance rates: 90 channels; with shapes, skewness and
    kurtosis less the history's too (216 on eight memories). Fits: moments, mass_reference."""
    reps = [{f"r_{k}": e for k, e in _REPS.items()} | {"e1": f"CASE WHEN abs(z) > q1 THEN {d(1.0)} ELSE {d(0.0)} END", "e2": f"CASE WHEN abs(z) > q2 THEN {d(1.0)} ELSE {d(0.0)} END", "e3": f"CASE WHEN abs(z) > q3 THEN {d(1.0)} ELSE {d(0.0)} END"}]
    sums: Stage = {}
    spread: Stage = {}
    outs: Stage = {}
    each = [(k, w) for k in _REPS for w in windows]
    for k, w in each:
        sums |= {f"m{n}_{k}{w}": ewma(" * ".join([f"r_{k}"] * n), 1 / w) for n in range(1, 5 if shapes else 3)}
        spread[f"v_{k}{w}"] = f"greatest(m2_{k}{w} - m1_{k}{w} * m1_{k}{w}, {d(1e-9)})"
    outs |= {f"gap_{k}{w}": clip(f"(m1_{k}{w} - h1_{k}) / sqrt(h2_{k} / {w})", -20, 20) for k, w in each}
    outs |= {f"lvr_{k}{w}": clip(f"ln(v_{k}{w} / h2_{k})", -20, 20) for k, w in each}
    if shapes:
        m = lambda n, k, w: f"m{n}_{k}{w}"
        outs |= {f"skew_{k}{w}": clip(f"({m(3, k, w)} - 3 * {m(1, k, w)} * v_{k}{w} - {m(1, k, w)} * {m(1, k, w)} * {m(1, k, w)}) / (v_{k}{w} * sqrt(v_{k}{w}) + {d(1e-9)}) - h3_{k}", -20, 20) for k, w in each}
        outs |= {f"kurt_{k}{w}": clip(f"({m(4, k, w)} - 4 * {m(1, k, w)} * {m(3, k, w)} + 6 * {m(1, k, w)} * {m(1, k, w)} * {m(2, k, w)} - 3 * {m(1, k, w)} * {m(1, k, w)} * {m(1, k, w)} * {m(1, k, w)}) / (v_{k}{w} * v_{k}{w} + {d(1e-9)}) - h4_{k}", -20, 20) for k, w in each}
    sums |= {f"share{i}_{w}": ewma(f"e{i}", 1 / w) for i in (1, 2, 3) for w in windows}
    outs |= {f"exc{i}_{w}": f"share{i}_{w} - {d(p)}" for i, p in ((1, 0.25), (2, 0.05), (3, 0.01)) for w in windows}
    return [*standardised(), {"zc": upto("sum(z)")}, *reps, sums, spread, outs], list(outs)


#: Fixed values of the mass battery against what came before its windows: the reference's memory, and the step from which on it is used.
LAGGED_MEMORY, LAGGED_FROM = 500, 25


def mass_lagged(windows: tuple[int, ...] = MASS_WINDOWS) -> Family:
    """The mass battery against the online part itself: a long exponential mean and variance, begun from the history's, which each window reads
    as it was a window ago; before step LAGGED_FROM the history's own. 90 channels. Fits: moments, mass_reference."""
    stages, _ = mass(windows)
    *before, sums, spread, outs = stages
    keep = d(1 - 1 / LAGGED_MEMORY)
    sums = sums | {f"l{n}_{k}": ewma(" * ".join([f"r_{k}"] * n), 1 / LAGGED_MEMORY) for k in _REPS for n in (1, 2)}
    begun = {f"b{n}_{k}": f"l{n}_{k} + power({keep}, step + 1) * {at}" for k in _REPS for n, at in ((1, f"h1_{k}"), (2, f"(h2_{k} + h1_{k} * h1_{k})"))}
    each = [(k, w) for k in _REPS for w in windows]
    late = {f"f{n}_{k}{w}": f"coalesce({lag(f'b{n}_{k}', w + 1)}, {at})" for k, w in each for n, at in ((1, f"h1_{k}"), (2, f"h2_{k} + h1_{k} * h1_{k}"))}
    used = {f"fm_{k}{w}": f"CASE WHEN step >= {LAGGED_FROM} THEN f1_{k}{w} ELSE h1_{k} END" for k, w in each}
    used |= {f"fv_{k}{w}": f"CASE WHEN step >= {LAGGED_FROM} THEN greatest(f2_{k}{w} - f1_{k}{w} * f1_{k}{w}, {d(1e-9)}) ELSE h2_{k} END" for k, w in each}
    made = {f"lgap_{k}{w}": clip(f"(m1_{k}{w} - fm_{k}{w}) / sqrt(fv_{k}{w} / {w})", -20, 20) for k, w in each}
    made |= {f"llvr_{k}{w}": clip(f"ln(v_{k}{w} / fv_{k}{w})", -20, 20) for k, w in each}
    made |= {c: e for c, e in outs.items() if c.startswith("exc")}
    return [*before, sums, spread | begun, late, used, made], list(made)


def rolling_acf(lags: tuple[int, ...] = (1, 2, 5, 10), windows: tuple[int, ...] = (50, 200)) -> Family:
    """Exponential autocorrelations less the history's: 8 channels. Fits: moments, acf_reference (hacf_k, and the history's last ten as tail_1..10)."""
    shifted: Stage = {}
    for k in lags:
        cases = " ".join(f"WHEN step = {s} THEN tail_{k - s}" for s in range(k))
        shifted[f"z{k}"] = f"CASE {cases} ELSE {lag('z', k)} END"
    sums = {f"den{w}": ewma("z * z", 1 / w, 1.0) for w in windows} | {f"num{k}_{w}": ewma(f"z * z{k}", 1 / w) for k in lags for w in windows}
    outs = {f"acf{k}_{w}": f"{clip(f'num{k}_{w} / greatest(den{w}, {d(1e-9)})', -1.5, 1.5)} - hacf{k}" for w in windows for k in lags}
    return [*standardised(), shifted, sums, outs], list(outs)


#: The wide grid of autocorrelations: 8 lags by 5 memories.
WIDE_LAGS, WIDE_WINDOWS = (1, 2, 3, 5, 8, 12, 20, 30), (25, 50, 100, 200, 400)


def rank_battery(windows: tuple[int, ...] = MASS_WINDOWS) -> Family:
    """Five representations of an online value's rank in its history, each against what a uniform rank gives, and the shares in the
    outer tenths: 72 channels. Rows: relational.rank_against_history (below, n)."""
    one = lambda c: f"CASE WHEN {c} THEN {d(1.0)} ELSE {d(0.0)} END"
    rank = {"pit": clip(f"(below + {d(0.5)}) / (n + 1)", 1e-6, 1 - 1e-6)}
    reps = {"r_c": f"pit - {d(0.5)}", "r_a": f"abs(pit - {d(0.5)})", "r_s": f"sign(pit - {d(0.5)})", "r_g": probit("pit"), "r_m": "least(pit, 1 - pit)", "top": one(f"pit > {d(0.9)}"), "low": one(f"pit < {d(0.1)}")}
    uniform = {"c": (0.0, 1 / 12), "a": (0.25, 1 / 48), "s": (0.0, 1.0), "g": (0.0, 1.0), "m": (0.25, 1 / 48)}  # mean and variance of each
    sums = {f"{m}_{k}{w}": ewma(x, 1 / w) for k in uniform for w in windows for m, x in (("u1", f"r_{k}"), ("u2", f"r_{k} * r_{k}"))}
    outs = {f"rank_gap_{k}{w}": clip(f"(u1_{k}{w} - {d(mean)}) / sqrt({d(var)} / {w})", -20, 20) for k, (mean, var) in uniform.items() for w in windows}
    outs |= {f"rank_lvr_{k}{w}": clip(f"ln(greatest(u2_{k}{w} - u1_{k}{w} * u1_{k}{w}, {d(1e-9)}) / {d(var)})", -20, 20) for k, (_, var) in uniform.items() for w in windows}
    sums |= {f"share_{e}{w}": ewma(e, 1 / w) for e in ("top", "low") for w in windows}
    outs |= {f"rank_{e}{w}": f"share_{e}{w} - {d(0.1)}" for e in ("top", "low") for w in windows}
    return [rank, reps, sums, outs], list(outs)


def glr(windows: tuple[int, ...] = (8, 16, 32, 64, 128, 256), v: str = "z") -> Family:
    """Likelihood ratios of mean, scale and lag-1 dependence over trailing windows of doubling length, and their largest. Fits: moments."""
    totals = {"g1": upto(f"sum({v})"), "g2": upto(f"sum({v} * {v})"), "gx": upto(f"sum({v} * {v}p)"), "gn": upto("count(*)")}
    sums: Stage = {}
    outs: Stage = {}
    for m in windows:
        sums |= {f"g1_{m}": back("g1", m), f"g2_{m}": back("g2", m), f"gx_{m}": back("gx", m), f"gn_{m}": f"least(gn, {m})"}
        var = f"greatest(g2_{m} / gn_{m}, {d(1e-6)})"
        r = clip(f"gx_{m} / greatest(g2_{m}, {d(1e-9)})", -0.99, 0.99)
        outs |= {f"glr_mean{m}": f"abs(g1_{m}) / sqrt(gn_{m})", f"glr_scale{m}": f"{d(0.5)} * gn_{m} * ({var} - 1 - ln({var}))", f"glr_dep{m}": f"-{d(0.5)} * gn_{m} * ln(1 - {r} * {r})"}
    best = {f"glr_{x}_max": f"greatest({', '.join(f'glr_{x}{m}' for m in windows)})" for x in ("mean", "scale", "dep")}
    return [*standardised(), totals, sums, outs, best], [*outs, *best]


TAIL_WINDOWS = (25, 50, 100, 250, 500)


def tails() -> Family:
    """Exceedance rates, excess scale, asymmetry, clustering and a slowly decaying maximum on five memories: 40 channels. Fits: moments, tail_reference."""
    one = lambda c: f"CASE WHEN {c} THEN {d(1.0)} ELSE {d(0.0)} END"
    marks = {"t1": one("abs(z) > t90"), "t2": one("abs(z) > t975"), "t3": one("abs(z) > t995"), "t4": f"greatest(abs(z) - t90, 0) / (texc + {d(1e-9)})", "t5": one("z > thi"), "t6": one("z < tlo")}
    near = {"t7": f"t1 * coalesce({lag('t1')}, 0)"}
    expected = {"t1": 0.10, "t2": 0.025, "t3": 0.005, "t4": 0.10, "t5": 0.025, "t6": 0.025, "t7": 0.01}
    outs = {f"{k}_{w}": clip(f"{ewma(k, 1 / w)} - {d(p)}", -20, 20) for k, p in expected.items() for w in TAIL_WINDOWS}
    rest = {w: 1 - 0.5 / w for w in TAIL_WINDOWS}
    # A hair keeps ratios of whole values off the edges of rounding, where an engine's last bit would decide.
    outs |= {f"t8_{w}": clip(f"{decayed_max('abs(z)', k)} / tmax{w} - 1 + {d(1e-9)}", -20, 20) for w, k in rest.items()}
    return [*standardised(), marks, near, outs], list(outs)


def trailing() -> Family:
    """Deviation from the trailing mean, lags, velocities and prefix score of a standardised value. Fits: moments."""
    stages = [
        *standardised(),
        {"back10": before("avg(z)", 10), "n10": before("count(*)", 10), "prefix": f"{upto('sum(z)')} / sqrt(step + 1)"},
        {"deviation": "CASE WHEN n10 = 10 THEN z - back10 END", "velocity10": f"coalesce(z - {lag('z', 10)}, 0)", "velocity30": f"coalesce(z - {lag('z', 30)}, 0)", "mean5": before("avg(z)", 5), "sd5": before("stddev_pop(z)", 5)},
        {f"lag{k}": lag("z", k) for k in range(1, 9)},
        {"diff1": f"3 * coalesce(z - {lag('z')}, 0)", "diff10": f"{d(1.5)} * velocity10"},
    ]
    return stages, ["prefix", "deviation", "velocity10", "velocity30", "mean5", "sd5", *(f"lag{k}" for k in range(1, 9)), "diff1", "diff10"]


def transforms(x: str = "score") -> Family:
    """Output rules over a score: peak-hold, self-normalised, exponential, cumulative-maximum and running-mean mixes."""
    hold = 0.999
    stages = [
        {"held": decayed_max(x, hold), "cmax": upto(f"max({x})"), "rm20": last(f"avg({x})", 20), "rm60": last(f"avg({x})", 60), "rm200": last(f"avg({x})", 200), "ema": f"{ewma(x, 0.1)} + power({d(0.9)}, step + 1) * first_value({x}) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"},
        {"first10": upto(f"avg(CASE WHEN step < 10 THEN {x} END)"), "age": f"step - {upto(f'max(CASE WHEN {x} >= cmax THEN step END)')}"},
        {"selfnorm": f"greatest({x} - {d(0.5)} * first10, 0)", "mix_ema": f"{d(0.5)} * {x} + {d(0.5)} * ema", "mix_cmax": f"{d(0.5)} * {x} + {d(0.5)} * cmax", "mix_mean": f"{d(0.5)} * {x} + {d(0.5)} * rm60", "below_peak": f"cmax - {x}", "d20": f"{x} - rm20", "d60": "rm20 - rm60", "d200": "rm60 - rm200"},
    ]
    return stages, ["held", "cmax", "rm20", "rm60", "rm200", "ema", "selfnorm", "mix_ema", "mix_cmax", "mix_mean", "below_peak", "d20", "d60", "d200"]


def trajectory(scores: tuple[str, ...], differ: tuple[str, str] | None = None) -> Family:
    """How each of several scores came to be what it is: peak, running means, their gaps, the age of the peak; and how two of them differ."""
    first: Stage = {"seen": "ln(step + 2)"}
    second: Stage = {}
    for x in scores:
        first |= {f"{x}_max": upto(f"max({x})"), **{f"{x}_rm{w}": last(f"avg({x})", w) for w in (20, 60, 200)}}
        second |= {f"{x}_d20": f"{x} - {x}_rm20", f"{x}_d60": f"{x}_rm20 - {x}_rm60", f"{x}_d200": f"{x}_rm60 - {x}_rm200", f"{x}_below": f"{x}_max - {x}", f"{x}_rise": f"CASE WHEN {x} >= {x}_max AND ({lag(f'{x}_max')} IS NULL OR {x}_max > {lag(f'{x}_max')}) THEN step END"}
    third: Stage = {f"{x}_age": f"step - {upto(f'max({x}_rise)')}" for x in scores} | ({"differ": f"{differ[0]} - {differ[1]}"} if differ else {})
    names = [n for x in scores for n in (x, f"{x}_max", f"{x}_rm20", f"{x}_rm60", f"{x}_rm200", f"{x}_d20", f"{x}_d60", f"{x}_d200", f"{x}_below", f"{x}_age")]
    return [first, second, third], [*names, "seen", *(["differ"] if differ else [])]
