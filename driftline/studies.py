"""More registered queries: the same families on other views, scans, joined tables, process statistics, learners and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import arrays, augment, dynamics, families, forensics, grouped, innovations, learn, metrics, pipelines, ranking, relational, retro, screen, views
from driftline.plans import fits
from driftline.plans.panel import PANEL_SQL, lineitem_panel, long_panel_sql, online
from driftline.plans.staged import output, rendered, sql
from driftline.queries import _KINDED, CADENCE_SQL, FAMILIES, LONG, ONLINE_SQL, channels, member_rows, rounded, rounded_sql, scored, scored_sql, stats, with_sql
from driftline.session import durable, shared_folder, table
from driftline.sources import files
from driftline.streaming import families as streaming
from driftline.streaming import jobs
from driftline.streaming import white as white_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


# Views: a panel of other values, and a family on it

def seen_sql(*ctes: str) -> str:
    """The panel's SQL with the plain panel named panel0, and what makes the panel seen out of it."""
    return with_sql(PANEL_SQL.replace("panel AS", "panel0 AS"), *ctes)


_COUNTED = "counted AS (SELECT *, sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id) AS hl, count(*) OVER (PARTITION BY id) AS tot, row_number() OVER (PARTITION BY id ORDER BY time) - 1 AS tm FROM {0}), panel AS (SELECT id, tm AS time, value, hl AS hist_len, tot - hl AS onl_len, period, tm - hl AS step, target FROM counted)"
SEEN = {
    "asinh": (views.compressed, "panel AS (SELECT * REPLACE (asinh(value) AS value) FROM panel0)"),
    "deviations": (views.deviations, "dev AS (SELECT * REPLACE (value - avg(value) OVER b AS value), count(*) OVER b AS cb FROM panel0 WINDOW b AS (PARTITION BY id ORDER BY time ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), kept AS (SELECT * FROM dev WHERE cb = 10), " + _COUNTED.format("kept")),
    "whitened": (
        views.whitened,
        fits.MOMENTS_SQL.strip().replace("fits AS", "mom0 AS", 1).replace("FROM panel ", "FROM panel0 ") + ", zed AS (SELECT p.*, (value - mu) / sd0 AS z, lag((value - mu) / sd0) OVER (PARTITION BY p.id ORDER BY time) AS zp FROM panel0 p JOIN mom0 m ON p.id = m.id), "
        "rhos AS (SELECT id, greatest(CAST(-0.95 AS DOUBLE), least(CAST(0.95 AS DOUBLE), sum(z * zp) / greatest(sum(zp * zp), CAST(1e-12 AS DOUBLE)))) AS rho FROM zed WHERE period = 1 AND zp IS NOT NULL GROUP BY id), "
        "kept AS (SELECT z.* REPLACE (z.z - rho * zp AS value) FROM zed z JOIN rhos r ON z.id = r.id WHERE zp IS NOT NULL), " + _COUNTED.format("kept"),
    ),
    "last_history": (lambda p: views.last_history(p, 256), "kept AS (SELECT * FROM panel0 WHERE time >= hist_len - 256), " + _COUNTED.format("kept")),
}


def _viewed(name: str, view: str, family: str) -> None:
    (stages, names), fit, fit_sql = FAMILIES[family]
    seen, seen_by = SEEN[view]

    def run(spark: SparkSession, d: str) -> DataFrame:
        panel = seen(lineitem_panel(spark, d))
        return output(rendered(fits.fitted(panel, fit), stages), names)

    QUERIES[name] = run
    ORACLE[name] = seen_sql(seen_by, fit_sql, ONLINE_SQL) + ", " + sql("online", stages, names)


for _name, _view, _family in (
    ("monitor_asinh", "asinh", "channels_monitor"), ("multiscale_asinh", "asinh", "channels_multiscale"), ("monitor_deviations", "deviations", "channels_monitor"),
    ("mass_whitened", "whitened", "channels_mass"), ("mass_last_history", "last_history", "channels_mass"),
):
    _viewed(_name, _view, _family)

_WIDE = families.mass(families.WIDE_MASS_WINDOWS, shapes=True)
QUERIES["channels_mass_wide"] = lambda spark, d: output(rendered(online(p := lineitem_panel(spark, d), fits.mass_reference(p, shapes=True)), _WIDE[0]), _WIDE[1], 3)
ORACLE["channels_mass_wide"] = with_sql(PANEL_SQL, fits.MASS_REFERENCE_SQL, ONLINE_SQL) + ", " + sql("online", *_WIDE, 3)

_ANCHORED = FAMILIES["channels_monitor"][0][1]


def anchor_view(spark: SparkSession, d: str) -> DataFrame:
    made = lambda p: channels(p, "channels_monitor")
    return output(views.anchor_view(lineitem_panel(spark, d), made, _ANCHORED), _ANCHORED)


def _anchor_sql() -> str:
    parts, ctes = [f"SELECT id, step, {', '.join(f'CAST(0.5 AS DOUBLE) AS {c}' for c in _ANCHORED)} FROM panel0 WHERE period = 2 AND step < 10"], [PANEL_SQL.replace("panel AS", "panel0 AS")]
    for a, b in ((10, 40), (40, 100_000)):
        inner = with_sql(f"panel AS (SELECT id, step AS time, value, CASE WHEN step < {a} THEN 1 ELSE 2 END AS period, step - {a} AS step, target FROM panel0 WHERE period = 2)", fits.TREND_SQL, ONLINE_SQL) + ", " + sql("online", FAMILIES["channels_monitor"][0][0], _ANCHORED)
        parts.append(f"SELECT id, step + {a} AS step, {', '.join(_ANCHORED)} FROM ({inner}) WHERE step + {a} < {b}")
    return with_sql(*ctes) + " " + " UNION ALL ".join(parts)


QUERIES["anchor_view"] = anchor_view
ORACLE["anchor_view"] = _anchor_sql()

QUERIES["raw_inputs"] = lambda spark, d: rounded(views.raw_inputs(p := lineitem_panel(spark, d), fits.moments(p)), ["id", "step"], ["z", "asinh_z"])
ORACLE["raw_inputs"] = with_sql(PANEL_SQL, fits.MOMENTS_SQL, ONLINE_SQL) + " SELECT id, step, round((value - mu) / sd0, 6) + 0.0 AS z, round(asinh((value - mu) / sd0), 6) + 0.0 AS asinh_z FROM online"

_ORDERED = [f"{c}{k}" for c in "wo" for k in range(32)]
QUERIES["ordered_window"] = lambda spark, d: rounded(views.ordered_window(p := lineitem_panel(spark, d), fits.moments(p)), ["id", "step"], _ORDERED)
_PLACE = "CASE WHEN len(a) > {0} THEN a[len(a) - {0}] ELSE 0 END"
ORACLE["ordered_window"] = (
    with_sql(PANEL_SQL, fits.MOMENTS_SQL, ONLINE_SQL)
    + ", x AS (SELECT id, step, greatest(-20, least(20, (value - mu) / sd0)) AS z FROM online), l AS (SELECT id, step, list(z) OVER w AS a, list_sort(list(z) OVER w) AS s FROM x WINDOW w AS (PARTITION BY id ORDER BY step ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) SELECT id, step, "
    + ", ".join(f"round({_PLACE.format(31 - k)}, 6) + 0.0 AS w{k}" for k in range(32)) + ", " + ", ".join(f"round(coalesce(s[{k + 1}], 0), 6) + 0.0 AS o{k}" for k in range(32)) + " FROM l"
)

_MEDIANS = (3, 5, 9)
QUERIES["rolling_median"] = lambda spark, d: rounded(lineitem_panel(spark, d).select("id", "time", *(F.expr(f"percentile(value, 0.5) OVER (PARTITION BY id ORDER BY time ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)").alias(f"median{w}") for w in _MEDIANS)), ["id", "time"], [f"median{w}" for w in _MEDIANS])
ORACLE["rolling_median"] = with_sql(PANEL_SQL) + " SELECT id, time, " + ", ".join(f"round(quantile_cont(value, 0.5) OVER (PARTITION BY id ORDER BY time ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) + 0.0 AS median{w}" for w in _MEDIANS) + " FROM panel"

QUERIES["sampled_steps"] = lambda spark, d: augment.sampled_steps(lineitem_panel(spark, d).where("period = 2")).select("id", "step", "target")
ORACLE["sampled_steps"] = with_sql(PANEL_SQL) + ", n AS (SELECT id, count(*) AS n FROM panel WHERE period = 2 GROUP BY id), g AS (SELECT DISTINCT id, CAST(floor(power(CAST(n AS DOUBLE), k / CAST(59 AS DOUBLE)) + CAST(1e-9 AS DOUBLE)) AS BIGINT) - 1 AS step FROM n, range(0, 60) r(k) WHERE n > 60 UNION SELECT id, s FROM n, range(0, 60) r(s) WHERE n <= 60) SELECT p.id, p.step, p.target FROM panel p JOIN g ON p.id = g.id AND p.step = g.step WHERE period = 2"

QUERIES["panel_series"] = lambda spark, d: panel_series(lineitem_panel(spark, d))
ORACLE["panel_series"] = with_sql(PANEL_SQL) + " SELECT id, count(*) FILTER (period = 1) AS n_history, count(*) FILTER (period = 2) AS n_online, round(sum(CASE WHEN period = 1 THEN value * (time + 1) ELSE 0 END), 4) + 0.0 AS history, round(sum(CASE WHEN period = 2 THEN value * (step + 1) ELSE 0 END), 4) + 0.0 AS online FROM panel GROUP BY id"


def panel_series(panel: DataFrame) -> DataFrame:
    """One row a series, without labels: its history and online part as arrays, checked by their lengths and weighted sums."""
    each = panel.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("time", "value", "period"))).alias("s"))
    part = lambda p: F.transform(F.filter("s", lambda x: x["period"] == p), lambda x: x["value"])
    each = each.select("id", part(1).alias("h"), part(2).alias("o"))
    total = lambda c: F.round(F.aggregate(F.transform(c, lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x), 4)
    return each.select("id", F.size("h").cast("long").alias("n_history"), F.size("o").cast("long").alias("n_online"), total("h").alias("history"), total("o").alias("online"))


# Scans

def detrended_online(spark: SparkSession, d: str, suppliers: int = 1) -> DataFrame:
    panel = lineitem_panel(spark, d, suppliers=suppliers)
    return rendered(fits.fitted(panel, fits.trend), families.views()[:1])


_SPLITS_SQL = CADENCE_SQL + """,
x AS (SELECT id, step, step + 1 AS k, greatest(least((value - (level + slope * (step + 1))) / sd, winsor), -winsor) AS z, value, level, sd FROM online),
sums AS (SELECT *, sum(z) OVER w AS a, sum(z * z) OVER w AS b FROM x WINDOW w AS (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pairs AS (SELECT t.id, t.step, t.k AS t, s.k AS k, s.a AS a, s.b AS b, t.a AS ta, t.b AS tb, greatest(s.b / s.k - (s.a / s.k) * (s.a / s.k), CAST(1e-12 AS DOUBLE)) AS v1,
                 greatest((t.b - s.b) / (t.k - s.k) - ((t.a - s.a) / (t.k - s.k)) * ((t.a - s.a) / (t.k - s.k)), CAST(1e-12 AS DOUBLE)) AS v2
          FROM sums t JOIN sums s ON t.id = s.id AND s.k >= 5 AND s.k <= t.k - 5 WHERE t.k IN (SELECT t FROM cadence) AND t.k >= 10),
gaps AS (SELECT *, abs(a / k - (ta - a) / (t - k)) / sqrt(v1 / k + v2 / (t - k)) AS gap FROM pairs),
top AS (SELECT id, step, first(t) AS t, first(ta) AS ta, first(tb) AS tb, max(gap) AS gap, max(abs(ln(v2 / v1))) AS ratio, arg_min(k, struct_pack(g := -gap, k := k)) AS best FROM gaps GROUP BY id, step)
"""
_SQ = "(1 / (1 + exp(-2 * (({0}) - 1))))"
_HOLD = "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.5)"
_RETRO_SQL = (
    _SPLITS_SQL.strip()
    + """, tail AS (SELECT top.*, top.ta - s.a AS sa, top.tb - s.b AS sb, top.t - best AS n FROM top JOIN sums s ON top.id = s.id AND s.k = top.best),
wander AS (SELECT *, count(*) OVER w AS seen, stddev_pop(best) OVER w / t AS spread FROM tail WINDOW w AS (PARTITION BY id ORDER BY step ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
parts AS (SELECT id, step, """
    + ", ".join(
        f"CASE WHEN k >= {n + 5} THEN abs((a - a{n}) / {n} - a{n} / (k - {n})) / greatest(sqrt(greatest((b{n} - a{n} * a{n} / (k - {n})) / (k - {n} - 1), CAST(1e-9 AS DOUBLE)) / (k - {n}) + greatest(((b - b{n}) - (a - a{n}) * (a - a{n}) / {n}) / ({n} - 1), CAST(1e-9 AS DOUBLE)) / {n}), CAST(1e-9 AS DOUBLE)) ELSE 0 END AS r{n}"
        for n in retro.DEPTHS
    )
    + " FROM (SELECT *, "
    + ", ".join(f"lag(a, {n}) OVER w AS a{n}, lag(b, {n}) OVER w AS b{n}" for n in retro.DEPTHS)
    + f""" FROM sums WINDOW w AS (PARTITION BY id ORDER BY step)) WHERE k IN (SELECT t FROM cadence) AND k >= 10),
made AS (SELECT w.id, w.step, {_SQ.format("gap / (CAST(1.02 AS DOUBLE) * sqrt(ln(greatest(t, 3))))")} AS scan_best, CASE WHEN seen >= 3 THEN {_SQ.format("(CAST(0.08 AS DOUBLE) - spread) / CAST(0.04 AS DOUBLE) + 1")} END AS split_stability,
                {_SQ.format("(abs(sa / n) + abs(ln(greatest((sb - sa * sa / n) / (n - 1), CAST(1e-9 AS DOUBLE))))) / CAST(0.9 AS DOUBLE)")} AS tail_calm, {", ".join(f"{_SQ.format(f'r{n} / CAST(2.6 AS DOUBLE)')} AS recent_{n}" for n in retro.DEPTHS)}
         FROM wander w JOIN parts p ON w.id = p.id AND w.step = p.step),
held AS (SELECT x.id, x.step, {", ".join(f"{_HOLD.format(c)} AS {c}" for c in retro.RETRO)} FROM x LEFT JOIN (SELECT id AS mid, step AS mstep, * EXCLUDE (id, step) FROM made) ON x.id = mid AND x.step = mstep)"""
)
QUERIES["retro"] = lambda spark, d: rounded(retro.retro(detrended_online(spark, d)), ["id", "step"], retro.RETRO, 5)
QUERIES["retro_long"] = lambda spark, d: rounded(retro.retro(detrended_online(spark, d, LONG)), ["id", "step"], retro.RETRO, 5)
ORACLE["retro_long"] = with_sql(long_panel_sql(LONG), fits.TREND_SQL, ONLINE_SQL, _RETRO_SQL) + " " + rounded_sql(["id", "step"], retro.RETRO, "held", 5)
ORACLE["retro"] = with_sql(PANEL_SQL, fits.TREND_SQL, ONLINE_SQL, _RETRO_SQL) + " " + rounded_sql(["id", "step"], retro.RETRO, "held", 5)


def review(spark: SparkSession, d: str) -> DataFrame:
    """Splits, and the distance of the online part from the history, which is taken less its last level but not its slope."""
    panel = lineitem_panel(spark, d)
    fitted = fits.trend(panel)
    points = rendered(online(panel, fitted), families.views()[:1])
    history = panel.where("period = 1").join(fitted.select("id", "level", "sd"), "id").select("id", "step", "period", ((F.col("value") - F.col("level")) / F.col("sd")).alias("value"))
    ranked = relational.rank_against_history(history.unionByName(points.select("id", "step", "period", F.col("z").alias("value")))).select("id", "step", "upto", "n")
    return rounded(retro.review(points, ranked.join(points.select("id", "step", "z"), ["id", "step"])), ["id", "step"], retro.REVIEW, 5)


QUERIES["review"] = review
ORACLE["review"] = with_sql(PANEL_SQL, fits.TREND_SQL, ONLINE_SQL, _SPLITS_SQL) + f""",
h AS (SELECT p.id, (p.value - level) / sd AS v, count(*) OVER (PARTITION BY p.id) AS n FROM panel p JOIN fits f ON p.id = f.id WHERE period = 1),
f AS (SELECT x.id, x.step, x.z, count(*) FILTER (h.v <= x.z) / CAST(first(n) AS DOUBLE) AS f, first(n) AS n FROM x JOIN h ON x.id = h.id GROUP BY 1, 2, 3),
place AS (SELECT t.id, t.step, t.t, n, abs(row_number() OVER (PARTITION BY t.id, t.step ORDER BY f.z, f.f) / CAST(t.t AS DOUBLE) - f.f) AS off FROM top t JOIN f ON t.id = f.id AND f.step <= t.step),
ks AS (SELECT id, step, CASE WHEN first(n) >= 32 THEN max(off) * sqrt(first(t)) ELSE 0 END AS ks FROM place GROUP BY id, step),
made AS (SELECT t.id AS mid, t.step AS mstep, {_SQ.format("gap / (CAST(1.02 AS DOUBLE) * sqrt(ln(greatest(t, 3))))")} AS scan_mean, {_SQ.format("ratio / CAST(1.10 AS DOUBLE)")} AS scan_variance, {_SQ.format("ks / (CAST(0.37 AS DOUBLE) * sqrt(ln(greatest(t, 3))))")} AS scan_ks FROM top t JOIN ks k ON t.id = k.id AND t.step = k.step),
held AS (SELECT x.id, x.step, {", ".join(f"{_HOLD.format(c)} AS {c}" for c in retro.REVIEW)} FROM x LEFT JOIN made ON x.id = mid AND x.step = mstep) """ + rounded_sql(["id", "step"], retro.REVIEW, "held", 5)


# Grouped families

GROUPED = {
    "prefix_battery_2": lambda p: forensics.prefix_battery(p, second=True), "spectral": forensics.spectral, "forecaster": forensics.forecaster, "binned_tests": forensics.binned_tests,
    "every_split": forensics.every_split, "regimes_level": grouped.regimes, "regimes_regression": lambda p: grouped.regimes(p, "ar"),
}
for _name, _made in GROUPED.items():
    QUERIES[_name] = lambda spark, d, f=_made: f(lineitem_panel(spark, d))


_TANH = "CASE WHEN best IS NOT NULL THEN 1 - 2 / (exp(least(2 * ({0}), 600)) + 1) END"
QUERIES["every_split"] = lambda spark, d: rounded(forensics.every_split(lineitem_panel(spark, d)), ["id", "step"], forensics.SPLITS, 5)
ORACLE["every_split"] = with_sql(PANEL_SQL) + f""",
h AS (SELECT id, avg(value) AS m, var_pop(value) AS v FROM panel WHERE period = 1 GROUP BY id),
x AS (SELECT p.id, p.step, (value - m) / sqrt(v + 1e-12) AS z FROM panel p JOIN h ON p.id = h.id WHERE period = 2),
s AS (SELECT id, step + 1 AS k, sum(z) OVER w AS a, sum(z * z) OVER w AS b FROM x WINDOW w AS (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) UNION ALL SELECT id, 0, 0, 0 FROM h),
parts AS (SELECT e.id, e.k - 1 AS step, f.k, CAST(e.k - f.k AS DOUBLE) AS n, (e.a - f.a) / (e.k - f.k) AS m, (e.b - f.b) / (e.k - f.k) AS q FROM s e JOIN s f ON e.id = f.id AND f.k <= e.k - 10),
likely AS (SELECT id, step, k, n, n * m * m / 2 AS bm, n * (greatest(q - m * m, 1e-9) - 1 - ln(greatest(q - m * m, 1e-9))) / 2 AS bv FROM parts),
top AS (SELECT id, step, max(bm + bv) AS best, arg_min(k, struct_pack(g := -(bm + bv), k := k)) AS k, max(bm) AS bm, max(bv) AS bv, max(bm + bv) FILTER (n <= 200) AS late FROM likely GROUP BY id, step),
made AS (SELECT x.id, x.step, {_TANH.format("best / 20")} AS best, k / CAST(greatest(x.step, 1) AS DOUBLE) AS place, {_TANH.format("bm / 20")} AS mean, {_TANH.format("bv / 20")} AS variance, {_TANH.format("late / 20")} AS recent, {_TANH.format("(best - ln(greatest(x.step + 1, 2)) / 2) / 20")} AS excess
  FROM x LEFT JOIN top ON x.id = top.id AND x.step = top.step)
SELECT id, step, {", ".join(f"round(coalesce({c}, 0), 5) + 0.0 AS {c}" for c in forensics.SPLITS)} FROM made"""


def frequency(panel: DataFrame) -> DataFrame:
    """The hundred channels of spectra and autocorrelations, side by side."""
    both = {"short": grouped.spectra(None), "long": grouped.spectra(None, grouped.LONG_SPECTRA, 10, overlap=True)}
    return grouped.together(panel, {"spectra": grouped.together(None, both), "acf": arrays.rolling_acf()})


def white(panel: DataFrame, scored=None) -> DataFrame:
    """The 119 channels of the whitened stream: battery and log scale, step, tests, odds, context."""
    return grouped.alone(panel, white_stream.family(scored))


def joint(panel: DataFrame) -> DataFrame:
    """All families of the final monitor side by side (its net's two channels are left out): plain and compressed, forecaster, batteries,
    run lengths, mass, frequency, novelty, whitened."""
    plain = {"": forensics.monitor(None), "_scales": arrays.multiscale(), "_retro": arrays.retro()}
    parts = {f"raw{n}": f for n, f in plain.items()} | {f"asinh{n}": grouped.compressed(f) for n, f in plain.items()}
    own = {
        "forecast": forensics.forecaster(None), "prefix": forensics.prefix_battery(None), "prefix2": forensics.prefix_battery(None, second=True),
        "prefix_asinh": grouped.compressed(forensics.prefix_battery(None)), "prefix2_asinh": grouped.compressed(forensics.prefix_battery(None, second=True)),
        "spectral": forensics.spectral(None), "runs": grouped.run_lengths(None), "novelty": grouped.novelty(None),
        "short": grouped.spectra(None), "long": grouped.spectra(None, grouped.LONG_SPECTRA, 10, overlap=True),
    }
    parts |= {"own": grouped.together(None, own), "mass": arrays.mass(), "acf": arrays.rolling_acf(), "white": white_stream.family()}
    return grouped.together(panel, parts)


QUERIES["frequency"] = lambda spark, d: frequency(lineitem_panel(spark, d))
QUERIES["white_channels"] = lambda spark, d: white(lineitem_panel(spark, d))
QUERIES["channels_joint"] = lambda spark, d: joint(lineitem_panel(spark, d))
QUERIES["white_student"] = lambda spark, d: white(lineitem_panel(spark, d), innovations.student_scores)
QUERIES["white_asinh"] = lambda spark, d: white(views.compressed(lineitem_panel(spark, d)))
QUERIES["white_stream"] = lambda spark, d: innovations.inputs(innovations.streams(lineitem_panel(spark, d)))
QUERIES["stream_white"] = lambda spark, d: white_stream.replay(lineitem_panel(spark, d).select("id", "time", "value", "hist_len"))
QUERIES["white_calibrated"] = lambda spark, d: grouped.alone(lineitem_panel(spark, d), white_stream.calibrated())


# Processes and relational verbs

QUERIES["dynamics"] = lambda spark, d: dynamics.dynamics(lineitem_panel(spark, d))
QUERIES["process_kinds"] = lambda spark, d: dynamics.kinds(dynamics.dynamics(lineitem_panel(spark, d)))

_WHOLE = ["n", "distinct"]
_MARGINAL = [c for c in dynamics.MARGINAL if c not in _WHOLE]
QUERIES["marginals"] = lambda spark, d: rounded(dynamics.marginals(lineitem_panel(spark, d)), ["id", *_WHOLE], _MARGINAL)
ORACLE["marginals"] = with_sql(PANEL_SQL) + """,
r AS (SELECT *, lag(value) OVER (PARTITION BY id ORDER BY time) AS prev, avg(value) OVER (PARTITION BY id) AS mv FROM panel WHERE period = 1),
m AS (SELECT id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS largest, avg(power(value - mv, 3)) / power(stddev_pop(value), 3) AS skew, kurtosis_pop(value) AS kurt,
             quantile_cont(value, 0.01) AS q1, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99,
             count(DISTINCT value) AS "distinct", avg(CASE WHEN abs(value - round(value)) < 1e-6 THEN 1.0 ELSE 0.0 END) AS whole, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zeros, avg(CASE WHEN prev IS NULL THEN NULL WHEN value = prev THEN 1.0 ELSE 0.0 END) AS repeats FROM r GROUP BY id),
f AS (SELECT *, (q99 - q1) / (q75 - q25 + CAST(1e-12 AS DOUBLE)) AS tail_ratio, (q99 - median) / (median - q1 + CAST(1e-12 AS DOUBLE)) AS tail_asymmetry, greatest(largest - mean, mean - least) / sd AS max_abs_z, n / CAST(6 AS DOUBLE) * (skew * skew + kurt * kurt / 4) AS jarque_bera FROM m)
SELECT id, n, "distinct", """ + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in _MARGINAL) + " FROM f"

QUERIES["first_by_key"] = lambda spark, d: relational.first_by_key(stats(spark, d).select("kind", "n", "id", "broken"), "kind", ["n", "id"])
ORACLE["first_by_key"] = _KINDED + " SELECT kind, n, id, broken FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n, id) AS r FROM kinded) WHERE r = 1"

QUERIES["reindexed"] = lambda spark, d: rounded(relational.reindexed(stats(spark, d).where("broken = 1").select("id", "tau", "sd"), lineitem_panel(spark, d).select("id").distinct(), "id"), ["id", "tau"], ["sd"])
ORACLE["reindexed"] = _KINDED + " SELECT p.id, k.tau, round(k.sd, 6) + 0.0 AS sd FROM (SELECT DISTINCT id FROM panel) p LEFT JOIN (SELECT * FROM kinded WHERE broken = 1) k ON p.id = k.id"


def suffixed(spark: SparkSession, d: str) -> DataFrame:
    panel = lineitem_panel(spark, d)
    history = dynamics.marginals(panel).select("id", "n", "mean", "sd")
    whole = panel.groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return rounded(relational.suffixed_join([("", stats(spark, d).select("id", "n", "mean")), ("_t2", history), ("_t2b", whole)], "id"), ["id", "n", "n_t2", "n_t2b"], ["mean", "mean_t2", "sd", "mean_t2b"])


QUERIES["suffixed_join"] = suffixed
ORACLE["suffixed_join"] = _KINDED + ", h AS (SELECT id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM panel WHERE period = 1 GROUP BY id), w AS (SELECT id, count(*) AS n, avg(value) AS mean FROM panel GROUP BY id) SELECT k.id, k.n, h.n AS n_t2, w.n AS n_t2b, round(k.mean, 6) + 0.0 AS mean, round(h.mean, 6) + 0.0 AS mean_t2, round(h.sd, 6) + 0.0 AS sd, round(w.mean, 6) + 0.0 AS mean_t2b FROM kinded k JOIN h ON k.id = h.id JOIN w ON k.id = w.id"

_LEAST = ["mean", "sd", "q95"]


def least_columns(spark: SparkSession, d: str) -> DataFrame:
    name, margin = relational.least_of(_LEAST)
    return rounded(stats(spark, d).withColumn("least", name).withColumn("margin", margin), ["id", "least"], ["margin"])


QUERIES["least_columns"] = least_columns
ORACLE["least_columns"] = _KINDED + ", l AS (SELECT id, list_sort([mean, sd, q95]) AS s, mean, sd, q95 FROM kinded) SELECT id, CASE WHEN mean = s[1] THEN 'mean' WHEN sd = s[1] THEN 'sd' ELSE 'q95' END AS least, round(s[2] - s[1], 6) + 0.0 AS margin FROM l"

QUERIES["kinds_without_scale"] = lambda spark, d: stats(spark, d).select(F.concat_ws(",", relational.replaced(F.col("kind"), "[VD]", "other"), F.coalesce("bin", F.lit("none"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
ORACLE["kinds_without_scale"] = _KINDED + " SELECT CASE WHEN regexp_replace(kind, '[VD]', '', 'g') = '' THEN 'other' ELSE regexp_replace(kind, '[VD]', '', 'g') END || ',' || coalesce(bin, 'none') AS key, count(*) AS n FROM kinded GROUP BY 1"

QUERIES["fixed_histogram"] = lambda spark, d: relational.fixed_histogram(lineitem_panel(spark, d), "value", 8, 5.0, 45.0)
ORACLE["fixed_histogram"] = with_sql(PANEL_SQL) + ", c AS (SELECT CAST(least(floor((value - 5) / 5), 7) AS BIGINT) AS bin, count(*) AS n FROM panel WHERE value >= 5 AND value <= 45 GROUP BY 1) SELECT b AS bin, coalesce(n, 0) AS n FROM range(0, 8) r(b) LEFT JOIN c ON bin = b"

QUERIES["described"] = lambda spark, d: rounded(relational.described(stats(spark, d), ["n", "mean", "sd", "skew"]), ["name", "n"], ["mean", "sd", "least", "q25", "q50", "q75", "largest"])
ORACLE["described"] = _KINDED + ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({c} AS DOUBLE) AS x FROM kinded" for c in ("n", "mean", "sd", "skew")) + ") SELECT name, count(*) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) + 0.0 AS sd, round(min(x), 6) + 0.0 AS least, round(quantile_cont(x, 0.25), 6) + 0.0 AS q25, round(quantile_cont(x, 0.5), 6) + 0.0 AS q50, round(quantile_cont(x, 0.75), 6) + 0.0 AS q75, round(max(x), 6) + 0.0 AS largest FROM long WHERE x IS NOT NULL GROUP BY name"


def sample_tests(spark: SparkSession, d: str) -> DataFrame:
    """Broken against whole series, in each of the statistics of their online parts."""
    long = stats(spark, d).selectExpr("broken", "stack(4, 'mean', mean, 'sd', sd, 'skew', skew, 'ac1', ac1) AS (name, x)").withColumn("x", F.round("x", 9))
    return rounded(relational.two_sample_tests(long, "x", F.col("broken"), "name"), ["name", "n0", "n1"], ["ks", "ks_p", "u", "mw_p"])


_ERF = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
_ERF_SQL = f"CAST({_ERF[-1]} AS DOUBLE)"
for _c in reversed(_ERF[:-1]):
    _ERF_SQL = f"({_ERF_SQL} * q + CAST({_c} AS DOUBLE))"
QUERIES["two_sample_tests"] = sample_tests
ORACLE["two_sample_tests"] = _KINDED + """,
long AS (SELECT broken, name, round(x, 9) AS x FROM (""" + " UNION ALL ".join(f"SELECT broken, '{c}' AS name, {c} AS x FROM kinded" for c in ("mean", "sd", "skew", "ac1")) + f""") WHERE x IS NOT NULL),
sizes AS (SELECT name, count(*) FILTER (broken = 0) AS n0, count(*) FILTER (broken = 1) AS n1 FROM long GROUP BY name),
f AS (SELECT name, x, (SELECT count(*) FROM long l WHERE l.name = o.name AND l.broken = 0 AND l.x <= o.x) AS ca, (SELECT count(*) FROM long l WHERE l.name = o.name AND l.broken = 1 AND l.x <= o.x) AS cb, count(*) AS m FROM long o GROUP BY name, x),
ks AS (SELECT f.name, max(abs(ca / CAST(n0 AS DOUBLE) - cb / CAST(n1 AS DOUBLE))) AS ks, sum(CAST(m * m * m - m AS DOUBLE)) AS ties FROM f JOIN sizes USING (name) GROUP BY f.name),
u AS (SELECT a.name, sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0.0 END) AS u FROM long a JOIN long b ON a.name = b.name AND a.broken = 1 AND b.broken = 0 GROUP BY a.name),
r AS (SELECT name, n0, n1, ks, u, sqrt(n0 * n1 / CAST(n0 + n1 AS DOUBLE)) * ks AS root, greatest(abs(u - n0 * n1 / CAST(2 AS DOUBLE)) - 0.5, 0) / sqrt(n0 * n1 / CAST(12 AS DOUBLE) * (n0 + n1 + 1 - ties / ((n0 + n1) * (n0 + n1 - 1)))) / sqrt(CAST(2 AS DOUBLE)) AS e FROM sizes JOIN ks USING (name) JOIN u USING (name)),
q AS (SELECT *, 1 / (1 + CAST(0.5 AS DOUBLE) * e) AS q, list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * CAST(k * k AS DOUBLE) * root * root))) AS terms FROM r)
SELECT name, n0, n1, round(ks, 6) + 0.0 AS ks, round(CASE WHEN root < 0.2 THEN 1 ELSE greatest(0, least(1, 2 * terms)) END, 6) + 0.0 AS ks_p, round(CAST(u AS DOUBLE), 6) + 0.0 AS u, round(q * exp(-e * e + {_ERF_SQL}), 6) + 0.0 AS mw_p FROM q"""

QUERIES["won_by_kind"] = lambda spark, d: rounded(relational.won_by_kind(scored(spark, d), stats(spark, d).select("id", "kind")), ["kind", "series"], ["auc"])
ORACLE["won_by_kind"] = scored_sql() + ", " + _KINDED[_KINDED.index("lagged AS") :] + """,
clean AS (SELECT s.* FROM scored s WHERE s.id NOT IN (SELECT id FROM scored WHERE target = 1)),
many AS (SELECT step, count(*) AS n FROM clean GROUP BY step HAVING count(*) >= 20),
won AS (SELECT a.id, sum(CASE WHEN b.score < a.score THEN 1.0 WHEN b.score = a.score THEN 0.5 ELSE 0.0 END) / count(*) AS auc FROM scored a JOIN many m ON a.step = m.step JOIN clean b ON a.step = b.step WHERE a.target = 1 GROUP BY a.id)
SELECT kind, count(*) AS series, round(avg(auc), 6) + 0.0 AS auc FROM won JOIN kinded USING (id) GROUP BY kind"""

QUERIES["effect_mixture"] = lambda spark, d: relational.mixture(stats(spark, d).selectExpr("broken", "stack(3, 'mean', mean, 'sd', sd, 'ac1', ac1) AS (name, x)"), "x", "broken", "name")
QUERIES["separation"] = lambda spark, d: learn.separation(stats(spark, d), ["mean", "sd", "skew", "kurt", "ac1"], "broken")


# Joins, score rules, files

def baseline_join(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the series with a break, each with the baseline's where there is one (up to step 100)."""
    left = scored(spark, d, "strongest", 4).where("target = 1").select("id", "step", F.col("score").alias("a"))
    right = scored(spark, d, digits=4).where("step < 100").select("id", "step", F.col("score").alias("b"))
    return rounded(left.join(right, ["id", "step"], "left"), ["id", "step"], ["a", "b"], 4)


QUERIES["baseline_left_join"] = baseline_join
ORACLE["baseline_left_join"] = (
    with_sql(PANEL_SQL, fits.MOMENTS_SQL.replace("fits AS", "f1 AS", 1), fits.TREND_SQL.replace("fits AS", "f2 AS", 1))
    + ", online1 AS (SELECT p.id, p.value, p.step, p.target, f.* EXCLUDE (id) FROM panel p JOIN f1 f ON p.id = f.id WHERE p.period = 2), online2 AS (SELECT p.id, p.value, p.step, p.target, f.* EXCLUDE (id) FROM panel p JOIN f2 f ON p.id = f.id WHERE p.period = 2)"
    + f", b AS (WITH {sql('online1', families.baseline()[0], ['score'], 4)}), a AS (WITH {sql('online2', families.strongest()[0], ['score'], 4, ('id', 'step', 'target'))}) SELECT a.id, a.step, a.score AS a, b.score AS b FROM a LEFT JOIN (SELECT * FROM b WHERE step < 100) b ON a.id = b.id AND a.step = b.step WHERE a.target = 1"
)

QUERIES["members_semi_join"] = lambda spark, d: rounded(lineitem_panel(spark, d).where("period = 2").join(stats(spark, d).where("sd > 15").select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), ["id", "n"], ["mean"])
ORACLE["members_semi_join"] = _KINDED + " SELECT id, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM panel WHERE period = 2 AND id IN (SELECT id FROM kinded WHERE sd > 15) GROUP BY id"

QUERIES["logits"] = lambda spark, d: rounded(scored(spark, d).select("id", "step", learn.logit(F.col("score")).alias("logit"), (1 / (1 + F.exp(-learn.logit(F.col("score"))))).alias("back")), ["id", "step"], ["logit", "back"], 7)
ORACLE["logits"] = scored_sql() + ", l AS (SELECT id, step, ln(greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), score)) / (1 - greatest(CAST(1e-6 AS DOUBLE), least(1 - CAST(1e-6 AS DOUBLE), score)))) AS x FROM scored) SELECT id, step, round(x, 7) + 0.0 AS logit, round(1 / (1 + exp(-x)), 7) + 0.0 AS back FROM l"


def calibrated(spark: SparkSession, d: str) -> DataFrame:
    """Baseline scores less the median of |z| / (1 + |z|) on the history."""
    panel = lineitem_panel(spark, d)
    z = F.abs((F.col("value") - F.col("mu")) / F.col("sd0"))
    history = panel.where("period = 1").join(fits.moments(panel), "id").select("id", (z / (1 + z)).alias("score"))
    return rounded(learn.calibrated(scored(spark, d).select("id", "step", "score"), history), ["id", "step"], ["score"], 5)


QUERIES["history_calibrated"] = calibrated
ORACLE["history_calibrated"] = scored_sql() + ", h AS (SELECT p.id, abs((value - mu) / sd0) AS z FROM panel p JOIN fits f ON p.id = f.id WHERE period = 1), l AS (SELECT id, quantile_cont(z / (1 + z), 0.5) AS level FROM h GROUP BY id) SELECT s.id, s.step, round(score - level, 5) + 0.0 AS score FROM scored s JOIN l ON s.id = l.id"


def gated_holds(spark: SparkSession, d: str) -> DataFrame:
    error = forensics.forecaster(lineitem_panel(spark, d)).select("id", "step", F.col("fast").alias("error"))
    return learn.held(scored(spark, d).select("id", "step", "score").join(error, ["id", "step"]))


QUERIES["gated_holds"] = gated_holds


def interactions(spark: SparkSession, d: str) -> DataFrame:
    panel = lineitem_panel(spark, d)
    prefix = grouped.together(panel, {"raw": forensics.prefix_battery(None), "asinh": grouped.compressed(forensics.prefix_battery(None))})
    some = ["ks", "dmean", "dlogsd", "half_mean", "half_logsd"]
    rows = prefix.select("id", "step", *(F.col(f"raw_{c}").alias(c) for c in some), *(F.col(f"asinh_{c}").alias(f"a_{c}") for c in some))
    scan = retro.retro(detrended_online(spark, d)).select("id", "step", F.col("scan_best").alias("scan"))
    return learn.interactions(rows.join(scan, ["id", "step"]))


QUERIES["interactions"] = interactions

QUERIES["panel_parquet_roundtrip"] = lambda spark, d: rounded(files.through(lineitem_panel(spark, d), "parquet"), ["id", "time", "period"], ["value"])
ORACLE["panel_parquet_roundtrip"] = with_sql(PANEL_SQL) + " SELECT id, CAST(time AS INTEGER) AS time, period, round(value, 6) + 0.0 AS value FROM panel"

QUERIES["shifted_edition"] = lambda spark, d: rounded(files.shifted_edition(lineitem_panel(spark, d).select("id", "time", "value", (F.col("period") - 1).alias("period")), 20), ["id", "time", "period", "step"], ["value"])
ORACLE["shifted_edition"] = with_sql(PANEL_SQL) + " SELECT id, time, CASE WHEN time < hist_len - 20 THEN 1 ELSE 2 END AS period, time - hist_len + 20 AS step, round(value, 6) + 0.0 AS value FROM panel"

_CUTS = with_sql(PANEL_SQL) + """,
meta AS (SELECT id, max(onl_len) AS onl_len, max(hist_len) AS hist_len, min(CASE WHEN target = 1 THEN step END) AS tau FROM panel WHERE period = 2 GROUP BY id),
lim AS (SELECT *, least(coalesce(tau, onl_len), onl_len - 20) AS lim FROM meta WHERE onl_len >= 60),
cuts AS (SELECT l.id, hist_len AS hl, j, 10 + (l.id * 31 + j * 57) % (lim - 10) AS k FROM lim l, range(0, 6) v(j) WHERE lim >= 30)
SELECT 100000 + p.id * 10 + j AS id, time, time - hl - k AS step, target, round(value, 6) + 0.0 AS value FROM panel p JOIN cuts c ON p.id = c.id WHERE time - hl - k >= 0"""
QUERIES["boundary_cuts_six"] = lambda spark, d: rounded(augment.boundary_cuts(lineitem_panel(spark, d), cuts=6).where("period = 2"), ["id", "time", "step", "target"], ["value"])
ORACLE["boundary_cuts_six"] = _CUTS

QUERIES["mirrored_back"] = lambda spark, d: rounded(augment.mirrored(augment.backward(lineitem_panel(spark, d))), ["id", "time", "step", "period", "target"], ["value"])
ORACLE["mirrored_back"] = with_sql(PANEL_SQL) + " SELECT 500000 + id AS id, time, time - hist_len + hist_len // 4 AS step, CASE WHEN time < hist_len - hist_len // 4 THEN 1 ELSE 2 END AS period, target, round(-value, 6) + 0.0 AS value FROM panel"

QUERIES["standardised_windows"] = lambda spark, d: augment.windows(lineitem_panel(spark, d).where("period = 2"), stride=32).select("id", "start", "label", F.round(F.aggregate(augment.standardised(F.col("values")), F.lit(0.0), lambda a, x: a + x * x * x), 4).alias("third"))
ORACLE["standardised_windows"] = with_sql(PANEL_SQL) + """,
meta AS (SELECT id, max(onl_len) AS n, min(CASE WHEN target = 1 THEN step END) AS tau FROM panel WHERE period = 2 GROUP BY id),
starts AS (SELECT id, n, tau, s * 32 AS start FROM meta, range(0, 1000) r(s) WHERE s * 32 + 128 <= n),
labelled AS (SELECT *, CASE WHEN tau IS NULL OR start + 128 <= tau THEN 0 WHEN (tau - start) / CAST(128 AS DOUBLE) BETWEEN 0.15 AND 0.85 THEN 1 END AS label FROM starts),
rows_ AS (SELECT l.id, l.start, l.label, p.value, avg(p.value) OVER w AS m, stddev_pop(p.value) OVER w AS s FROM labelled l JOIN panel p ON p.id = l.id AND p.period = 2 AND p.step >= l.start AND p.step < l.start + 128 WHERE l.label IS NOT NULL WINDOW w AS (PARTITION BY l.id, l.start))
SELECT id, start, label, round(sum(power((value - m) / s, 3)), 4) + 0.0 AS third FROM rows_ GROUP BY 1, 2, 3"""

# Hidden breaks

SIDE = 60


def screened(spark: SparkSession, d: str) -> DataFrame:
    panel = lineitem_panel(spark, d)
    found = durable(screen.cases(panel, SIDE))
    return screen.judged(durable(screen.statistics(screen.sides(panel, found, SIDE))), screen.STATISTICS)


def screened_spectra(spark: SparkSession, d: str) -> DataFrame:
    panel = lineitem_panel(spark, d)
    rows = durable(screen.sides(panel, durable(screen.cases(panel, SIDE)), SIDE))
    plain = screen.statistics(rows).select("case", "place", "broken", "after", "mean", "sd", "kurt", "ac1")
    return screen.excess(screen.judged(plain.join(screen.spectra(rows), ["case", "place", "broken", "after"]), ["ac1", *screen.SPECTRUM]), screen.SPECTRUM)


_UNBIASED = "(({1}) - 1) / CAST((({1}) - 2) * (({1}) - 3) AS DOUBLE) * ((({1}) + 1) * ({0}) + 6)"
_KURT = lambda x: _UNBIASED.format(f"kurtosis_pop({x})", f"count({x})")
_SCREEN_SQL = with_sql(PANEL_SQL) + f""",
each AS (SELECT id, max(hist_len) AS h, max(onl_len) AS n, max(target) AS broken, min(CASE WHEN target = 1 THEN step END) AS tau FROM panel WHERE period = 2 GROUP BY id),
fit AS (SELECT * FROM each WHERE broken = 0 OR (n - tau >= {SIDE} AND tau + h >= {SIDE})),
dealt AS (SELECT *, n // 32 AS class, row_number() OVER (PARTITION BY n // 32, broken ORDER BY (id * 2654435761 + 1) % 4294967296, id) - 1 AS num FROM fit),
sizes AS (SELECT class, count(*) AS many FROM dealt WHERE broken = 0 GROUP BY class),
wanted AS (SELECT d.id AS b, d.tau, d.class, p.place, (d.num * 2 + p.place) % many AS spot FROM dealt d JOIN sizes USING (class), (VALUES (0), (1)) p(place) WHERE broken = 1 AND p.place < least(2, many)),
cases AS (SELECT id AS b, 0 AS place, id, 1 AS broken, tau AS cut, h FROM fit WHERE broken = 1
  UNION ALL SELECT w.b, w.place + 1, c.id, 0, least(w.tau, c.n - {SIDE}), c.h FROM wanted w JOIN dealt c ON c.broken = 0 AND c.class = w.class AND c.num = w.spot),
kept AS (SELECT * FROM cases WHERE cut + h >= {SIDE} AND cut >= 0),
sides AS (SELECT k.b, k.place, k.broken, p.step >= k.cut AS later, p.step - k.cut + CASE WHEN p.step >= k.cut THEN 0 ELSE {SIDE} END AS pos, value FROM kept k JOIN panel p ON p.id = k.id AND p.step >= k.cut - {SIDE} AND p.step < k.cut + {SIDE}),
m AS (SELECT *, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM sides WINDOW w AS (PARTITION BY b, place, broken, later)),
z AS (SELECT *, (value - mean) / (sd + 1e-12) AS z FROM m),
l AS (SELECT *, {", ".join(f"lag(z, {k}) OVER w AS z{k}" for k in (1, 3, 5, 10, 30))}, avg(z) OVER (PARTITION BY b, place, broken, later ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS near FROM z WINDOW w AS (PARTITION BY b, place, broken, later ORDER BY pos)),
diffs AS (SELECT *, z - z1 AS d, lag(z - z1) OVER (PARTITION BY b, place, broken, later ORDER BY pos) AS d1 FROM l),
stats AS (SELECT b, place, broken, later, first(mean) AS mean, first(sd) AS sd, {_KURT("value")} AS kurt, corr(z, z1) AS ac1, corr(z, z3) AS ac3, corr(z, z10) AS ac10, corr(z, z30) AS ac30, corr(z * z, z1 * z1) AS vol_ac1, corr(abs(z), abs(z5)) AS abs_ac5,
    stddev_pop(d) AS diff_sd, {_KURT("d")} AS diff_kurt, corr(d, d1) AS turning, corr(z, z1 * z1) AS bend, quantile_cont(abs(z), 0.95) AS q95, quantile_cont(abs(z), 0.99) AS q99, avg(CASE WHEN z1 IS NOT NULL THEN CASE WHEN sign(z) <> sign(z1) THEN 1.0 ELSE 0.0 END END) AS crossing,
    var_pop(CASE WHEN pos % 10 = 0 AND pos < n - 50 THEN near END) AS long_var FROM diffs GROUP BY b, place, broken, later),
changes AS (SELECT x.b, x.place, x.broken, coalesce(abs(x.mean - y.mean) / (y.sd + 1e-12) <= 0.3 AND x.sd / (y.sd + 1e-12) BETWEEN 0.85 AND 1.18 AND abs(x.ac1 - y.ac1) <= 0.12 AND abs(x.kurt - y.kurt) <= 1.5, false) AS hidden, {", ".join(f"x.{c} - y.{c} AS {c}" for c in screen.STATISTICS)}
  FROM stats x JOIN stats y ON x.b = y.b AND x.place = y.place AND x.broken = y.broken AND x.later AND NOT y.later)"""
QUERIES["hidden_breaks"] = lambda spark, d: rounded(screened(spark, d).withColumn("broken", F.col("broken").cast("long")), ["case", "place", "broken", "hidden"], screen.STATISTICS, 5)
ORACLE["hidden_breaks"] = _SCREEN_SQL + ' SELECT b AS "case", CAST(place AS BIGINT) AS place, CAST(broken AS BIGINT) AS broken, hidden, ' + ", ".join(f"round(CAST({c} AS DOUBLE), 5) + 0.0 AS {c}" for c in screen.STATISTICS) + " FROM changes"
_EXCESS = ["sd_break", "sd_control", "ratio", "far_break", "far_control"]
QUERIES["hidden_excess"] = lambda spark, d: rounded(screen.excess(screened(spark, d), screen.STATISTICS), ["hidden", "name", "breaks", "controls"], _EXCESS, 4)
ORACLE["hidden_excess"] = _SCREEN_SQL + f""",
long AS (UNPIVOT (SELECT hidden, broken, {", ".join(screen.STATISTICS)} FROM changes) ON {", ".join(screen.STATISTICS)} INTO NAME name VALUE d),
spread AS (SELECT hidden, name, count(*) FILTER (broken = 1) AS breaks, count(*) FILTER (broken = 0) AS controls, stddev_samp(d) FILTER (broken = 1) AS sb, stddev_samp(d) FILTER (broken = 0) AS sc FROM long GROUP BY hidden, name)
SELECT l.hidden, l.name, first(breaks) AS breaks, first(controls) AS controls, round(first(sb), 4) + 0.0 AS sd_break, round(first(sc), 4) + 0.0 AS sd_control, round(first(sb) / nullif(first(sc), 0), 4) + 0.0 AS ratio,
  round(avg(CASE WHEN abs(d) > 2 * sc THEN 1.0 ELSE 0.0 END) FILTER (broken = 1), 4) + 0.0 AS far_break, round(avg(CASE WHEN abs(d) > 2 * sc THEN 1.0 ELSE 0.0 END) FILTER (broken = 0), 4) + 0.0 AS far_control
FROM long l JOIN spread s ON l.hidden = s.hidden AND l.name = s.name GROUP BY l.hidden, l.name"""
QUERIES["hidden_spectra"] = screened_spectra


# Learners

def _rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rows, names = member_rows(spark, d)
    return table(rows.select("id", "step", "target", *names)), names


def _learned(made: Callable[[DataFrame, list[str]], DataFrame], by: str | None = None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        got = made(*_rows(spark, d))
        return metrics.ts_auc_by(got, by) if by else metrics.ts_auc(got)

    return run


QUERIES["learn_holdout"] = lambda spark, d: learn.holdout(*_rows(spark, d))
QUERIES["learn_ranker"] = _learned(learn.ranker, "fold")
QUERIES["learn_listwise"] = _learned(ranking.listwise, "fold")
QUERIES["learn_bagged"] = _learned(lambda r, n: learn.bagged(r, n, bags=2))
QUERIES["learn_specialists"] = _learned(learn.specialists)
QUERIES["learn_pruned"] = _learned(lambda r, n: learn.pruned(r, n, 6), "fold")
QUERIES["learn_stacked"] = _learned(lambda r, n: learn.stacked({"plain": learn.cross_validated(r, n), "ranked": learn.ranker(r, n)}), "fold")


def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    rows, names = _rows(spark, d)
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    learn.saved(rows, names, path)
    return metrics.ts_auc(learn.loaded(path, rows, names))


QUERIES["model_roundtrip"] = model_roundtrip
def scorer_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A scorer of four fifths of the series, written as one pipeline, read again and applied to the others."""
    rows, names = _rows(spark, d)
    data, path = learn.folds(rows), f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    pipelines.saved(data.where("fold > 0"), names, path)
    return metrics.ts_auc(pipelines.scored(data.where("fold = 0"), path))


QUERIES["scorer_roundtrip"] = scorer_roundtrip
QUERIES["rank_groups"] = lambda spark, d: learn.rank_groups(scored(spark, d), 40).groupBy("step", "chunk").agg(F.count("*").alias("n"))


_MONITOR = FAMILIES["channels_monitor"][0]
_TRAJECTORY = families.trajectory(("raw_cusum", "raw_page_hinkley", "absolute_cusum"), ("raw_cusum", "raw_page_hinkley"))
QUERIES["trajectory"] = lambda spark, d: output(rendered(member_rows(spark, d)[0].select("id", "step", *_MONITOR[1]), _TRAJECTORY[0]), _TRAJECTORY[1])
ORACLE["trajectory"] = with_sql(PANEL_SQL, fits.TREND_SQL, ONLINE_SQL) + ", " + sql("online", [*_MONITOR[0], *_TRAJECTORY[0]], _TRAJECTORY[1])
QUERIES["forecaster_horizons"] = lambda spark, d: grouped.together(lineitem_panel(spark, d), {f"ahead{k}": forensics.forecaster(None, ahead=k) for k in (1, 5)})
QUERIES["spectra_increments"] = lambda spark, d: grouped.together(lineitem_panel(spark, d), {"level": grouped.spectra(None, (32, 128)), "step": forensics.increments(grouped.spectra(None, (32, 128)))})


# Streams

def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    """The monitor as a stream; its rows are those of the batch's windows."""
    points = lineitem_panel(spark, d).select("id", "time", "value", "hist_len")
    got = jobs.replay(points, by="time", through=lambda s: streaming.stream(s, forensics.monitor(None)))
    return output(got, _MONITOR[1])


QUERIES["stream_monitor"] = stream_monitor
ORACLE["stream_monitor"] = with_sql(PANEL_SQL, fits.TREND_SQL, ONLINE_SQL) + ", " + sql("online", *_MONITOR)


def stream_run_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Run lengths as a stream: points in four files, whatever their order within."""
    points = lineitem_panel(spark, d).select("id", "time", "value", "hist_len")
    return jobs.replay(points, by="time", through=lambda s: streaming.stream(s, grouped.run_lengths(None)))


QUERIES["stream_run_lengths"] = stream_run_lengths


def queries() -> dict[str, Query]:
    """Those with SQL first, then by how much they put together."""
    late = ("white_", "learn_", "channels_joint", "separation")
    return {n: QUERIES[n] for n in sorted(QUERIES, key=lambda n: (n not in ORACLE, n.startswith(late)))}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
