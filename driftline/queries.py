"""Registered queries over the lineitem panel, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators import augment, families, forensics, grouped, innovations, learn, metrics, relational, retro
from driftline.plans import fits
from driftline.plans.panel import PANEL_SQL, lineitem_panel, long_panel_sql, online
from driftline.plans.staged import d as dbl
from driftline.plans.staged import ewma, output, probit, rendered, sql
from driftline.session import table
from driftline.sources import files
from driftline.streaming import jobs
from driftline.streaming import white as white_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ONLINE_SQL = "online AS (SELECT p.id, p.value, p.step, p.target, f.* EXCLUDE (id) FROM panel p JOIN fits f ON p.id = f.id WHERE p.period = 2)"


def with_sql(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(c.strip() for c in ctes)


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *((F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in values))


def rounded_sql(keys: list[str], values: list[str], source: str, digits: int = 6) -> str:
    return f"SELECT {', '.join([*keys, *(f'round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}' for c in values)])} FROM {source}"


# Panel and fits

QUERIES["panel_points"] = lambda spark, d: rounded(lineitem_panel(spark, d), ["id", "time", "period", "step", "target"], ["value"])
ORACLE["panel_points"] = with_sql(PANEL_SQL) + " " + rounded_sql(["id", "time", "period", "step", "target"], ["value"], "panel")

QUERIES["fit_moments"] = lambda spark, d: rounded(fits.moments(lineitem_panel(spark, d)), ["id", "hn"], ["mu", "sd0", "sd1", "last_z"])
ORACLE["fit_moments"] = with_sql(PANEL_SQL, fits.MOMENTS_SQL) + " " + rounded_sql(["id", "hn"], ["mu", "sd0", "sd1", "last_z"], "fits")

_TREND = ["level", "sd", "slope", "rho", "kurt", "infl", "winsor", "white", "prev0"]
QUERIES["fit_trend"] = lambda spark, d: rounded(fits.trend(lineitem_panel(spark, d)), ["id", "hn"], _TREND)
ORACLE["fit_trend"] = with_sql(PANEL_SQL, fits.TREND_SQL) + " " + rounded_sql(["id", "hn"], _TREND, "fits")


# Channel families

FAMILIES = {
    "channels_baseline": (families.baseline(), fits.moments, fits.MOMENTS_SQL),
    "channels_monitor": (families.monitor(), fits.trend, fits.TREND_SQL),
    "channels_multiscale": (families.multiscale(), fits.trend, fits.TREND_SQL),
    "channels_mass": (families.mass(), fits.mass_reference, fits.MASS_REFERENCE_SQL),
    "channels_mass_lagged": (families.mass_lagged(), fits.mass_reference, fits.MASS_REFERENCE_SQL),
    "channels_acf": (families.rolling_acf(), fits.acf_reference, fits.ACF_REFERENCE_SQL),
    "channels_acf_wide": (families.rolling_acf(families.WIDE_LAGS, families.WIDE_WINDOWS), lambda p: fits.acf_reference(p, families.WIDE_LAGS), fits.acf_reference_sql(families.WIDE_LAGS)),
    "channels_glr": (families.glr(), fits.moments, fits.MOMENTS_SQL),
    "channels_tail": (families.tails(), fits.tail_reference, fits.TAIL_REFERENCE_SQL),
    "channels_trailing": (families.trailing(), fits.moments, fits.MOMENTS_SQL),
}


def channels(panel: DataFrame, name: str) -> DataFrame:
    """A family's channels (id, step, columns by name), not rounded, of a panel."""
    (stages, names), fit, _ = FAMILIES[name]
    return rendered(fits.fitted(panel, fit), stages).select("id", "step", *names)


for _name, ((_stages, _names), _fit, _fit_sql) in FAMILIES.items():
    QUERIES[_name] = lambda spark, d, s=_stages, n=_names, f=_fit: output(rendered(fits.fitted(lineitem_panel(spark, d), f), s), n)
    ORACLE[_name] = with_sql(PANEL_SQL, _fit_sql, ONLINE_SQL) + ", " + sql("online", _stages, _names)


# Scores and metrics

def scored(spark: SparkSession, d: str, name: str = "channels_baseline", digits: int = 6) -> DataFrame:
    """(id, step, target, score); scores are rounded, so that ties are the same in any engine."""
    (stages, _), fit, _ = FAMILIES[name]
    panel = lineitem_panel(spark, d)
    return rendered(fits.fitted(panel, fit), stages).select("id", "step", "target", F.round("score", digits).alias("score"))


def scored_sql(name: str = "channels_baseline", digits: int = 6) -> str:
    (stages, _), _, fit_sql = FAMILIES[name]
    inner = sql("online", stages, ["score"], digits, ("id", "step", "target"))
    return with_sql(PANEL_SQL, fit_sql, ONLINE_SQL) + f", scored AS (WITH {inner})"


FAMILIES["strongest"] = (families.strongest(), fits.trend, fits.TREND_SQL)

AUC_SQL = """
ranked AS (SELECT *, rank() OVER (PARTITION BY step ORDER BY score) + (count(*) OVER (PARTITION BY step, score) - 1) / CAST(2 AS DOUBLE) AS r FROM scored),
steps AS (SELECT step, sum(target) AS np, sum(1 - target) AS nn, sum(CASE WHEN target = 1 THEN r ELSE 0 END) AS rs FROM ranked GROUP BY step),
each AS (SELECT step, np * nn AS pairs, (rs - np * (np + 1) / CAST(2 AS DOUBLE)) / (np * nn) AS auc FROM steps WHERE np > 0 AND nn > 0)
"""
_TS_AUC_SQL = ", " + AUC_SQL.strip() + " SELECT round(coalesce(sum(auc * pairs) / sum(pairs), 0.5), 6) + 0.0 AS ts_auc, count(*) AS steps, CAST(coalesce(sum(pairs), 0) AS BIGINT) AS pairs FROM each"

QUERIES["tsauc_ewma_baseline"] = lambda spark, d: rounded(metrics.ts_auc(scored(spark, d)), ["steps", "pairs"], ["ts_auc"])
ORACLE["tsauc_ewma_baseline"] = scored_sql() + _TS_AUC_SQL
QUERIES["tsauc_strongest"] = lambda spark, d: rounded(metrics.ts_auc(scored(spark, d, "strongest")), ["steps", "pairs"], ["ts_auc"])
ORACLE["tsauc_strongest"] = scored_sql("strongest") + _TS_AUC_SQL

QUERIES["step_curve"] = lambda spark, d: rounded(metrics.step_curve(scored(spark, d)), ["step", "weight"], ["auc", "smooth"])
ORACLE["step_curve"] = scored_sql() + ", " + AUC_SQL.strip() + " SELECT step, CAST(pairs AS BIGINT) AS weight, round(auc, 6) + 0.0 AS auc, round(avg(auc) OVER (ORDER BY step ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING), 6) + 0.0 AS smooth FROM each"

_RANGE = "CASE WHEN step < 30 THEN '000-030' WHEN step < 100 THEN '030-100' WHEN step < 300 THEN '100-300' WHEN step < 700 THEN '300-700' ELSE '700-' END"
QUERIES["tsauc_by_step_range"] = lambda spark, d: rounded(metrics.ts_auc_by(scored(spark, d).withColumn("range", F.expr(_RANGE)), "range"), ["range", "pairs"], ["ts_auc"])
ORACLE["tsauc_by_step_range"] = scored_sql() + ", " + AUC_SQL.strip() + f" SELECT {_RANGE} AS range, round(sum(auc * pairs) / sum(pairs), 6) + 0.0 AS ts_auc, CAST(sum(pairs) AS BIGINT) AS pairs FROM each GROUP BY 1"

QUERIES["within_series_auc"] = lambda spark, d: rounded(metrics.group_auc(scored(spark, d), ["id"]), ["id", "np", "nn"], ["auc"])
ORACLE["within_series_auc"] = scored_sql() + """,
ranked AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY score) + (count(*) OVER (PARTITION BY id, score) - 1) / CAST(2 AS DOUBLE) AS r FROM scored),
sums AS (SELECT id, sum(target) AS np, sum(1 - target) AS nn, sum(CASE WHEN target = 1 THEN r ELSE 0 END) AS rs FROM ranked GROUP BY id)
SELECT id, CAST(np AS BIGINT) AS np, CAST(nn AS BIGINT) AS nn, CASE WHEN np > 0 AND nn > 0 THEN round((rs - np * (np + 1) / CAST(2 AS DOUBLE)) / (np * nn), 6) + 0.0 END AS auc FROM sums"""

QUERIES["series_earnings"] = lambda spark, d: rounded(metrics.earnings(scored(spark, d)), ["id", "steps"], ["earned"])
ORACLE["series_earnings"] = scored_sql() + """,
won AS (
  SELECT a.id, a.step, avg(CASE WHEN a.score = b.score THEN CAST(0.5 AS DOUBLE) WHEN (a.score > b.score) = (a.target = 1) THEN 1 ELSE 0 END) AS w
  FROM scored a JOIN scored b ON a.step = b.step AND a.target <> b.target GROUP BY a.id, a.step)
SELECT id, count(*) AS steps, round(avg(w), 6) + 0.0 AS earned FROM won GROUP BY id"""

QUERIES["row_weights"] = lambda spark, d: rounded(metrics.weights(scored(spark, d)), ["id", "step"], ["step_weight", "pair_weight", "evidence_weight"])
ORACLE["row_weights"] = scored_sql() + """,
base AS (SELECT id, step, target, count(*) OVER (PARTITION BY step) AS n, sum(target) OVER (PARTITION BY step) AS pos, min(CASE WHEN target = 1 THEN step END) OVER (PARTITION BY id) AS t0 FROM scored),
w AS (SELECT *, 1 / CAST(n AS DOUBLE) AS w1, pos * (n - pos) / CAST(n AS DOUBLE) AS w2 FROM base)
SELECT id, step, round(w1 / (SELECT avg(w1) FROM w), 6) + 0.0 AS step_weight, round(w2 / (SELECT avg(w2) FROM w), 6) + 0.0 AS pair_weight,
       round(CASE WHEN target = 1 THEN greatest(CAST(0.05 AS DOUBLE), least(CAST(1 AS DOUBLE), (step - t0 + 1) / CAST(50 AS DOUBLE))) ELSE 1 END, 6) + 0.0 AS evidence_weight FROM w"""

_TRANSFORMS = families.transforms()
QUERIES["score_transforms"] = lambda spark, d: output(rendered(scored(spark, d, digits=12), _TRANSFORMS[0]), _TRANSFORMS[1])
ORACLE["score_transforms"] = scored_sql(digits=12) + ", " + sql("scored", *_TRANSFORMS)


def _two_scores(spark: SparkSession, d: str) -> DataFrame:
    other = scored(spark, d, "strongest", 4).select("id", "step", F.col("score").alias("b"))
    return scored(spark, d, digits=4).withColumnRenamed("score", "a").join(other, ["id", "step"])


QUERIES["spearman_by_step"] = lambda spark, d: rounded(metrics.spearman(_two_scores(spark, d), "a", "b").where("n >= 3"), ["step", "n"], ["rho"])
_S1, _S2 = (sql("online1", families.baseline()[0], ["score"], 4), sql("online2", families.strongest()[0], ["score"], 4))
ORACLE["spearman_by_step"] = (
    with_sql(PANEL_SQL, fits.MOMENTS_SQL.replace("fits AS", "f1 AS", 1), fits.TREND_SQL.replace("fits AS", "f2 AS", 1))
    + ", online1 AS (SELECT p.id, p.value, p.step, f.* EXCLUDE (id) FROM panel p JOIN f1 f ON p.id = f.id WHERE p.period = 2), online2 AS (SELECT p.id, p.value, p.step, f.* EXCLUDE (id) FROM panel p JOIN f2 f ON p.id = f.id WHERE p.period = 2)"
    + f", a AS (WITH {_S1}), b AS (WITH {_S2})"
    + """, pairs2 AS (SELECT a.id, a.step, a.score AS a, b.score AS b FROM a JOIN b ON a.id = b.id AND a.step = b.step),
ranks AS (SELECT step, rank() OVER (PARTITION BY step ORDER BY a) + (count(*) OVER (PARTITION BY step, a) - 1) / CAST(2 AS DOUBLE) AS ra,
                 rank() OVER (PARTITION BY step ORDER BY b) + (count(*) OVER (PARTITION BY step, b) - 1) / CAST(2 AS DOUBLE) AS rb FROM pairs2)
SELECT step, count(*) AS n, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN round(covar_pop(ra, rb) / sqrt(var_pop(ra) * var_pop(rb)), 6) + 0.0 END AS rho FROM ranks GROUP BY step HAVING count(*) >= 3"""
)


# Relational verbs on one row a series

STATS_SQL = """
lagged AS (SELECT *, lag(value) OVER (PARTITION BY id ORDER BY step) AS prev FROM panel WHERE period = 2),
m AS (SELECT *, avg(value) OVER (PARTITION BY id) AS mv FROM lagged),
stats AS (
  SELECT id, max(target) AS broken, min(CASE WHEN target = 1 THEN step END) AS tau, CAST(sum(target) AS BIGINT) AS post_len, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd,
         avg((value - mv) * (value - mv) * (value - mv)) / power(stddev_pop(value), 3) AS skew, kurtosis_pop(value) AS kurt, corr(value, prev) AS ac1,
         quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.95) AS q95
  FROM m GROUP BY id)
"""
_STATS = ["mean", "sd", "skew", "kurt", "ac1", "q05", "q50", "q95"]
_BINS = [0.0, 40.0, 80.0, 120.0, 160.0, 1000.0]
_BIN_SQL = "CASE " + " ".join(f"WHEN post_len >= {a:g} AND post_len < {b:g} THEN '{a:g}-{b:g}'" for a, b in zip(_BINS, _BINS[1:])) + " END"
_KIND_SQL = "CASE WHEN {0} = '' THEN 'none' ELSE {0} END".format("(CASE WHEN abs(mean - 25) > 4 THEN 'M' ELSE '' END || CASE WHEN sd > 16 THEN 'V' ELSE '' END || CASE WHEN abs(ac1) > 0.05 THEN 'D' ELSE '' END)")


def stats(spark: SparkSession, d: str) -> DataFrame:
    """One row a series, with a bin of its broken length and a kind made of flags."""
    flags = {"M": F.abs(F.round("mean", 9) - 25) > 4, "V": F.round("sd", 9) > 16, "D": F.abs(F.round("ac1", 9)) > 0.05}
    base = relational.segment_stats(lineitem_panel(spark, d))
    return base.withColumn("bin", relational.cut(F.col("post_len"), _BINS)).withColumn("kind", relational.kind(flags))


_KINDED = with_sql(PANEL_SQL, STATS_SQL) + f", kinded AS (SELECT *, {_BIN_SQL} AS bin, {_KIND_SQL} AS kind FROM stats)"

QUERIES["segment_stats"] = lambda spark, d: rounded(stats(spark, d), ["id", "broken", "tau", "post_len", "n", "bin", "kind"], _STATS)
ORACLE["segment_stats"] = _KINDED + " " + rounded_sql(["id", "broken", "tau", "post_len", "n", "bin", "kind"], _STATS, "kinded")

QUERIES["kind_by_bin_crosstab"] = lambda spark, d: relational.crosstab(stats(spark, d), "kind", "bin", ["0-40", "40-80", "80-120", "120-160", "160-1000"])
ORACLE["kind_by_bin_crosstab"] = _KINDED + " SELECT kind, " + ", ".join(f"CAST(count(*) FILTER (bin = '{a:g}-{b:g}') AS BIGINT) AS \"{a:g}-{b:g}\"" for a, b in zip(_BINS, _BINS[1:])) + " FROM kinded GROUP BY kind"

QUERIES["kind_value_counts"] = lambda spark, d: stats(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg((F.abs("skew") > 0.1).cast("double")), 6).alias("skewed"))
ORACLE["kind_value_counts"] = _KINDED + " SELECT kind, count(*) AS n, round(avg(CASE WHEN abs(skew) > 0.1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS skewed FROM kinded GROUP BY kind"

_ROBUST_SQL = _KINDED + """,
med AS (SELECT n % 3 AS g, quantile_cont(sd, 0.5) AS med, count(*) AS c FROM kinded WHERE broken = 0 GROUP BY 1),
mad AS (SELECT n % 3 AS g, quantile_cont(abs(sd - med), 0.5) AS mad FROM kinded JOIN med ON n % 3 = g WHERE broken = 0 GROUP BY 1),
robust AS (SELECT k.*, CASE WHEN c >= 5 THEN (sd - med) / (CAST(1.4826 AS DOUBLE) * mad + CAST(1e-12 AS DOUBLE)) END AS z FROM kinded k LEFT JOIN med ON n % 3 = med.g LEFT JOIN mad ON n % 3 = mad.g)"""


def robust(spark: SparkSession, d: str) -> DataFrame:
    return relational.robust_z(stats(spark, d).withColumn("g", F.col("n") % 3), "sd", "g", F.col("broken") == 0, 5)


QUERIES["robust_z_controls"] = lambda spark, d: rounded(robust(spark, d), ["id", "broken"], ["z"])
ORACLE["robust_z_controls"] = _ROBUST_SQL + " " + rounded_sql(["id", "broken"], ["z"], "robust")

QUERIES["detectability"] = lambda spark, d: rounded(relational.detectability(robust(spark, d), ["z", "skew", "kurt"]), ["name", "broken", "n"], ["iqr", "over2", "over3", "over5"])
ORACLE["detectability"] = _ROBUST_SQL + """,
long AS (SELECT broken, 'z' AS name, z FROM robust UNION ALL SELECT broken, 'skew', skew FROM robust UNION ALL SELECT broken, 'kurt', kurt FROM robust)
SELECT name, broken, count(*) AS n, round(quantile_cont(z, 0.75) - quantile_cont(z, 0.25), 6) + 0.0 AS iqr, """ + ", ".join(f"round(avg(CASE WHEN abs(z) > {k} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS over{k}" for k in (2, 3, 5)) + " FROM long WHERE z IS NOT NULL GROUP BY name, broken"

QUERIES["top_series_by_sd"] = lambda spark, d: rounded(stats(spark, d).select("id", F.round("sd", 6).alias("sd")).orderBy(F.desc("sd"), "id").limit(10), ["id"], ["sd"])
ORACLE["top_series_by_sd"] = _KINDED + " SELECT id, round(sd, 6) + 0.0 AS sd FROM kinded ORDER BY round(sd, 6) DESC, id LIMIT 10"

_WIDE = ["mean", "sd", "skew", "kurt"]
QUERIES["winsorised_features"] = lambda spark, d: rounded(relational.winsorised(stats(spark, d).select("id", *_WIDE), _WIDE), ["id"], _WIDE)
ORACLE["winsorised_features"] = _KINDED + ", marks AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.5) AS {c}_mid, quantile_cont({c}, 0.99) AS {c}_hi" for c in _WIDE) + " FROM kinded) SELECT id, " + ", ".join(f"round(greatest({c}_lo, least({c}_hi, coalesce({c}, {c}_mid))), 6) + 0.0 AS {c}" for c in _WIDE) + " FROM kinded, marks"

QUERIES["value_histogram"] = lambda spark, d: relational.histogram(lineitem_panel(spark, d), "value", 12, "period")
ORACLE["value_histogram"] = with_sql(PANEL_SQL) + """,
edge AS (SELECT period, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM panel GROUP BY period)
SELECT p.period, CAST(least(floor((value - a) / (b - a) * 12), 11) AS BIGINT) AS bin, count(*) AS n FROM panel p JOIN edge e ON p.period = e.period WHERE value >= a AND value <= b AND b > a GROUP BY 1, 2"""

QUERIES["two_sample_ks_w1"] = lambda spark, d: rounded(relational.two_sample(lineitem_panel(spark, d)), ["id", "n0", "n1"], ["ks", "w1"])
ORACLE["two_sample_ks_w1"] = with_sql(PANEL_SQL) + """,
merged AS (SELECT id, value, sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN period = 2 THEN 1 ELSE 0 END) AS b FROM panel GROUP BY id, value),
f AS (SELECT id, sum(a) OVER w / CAST(sum(a) OVER (PARTITION BY id) AS DOUBLE) AS fa, sum(b) OVER w / CAST(sum(b) OVER (PARTITION BY id) AS DOUBLE) AS fb,
             sum(a) OVER (PARTITION BY id) AS n0, sum(b) OVER (PARTITION BY id) AS n1, lead(value) OVER (PARTITION BY id ORDER BY value) - value AS gap
      FROM merged WINDOW w AS (PARTITION BY id ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, CAST(first(n0) AS BIGINT) AS n0, CAST(first(n1) AS BIGINT) AS n1, round(max(abs(fa - fb)), 6) + 0.0 AS ks, round(sum(abs(fa - fb) * coalesce(gap, 0)), 6) + 0.0 AS w1 FROM f GROUP BY id"""

QUERIES["rank_against_history"] = lambda spark, d: rounded(relational.rank_against_history(lineitem_panel(spark, d)), ["id", "step", "below", "upto", "n"], ["u"])
ORACLE["rank_against_history"] = with_sql(PANEL_SQL) + """,
h AS (SELECT id, count(*) AS n FROM panel WHERE period = 1 GROUP BY id),
c AS (SELECT o.id, o.step, count(*) FILTER (p.value < o.value) AS below, count(*) FILTER (p.value <= o.value) AS upto
      FROM panel o JOIN panel p ON p.id = o.id AND p.period = 1 WHERE o.period = 2 GROUP BY o.id, o.step)
SELECT c.id, c.step, below, upto, n, round((CAST(0.5 AS DOUBLE) * (below + upto) + CAST(0.5 AS DOUBLE)) / (n + 1), 6) + 0.0 AS u FROM c JOIN h ON c.id = h.id"""

_RANKS = families.rank_battery()
QUERIES["rank_battery"] = lambda spark, d: output(rendered(relational.rank_against_history(lineitem_panel(spark, d)), _RANKS[0]), _RANKS[1])
ORACLE["rank_battery"] = with_sql(PANEL_SQL) + """,
h AS (SELECT id, count(*) AS n FROM panel WHERE period = 1 GROUP BY id),
c AS (SELECT o.id, o.step, count(*) FILTER (p.value < o.value) AS below FROM panel o JOIN panel p ON p.id = o.id AND p.period = 1 WHERE o.period = 2 GROUP BY o.id, o.step),
ranked AS (SELECT c.id, c.step, below, n FROM c JOIN h ON c.id = h.id), """ + sql("ranked", *_RANKS)

QUERIES["matched_controls"] = lambda spark, d: relational.matched_controls(stats(spark, d), "id", "n", "broken")
ORACLE["matched_controls"] = _KINDED + """,
dealt AS (SELECT id, broken, n // 8 AS class, row_number() OVER (PARTITION BY n // 8, broken ORDER BY (id * 2654435761 + 1) % 4294967296, id) - 1 AS num FROM kinded),
controls AS (SELECT class, id AS control, num AS at, count(*) OVER (PARTITION BY class) AS many FROM dealt WHERE broken = 0),
sizes AS (SELECT DISTINCT class, many FROM controls),
wanted AS (SELECT d.id, d.class, p.place, (d.num * 2 + p.place) % many AS at FROM dealt d JOIN sizes USING (class), (VALUES (0), (1)) p(place) WHERE broken = 1 AND p.place < least(2, many))
SELECT w.id, control, CAST(w.place AS BIGINT) AS place FROM wanted w JOIN controls c ON w.class = c.class AND w.at = c.at"""

QUERIES["score_label_join"] = lambda spark, d: rounded(scored(spark, d).select("id", "step", "score").join(lineitem_panel(spark, d).where("period = 2").select("id", "step", "target"), ["id", "step"]).groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("id").alias("series"), F.avg("score").alias("score")), ["target", "n", "series"], ["score"])
ORACLE["score_label_join"] = scored_sql() + " SELECT target, count(*) AS n, count(DISTINCT id) AS series, round(avg(score), 6) + 0.0 AS score FROM scored GROUP BY target"


# Grouped functions of a series

#: The counts of points at which scans are made, as far as the longest series goes.
CADENCE_SQL = f"cadence AS (SELECT CAST(1 AS BIGINT) AS t UNION ALL SELECT greatest(t + 1, CAST(floor(t * {dbl(retro.RATIO)}) AS BIGINT)) FROM cadence WHERE t <= (SELECT max(step) FROM online))"
#: Suppliers in a series of the panel whose series are a few thousand points long.
LONG = 8


def z_online(spark: SparkSession, d: str, suppliers: int = 1) -> DataFrame:
    panel = lineitem_panel(spark, d, suppliers=suppliers)
    return rendered(online(panel, fits.moments(panel)), families.standardised())


QUERIES["split_scan"] = lambda spark, d: rounded(retro.split_scan(z_online(spark, d), "z"), ["id", "step"], ["gap", "ratio"])
QUERIES["split_scan_long"] = lambda spark, d: rounded(retro.split_scan(z_online(spark, d, LONG), "z"), ["id", "step"], ["gap", "ratio"])
_SCAN_SQL = """,
x AS (SELECT id, step, step + 1 AS k, (value - mu) / sd0 AS z FROM online),
sums AS (SELECT id, step, k, sum(z) OVER w AS a, sum(z * z) OVER w AS b FROM x WINDOW w AS (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pairs AS (SELECT t.id, t.step, t.k AS t, s.k, s.a / s.k AS m1, (t.a - s.a) / (t.k - s.k) AS m2,
                 s.b / s.k - (s.a / s.k) * (s.a / s.k) AS u1, (t.b - s.b) / (t.k - s.k) - ((t.a - s.a) / (t.k - s.k)) * ((t.a - s.a) / (t.k - s.k)) AS u2
          FROM sums t JOIN sums s ON t.id = s.id AND s.k >= 5 AND s.k <= t.k - 5 WHERE t.k IN (SELECT t FROM cadence) AND t.k >= 10),
best AS (SELECT id, step, max(abs(m1 - m2) / sqrt(greatest(u1, CAST(1e-12 AS DOUBLE)) / k + greatest(u2, CAST(1e-12 AS DOUBLE)) / (t - k))) AS g,
                max(abs(ln(greatest(u2, CAST(1e-12 AS DOUBLE)) / greatest(u1, CAST(1e-12 AS DOUBLE))))) AS r FROM pairs GROUP BY id, step),
held AS (SELECT x.id, x.step, last_value(g IGNORE NULLS) OVER w AS g, last_value(r IGNORE NULLS) OVER w AS r FROM x LEFT JOIN best USING (id, step)
         WINDOW w AS (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT id, step, round(coalesce(g, 0), 6) + 0.0 AS gap, round(coalesce(r, 0), 6) + 0.0 AS ratio FROM held"""
ORACLE["split_scan"] = with_sql(PANEL_SQL, fits.MOMENTS_SQL, ONLINE_SQL, CADENCE_SQL) + _SCAN_SQL
ORACLE["split_scan_long"] = with_sql(long_panel_sql(LONG), fits.MOMENTS_SQL, ONLINE_SQL, CADENCE_SQL) + _SCAN_SQL

QUERIES["white_context"] = lambda spark, d: innovations.streams(lineitem_panel(spark, d)).where("step = 0").select("id", *innovations.CONTEXT)
QUERIES["white_battery"] = lambda spark, d: grouped.alone(lineitem_panel(spark, d), white_stream.battery())
QUERIES["white_odds"] = lambda spark, d: innovations.odds(innovations.streams(lineitem_panel(spark, d)))
QUERIES["white_tests"] = lambda spark, d: innovations.tests(innovations.streams(lineitem_panel(spark, d)))
QUERIES["run_lengths"] = lambda spark, d: grouped.run_lengths(lineitem_panel(spark, d))
QUERIES["spectra_short"] = lambda spark, d: grouped.spectra(lineitem_panel(spark, d))
QUERIES["spectra_long"] = lambda spark, d: grouped.spectra(lineitem_panel(spark, d), grouped.LONG_SPECTRA, 10, overlap=True)
QUERIES["novelty"] = lambda spark, d: grouped.novelty(lineitem_panel(spark, d))


def dependence_channels(spark: SparkSession, d: str) -> DataFrame:
    """CUSUMs and exponential means of lagged products of residuals, and two portmanteau sums."""
    rows = grouped.dependence(lineitem_panel(spark, d))
    sides = {f"q{k}": innovations._two_sided(f"dep{k}_cusum", f"q{k}") for k in (1, 2, 3, 5, 10)} | {f"a{k}": innovations._two_sided(f"abs{k}_cusum", f"a{k}") for k in (1, 2, 5)}
    smooth = {f"dep{k}_fast": ewma(f"q{k}", 0.02) for k in (1, 2, 3, 5, 10)} | {f"dep{k}_slow": ewma(f"q{k}", 0.005) for k in (1, 2, 3, 5, 10)} | {f"abs{k}_ewma": ewma(f"a{k}", 0.01) for k in (1, 2, 5)}
    ports = {f"p{k}": ewma(f"q{k}", 0.01) for k in range(1, 11)} | {f"r{k}": ewma(f"q{k}", 0.003) for k in range(1, 11)}
    sums = {"port_fast": "199 * (" + " + ".join(f"p{k} * p{k}" for k in range(1, 11)) + ")", "port_slow": "666 * (" + " + ".join(f"r{k} * r{k}" for k in range(1, 11)) + ")"}
    names = [next(iter(v[1])) for v in sides.values()] + list(smooth) + list(sums)
    out = rendered(rows, [{k: e for v in sides.values() for k, e in v[0].items()} | smooth | ports, {k: e for v in sides.values() for k, e in v[1].items()} | sums])
    return out.select("id", "step", *(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col(c))).alias(c) for c in names))


QUERIES["dependence_cusum"] = dependence_channels


QUERIES["series_features"] = lambda spark, d: forensics.series_features(lineitem_panel(spark, d))
QUERIES["prefix_battery"] = lambda spark, d: forensics.prefix_battery(lineitem_panel(spark, d))


_RANK_VIEW = [
    {"u": f"greatest(least({dbl(0.5)} * (below + upto) + {dbl(0.5)}, n + {dbl(0.999999999)}), {dbl(1e-9)}) / (n + 1)"},
    {"z": probit("u")},
    *families.zipped(families._cusum("z", 0.5, 0.84, "log", "cusum"), families._cusum("z", 0.05, 1.0, "sqrt", "page_hinkley"), families._variance_ratio("z")),
]
_RANK_NAMES = [f"z_{n}{s}" for n in ("cusum", "page_hinkley", "variance_ratio") for s in ("", "_now")]
#: The three detectors on normal scores of midranks.
QUERIES["rank_view"] = lambda spark, d: output(rendered(relational.rank_against_history(lineitem_panel(spark, d)).select("id", "step", "below", "upto", "n"), _RANK_VIEW), _RANK_NAMES)
ORACLE["rank_view"] = with_sql(PANEL_SQL) + """,
h AS (SELECT id, count(*) AS n FROM panel WHERE period = 1 GROUP BY id),
c AS (SELECT o.id, o.step, count(*) FILTER (p.value < o.value) AS below, count(*) FILTER (p.value <= o.value) AS upto FROM panel o JOIN panel p ON p.id = o.id AND p.period = 1 WHERE o.period = 2 GROUP BY o.id, o.step),
ranked AS (SELECT c.id, c.step, below, upto, n FROM c JOIN h ON c.id = h.id), """ + sql("ranked", _RANK_VIEW, _RANK_NAMES)

_DIV = forensics.divergences()
QUERIES["divergences"] = lambda spark, d: output(forensics.divergence_rows(lineitem_panel(spark, d)), _DIV[1])
ORACLE["divergences"] = with_sql(PANEL_SQL, forensics.BIN_REFERENCE_SQL, ONLINE_SQL) + ", " + sql("online", *_DIV)


# Files

QUERIES["panel_csv_roundtrip"] = lambda spark, d: rounded(files.through(lineitem_panel(spark, d), "csv"), ["id", "time", "period"], ["value"])
ORACLE["panel_csv_roundtrip"] = with_sql(PANEL_SQL) + " SELECT id, CAST(time AS INTEGER) AS time, period, round(value, 6) + 0.0 AS value FROM panel"


# Augmentation

QUERIES["boundary_cuts"] = lambda spark, d: rounded(augment.boundary_cuts(lineitem_panel(spark, d)).where("period = 2"), ["id", "time", "step", "target"], ["value"])
ORACLE["boundary_cuts"] = with_sql(PANEL_SQL) + """,
meta AS (SELECT id, max(onl_len) AS onl_len, max(hist_len) AS hist_len, min(CASE WHEN target = 1 THEN step END) AS tau FROM panel WHERE period = 2 GROUP BY id),
lim AS (SELECT *, least(coalesce(tau, onl_len), onl_len - 20) AS lim FROM meta WHERE onl_len >= 60),
cuts AS (SELECT l.id, hist_len AS hl, j, 10 + (l.id * 31 + j * 57) % (lim - 10) AS k FROM lim l, (VALUES (0), (1), (2)) v(j) WHERE lim >= 30)
SELECT 100000 + p.id * 10 + j AS id, time, time - hl - k AS step, target, round(value, 6) + 0.0 AS value FROM panel p JOIN cuts c ON p.id = c.id WHERE time - hl - k >= 0"""

QUERIES["cut_windows"] = lambda spark, d: augment.windows(lineitem_panel(spark, d).where("period = 2")).select("id", "start", "label", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
ORACLE["cut_windows"] = with_sql(PANEL_SQL) + """,
meta AS (SELECT id, max(onl_len) AS n, min(CASE WHEN target = 1 THEN step END) AS tau FROM panel WHERE period = 2 GROUP BY id),
starts AS (SELECT id, n, tau, s * 16 AS start FROM meta, range(0, 1000) r(s) WHERE s * 16 + 128 <= n),
labelled AS (SELECT *, CASE WHEN tau IS NULL OR start + 128 <= tau THEN 0 WHEN (tau - start) / CAST(128 AS DOUBLE) BETWEEN 0.15 AND 0.85 THEN 1 END AS label FROM starts)
SELECT l.id, l.start, l.label, round(sum(p.value), 4) + 0.0 AS total FROM labelled l JOIN panel p ON p.id = l.id AND p.period = 2 AND p.step >= l.start AND p.step < l.start + 128 WHERE l.label IS NOT NULL GROUP BY 1, 2, 3"""


# Learners and blends

def member_rows(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """The monitor's channels with their labels."""
    (stages, names), fit, _ = FAMILIES["channels_monitor"]
    panel = lineitem_panel(spark, d)
    return rendered(fits.fitted(panel, fit), stages).select("id", "step", "target", *names), names


def _learned(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, names = member_rows(spark, d)
        return metrics.ts_auc_by(learn.cross_validated(table(rows), names, kind), "fold")

    return run


QUERIES["learn_logistic_cv"] = _learned("logistic")
QUERIES["learn_trees_cv"] = _learned("trees")


def blend(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = member_rows(spark, d)
    final = learn.gated_blend(F.col("raw_cusum"), F.col("raw_page_hinkley"), F.col("raw_variance_ratio"), F.col("absolute_cusum"))
    return rounded(rows.withColumn("score", final), ["id", "step"], ["score"], 4)


QUERIES["gated_blend"] = blend
ORACLE["gated_blend"] = with_sql(PANEL_SQL, fits.TREND_SQL, ONLINE_SQL) + ", " + sql(
    "online",
    [*families.monitor()[0], {"score": "CASE WHEN step < 100 THEN CAST(0.55 AS DOUBLE) * raw_cusum + CAST(0.25 AS DOUBLE) * raw_page_hinkley + CAST(0.20 AS DOUBLE) * raw_variance_ratio ELSE CAST(0.50 AS DOUBLE) * raw_cusum + CAST(0.25 AS DOUBLE) * raw_page_hinkley + CAST(0.25 AS DOUBLE) * absolute_cusum END"}],
    ["score"],
)


# Streaming

def stream_points(spark: SparkSession, d: str) -> DataFrame:
    panel = lineitem_panel(spark, d)
    return online(panel, fits.moments(panel)).select("id", "step", "value", "mu", "sd0")


def stream_detectors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(jobs.replay(stream_points(spark, d)), ["id", "step"], ["cusum", "cusum_now", "ewma"], 4)


QUERIES["stream_detectors"] = stream_detectors
_STREAM = [*families.standardised(), *families._cusum("z", 0.5, 0.84, "log", "c"), {"lvl": ewma("z", 0.05), "wgt": f"(1 - power({dbl(0.95)}, step + 1)) / {dbl(0.05)}"}, {"ratio": "abs(lvl) * sqrt(greatest(wgt, 1)) / 3"}, {"cusum": "z_c", "cusum_now": "z_c_now", "ewma": "1 - 2 / (exp(2 * least(ratio, 300)) + 1)"}]
ORACLE["stream_detectors"] = with_sql(PANEL_SQL, fits.MOMENTS_SQL, ONLINE_SQL) + ", " + sql("online", _STREAM, ["cusum", "cusum_now", "ewma"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
