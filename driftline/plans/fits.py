"""History fits: one row a series, from aggregates over its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.panel import online


def moments(panel: DataFrame) -> DataFrame:
    """(id, hn, mu, sd0, sd1, last_z): size, mean, population and sample deviation, and the last standardised value."""
    h = panel.where("period = 1")
    out = h.groupBy("id").agg(
        F.count("*").alias("hn"),
        F.avg("value").alias("mu"),
        (F.stddev_pop("value") + F.lit(1e-12)).alias("sd0"),
        F.greatest(F.stddev_samp("value"), F.lit(1e-8)).alias("sd1"),
        F.max_by("value", "time").alias("last_value"),
    )
    return out.withColumn("last_z", (F.col("last_value") - F.col("mu")) / F.col("sd0")).drop("last_value")


MOMENTS_SQL = """
fits AS (
  SELECT id, count(*) AS hn, avg(value) AS mu, stddev_pop(value) + CAST(1e-12 AS DOUBLE) AS sd0,
         greatest(stddev_samp(value), CAST(1e-8 AS DOUBLE)) AS sd1,
         (max_by(value, time) - avg(value)) / (stddev_pop(value) + CAST(1e-12 AS DOUBLE)) AS last_z
  FROM panel WHERE period = 1 GROUP BY id)
"""


_TREND = ("hn", "level", "sd", "slope", "rho", "kurt", "infl", "winsor", "white", "prev0")


def trended(panel: DataFrame) -> DataFrame:
    """panel's rows, each with its series' trend(): windows over the series, so that rows stand by series and step, as a family's windows
    want them, with one exchange and without a join. Series without a history are left out."""
    whole, by = Window.partitionBy("id"), Window.partitionBy("id").orderBy("step")
    then = lambda c: F.when(F.col("period") == 1, F.col(c))
    rows = panel.withColumns({
        "hn": F.count(then("value")).over(whole), "mv": F.avg(then("value")).over(whole), "mt": F.avg(then("time")).over(whole),
        "slope": F.coalesce(F.regr_slope(then("value"), then("time")).over(whole), F.lit(0.0)), "lastv": F.max_by("value", then("time")).over(whole),
    })
    rows = rows.where("hn > 0").withColumn("e", then("value") - F.col("mv") - F.col("slope") * (F.col("time") - F.col("mt")))
    rows = rows.withColumn("e1", F.lag("e").over(by)).withColumns({
        "ee": F.sum(F.col("e") * F.col("e")).over(whole), "ee1": F.sum(F.col("e") * F.col("e1")).over(whole), "m4": F.avg(F.pow("e", F.lit(4.0))).over(whole),
    })
    rows = rows.withColumns({
        "sd": F.greatest(F.sqrt(F.col("ee") / F.nullif(F.col("hn") - 1, F.lit(0))), F.lit(1e-9)),
        "rho": F.coalesce(F.col("ee1") / F.nullif("ee", F.lit(0.0)), F.lit(0.0)),
    })
    few, some = F.col("hn") < 16, F.col("hn") > 32
    out = rows.select(
        *panel.columns, "hn",
        F.when(few, 0.0).otherwise(F.col("mv") + F.col("slope") * (F.col("hn") - 1 - F.col("mt"))).alias("level"),
        F.when(few, 1.0).otherwise(F.col("sd")).alias("sd"),
        F.when(few, 0.0).otherwise(F.col("slope")).alias("slope"),
        F.when(some, F.greatest(F.lit(-0.95), F.least(F.lit(0.95), "rho"))).otherwise(0.0).alias("rho"),
        F.when(some, F.greatest(F.lit(-2.0), F.least(F.lit(50.0), F.col("m4") / F.pow("sd", F.lit(4.0)) - 3))).otherwise(0.0).alias("kurt"),
        "lastv",
    )
    return out.select(
        "*",
        F.sqrt(F.greatest((1 + F.col("rho")) / (1 - F.col("rho")), F.lit(1e-6))).alias("infl"),
        F.greatest(F.lit(4.0), F.least(F.lit(8.0), 4 + 0.5 * F.sqrt(F.greatest("kurt", F.lit(0.0))))).alias("winsor"),
        F.sqrt(F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-6))).alias("white"),
        ((F.col("lastv") - F.col("level")) / F.col("sd")).alias("prev0"),
    ).drop("lastv")


def trend(panel: DataFrame) -> DataFrame:
    """(id, hn, level, sd, slope, rho, kurt, infl, winsor, white, prev0): the detrended normalisation of a series.

    level is the trend's value at the last history point. Histories of fewer
    than 16 points are taken as they are; rho and kurt need more than 32. prev0
    is the last history value, standardised and not clipped.
    """
    rows = trended(panel.where("period = 1").select("id", "time", "step", "value", "period"))
    return rows.groupBy("id").agg(*(F.first(c).alias(c) for c in _TREND))


def fitted(panel: DataFrame, fit) -> DataFrame:
    """The online rows, each with its series' values of a fit: trend by windows, any other joined."""
    return trended(panel).where("period = 2") if fit is trend else online(panel, fit(panel))


TREND_SQL = """
line AS (
  SELECT id, count(*) AS hn, avg(value) AS mv, avg(time) AS mt, coalesce(regr_slope(value, time), 0) AS slope, max_by(value, time) AS lastv
  FROM panel WHERE period = 1 GROUP BY id),
rest AS (SELECT p.id, p.time, hn, mv, mt, slope, lastv, value - mv - slope * (time - mt) AS e FROM panel p JOIN line USING (id) WHERE period = 1),
lagged AS (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY time) AS e1 FROM rest),
stats AS (
  SELECT id, first(hn) AS hn, first(mv) AS mv, first(mt) AS mt, first(slope) AS slope, first(lastv) AS lastv,
         greatest(sqrt(sum(e * e) / (count(*) - 1)), CAST(1e-9 AS DOUBLE)) AS sd, sum(e * e1) / sum(e * e) AS rho, avg(e * e * e * e) AS m4
  FROM lagged GROUP BY id),
shaped AS (
  SELECT id, hn, CASE WHEN hn < 16 THEN 0 ELSE mv + slope * (hn - 1 - mt) END AS level, CASE WHEN hn < 16 THEN 1 ELSE sd END AS sd,
         CASE WHEN hn < 16 THEN 0 ELSE slope END AS slope, CASE WHEN hn > 32 THEN greatest(-0.95, least(0.95, rho)) ELSE 0 END AS rho,
         CASE WHEN hn > 32 THEN greatest(-2.0, least(50.0, m4 / (sd * sd * sd * sd) - 3)) ELSE 0 END AS kurt, lastv
  FROM stats),
fits AS (
  SELECT id, hn, level, sd, slope, CAST(rho AS DOUBLE) AS rho, CAST(kurt AS DOUBLE) AS kurt, sqrt(greatest((1 + rho) / (1 - rho), CAST(1e-6 AS DOUBLE))) AS infl,
         greatest(4.0, least(8.0, 4 + 0.5 * sqrt(greatest(kurt, 0)))) AS winsor, sqrt(greatest(1 - rho * rho, CAST(1e-6 AS DOUBLE))) AS white,
         (lastv - level) / sd AS prev0
  FROM shaped)
"""


def mass_reference(panel: DataFrame, shapes: bool = False) -> DataFrame:
    """moments with each representation's history mean and variance (h1_*, h2_*), with shapes its skewness and kurtosis too (h3_*, h4_*),
    and three quantiles of |z| (q1..q3)."""
    m = moments(panel)
    h = panel.where("period = 1").select("id", "time", "value").join(m, "id").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd0"))
    h = h.withColumn("dz", F.col("z") - F.coalesce(F.lag("z").over(Window.partitionBy("id").orderBy("time")), "z"))
    reps = {"z": F.col("z"), "a": F.abs("z"), "q": F.col("z") * F.col("z"), "d": F.col("dz"), "s": F.signum("z")}
    aggs = [x for k, e in reps.items() for x in (F.avg(e).alias(f"h1_{k}"), (F.var_pop(e) + F.lit(1e-9)).alias(f"h2_{k}"))]
    quantiles = [F.percentile(F.abs("z"), F.lit(p)).alias(f"q{i}") for i, p in ((1, 0.75), (2, 0.95), (3, 0.99))]
    out = h.groupBy("id").agg(*(F.first(c).alias(c) for c in ("hn", "mu", "sd0", "last_z")), *aggs, *quantiles)
    if not shapes:
        return out.select("*", F.lit(0.0).alias("h1_c"), F.lit(1e-9).alias("h2_c"))
    off = {k: e - F.col(f"h1_{k}") for k, e in reps.items()}
    sd = {k: F.sqrt(F.greatest(F.col(f"h2_{k}") - 1e-9, F.lit(0.0))) + 1e-9 for k in reps}
    shape = [F.avg(F.pow(off[k] / sd[k], F.lit(float(n)))).alias(f"h{n}_{k}") for k in reps for n in (3, 4)]
    higher = h.select("id", "z", "dz").join(out, "id").groupBy("id").agg(*shape)
    zero = {"h1_c": 0.0, "h2_c": 1e-9, "h3_c": 0.0, "h4_c": 0.0}
    return out.join(higher, "id").select("*", *(F.lit(v).alias(c) for c, v in zero.items()))


_Z_SQL = MOMENTS_SQL.replace("fits AS", "mom AS", 1) + """,
hz AS (SELECT p.id, p.time, hn, mu, sd0, last_z, (value - mu) / sd0 AS z FROM panel p JOIN mom USING (id) WHERE period = 1)
"""

_REPS_SQL = {"z": "z", "a": "abs(z)", "q": "z * z", "d": "dz", "s": "sign(z)"}
_SHAPES_SQL = ", ".join(f"avg(power(({e} - h1_{k}) / (sqrt(greatest(h2_{k} - CAST(1e-9 AS DOUBLE), 0)) + CAST(1e-9 AS DOUBLE)), {n})) AS h{n}_{k}" for k, e in _REPS_SQL.items() for n in (3, 4))
MASS_REFERENCE_SQL = _Z_SQL + """,
hd AS (SELECT *, z - coalesce(lag(z) OVER (PARTITION BY id ORDER BY time), z) AS dz FROM hz),
firsts AS (
  SELECT id, first(hn) AS hn, first(mu) AS mu, first(sd0) AS sd0, first(last_z) AS last_z,
         avg(z) AS h1_z, var_pop(z) + CAST(1e-9 AS DOUBLE) AS h2_z, avg(abs(z)) AS h1_a, var_pop(abs(z)) + CAST(1e-9 AS DOUBLE) AS h2_a,
         avg(z * z) AS h1_q, var_pop(z * z) + CAST(1e-9 AS DOUBLE) AS h2_q, avg(dz) AS h1_d, var_pop(dz) + CAST(1e-9 AS DOUBLE) AS h2_d,
         avg(sign(z)) AS h1_s, var_pop(sign(z)) + CAST(1e-9 AS DOUBLE) AS h2_s, CAST(0 AS DOUBLE) AS h1_c, CAST(1e-9 AS DOUBLE) AS h2_c,
         quantile_cont(abs(z), 0.75) AS q1, quantile_cont(abs(z), 0.95) AS q2, quantile_cont(abs(z), 0.99) AS q3
  FROM hd GROUP BY id),
""" + f"""
shapes AS (SELECT d.id, {_SHAPES_SQL}, CAST(0 AS DOUBLE) AS h3_c, CAST(0 AS DOUBLE) AS h4_c FROM hd d JOIN (SELECT * EXCLUDE (hn, mu, sd0, last_z) FROM firsts) f ON d.id = f.id GROUP BY d.id),
fits AS (SELECT firsts.*, shapes.* EXCLUDE (id) FROM firsts JOIN shapes USING (id))
"""


def acf_reference(panel: DataFrame, lags: tuple[int, ...] = (1, 2, 5, 10)) -> DataFrame:
    """moments with the history's autocorrelations (hacf_k as hacf{k}) and its last values, standardised (tail_1 is the last)."""
    m = moments(panel)
    by = Window.partitionBy("id").orderBy("time")
    h = panel.where("period = 1").select("id", "time", "value").join(m, "id").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd0"))
    h = h.select("*", *(F.lag("z", k).over(by).alias(f"z{k}") for k in lags))
    tails = [F.max(F.when(F.col("hn") - F.col("time") == j, F.col("z"))).alias(f"tail_{j}") for j in range(1, max(lags) + 1)]
    return h.groupBy("id").agg(*(F.first(c).alias(c) for c in ("hn", "mu", "sd0", "last_z")), *(F.corr("z", f"z{k}").alias(f"hacf{k}") for k in lags), *tails)


def acf_reference_sql(lags: tuple[int, ...] = (1, 2, 5, 10)) -> str:
    lagged = ", ".join(f"lag(z, {k}) OVER (PARTITION BY id ORDER BY time) AS z{k}" for k in lags)
    made = ", ".join([*(f"corr(z, z{k}) AS hacf{k}" for k in lags), *(f"max(CASE WHEN hn - time = {j} THEN z END) AS tail_{j}" for j in range(1, max(lags) + 1))])
    return _Z_SQL + f""",
hl AS (SELECT *, {lagged} FROM hz),
fits AS (SELECT id, first(hn) AS hn, first(mu) AS mu, first(sd0) AS sd0, first(last_z) AS last_z, {made} FROM hl GROUP BY id)
"""


ACF_REFERENCE_SQL = acf_reference_sql()


#: Windows whose expected largest |z| the history gives.
BLOCKS = (25, 50, 100, 250, 500)


def _block_of(w: int):
    return lambda b: F.struct(F.lit(w).alias("w"), b.alias("b"))


def _block_maxima(h: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(id, tmax{w}): the median, over half-overlapping blocks of w history points, of their largest |z|.

    A point goes to the two or three blocks that hold it; no pair of points meets.
    """
    starts = []
    for w in windows:
        s = max(w // 2, 1)
        first, last = F.greatest(F.ceil((F.col("time") - w + 1) / s), F.lit(0)), F.least(F.floor(F.col("time") / s), F.floor((F.greatest(F.col("hn") - w, F.lit(1)) - 1) / s))
        starts.append(F.when(first <= last, F.transform(F.sequence(first.cast("long"), last.cast("long")), _block_of(w))).otherwise(F.array().cast("array<struct<w:int,b:bigint>>")))
    each = h.select("id", F.abs("z").alias("az"), F.explode(F.concat(*starts)).alias("s"))
    tops = each.groupBy("id", "s.w", "s.b").agg(F.max("az").alias("top"))
    return tops.groupBy("id").agg(*(F.percentile(F.when(F.col("w") == w, F.col("top")), F.lit(0.5)).alias(f"tmax{w}") for w in windows))


_BLOCK_SQL = " UNION ALL ".join(
    f"SELECT id, {w} AS w, b, max(abs(z)) AS top FROM hz, (SELECT unnest(range(0, 2000)) AS b) WHERE b * {max(w // 2, 1)} < greatest(hn - {w}, 1) AND time >= b * {max(w // 2, 1)} AND time < b * {max(w // 2, 1)} + {w} GROUP BY 1, 2, 3" for w in BLOCKS
)


def tail_reference(panel: DataFrame) -> DataFrame:
    """moments with tail quantiles of |z| and z, the mean excess over the 90 % quantile, and the expected maxima of windows."""
    m = moments(panel)
    h = panel.where("period = 1").select("id", "time", "value").join(m, "id").withColumn("z", (F.col("value") - F.col("mu")) / F.col("sd0"))
    q = h.groupBy("id").agg(
        *(F.percentile(F.abs("z"), F.lit(p)).alias(n) for n, p in (("t90", 0.9), ("t975", 0.975), ("t995", 0.995))),
        *(F.percentile("z", F.lit(p)).alias(n) for n, p in (("thi", 0.975), ("tlo", 0.025))),
    )
    over = h.join(q, "id").groupBy("id").agg(F.coalesce(F.avg(F.when(F.abs("z") > F.col("t90"), F.abs("z") - F.col("t90"))), F.lit(1.0)).alias("texc"))
    return m.join(q, "id").join(over, "id").join(_block_maxima(h, BLOCKS), "id")


TAIL_REFERENCE_SQL = _Z_SQL + """,
qs AS (SELECT id, quantile_cont(abs(z), 0.9) AS t90, quantile_cont(abs(z), 0.975) AS t975, quantile_cont(abs(z), 0.995) AS t995,
              quantile_cont(z, 0.975) AS thi, quantile_cont(z, 0.025) AS tlo FROM hz GROUP BY id),
xs AS (SELECT id, coalesce(avg(CASE WHEN abs(z) > t90 THEN abs(z) - t90 END), 1) AS texc FROM hz JOIN qs USING (id) GROUP BY id),
""" + f"""
tops AS ({_BLOCK_SQL}),
ms AS (SELECT id, {", ".join(f"quantile_cont(CASE WHEN w = {w} THEN top END, 0.5) AS tmax{w}" for w in BLOCKS)} FROM tops GROUP BY id),
fits AS (SELECT * FROM mom JOIN qs USING (id) JOIN xs USING (id) JOIN ms USING (id))
"""
