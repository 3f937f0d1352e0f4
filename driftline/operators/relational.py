"""Relational verbs on tables with one row a series: cross-tables, bins, robust z, detectability, labels, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.plans.scans import running


def segment_stats(panel: DataFrame) -> DataFrame:
    """(id, broken, tau, post_len, n, mean, sd, skew, kurt, ac1, q05, q50, q95) of each series' online part."""
    by = Window.partitionBy("id").orderBy("step")
    o = panel.where("period = 2").withColumn("prev", F.lag("value").over(by))
    g = o.groupBy("id").agg(
        F.max("target").alias("broken"), F.min(F.when(F.col("target") == 1, F.col("step"))).alias("tau"),
        F.sum("target").alias("post_len"), F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"),
        F.skewness("value").alias("skew"), F.kurtosis("value").alias("kurt"), F.corr("value", "prev").alias("ac1"),
        *(F.percentile("value", F.lit(p)).alias(n) for n, p in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))),
    )
    return g


def cut(value: Column, edges: list[float], labels: list[str] | None = None) -> Column:
    """Bins closed on the left; null outside of all."""
    out = F.lit(None).cast("string")
    for k in reversed(range(len(edges) - 1)):
        inside = (value >= edges[k]) & (value < edges[k + 1])
        out = F.when(inside, F.lit(labels[k] if labels else f"{edges[k]:g}-{edges[k + 1]:g}")).otherwise(out)
    return out


def crosstab(rows: DataFrame, a: str, b: str, values: list) -> DataFrame:
    """Counts of a by b, one column a value of b; a missing cell is 0. Values are given, so no pass is spent on finding them."""
    return rows.groupBy(a).pivot(b, values).count().na.fill(0)


def robust_z(rows: DataFrame, value: str, bin: str, control: Column, least: int = 1) -> DataFrame:
    """rows with z: the value against the median and 1.4826 MAD of the control rows of its bin; bins with fewer than least controls give null."""
    c = rows.where(control).groupBy(bin).agg(F.percentile(value, F.lit(0.5)).alias("med"), F.count("*").alias("controls"))
    off = rows.where(control).join(c, bin).groupBy(bin).agg(F.percentile(F.abs(F.col(value) - F.col("med")), F.lit(0.5)).alias("mad"))
    fitted = c.where(F.col("controls") >= least).join(off, bin)
    z = (F.col(value) - F.col("med")) / (F.lit(1.4826) * F.col("mad") + F.lit(1e-12))
    return rows.join(fitted, bin, "left").withColumn("z", z).drop("med", "mad", "controls")


def detectability(rows: DataFrame, names: list[str], broken: str = "broken") -> DataFrame:
    """(name, broken, n, iqr, over2, over3, over5) for each z column: quartile range and shares of large values, broken rows and others."""
    pairs = ", ".join(f"'{c}', {c}" for c in names)
    long = rows.selectExpr(broken, f"stack({len(names)}, {pairs}) AS (name, z)").where("z IS NOT NULL")
    share = lambda k: F.avg((F.abs("z") > k).cast("double"))
    return long.groupBy("name", broken).agg(F.count("*").alias("n"), (F.percentile("z", F.lit(0.75)) - F.percentile("z", F.lit(0.25))).alias("iqr"), *(share(k).alias(f"over{k}") for k in (2, 3, 5)))


def kind(flags: dict[str, Column], none: str = "none") -> Column:
    """The letters of all flags that hold, put together."""
    joined = F.concat(*(F.when(c, F.lit(k)).otherwise(F.lit("")) for k, c in flags.items()))
    return F.when(joined == "", F.lit(none)).otherwise(joined)


def winsorised(rows: DataFrame, names: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Infinite values as missing, missing ones by the median, all clipped at two quantiles of their column."""
    finite = rows.select(*(c for c in rows.columns if c not in names), *(F.when(F.abs(F.col(c)) < float("inf"), F.col(c)).alias(c) for c in names))
    marks = finite.agg(*(F.percentile(c, F.lit(p)).alias(f"{c}_{k}") for c in names for k, p in (("lo", lo), ("mid", 0.5), ("hi", hi))))
    filled = finite.crossJoin(F.broadcast(marks))  # one row
    return filled.select(*(c for c in finite.columns if c not in names), *(F.greatest(F.col(f"{c}_lo"), F.least(F.col(f"{c}_hi"), F.coalesce(c, f"{c}_mid"))).alias(c) for c in names))


def histogram(rows: DataFrame, value: str, bins: int, by: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """(by, bin, n): equal bins between two quantiles of each group; what lies outside is left out."""
    edge = rows.groupBy(by).agg(F.percentile(value, F.lit(lo)).alias("a"), F.percentile(value, F.lit(hi)).alias("b"))
    inside = rows.join(edge, by).where((F.col(value) >= F.col("a")) & (F.col(value) <= F.col("b")) & (F.col("b") > F.col("a")))
    at = F.least(F.floor((F.col(value) - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1))
    return inside.groupBy(by, at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def two_sample(panel: DataFrame) -> DataFrame:
    """(id, n0, n1, ks, w1): Kolmogorov-Smirnov and Wasserstein distances between history and online values.

    Both come from running counts over the merged values; no pair of rows meets.
    """
    at = panel.groupBy("id", "value").agg(F.sum((F.col("period") == 1).cast("long")).alias("a"), F.sum((F.col("period") == 2).cast("long")).alias("b"))
    by = Window.partitionBy("id").orderBy("value")
    upto, whole = by.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("id")
    f = at.select("id", "value", (F.sum("a").over(upto) / F.sum("a").over(whole)).alias("fa"), (F.sum("b").over(upto) / F.sum("b").over(whole)).alias("fb"), F.sum("a").over(whole).alias("n0"), F.sum("b").over(whole).alias("n1"), (F.lead("value").over(by) - F.col("value")).alias("gap"))
    gap = F.abs(F.col("fa") - F.col("fb"))
    return f.where("n0 > 0 and n1 > 0").groupBy("id").agg(F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.max(gap).alias("ks"), F.sum(gap * F.coalesce("gap", F.lit(0.0))).alias("w1"))


def rank_against_history(panel: DataFrame) -> DataFrame:
    """(id, step, below, upto, n, u): each online value's place among its history's, and its midrank share.

    History and online rows are merged and counted in order of value, so the
    inequality join is one window.
    """
    h = (F.col("period") == 1).cast("long")
    by = Window.partitionBy("id").orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("id", "value")
    n = F.sum(h).over(Window.partitionBy("id"))
    ranked = panel.select("id", "step", "period", F.sum(h).over(by).alias("upto"), F.sum(h).over(same).alias("same"), n.alias("n")).where("period = 2")
    below = F.col("upto") - F.col("same")
    return ranked.select("id", "step", below.alias("below"), "upto", "n", ((0.5 * (below + F.col("upto")) + 0.5) / (F.col("n") + 1)).alias("u"))


def matched_controls(rows: DataFrame, key: str, size: str, broken: str, per: int = 2, width: int = 8, seed: int = 1) -> DataFrame:
    """(key, control, place): to each broken row, per others of its size class, in a seeded order of their own.

    Both sides are numbered within their class and meet on the number, so no row
    is joined with a whole class.
    """
    classed = rows.withColumn("class", F.floor(F.col(size) / width)).withColumn("o", (F.col(key) * 2654435761 + seed) % 4294967296)
    num = F.row_number().over(Window.partitionBy("class", broken).orderBy("o", key)) - 1
    classed = classed.withColumn("num", num)
    controls = classed.where(F.col(broken) == 0).select("class", F.col(key).alias("control"), F.col("num").alias("at"), F.count("*").over(Window.partitionBy("class")).alias("many"))
    sizes = controls.groupBy("class").agg(F.first("many").alias("many"))
    wanted = classed.where(F.col(broken) == 1).join(sizes, "class").withColumn("place", F.explode(F.sequence(F.lit(0), F.least(F.lit(per), F.col("many")).cast("int") - 1)))
    wanted = wanted.withColumn("at", (F.col("num") * per + F.col("place")) % F.col("many"))
    return wanted.join(controls.drop("many"), ["class", "at"]).select(key, "control", F.col("place").cast("long").alias("place"))


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row a key, the first in an order; a maximum over partial results, no window over a key."""
    rest = [c for c in rows.columns if c != key and c not in order]
    kept = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return kept.select(key, *(F.col(f"r.{c}").alias(c) for c in rows.columns if c != key))


def reindexed(rows: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """rows by the keys of an index: keys that rows lack give nulls, others are left out."""
    return index.select(key).join(rows, key, "left")


def suffixed_join(tables: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """Feature tables joined on their key; a column that an earlier table has gets the later table's suffix."""
    out = None
    for suffix, df in tables:
        if out is None:
            out = df
            continue
        renamed = df.select(key, *(F.col(c).alias(c + suffix if c in out.columns else c) for c in df.columns if c != key))
        out = out.join(renamed, key)
    return out


def least_of(columns: list[str]) -> tuple[Column, Column]:
    """The name of the column with the least value, the first name of equals, and how far the next value is."""
    ranked = F.array_sort(F.array(*(F.struct(F.col(c).cast("double").alias("v"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(columns))))
    return ranked[0]["c"], ranked[1]["v"] - ranked[0]["v"]


def replaced(text: Column, pattern: str, empty: str) -> Column:
    """A text without what matches a pattern; what is left empty has a name."""
    left = F.regexp_replace(text, pattern, "")
    return F.when(left == "", F.lit(empty)).otherwise(left)


def fixed_histogram(rows: DataFrame, value: str, bins: int, lo: float, hi: float) -> DataFrame:
    """(bin, n) of all equal bins between two bounds, the last closed on both sides; what lies outside is left out."""
    inside = rows.where((F.col(value) >= lo) & (F.col(value) <= hi))
    at = F.least(F.floor((F.col(value) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0, ["n"])


def described(rows: DataFrame, names: list[str]) -> DataFrame:
    """(name, n, mean, sd, least, q25, q50, q75, largest) of each column."""
    long = rows.selectExpr(f"stack({len(names)}, {', '.join(f'{c!r}, CAST({c} AS DOUBLE)' for c in names)}) AS (name, x)").where("x IS NOT NULL")
    return long.groupBy("name").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.min("x").alias("least"),
        *(F.percentile("x", F.lit(p)).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))), F.max("x").alias("largest"),
    )


#: Terms of the series of the Kolmogorov distribution.
KS_TERMS = 100


def two_sample_tests(rows: DataFrame, value: str, group: Column, by: str) -> DataFrame:
    """(by, n0, n1, ks, ks_p, u, mw_p): Kolmogorov-Smirnov and Mann-Whitney tests of the rows where group is 1 against the others.

    Both come from counts of merged values; p-values by the limit distributions
    (Mann-Whitney with corrections for ties and continuity).
    """
    at = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("x")).agg(F.sum((group == 1).cast("long")).alias("b"), F.sum((group == 0).cast("long")).alias("a"))
    upto, whole = Window.partitionBy(by).orderBy("x").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(by)
    f = at.select(by, "a", "b", F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb"), F.sum("a").over(whole).alias("n0"), F.sum("b").over(whole).alias("n1")).where("n0 > 0 and n1 > 0")
    ties = (F.col("a") + F.col("b")).cast("double")
    got = f.groupBy(by).agg(
        F.first("n0").alias("n0"), F.first("n1").alias("n1"), F.max(F.abs(F.col("ca") / F.col("n0") - F.col("cb") / F.col("n1"))).alias("ks"),
        F.sum(F.col("b") * (F.col("ca") - F.col("a") + F.col("a") / 2.0)).alias("u"), F.sum(ties * ties * ties - ties).alias("ties"),
    )
    a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
    root = F.sqrt(a * b / (a + b)) * F.col("ks")
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * root * root))
    ks_p = F.when(root < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms)))
    sd = F.sqrt(a * b / 12 * (a + b + 1 - F.col("ties") / ((a + b) * (a + b - 1))))
    z = F.greatest(F.abs(F.col("u") - a * b / 2) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    return got.select(by, "n0", "n1", "ks", ks_p.alias("ks_p"), "u", F.coalesce(normal_tails(z), F.lit(1.0)).alias("mw_p"))


def normal_tails(z: Column) -> Column:
    """The share of a normal distribution farther out than z on both sides, z not negative; a rational approximation (1.2e-7 relative)."""
    #: Coefficients of the approximation of the complementary error function.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    x = z / (2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    body = F.lit(c[-1])
    for k in reversed(c[:-1]):
        body = body * t + k
    return t * F.exp(-x * x + body)


def won_by_kind(scored: DataFrame, kinds: DataFrame, least: int = 20) -> DataFrame:
    """(kind, series, auc): how often series of a kind score above clean ones at the same steps after their break, a mean over series.

    scored: (id, step, target, score); kinds: (id, kind). Clean series are those
    never broken. Running totals over ranges of (step, score) give the counts; steps with fewer
    than least clean series do not count.
    """
    broken = F.max("target").over(Window.partitionBy("id"))
    s = scored.withColumn("clean", (broken == 0).cast("long"))
    each = s.groupBy("step", "score").agg(F.sum("clean").alias("same"))
    places = running(each, ["step"], [F.asc_nulls_first("score")], {"lower": F.col("same")}).join(each.groupBy("step").agg(F.sum("same").alias("n")).where(F.col("n") >= least), "step")
    places = places.withColumnsRenamed({"step": "at", "score": "of"})
    met = s.where("target = 1").join(places, F.col("step").eqNullSafe(F.col("at")) & F.col("score").eqNullSafe(F.col("of")))
    won = met.groupBy("id").agg((F.sum(F.col("lower") + F.col("same") / 2.0) / F.sum("n")).alias("auc"))
    return won.join(kinds, "id").groupBy("kind").agg(F.count("*").alias("series"), F.avg("auc").alias("auc"))


def mixture(rows: DataFrame, value: str, group: str, by: str, cells: int = 400, widths: int = 24, shares: int = 21) -> DataFrame:
    """(by, share, width, gain): how large a share of the rows with group 1 is the others' distribution, widened, by most likelihood.

    The others are counted in cells between their outermost values, so that what
    a group's task holds is bounded (cells, and a count a cell for each side),
    however many rows there are. Densities are sums of normal kernels.
    """
    import numpy as np
    import pandas as pd

    known = rows.where(F.col(value).isNotNull())
    ends = known.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    cell = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * cells), F.lit(cells - 1))
    counts = known.join(ends, by).groupBy(by, "lo", "hi", F.coalesce(cell, F.lit(0)).cast("int").alias("cell")).agg(F.sum((F.col(group) == 1).cast("double")).alias("b"), F.sum((F.col(group) == 0).cast("double")).alias("c"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        x = lo + (pdf["cell"].to_numpy() + 0.5) * (hi - lo) / cells
        b, c = pdf["b"].to_numpy(), pdf["c"].to_numpy()
        best = (0.0, 0.0, 0.0)
        if c.sum() > 0 and b.sum() > 0 and hi > lo:
            mean = (x * c).sum() / c.sum()
            sd = np.sqrt((np.square(x - mean) * c).sum() / c.sum()) + 1e-9
            gap = np.square(x[:, None] - x[None])
            density = lambda s: (np.exp(-gap / (2 * s * s)) @ c) / (c.sum() * s * np.sqrt(2 * np.pi))
            own = density(0.53 * sd * c.sum() ** -0.2 + 1e-6)
            plain = b @ np.log(own + 1e-300)
            for s in sd * np.geomspace(0.1, 3, widths):
                wide = density(s)
                for share in np.linspace(0, 1, shares):
                    gain = float(b @ np.log((1 - share) * own + share * wide + 1e-300) - plain)
                    if gain > best[2]:
                        best = (float(share), float(s), gain)
        return pd.DataFrame([[pdf[by].iloc[0], *best]], columns=[by, "share", "width", "gain"])

    kind = rows.schema[by].dataType.simpleString()
    return counts.groupBy(by).applyInPandas(one, f"{by} {kind}, share double, width double, gain double")
