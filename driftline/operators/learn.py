"""Learners over channels, and blends of their scores."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators import metrics
from driftline.session import durable, ship, table


def logit(score: Column, least: float = 1e-6) -> Column:
    q = F.greatest(F.lit(least), F.least(F.lit(1 - least), score))
    return F.ln(q / (1 - q))


def folds(rows: DataFrame, n: int = 5) -> DataFrame:
    """rows with fold: all rows of a series in one, series spread by a hash."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(n)).cast("int"))


def by_step(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with aggregates of their step. The steps, no more than the longest series has, are a small table that meets the rows where they lie."""
    return rows.join(F.broadcast(table(rows.groupBy("step").agg(*(e.alias(n) for n, e in made.items())))), "step")


def assembled(rows: DataFrame, names: list[str], logits: bool) -> DataFrame:
    """(id, step, target, w, features) of rows, which are read twice; each step weighs alike, however many series are alive then."""
    weighed = by_step(rows, w=1.0 / F.count("*"))
    shown = weighed.select("id", "step", "target", "w", *((logit(F.col(c)) if logits else F.coalesce(c, F.lit(0.0))).alias(c) for c in names))
    return VectorAssembler(inputCols=names, outputCol="features").transform(shown).select("id", "step", "target", "w", "features")


def _learner(kind: str, seed: int = 1):
    if kind == "logistic":
        return LogisticRegression(weightCol="w", maxIter=20, regParam=1e-4)
    return GBTClassifier(weightCol="w", maxIter=10, maxDepth=4, seed=seed)


def _prepared(rows: DataFrame, names: list[str], kind: str) -> DataFrame:
    """The learner's rows, made anew for every fit and score, which costs less than keeping them: rows should be a table."""
    return assembled(rows, names, kind == "logistic").withColumn("label", F.col("target").cast("double"))


def _scored(model, rows: DataFrame, *more: str) -> DataFrame:
    return model.transform(rows).select("id", "step", "target", *more, vector_to_array("probability")[1].alias("score"))


#: Bytes of training rows that models fitted side by side hold, at most, at 16 a channel: each fit keeps its own rows in memory, for many passes.
SIDE_BY_SIDE = 2 << 30


def _side_by_side(rows: int, channels: int, n: int) -> int:
    """How many of n models are fitted at a time: as many as hold their rows in SIDE_BY_SIDE, at least one."""
    return max(1, min(n, SIDE_BY_SIDE // max(1, rows * channels * 16)))


def _out_of_fold(data: DataFrame, kind: str, n: int, channels: int) -> DataFrame:
    """Each fold's scores by a model of the others. Logistic models of all folds are fitted in the same passes over the rows; others side
    by side while their passes are short, then one by one."""
    if kind == "logistic":
        rows, coefs = data.withColumn("x", vector_to_array("features")), logistic_fits(data, n, channels)
        line = lambda c: reduce(Column.__add__, (F.col("x")[j] * float(v) for j, v in enumerate(c[:-1])), F.lit(float(c[-1])))
        score = F.coalesce(*(F.when(F.col("fold") == k, 1 / (1 + F.exp(-line(c)))) for k, c in enumerate(coefs)))
        return rows.select("id", "step", "target", "fold", score.alias("score"))
    with ThreadPoolExecutor(_side_by_side(data.count(), channels, n)) as pool:
        models = list(pool.map(lambda k: _learner(kind).fit(data.where(F.col("fold") != k)), range(n)))
    parts = [_scored(m, data.where(F.col("fold") == k), "fold") for k, m in enumerate(models)]
    return reduce(DataFrame.unionByName, parts)


def _blocks(batches: Iterator[pa.RecordBatch], channels: int, rows: int = 20_000) -> Iterator[tuple[np.ndarray, ...]]:
    """Batches put together to some thousands of rows: channels with a one behind them, label, weight and fold."""
    held: list[pa.RecordBatch] = []
    for b in itertools.chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
        if held and (b is None or sum(h.num_rows for h in held) >= rows):
            whole = pa.Table.from_batches(held)
            x = np.concatenate([c.flatten().to_numpy() for c in whole["x"].chunks]).reshape(-1, channels)
            yield np.column_stack([x, np.ones(len(x))]), *(whole[c].to_numpy() for c in ("label", "w", "fold"))
            held = []


def _logistic_sums(rows: DataFrame, coefs: np.ndarray) -> np.ndarray:
    """(fold, ...): second and first derivatives of the weighted logistic loss at each fold's coefficients, the loss, the weights and their
    squares, over the rows of the other folds."""
    n, size = coefs.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, size * size + size + 3))
        for x, y, w, fold in _blocks(batches, size - 1):
            for k in range(n):
                z, t, v = x[fold != k], y[fold != k], w[fold != k]
                at = np.clip(z @ coefs[k], -500, 500)
                p = 1 / (1 + np.exp(-at))
                total[k] += np.concatenate([((z * (v * p * (1 - p))[:, None]).T @ z).ravel(), z.T @ (v * (p - t)), [v @ (np.logaddexp(0, at) - t * at), v.sum(), v @ v]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros((n, size * size + size + 3))
    for r in rows.mapInArrow(added, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out.ravel()[r["at"]] = r["v"]
    return out


def logistic_fits(data: DataFrame, n: int, channels: int, ridge: float = 1e-4, least: float = 1e-12, most: int = 100) -> np.ndarray:
    """(fold, coefficient, the constant last): the logistic model of the rows outside each fold, by Newton steps, all folds in one pass a step.

    Nothing but the rows' table is stored. The ridge is on standardised
    channels, without the constant. A step that does not lessen the loss is
    halved; a fold is ready when its next step would gain nothing (least).
    data: (features, label, w, fold), without missing values.
    """
    ship(data.sparkSession)
    rows, size = data.select(vector_to_array("features").alias("x"), "label", "w", "fold"), channels + 1
    coefs, kept, best, ready, penalty = np.zeros((n, size)), np.zeros((n, size)), np.full(n, np.inf), np.zeros(n, bool), None
    for _ in range(most):
        got = _logistic_sums(rows, coefs)
        curved, slope = got[:, : size * size].reshape(n, size, size), got[:, size * size : -3]
        loss, weight, squared = got[:, -3], got[:, -2], got[:, -1]
        if penalty is None:  # at coefficients of zero the second derivatives are a fourth of the rows' products
            some = np.maximum(weight, 1e-300)
            mean, square = 4 * curved[:, -1] / some[:, None], 4 * np.diagonal(curved, axis1=1, axis2=2) / some[:, None]
            variance = np.maximum(square - mean**2, 0.0) / np.maximum(1 - squared / some**2, 1e-300)[:, None]
            flat = variance <= 1e-12 * square
            penalty = np.where(flat, 0.0, ridge * variance)
            ones = (weight / 2 - slope[:, -1]) / some
        for k in np.flatnonzero(~ready):
            if ones[k] < 1e-12 or ones[k] > 1 - 1e-12:  # one class only, or no rows
                kept[k, -1], ready[k] = np.inf if ones[k] > 0.5 else -np.inf, True
                continue
            now = loss[k] / weight[k] + penalty[k] @ coefs[k] ** 2 / 2
            if now > best[k] * (1 + 1e-14):
                coefs[k] = (coefs[k] + kept[k]) / 2
                ready[k] = np.abs(coefs[k] - kept[k]).max() < 1e-9
                continue
            kept[k], best[k] = coefs[k], now
            free = np.append(np.flatnonzero(~flat[k, :-1]), size - 1)
            down = slope[k, free] / weight[k] + penalty[k, free] * coefs[k, free]
            step = np.linalg.lstsq(curved[k][np.ix_(free, free)] / weight[k] + np.diag(penalty[k, free]), down, rcond=1e-14)[0]
            ready[k] = step @ down < least
            coefs[k, free] = coefs[k, free] - step
        coefs[ready] = 0.0
        if ready.all():
            break
    return kept


def cross_validated(rows: DataFrame, names: list[str], kind: str = "logistic", n: int = 5) -> DataFrame:
    """(id, step, target, fold, score): scores of each fold from a model of the others.

    kind: "logistic" (on logits of the channels) or "trees" (gradient-boosted;
    it stands for boosters and step-wise rankers that Spark does not have).
    """
    return _out_of_fold(folds(_prepared(rows, names, kind), n), kind, n, len(names))


def holdout(rows: DataFrame, names: list[str], kind: str = "logistic", n: int = 5) -> DataFrame:
    """(name, ts_auc, pairs): the model of four fifths of the series on the others, and each channel by itself there."""
    data = folds(_prepared(rows, names, kind), n)
    model = _scored(_learner(kind).fit(data.where("fold > 0")), data.where("fold = 0")).withColumn("name", F.lit("model"))
    one = folds(rows, n).where("fold = 0")
    each = one.select("id", "step", "target", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in names))).alias("r")).select("id", "step", "target", "r.*")
    return metrics.ts_auc_by(model.select("id", "step", "target", "name", "score").unionByName(each), "name")


def ranker(rows: DataFrame, names: list[str], n: int = 5) -> DataFrame:
    """(id, step, target, fold, score): a linear ranker within steps.

    Channels are taken less their mean over the series alive at that step, so
    only how a series differs from the others then is learned, and a step weighs
    by its pairs of series. It stands for list-wise boosters.
    """
    means = {f"mean_{k}": F.avg(F.coalesce(c, F.lit(0.0))) for k, c in enumerate(names)}
    beside, np, all = by_step(rows, pos=F.sum("target"), all=F.count("*"), **means), F.col("pos"), F.col("all")
    x = beside.select("id", "step", "target", (np * (all - np) / (all * all)).cast("double").alias("w"), *((F.coalesce(c, F.lit(0.0)) - F.col(f"mean_{k}")).alias(c) for k, c in enumerate(names)))
    data = VectorAssembler(inputCols=names, outputCol="features").transform(x.where("w > 0")).withColumn("label", F.col("target").cast("double"))
    return _out_of_fold(folds(data.select("id", "step", "target", "label", "w", "features"), n), "logistic", n, len(names))


def rank_groups(rows: DataFrame, most: int = 8000, seed: int = 5) -> DataFrame:
    """rows with chunk: each step's rows dealt by a keyed hash to groups of about most, at most half as many again."""
    sizes = rows.groupBy("step").agg(F.ceil(F.count("*") / most).alias("chunks"))
    return rows.join(sizes, "step").withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("chunks")).cast("int")).drop("chunks")


def bagged(rows: DataFrame, names: list[str], kind: str = "trees", bags: int = 3, n: int = 5) -> DataFrame:
    """(id, step, target, score) of a fifth of the series: the mean over models of other fifths, each with a seed of its own."""
    data, out = folds(_prepared(rows, names, kind), n), None
    for k in range(1, bags + 1):
        scored = _scored(_learner(kind, k).fit(data.where((F.col("fold") > 0) & (F.col("fold") != k))), data.where("fold = 0"))
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("id", "step").agg(F.first("target").alias("target"), F.avg("score").alias("score"))


def stacked(members: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """(id, step, target, fold, score): a logistic model over the members' out-of-fold scores, itself cross-validated."""
    both = None
    for name, df in members.items():
        one = df.select("id", "step", "target", F.col("score").alias(name)) if both is None else df.select("id", "step", F.col("score").alias(name))
        both = one if both is None else both.join(one, ["id", "step"])
    return cross_validated(table(both), list(members), "logistic", n)


def specialists(rows: DataFrame, names: list[str], bounds: tuple[int, ...] = (0, 50, 150), overlap: float = 0.2, kind: str = "logistic", n: int = 5) -> DataFrame:
    """(id, step, target, score) of a fifth of the series: each range of steps by a model of its own, fitted on a somewhat wider range."""
    data, out = folds(_prepared(rows, names, kind), n), None
    for lo, hi in zip(bounds, [*bounds[1:], None]):
        wide = (F.col("step") >= lo * (1 - overlap)) & (F.lit(True) if hi is None else F.col("step") < hi * (1 + overlap))
        here = (F.col("step") >= lo) & (F.lit(True) if hi is None else F.col("step") < hi)
        scored = _scored(_learner(kind).fit(data.where(wide & (F.col("fold") > 0))), data.where(here & (F.col("fold") == 0)))
        out = scored if out is None else out.unionByName(scored)
    return out


def importances(rows: DataFrame, names: list[str], n: int = 5) -> list[tuple[str, float]]:
    """Channels by how much a boosted model of four fifths of the series uses them, most first."""
    data = folds(_prepared(rows, names, "trees"), n)
    found = _learner("trees").fit(data.where("fold > 0")).featureImportances.toArray()
    return sorted(zip(names, map(float, found)), key=lambda x: (-x[1], x[0]))


def pruned(rows: DataFrame, names: list[str], keep: int, kind: str = "logistic") -> DataFrame:
    """cross_validated() on the channels that a boosted model uses most."""
    return cross_validated(rows, [c for c, _ in importances(rows, names)[:keep]], kind)


def saved(rows: DataFrame, names: list[str], path: str, kind: str = "logistic") -> None:
    """Fit on all rows and write the model."""
    _learner(kind).fit(_prepared(rows, names, kind)).write().overwrite().save(path)


def loaded(path: str, rows: DataFrame, names: list[str], kind: str = "logistic") -> DataFrame:
    """(id, step, target, score) by a model that was written."""
    model = (LogisticRegressionModel if kind == "logistic" else GBTClassificationModel).load(path)
    return _scored(model, assembled(rows, names, kind == "logistic"))


def calibrated(scored: DataFrame, history: DataFrame, share: float = 0.5, weight: float = 1.0) -> DataFrame:
    """scored less a quantile of its series' scores on the history (id, score); series without any stay."""
    level = history.groupBy("id").agg(F.percentile("score", F.lit(share)).alias("level"))
    return scored.join(level, "id", "left").withColumn("score", F.col("score") - weight * F.coalesce("level", F.lit(0.0))).drop("level")


def held(scored: DataFrame, calm: float = 0.99, loud: float = 0.999, limit: float = 1.5, exit_rows: int = 20, exit_share: float = 0.6) -> DataFrame:
    """(id, step, gated, entry_exit) of (id, step, score, error).

    gated holds the peak with a decay that depends on how calm the forecaster's
    error is. entry_exit holds it with the slower decay and lets go where the
    mean of the last rows falls under a share of what is held. Both carry their
    own past decisions along, which a window cannot; a group is one series.
    """
    ship(scored.sparkSession)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        x, out, gate, peak, total = pdf["score"].tolist(), [], 0.0, 0.0, 0.0
        for t, (v, e) in enumerate(zip(x, pdf["error"])):
            gate = max(v, gate * (calm if e < limit else loud))
            total += v - (x[t - exit_rows] if t >= exit_rows else 0.0)
            mean, peak = total / min(t + 1, exit_rows), max(v, peak * loud)
            peak = mean if mean < exit_share * peak else peak
            out.append((gate, peak))
        made = pd.DataFrame(out, columns=["gated", "entry_exit"])
        return pd.concat([pdf[["id", "step"]].reset_index(drop=True), made], axis=1)

    return scored.select("id", "step", "score", "error").groupBy("id").applyInPandas(one, "id long, step long, gated double, entry_exit double")


def interactions(rows: DataFrame) -> DataFrame:
    """(id, step, ...): evidence against the history set against evidence within the online part.

    rows: the prefix battery's ks, dmean, dlogsd, half_mean, half_logsd, plain
    and (with a_ in front) compressed, and scan, the best split's score.
    """
    outer = lambda p: F.greatest(3 * F.col(f"{p}ks"), F.abs(f"{p}dmean"), F.abs(f"{p}dlogsd"))
    half = lambda p: F.abs(f"{p}half_mean") + F.abs(f"{p}half_logsd")
    x = rows.select("id", "step", "scan", outer("").alias("outer_raw"), outer("a_").alias("outer_asinh"), half("").alias("half_raw"), half("a_").alias("half_asinh"))
    x = x.withColumn("inner", F.greatest("half_raw", "half_asinh", 2 * F.greatest(F.col("scan") - 0.5, F.lit(0.0))))
    quiet = {f"quiet_{v}": F.col(f"outer_{v}") * (1 - F.col("scan")) for v in ("raw", "asinh")}
    net = {f"net_{v}": F.col(f"outer_{v}") - F.col("inner") for v in ("raw", "asinh")}
    damped = {f"damped_{v}": F.col(f"outer_{v}") * F.exp(-2 * F.col(f"half_{v}")) for v in ("raw", "asinh")}
    return x.select("id", "step", *(e.alias(n) for n, e in (quiet | net | damped).items()), "inner", "outer_raw", "outer_asinh", (F.col("inner") - 0.5 * (F.col("outer_raw") + F.col("outer_asinh"))).alias("balance"))


def separation(rows: DataFrame, names: list[str], label: str, n: int = 5, seed: int = 7) -> DataFrame:
    """(labels, auc): the cross-validated logistic AUC of a label, folds dealt within its classes, and the same after labels are dealt anew.

    rows: one a series, with id. Labels are dealt anew by a keyed hash, with the
    same share of ones; folds are another hash's, alike in both classes.
    """
    base = rows.select("id", F.col(label).cast("int").alias("y"), *names)
    share = base.agg(F.avg("y").alias("p")).first()["p"] or 0.0
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1_000_000)) < int(share * 1_000_000)
    fold, out = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int").alias("fold"), None
    for kind, y in (("given", base.select("id", "y")), ("permuted", base.select("id", drawn.cast("int").alias("y")))):
        data = base.drop("y").join(y, "id").select("id", "y", fold, *names)
        data = durable(VectorAssembler(inputCols=names, outputCol="raw").transform(data.na.fill(0.0, names)).withColumn("label", F.col("y").cast("double")).select("id", "y", "fold", "label", "raw"))
        for k in range(n):
            train = data.where(F.col("fold") != k)
            scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="features").fit(train)
            model = LogisticRegression(maxIter=50, regParam=0.01).fit(scaler.transform(train))
            scored = model.transform(scaler.transform(data.where(F.col("fold") == k))).select(F.lit(kind).alias("labels"), F.col("y").alias("target"), vector_to_array("probability")[1].alias("score"))
            out = scored if out is None else out.unionByName(scored)
    return metrics.group_auc(out, ["labels"]).select("labels", "auc")


def gated_blend(core: Column, mass: Column, freq: Column, union: Column, gate: int = 100) -> Column:
    """A convex mix of members that changes at a step."""
    return F.when(F.col("step") < gate, 0.55 * core + 0.25 * mass + 0.20 * freq).otherwise(0.50 * core + 0.25 * mass + 0.25 * union)
