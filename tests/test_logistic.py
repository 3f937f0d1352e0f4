"""Logistic models of all folds at once against one fit after the other."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from driftline.operators import learn


@pytest.fixture(scope="module")
def data(spark):
    rng, rows = np.random.default_rng(6), []
    for i in range(900):
        x = rng.normal(size=3) * (1.0, 20.0, 0.01)
        y = float(rng.random() < 1 / (1 + np.exp(-(2 * x[0] - 0.1 * x[1] + 1))))
        rows.append((i, i % 7, i % 3, float(rng.random() + 0.1), y, *map(float, x), 5.0))
    df = spark.createDataFrame(rows, "id long, step long, fold int, w double, label double, a double, b double, c double, flat double").withColumn("target", F.col("label").cast("int"))
    return VectorAssembler(inputCols=["a", "b", "c", "flat"], outputCol="features").transform(df).cache()


def test_all_folds_reach_the_end_of_one_fit_after_the_other(data):
    got = learn.logistic_fits(data, 3, 4)
    for k in range(3):
        model = LogisticRegression(weightCol="w", maxIter=1000, tol=1e-14, regParam=1e-4).fit(data.where(F.col("fold") != k))
        want = model.coefficients.toArray()
        assert got[k][:3] == pytest.approx(want[:3], rel=1e-4, abs=1e-5)
        assert got[k][3] == 0.0 and got[k][4] == pytest.approx(model.intercept + 5.0 * want[3], rel=1e-4)  # the flat channel is a constant


def test_scores_are_those_of_the_other_folds_model_and_nothing_is_kept_in_memory(spark, data):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    coefs, rows = learn.logistic_fits(data, 3, 4), {r["id"]: r for r in data.collect()}
    for r in learn._out_of_fold(data, "logistic", 3, 4).collect():
        c, x = coefs[r["fold"]], rows[r["id"]]["features"].toArray()
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-(c[:-1] @ x + c[-1]))), abs=1e-12)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_folds_of_one_class_or_without_rows(data):
    one = learn._out_of_fold(data.where("label = 1"), "logistic", 3, 4).collect()
    assert one and all(r["score"] == 1.0 for r in one)
    assert learn._out_of_fold(data.where("id < 0"), "logistic", 3, 4).count() == 0
