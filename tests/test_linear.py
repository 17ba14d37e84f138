"""Linear models against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.operators import linear


def data_of(spark, n=2000):
    random = np.random.default_rng(8)
    x = random.normal(size=(n, 3)) * [1, 20, 0.1] + [0, 5, 100]
    y = x @ [2.0, -0.3, 4.0] + random.normal(size=n)
    w = random.uniform(0.5, 2, n)
    label = (random.uniform(size=n) < 1 / (1 + np.exp(-(x[:, 0] - 0.05 * x[:, 1])))).astype(float)
    rows = np.column_stack([x, y, w, label]).tolist()
    return spark.createDataFrame(rows, "a double, b double, c double, y double, w double, label double").repartition(7), x, y, w, label


def test_least_squares(spark):
    df, x, y, w, _ = data_of(spark)
    model = linear.fit_least_squares(df, ["a", "b", "c"], "y", weight="w")
    design = np.column_stack([np.ones(len(x)), x])
    want = np.linalg.lstsq(design * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    assert [model.intercept, *model.coefficients] == pytest.approx(want, rel=1e-6)
    score = df.select(model.score().alias("s"), "a", "b", "c").first()
    assert score.s == pytest.approx(model.intercept + np.dot(model.coefficients, [score.a, score.b, score.c]))


def test_logistic_has_no_gradient_left(spark):
    df, x, _, w, label = data_of(spark)
    model = linear.fit_logistic(df, ["a", "b", "c"], "label", weight="w", ridge=0.5)
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.array([model.intercept, *model.coefficients])
    chance = 1 / (1 + np.exp(-design @ beta))
    gradient = design.T @ (w * (label - chance)) - np.array([0, 0.5, 0.5, 0.5]) * beta
    assert np.abs(gradient).max() < 1e-4 and model.steps < 15
    mean = df.agg(F.avg(model.chance())).first()[0]
    assert mean == pytest.approx(chance.mean())


def test_separable_classes_and_dependent_features(spark):
    rows = [(float(i), 1.0, 2.0 * i, float(i >= 10)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, one double, twice double, y double")
    model = linear.fit_logistic(df, ["a", "one", "twice"], "y")
    assert df.filter((model.chance() > 0.5) == (F.col("y") == 1)).count() == 20
    flat = linear.fit_least_squares(df, ["a", "one", "twice"], "a")
    assert df.select(F.max(F.abs(flat.score() - F.col("a")))).first()[0] < 1e-6


def test_rows_without_numbers_and_empty_tables(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (None, 5.0), (float("nan"), 1.0), (3.0, None), (3.0, 6.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    model = linear.fit_least_squares(df, ["x"], "y")
    assert (model.intercept, *model.coefficients) == pytest.approx((0.0, 2.0), abs=1e-9)
    nothing = linear.fit_least_squares(df.limit(0), ["x"], "y")
    assert (nothing.intercept, *nothing.coefficients) == (0.0, 0.0)
    assert linear.fit_logistic(df.limit(0), ["x"], "y").coefficients == (0.0,)
    with pytest.raises(ValueError):
        linear.fit_least_squares(df, [], "y")
