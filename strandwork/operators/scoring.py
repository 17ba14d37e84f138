"""Distributed scoring and the linear baseline models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequences import kgrams
from strandwork.sources.session import written

Scorer = Callable[[list], np.ndarray]


def batch_score(
    df: DataFrame, *, id: str, feature: str, truth: str, factory: Callable[[], Scorer], batch_rows: int = 32
) -> DataFrame:
    """``(id, truth, prediction)`` from any Python model.

    ``factory`` runs once per task and returns ``score(list of features) -> array``;
    features arrive in batches of ``batch_rows``.
    """
    slim = df.select(
        F.col(id).alias("id"), F.col(truth).cast("double").alias("truth"), F.col(feature).alias("feature")
    )
    kind = slim.schema["id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at : at + batch_rows]
                values = np.asarray(score(list(part["feature"])), dtype=float).reshape(-1)
                yield pd.DataFrame({"id": part["id"], "truth": part["truth"], "prediction": values})

    return slim.mapInPandas(run, f"id {kind}, truth double, prediction double")


def linear_scorer(weights: list[float], intercept: float = 0.0) -> Callable[[], Scorer]:
    """Factory of a fixed linear model over vector features."""

    def factory() -> Scorer:
        vector = np.array(weights, dtype=float)
        return lambda features: np.stack([np.asarray(f, dtype=float) for f in features]) @ vector + intercept

    return factory


def with_grams(df: DataFrame, sequence: str, k: int = 3) -> DataFrame:
    """Adds the k-gram column that the baseline models read."""
    return df.withColumn("_grams", kgrams(F.col(sequence), k))


def _fitted(model, hashing: HashingTF, df: DataFrame, sequence: str, columns: list[str], k: int) -> PipelineModel:
    """The pipeline fitted on hashed k-grams, which are computed once and written: each pass of the fit reads them."""
    hashed = hashing.transform(with_grams(df.select(sequence, *columns), sequence, k)).select(*columns, "_features")
    return PipelineModel(stages=[hashing, model.fit(written(hashed, "hashed-grams"))])


def train_classifier(
    df: DataFrame,
    sequence: str,
    label: str,
    *,
    weight: str | None = None,
    k: int = 3,
    features: int = 4096,
    iterations: int = 20,
):
    """Class-weighted logistic regression on hashed k-grams; returns the fitted model."""
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    model = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.01)
    if weight:
        model = model.setWeightCol(weight)
    return _fitted(model, hashing, df, sequence, [label, *([weight] if weight else [])], k)


def train_regressor(
    df: DataFrame, sequence: str, label: str, *, k: int = 3, features: int = 4096, iterations: int = 20
):
    """Ridge regression on hashed k-grams, on a standardised label; returns the fitted model."""
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    model = LinearRegression(
        featuresCol="_features", labelCol=label, maxIter=iterations, regParam=0.1, solver="l-bfgs"
    )
    return _fitted(model, hashing, df, sequence, [label], k)


def apply_model(model, df: DataFrame, sequence: str, keep: list[str], k: int = 3) -> DataFrame:
    """Predictions of a trained baseline next to the ``keep`` columns."""
    return model.transform(with_grams(df, sequence, k)).select(*keep, "prediction")
