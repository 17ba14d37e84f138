"""Linear models on named features, fitted by sums.

The normal equations, and each Newton step of the logistic model, need one small matrix: products of features
added up over the rows. Tasks add up their rows in numpy, a ``groupBy`` adds the tasks up cell by cell, and
only the matrix, whose size is that of the model squared, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.binning import usable
from strandwork.sources.session import written

#: Features of a model whose matrix is still small.
MOST_FEATURES = 500


@dataclass(frozen=True)
class LinearModel:
    """``intercept`` and one coefficient per feature; ``steps`` is how many matrices were added up."""

    features: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    steps: int = 1

    def score(self) -> Column:
        """The linear score of a row."""
        terms = [F.lit(c) * F.col(f).cast("double") for f, c in zip(self.features, self.coefficients, strict=True)]
        return sum(terms, F.lit(self.intercept))

    def chance(self) -> Column:
        """The chance of class 1 under a logistic model."""
        return 1.0 / (1.0 + F.exp(-self.score()))

    def table(self, spark) -> DataFrame:
        """``(name, value)`` of intercept and coefficients."""
        rows = [("intercept", self.intercept), *zip(self.features, self.coefficients, strict=True)]
        return spark.createDataFrame(rows, "name string, value double")


Step = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _numbers(df: DataFrame, features: Sequence[str], label: str, weight: str | None) -> DataFrame:
    """The rows that have a number everywhere, as doubles."""
    if not 1 <= len(features) <= MOST_FEATURES:
        raise ValueError(f"between 1 and {MOST_FEATURES} features")
    columns = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    columns += [F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]
    rows = df.select(*columns)
    for name in rows.columns:
        rows = rows.filter(usable(F.col(name)))
    return rows


def _added_up(rows: DataFrame, size: int, step: Step) -> tuple[np.ndarray, np.ndarray]:
    """``step(X, y, w)`` gives a matrix and a vector for some rows, X with a leading 1; their sums over all rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            for i in range(0, batch.num_rows, 4096):
                part = [c[i : i + 4096] for c in columns]
                x = np.column_stack([np.ones(len(part[0])), *part[: size - 1]])
                matrix, vector = step(x, part[size - 1], part[size])
                total[:size] += matrix
                total[size] += vector
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["cell", "value"])

    cells = rows.mapInArrow(kernel, "cell bigint, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((size + 1) * size)
    total[cells["cell"].to_numpy()] = cells["value"].to_numpy()
    total = total.reshape(size + 1, size)
    return total[:size], total[size]


def _solved(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Least squares where features depend on each other, so a constant or repeated feature does no harm."""
    scale = np.sqrt(np.maximum(np.diag(matrix), 1e-300))
    return np.linalg.lstsq(matrix / np.outer(scale, scale), vector / scale, rcond=1e-13)[0] / scale


def fit_least_squares(
    df: DataFrame, features: Sequence[str], label: str, *, weight: str | None = None, ridge: float = 0.0
) -> LinearModel:
    """Weighted least squares in one pass; ``ridge`` times the squared coefficients is added to the loss.

    Rows with a NULL or NaN in any column are left out; without rows all coefficients are 0.
    """
    rows = _numbers(df, features, label, weight)
    size = len(features) + 1
    matrix, vector = _added_up(rows, size, lambda x, y, w: ((x * w[:, None]).T @ x, x.T @ (w * y)))
    matrix[np.arange(1, size), np.arange(1, size)] += ridge
    found = _solved(matrix, vector)
    return LinearModel(tuple(features), float(found[0]), tuple(map(float, found[1:])))


def fit_logistic(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    *,
    weight: str | None = None,
    ridge: float = 1.0,
    most_steps: int = 30,
    tolerance: float = 1e-10,
) -> LinearModel:
    """Weighted logistic regression by Newton steps; ``ridge`` as in ``fit_least_squares``.

    The loss is convex; a step is halved as long as it would raise the length of the gradient. It ends when
    no coefficient moves by more than ``tolerance`` of the largest.
    """
    rows = written(_numbers(df, features, label, weight), "linear-rows")
    size = len(features) + 1
    penalty = np.full(size, ridge)
    penalty[0] = 0.0

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def step(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            chance = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -700, 700)))
            return (x * (w * chance * (1 - chance))[:, None]).T @ x, x.T @ (w * (y - chance))

        matrix, gradient = _added_up(rows, size, step)
        return matrix + np.diag(penalty), gradient - penalty * beta

    beta, steps = np.zeros(size), 1
    matrix, gradient = at(beta)
    while steps < most_steps:
        move = _solved(matrix, gradient)
        matrix, new = at(beta + move)
        steps += 1
        while np.linalg.norm(new) > np.linalg.norm(gradient) and steps < most_steps and np.abs(move).max() > tolerance:
            move = move / 2
            matrix, new = at(beta + move)
            steps += 1
        beta, gradient = beta + move, new
        if np.abs(move).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    return LinearModel(tuple(features), float(beta[0]), tuple(map(float, beta[1:])), steps)

