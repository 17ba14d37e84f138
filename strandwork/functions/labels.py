"""Label and target expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions.attach import let


def window_label(value: Column, low: float, high: float) -> Column:
    """0 at or below ``low``, 1 at or above ``high``, NULL between them.

    NaN compares greater than everything in Spark, so it is excluded by name.
    ``high`` is tested first and wins where the two thresholds overlap.
    """
    return F.when(F.isnan(value), None).when(value >= high, 1).when(value <= low, 0).cast("int")


def standardize(value: Column, mean: Column, std: Column) -> Column:
    """z-score; a constant column (std 0) yields NULL."""
    return F.try_divide(value - mean, std)


def unstandardize(value: Column, mean: Column, std: Column) -> Column:
    return value * std + mean


def residual(prediction: Column, truth: Column) -> Column:
    return prediction - truth


def argmax(scores: Column) -> Column:
    """0-based index of the largest score, the first one on ties.

    As in the usual array library, a NaN score wins: ``array_max`` ranks NaN
    highest and ``array_position`` finds it.
    """
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label], shifted by the maximum against overflow."""

    def loss(top: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.log(total) + top - F.get(logits, label)

    return let(F.array_max(logits), loss)
