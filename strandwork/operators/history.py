"""Metric histories: long tables ``(run, metric, step, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_step(history: DataFrame, order: str | None = None) -> DataFrame:
    """Drop the repeats that come from logging one evaluation twice.

    Of differing repeats the last number by ``order`` stays, without it the largest; NaN and NULL only where
    there is no number.
    """
    number = F.when(~F.isnan("value"), F.col("value"))
    if order is not None:
        last = F.max_by("value", F.struct(number.isNotNull(), F.col(order)))
        return history.groupBy("run", "metric", "step").agg(last.alias("value"))
    return history.groupBy("run", "metric", "step").agg(F.coalesce(F.max(number), F.max("value")).alias("value"))


def pivot_metrics(history: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(run, step, <one column per metric>)``; a metric not logged at a step is NULL."""
    values = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return history.groupBy("run", "step").agg(*values)


def latest_metrics(history: DataFrame) -> DataFrame:
    """``(run, metric, step, value)`` of the last step of every metric."""
    last = F.max_by(F.struct("step", "value"), "step")
    return history.groupBy("run", "metric").agg(last.alias("l")).select("run", "metric", "l.step", "l.value")


def report(history: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``(run, <one column per metric>)``: the last value of every metric; NULL for one that a run lacks."""

    def last(metric: str) -> Column:
        mine = F.col("metric") == metric
        return F.max_by(F.when(mine, F.col("value")), F.when(mine, F.col("step")))

    values = [last(m).alias(m) for m in metrics]
    return history.groupBy("run").agg(*values)


def best_step(history: DataFrame, metric: str, *, largest: bool = True) -> DataFrame:
    """``(run, step, value)`` of the best value; the earliest step wins a tie."""
    rows = history.filter(F.col("metric") == metric).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    order = F.struct(F.col("value") if largest else -F.col("value"), -F.col("step"))
    best = F.max_by(F.struct("step", "value"), order)
    return rows.groupBy("run").agg(best.alias("b")).select("run", "b.step", "b.value")


def prefixed(history: DataFrame, prefix: str) -> DataFrame:
    return history.withColumn("metric", F.concat(F.lit(prefix), F.col("metric")))


def logs_to_columns(records: DataFrame, more: Sequence[DataFrame] = ()) -> DataFrame:
    """Stack ragged record tables; a field a record lacks is NULL."""
    for other in more:
        records = records.unionByName(other, allowMissingColumns=True)
    return records
