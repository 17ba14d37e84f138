"""Train/test splits.

A split is a column, not a pair of tables. Membership is a hash threshold, so
assigning it is part of the scan and a hot group needs no shuffle or join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequences import path_prefix
from strandwork.operators.selection import hash_cutoffs, mark_below, mark_first

TRAIN, TEST = "train", "test"


def _check(fraction: float) -> None:
    if not 0.0 < fraction < 1.0:
        raise ValueError("the test fraction must lie strictly between 0 and 1")


def random_split(df: DataFrame, key: list[str], *, fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Exactly ``ceil(fraction * n)`` random rows become the test split."""
    _check(fraction)
    marked = mark_first(df, key, lambda total: F.ceil(total * fraction), seed=seed, into="_test")
    return marked.withColumn("split", F.when(F.col("_test"), TEST).otherwise(TRAIN)).drop("_test")


def group_split(df: DataFrame, group: str, *, fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Whole groups go to one side; ``fraction`` counts groups, not rows.

    ``floor((1 - fraction) * groups)`` groups train, the others test. Rows
    without a group value form one group.
    """
    _check(fraction)
    groups = df.select(group).distinct()
    cuts = hash_cutoffs(groups, [group], lambda total: F.floor(total * (1 - fraction)), seed=seed)
    marked = mark_below(df, cuts, [group], seed=seed, into="_train")
    return marked.withColumn("split", F.when(F.col("_train"), TRAIN).otherwise(TEST)).drop("_train")


def prefix_split(df: DataFrame, path: str, level: int, *, fraction: float = 0.15, seed: int = 0) -> DataFrame:
    """Group split on the first ``level + 1`` words of a path; rows without a path are dropped.

    The prefix is kept in the column ``<path>_prefix``.
    """
    if level < 0:
        raise ValueError("level counts from 0")
    named = df.filter(F.col(path).isNotNull()).withColumn(path + "_prefix", path_prefix(F.col(path), level))
    return group_split(named, path + "_prefix", fraction=fraction, seed=seed)


def split_table(
    df: DataFrame,
    mode: str | int,
    *,
    key: list[str],
    column: str | None = None,
    fraction: float = 0.15,
    seed: int = 0,
) -> DataFrame:
    """``"random"``, ``"group"`` (column defaults to taxid) or a path level (column: taxonomy)."""
    if mode == "random":
        return random_split(df, key, fraction=fraction, seed=seed)
    if mode == "group":
        return group_split(df, column or "taxid", fraction=fraction, seed=seed)
    if isinstance(mode, int) and not isinstance(mode, bool):
        return prefix_split(df, column or "taxonomy", mode, fraction=fraction, seed=seed)
    raise ValueError(f"unknown split mode {mode!r}")


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups found in more than one split; empty for a sound split.

    Minimum and maximum of the split name decide it, which combines map-side.
    """
    spans = df.groupBy(group).agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    return spans.filter("lo <> hi").select(group)
