"""Class balancing to exact sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.operators.selection import first_n, redraw
from strandwork.sources.session import held


def class_ratio(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n_rows, n_positive, ratio)``."""
    positive = F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(positive.cast("bigint")).alias("n_positive"),
        F.avg(positive.cast("double")).alias("ratio"),
    )


def class_weights(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, label, weight)``: positives weigh 1, negatives p / (1 - p).

    A group without negatives has no negative weight (NULL).
    """
    share = F.avg(F.col(label).cast("double"))
    ratios = df.groupBy(*by).agg(F.try_divide(share, 1.0 - share).alias("negative"))
    both = F.array(
        F.struct(F.lit(0).alias("label"), F.col("negative").alias("weight")),
        F.struct(F.lit(1).alias("label"), F.lit(1.0).alias("weight")),
    )
    return ratios.select(*by, F.inline(both))


def balanced_sizes(n_a: Column, n_b: Column, *, desired: float = 0.5, max_upsampling: float = 0.0) -> Column:
    """``struct(a, b)``: class sizes at which the smaller class makes up ``desired``.

    The smaller class may grow by ``max_upsampling`` of itself. If that alone
    overshoots the wanted balance, only as much as needed is added; otherwise the
    larger class is cut for the rest. Fractions are truncated. Classes that are
    already balanced enough stay as they are.
    """
    if not 0.0 < desired <= 0.5:
        raise ValueError("desired balance must lie in (0, 0.5]")
    small, big = F.least(n_a, n_b).cast("double"), F.greatest(n_a, n_b).cast("double")
    most = F.floor(small * max_upsampling)
    overshoots = F.try_divide(small + most, small + most + big) > desired
    partial = ((desired * (small + big) - small) / (1 - desired)).cast("bigint")
    added = F.when(overshoots, partial).otherwise(most)
    cut = F.when(overshoots, F.lit(0)).otherwise((most + small + big - (small + most) / desired).cast("bigint"))
    settled = (n_a == n_b) | (F.try_divide(small, small + big) >= desired)
    new_small, new_big = (small + added).cast("bigint"), (big - cut).cast("bigint")
    a = F.when(settled, n_a).when(n_b > n_a, new_small).otherwise(new_big)
    b = F.when(settled, n_b).when(n_b > n_a, new_big).otherwise(new_small)
    return F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))


def class_targets(
    df: DataFrame, label: str, *, desired: float = 0.5, max_upsampling: float = 0.0, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, label, n_before, n_after)`` for the classes 0 and 1."""
    counts = df.groupBy(*by).agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    sized = counts.withColumn(
        "t", balanced_sizes(F.col("n0"), F.col("n1"), desired=desired, max_upsampling=max_upsampling)
    )
    rows = F.array(
        *[
            F.struct(F.lit(v).alias("label"), F.col(n).alias("n_before"), F.col(t).alias("n_after"))
            for v, n, t in ((0, "n0", "t.a"), (1, "n1", "t.b"))
        ]
    )
    return sized.select(*by, F.inline(rows))


def balance_classes(
    df: DataFrame,
    label: str,
    key: Sequence[str],
    *,
    desired: float | None = 0.5,
    max_upsampling: float = 0.0,
    keep_originals: bool = False,
    seed: int = 0,
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows of both classes at their target sizes.

    A class that shrinks loses random rows; a class that grows is redrawn with
    replacement as a whole (originals can vanish), or only topped up with
    ``keep_originals``. ``desired=None`` switches balancing off.
    """
    if desired is None:
        return df
    strata = [*by, label]
    targets = class_targets(df, label, desired=desired, max_upsampling=max_upsampling, by=by)
    values = targets.select(*by, F.col("label").cast(df.schema[label].dataType).alias(label), "n_before", "n_after")
    targets, _ = held(values)
    grows = F.col("n_after") > F.col("n_before")
    stay = F.col("n_before") if keep_originals else F.lit(0)
    kept = first_n(
        df, key, targets.select(*strata, F.when(grows, stay).otherwise(F.col("n_after")).alias("_take")), seed=seed, by=strata
    )
    extra = F.col("n_after") - (F.col("n_before") if keep_originals else F.lit(0))
    growing = targets.filter(grows).select(*strata, extra.alias("_take"))
    if growing.isEmpty():
        return kept
    return kept.unionByName(redraw(df, key, growing, seed=seed, by=strata))
