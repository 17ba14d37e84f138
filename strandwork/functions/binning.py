"""Equal-width bins over explicit edges.

Edges live in a small array column (one per group), and a row finds its bin by
one division plus a check against the two nearest edges: constant work per row,
and exact on the edges themselves, which ``width_bucket`` is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.attach import attach


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value)


def linspace(low: Column, high: Column, count: int) -> Column:
    """``count`` evenly spaced edges, the last one exactly ``high``."""
    step = (high - low) / (count - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(count - 1)),
        lambda i: F.when(i == count - 1, high).otherwise(i * step + low),
    )


def locate(
    df: DataFrame, value: Column, edges: Column, count: int, *, into: str, right: bool = False
) -> DataFrame:
    """Add how many edges are <= ``value`` (or < ``value`` with ``right``); NULL for NULL and NaN.

    The division guesses the edge below the value; rounding can put the guess one
    off, which the comparison with that edge and the next one settles. The guess is a
    column of its own so that it is computed once per row.
    """

    def passed(edge: Column) -> Column:
        return edge < value if right else edge <= value

    low, high = F.get(edges, F.lit(0)), F.get(edges, F.lit(count - 1))
    # Equal edges (a constant column): either all of them are passed or none.
    share = F.coalesce(F.try_divide(value - low, high - low), F.when(passed(low), 1.0).otherwise(0.0))
    guess = F.floor(F.least(F.greatest(share * (count - 1), F.lit(0.0)), F.lit(float(count - 1)))).cast("int")
    near = F.col("_near")
    step = F.when(~passed(F.get(edges, near)), 0).when(passed(F.get(edges, near + 1)), 2).otherwise(1)
    return df.withColumn("_near", F.when(usable(value), guess)).withColumn(into, near + step).drop("_near")


def label_edges(df: DataFrame, column: str, count: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, edges)``: ``count`` edges from the minimum to the maximum of ``column``."""
    value = F.col(column)
    range_ = df.filter(usable(value)).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return range_.select(*by, linspace(F.col("lo"), F.col("hi"), count).alias("edges"))


def digitize(df: DataFrame, column: str, edges: DataFrame, count: int, *, by: Sequence[str] = (), into: str = "bin"):
    """Bins 1..``count``: bin i is [edge i, edge i+1), the last bin holds only the maximum."""
    placed = attach(df, edges.select(*by, F.col("edges").alias("_edges")), by)
    return locate(placed, F.col(column), F.col("_edges"), count, into=into).drop("_edges")


def cut_edges(df: DataFrame, column: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, edges, mids)`` of right-closed bins.

    The lowest edge moves down by 0.1 % of the range so the minimum falls inside;
    a constant column is widened by 0.1 % of its value on both sides. Midpoints
    are those of the edges rounded to 3 digits, with more digits where 3 would
    make two edges equal.
    """
    value = F.col(column)
    stats = df.filter(usable(value)).groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    pad = F.when(lo == 0, F.lit(0.001)).otherwise(F.abs(lo) * 0.001)
    raw = F.when(lo == hi, linspace(lo - pad, hi + pad, bins + 1)).otherwise(linspace(lo, hi, bins + 1))
    shifted = F.transform(
        F.col("raw"), lambda e, i: F.when((i == 0) & (lo != hi), e - (hi - lo) * 0.001).otherwise(e)
    )
    tries = F.transform(
        F.sequence(F.lit(3), F.lit(15)),
        lambda d: F.transform("edges", lambda e: _round_digits(e, d)),
    )
    distinct = F.filter(tries, lambda a: F.size(F.array_distinct(a)) == bins + 1)
    rounded = F.coalesce(F.get(distinct, F.lit(0)), F.col("edges"))
    mids = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: _middle(F.col("rounded"), i))
    return (
        stats.withColumn("raw", raw)
        .withColumn("edges", shifted)
        .withColumn("rounded", rounded)
        .select(*by, "edges", mids.alias("mids"))
    )


def _middle(edges: Column, i: Column) -> Column:
    return (F.get(edges, i) + F.get(edges, i + 1)) * 0.5


def _round_digits(x: Column, digits: Column) -> Column:
    """Round to ``digits`` decimals, counted from the first significant one below 1."""
    leading = F.when(
        (F.abs(x) < 1) & (x != 0), -F.floor(F.log10(F.abs(x))).cast("int") - 1
    ).otherwise(0)
    scale = F.pow(F.lit(10.0), digits + leading)
    return F.rint(x * scale) / scale
