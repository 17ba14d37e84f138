"""Bind values: inside an expression, and per-group statistics to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.sources.session import SMALL_BYTES, held


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def same(left: DataFrame, right: DataFrame, by: Sequence[str], prefix: str) -> Column:
    """Equality of ``by`` with the prefixed copies in ``right``, in which NULLs meet.

    Where one side has no NULLs plain equality says the same and keeps the
    partitioning of the column usable for what follows the join.
    """
    condition = F.lit(True)
    for name in by:
        mine, other = left[name], right[prefix + name]
        nulls = left.schema[name].nullable and right.schema[prefix + name].nullable
        condition = condition & (mine.eqNullSafe(other) if nulls else mine == other)
    return condition


def join_by(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``by`` in which NULL keys meet; the keys of ``left`` stay."""
    renamed = right.withColumnsRenamed({c: "_r_" + c for c in by})
    joined = left.join(renamed, same(left, renamed, by, "_r_"), how)
    return joined.drop(*["_r_" + c for c in by])


def join_small(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``join_by`` that never moves the rows of ``left``: ``right`` is computed and broadcast.

    Its bytes are measured first. If they exceed ``SMALL_BYTES`` the keys are dealt into as many pieces as it
    takes, and ``left`` is read once for each piece, with the rows that belong to it.
    """
    table, size = held(right)
    pieces = max(1, -(-size // SMALL_BYTES))
    if pieces == 1:
        return join_by(left, F.broadcast(table), by, how)
    mine = F.pmod(F.xxhash64(*by), F.lit(pieces))
    parts = [join_by(left.filter(mine == i), F.broadcast(table.filter(mine == i)), by, how) for i in range(pieces)]
    return reduce(DataFrame.unionByName, parts)


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the columns of ``stats`` (one row per ``by`` group) to every row.

    Without groups ``stats`` has one row and is read as a scalar subquery, so there is no join at all. With
    groups it is broadcast in pieces of bounded size, so that ``df`` is not shuffled on ``by``, whose groups
    may be as uneven as they like.
    """
    values = [c for c in stats.columns if c not in by]
    if by:
        return join_small(df, stats, by)
    row = stats.select(F.struct(*values).alias("s")).scalar()
    return df.withColumns({c: row[c] for c in values})
