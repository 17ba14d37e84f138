"""Seeded pseudo-random order that is a function of the row key alone.

``md5(key|seed)`` gives the same order on every engine, every retry and every
partitioning, so a lost executor recomputes exactly the rows it had.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(key: Sequence[str], seed: int) -> Column:
    """Hexadecimal order key of a row; ascending order is a random permutation.

    The parts of the key carry their length, and NULL is a mark of its own, so different keys never
    meet in one string.
    """
    parts = [F.col(c).cast("string") for c in key]
    marked = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws("|", *marked, F.lit(str(seed))))


def draw(position: Column, size: Column, seed: int) -> Column:
    """The index in ``[0, size)`` that the draw number ``position`` hits."""
    digest = F.md5(F.concat_ws("|", position.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size
