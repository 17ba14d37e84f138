"""Sequence (character string) expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandwork.functions.attach import let

AMBIGUOUS = "[UZOB]"  # fixed value: residues that carry no single identity


def kgrams(sequence: Column, k: int = 3) -> Column:
    """Distinct character k-grams; empty when the sequence is shorter than ``k``.

    The text is split into characters once, so the cost is linear in its length
    (``substring`` per position would rescan the string every time).
    """
    count = F.greatest(F.length(sequence) - (k - 1), F.lit(0))

    def slide(chars: Column) -> Column:
        return F.transform(
            F.slice(chars, F.lit(1), count),
            lambda c, i: F.concat(c, *[F.get(chars, i + j) for j in range(1, k)]),
        )

    grams = let(F.split(sequence, ""), slide)
    return F.array_distinct(F.when(count > 0, grams).otherwise(F.array().cast("array<string>")))


def gram_codes(sequence: Column, k: int = 3) -> Column:
    """The distinct k-grams as longs, which are smaller to move and faster to intersect.

    Up to k = 3 the code points are packed (21 bits each), which is one-to-one;
    longer grams are hashed to 64 bits.
    """
    if k > 3:
        return F.transform(kgrams(sequence, k), lambda g: F.xxhash64(g))
    count = F.greatest(F.length(sequence) - (k - 1), F.lit(0))

    def slide(points: Column) -> Column:
        def pack(c: Column, i: Column) -> Column:
            for j in range(1, k):
                c = F.shiftleft(c, 21).bitwiseOR(F.get(points, i + j))
            return c

        return F.transform(F.slice(points, F.lit(1), count), pack)

    codes = let(F.transform(F.split(sequence, ""), lambda c: F.ascii(c).cast("bigint")), slide)
    return F.array_distinct(F.when(count > 0, codes).otherwise(F.array().cast("array<bigint>")))


def sorted_gram_codes(sequence: Column, k: int = 3) -> Column:
    """``gram_codes`` in ascending order. Up to k = 3 an Arrow-batched numpy kernel packs and sorts the code points."""
    if k > 3:
        return F.array_sort(gram_codes(sequence, k))

    def one(text: str | None):
        points = np.frombuffer((text or "").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        count = max(len(points) - k + 1, 0)
        codes = points[:count]
        for j in range(1, k):
            codes = codes << 21 | points[j : j + count]
        return np.unique(codes)

    @F.pandas_udf("array<bigint>")
    def kernel(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return kernel(sequence)


def jaccard(a: Column, b: Column) -> Column:
    """Exact Jaccard of two arrays without repeats; NULL when both are empty."""

    def share(common: Column) -> Column:
        return F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common)

    return let(F.size(F.array_intersect(a, b)), share)


def normalized(sequence: Column, *, drop_first: bool = True) -> Column:
    """Characters separated by spaces, ambiguous ones replaced by X.

    The first character (the start residue) is dropped unless told otherwise.
    """
    body = F.substring(sequence, 2, 2_147_483_647) if drop_first else sequence
    spaced = F.array_join(F.split(body, ""), " ")
    return F.regexp_replace(F.when(F.length(body) == 0, "").otherwise(spaced), AMBIGUOUS, "X")


def path_prefix(path: Column, level: int) -> Column:
    """First ``level + 1`` whitespace-separated words of a path."""
    words = F.split(F.trim(F.regexp_replace(path, r"\s+", " ")), " ")
    return F.array_join(F.slice(words, 1, level + 1), " ")


def encoded(
    words: Column,
    vocabulary: Column,
    *,
    length: int = 512,
    unknown: int = 1,
    pad: int = 0,
    start: int | None = None,
    end: int | None = None,
) -> Column:
    """``struct(input_ids, attention_mask)`` of fixed ``length``.

    ``vocabulary`` is a map word -> id. ``start`` and ``end`` are framing ids;
    they count towards ``length`` and truncation leaves room for them.
    """
    room = length - (start is not None) - (end is not None)
    ids = F.transform(F.slice(words, 1, room), lambda w: F.coalesce(F.try_element_at(vocabulary, w), F.lit(unknown)))
    return framed(ids, length=length, pad=pad, start=start, end=end)


def framed(ids: Column, *, length: int, pad: int = 0, start: int | None = None, end: int | None = None) -> Column:
    """``struct(input_ids, attention_mask)``: ``ids`` between the framing ids, padded to ``length``."""
    whole = F.concat(
        F.array(*[F.lit(v) for v in [start] if v is not None]).cast("array<int>"),
        ids,
        F.array(*[F.lit(v) for v in [end] if v is not None]).cast("array<int>"),
    )

    def padded(row: Column) -> Column:
        missing = F.lit(length) - F.size(row)
        return F.struct(
            F.concat(row, F.array_repeat(F.lit(pad), missing)).alias("input_ids"),
            F.concat(F.array_repeat(F.lit(1), F.size(row)), F.array_repeat(F.lit(0), missing)).alias("attention_mask"),
        )

    return let(whole, padded)
