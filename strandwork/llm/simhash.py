"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into ``max_bits // 2 + 1`` segments. If two fingerprints differ in at
most ``max_bits`` bits, one of those segments differs in at most one bit, so both own the same variant
of it with one bit masked. The variants are joined by equality and the pairs verified.

Only connections count, not pairs. Two fingerprints of a variant are a pair. The members of a larger one
are searched breadth-first in a task: whatever is found leaves the search at once, so a crowd of near copies
takes a few steps, and every member has one link, to the smallest fingerprint it is connected with.
Fingerprints that share a variant by chance alone are as many as there are fingerprints for each of about a
million values.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.store import free_name, written
from strandwork.llm.words import texts
from strandwork.operators.graph import connected_components

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Majority of the bits of the shingles' XXH64; 0 for a text without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for i in range(0, n, _BLOCK):
        j = min(n, i + _BLOCK)
        spans = zip(begins[i:j].tolist(), ends[i + shingle - 1 : j + shingle - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.dtype("<u8"), j - i)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """``(id, bits)``: the fingerprint of every row as a signed 64-bit integer."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(run.text(i), shingle) for run in texts(batch.column(1)) for i in range(len(run))]
            bits = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=[id, "bits"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(kernel, f"`{id}` {kind}, bits bigint")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """``(lowest bit, width)`` of the segments, one of which differs in at most one bit."""
    parts = max_bits // 2 + 1
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(low, high - low) for low, high in pairwise(edges)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def variants(bits: Column, max_bits: int) -> Column:
    """Array of the segments of ``bits`` with one bit masked, as ``(slot, value)`` structs."""
    out = []
    for low, width in segments(max_bits):
        segment = F.shiftrightunsigned(bits, low).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        for j in range(width):
            mask = _signed(((1 << 64) - 1) ^ (1 << j))
            out.append(F.struct(F.lit(low + j).alias("slot"), segment.bitwiseAND(F.lit(mask)).alias("value")))
    return F.array(*out)


def _met(spread: DataFrame, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The pairs ``(a, b)`` that are alone with a variant, and the rows of the larger groups.

    All of these grow with the documents, so none is to be broadcast, whatever its estimated size.
    """
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    sizes = spread.groupBy("slot", "value").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b"))
    sizes = written(sizes.filter("n > 1"), "simhash-groups")
    twos = sizes.filter((F.col("n") == 2) & near).select("a", "b")
    large = sizes.filter("n > 2").select("slot", "value")
    return twos, spread.join(large.hint("merge"), ["slot", "value"], "left_semi")


def heads(bits: np.ndarray, max_bits: int) -> np.ndarray:
    """For each of some distinct fingerprints the first of those it is connected with."""
    out = np.full(len(bits), -1)
    left = np.arange(len(bits))
    while len(left):
        head, left = left[0], left[1:]
        out[head] = head
        front = [np.array([head])]
        while front and len(left):
            some = front.pop()
            width = max(1, (1 << 18) // len(left))
            if len(some) > width:
                front.append(some[width:])
                some = some[:width]
            near = (np.bitwise_count(bits[some, None] ^ bits[None, left]) <= max_bits).any(axis=0)
            if near.any():
                out[left[near]] = head
                front.append(left[near])
                left = left[~near]
    return out


def _few_heads(bits: list[int], max_bits: int) -> list[int]:
    """``heads`` of a handful of fingerprints."""
    out = [-1] * len(bits)
    for head in range(len(bits)):
        if out[head] < 0:
            out[head], front = head, [head]
            while front:
                i = front.pop()
                new = [j for j, h in enumerate(out) if h < 0 and (bits[i] ^ bits[j]).bit_count() <= max_bits]
                for j in new:
                    out[j] = head
                front += new
    return out


def _searched(rows: DataFrame, max_bits: int) -> DataFrame:
    """``(a, b)``: for the rows ``(bits, slot, value)`` of each group, links from the smallest of what is connected."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [np.empty(0, np.int64)], None
        for batch in batches:
            bits, slots, values = (batch.column(c).to_numpy() for c in ("bits", "slot", "value"))
            cuts = np.flatnonzero((slots[1:] != slots[:-1]) | (values[1:] != values[:-1])) + 1
            found: tuple[list, list] = ([], [])
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bits)], strict=True):
                if i < j:
                    if (slots[i], values[i]) != at:
                        linked(np.concatenate(held), *found)
                        held, at = [], (slots[i], values[i])
                    held.append(bits[i:j])
            yield shaped(*found)
        found = ([], [])
        linked(np.concatenate(held), *found)
        yield shaped(*found)

    def linked(bits: np.ndarray, a: list, b: list) -> None:
        bits = np.sort(bits)
        if len(bits) <= 24:
            few = bits.view(np.uint64).tolist()
            head = np.array(_few_heads(few, max_bits), np.int64)
        else:
            head = heads(bits, max_bits)
        other = np.flatnonzero(head != np.arange(len(bits)))
        a.append(bits[head[other]])
        b.append(bits[other])

    def shaped(a: list, b: list) -> pa.RecordBatch:
        ends = [np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    own = rows.select("bits", "slot", "value").repartition("slot", "value").sortWithinPartitions("slot", "value")
    return own.mapInArrow(kernel, "a bigint, b bigint")


def links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``(a, b)`` over distinct ``prints(bits)``: links that connect all that differ in at most ``max_bits`` bits.

    A link joins two members of one component, and all components are connected; not every pair is a link.
    """
    spread = prints.select("bits", F.inline(variants(F.col("bits"), max_bits)))
    pairs, crowded = _met(spread, max_bits)
    return pairs.unionByName(_searched(crowded, max_bits)).distinct()


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    max_bits: int = 4,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most ``max_bits`` bits; ``component_id`` is the
    smallest id reachable over links. Texts that are NULL, empty or without words have fingerprint 0 and
    are linked like any other. Repeated rows and equal ids stay and share a component; a NULL id counts
    for no ``component_id`` (NULL if all of the component are). Other columns, whatever their names, are
    not read. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id, text, shingle).withColumnRenamed(id, "id"), "simhash-prints")
    smallest_ids = written(prints.groupBy("bits").agg(F.min("id").alias("head")), "simhash-heads")
    groups = connected_components(links(smallest_ids.select("bits"), max_bits))
    groups = groups.withColumnsRenamed({"id": "bits", "component": "group"})
    tied = smallest_ids.join(groups.hint("merge"), "bits")
    ids = tied.groupBy("group").agg(F.min("head").alias("smallest"))
    smallest = tied.join(ids.hint("merge"), "group").select("bits", "smallest")
    every = smallest_ids.join(smallest.hint("merge"), "bits", "left").select("bits", F.coalesce("smallest", "head").alias("component_id"))
    return prints.join(every.hint("merge"), "bits").select(
        F.col("id").alias(id), F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each component of ``near_duplicates``.

    The one with the smallest id stays (NULL is the largest), among equal ids that with the smallest text
    hash, and of equal rows any one.
    """
    name = free_name(docs, "simhash_key")
    key = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.xxhash64(text).alias("mark"))
    keyed = docs.withColumn(name, key)
    found = near_duplicates(keyed, name, text, **how)
    first = found.filter(F.col(name) == F.col("component_id")).select(name).distinct()
    # Equal rows meet in a partial aggregate, not in one task.
    return keyed.join(first.hint("merge"), name, "left_semi").dropDuplicates([name]).select(*docs.columns)
