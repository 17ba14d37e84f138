"""Periodic runs of words by scale-tiled distribution.

A run is a stretch of words with smallest period ``q`` and at least ``exponent`` periods that neither
neighbour prolongs. Periods are handled by octaves ``[P, 2P)``. A document is cut into tiles whose size and
overlap follow the octaves they answer for; a document of ordinary length is one tile for all of them.
Tiles know nothing of each other. In a tile, boundaries stand every ``P`` words. Any run of the octave has
a boundary after which ``2P`` words equal those one period later, which a block hash finds for all
boundaries and periods at once; there the Z-values of the period, the number of words that agree forward
and backward of the boundary, give the fragment of the run that lies in the tile. Where the
words at a boundary already belong to a fragment of a smaller period, longer ones are its multiples and
are left out.

Spark brings together the fragments of a document and period, joins those that touch, and hands the runs
back to their document. Only documents with a fragment travel with their words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.llm.store import written
from strandwork.llm.words import mixed, texts

EXPONENT = 4
LEAST_WORDS = 6
#: Words of a tile for the smallest octaves; a tile answers for periods up to an eighth of its words.
TILE = 1 << 16
_SLICE = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tiles(n: int, size: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """``(begin, end, low, high)`` of the tiles of ``n`` words: where they lie and the periods they answer for."""
    low = 1
    while n > size:
        top = max(1, size // 16)  # the largest octave of these tiles
        for at in range(0, n, size):
            yield max(0, at - 2 * top), min(n, at + size + EXPONENT * top), low, 2 * top
        low, size = 2 * top, 16 * size
    if n:
        yield 0, n, low, n


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


def _z_forward(w: np.ndarray, m: int, p: int, step: int) -> int:
    """Where from ``m`` on the words stop to equal those ``p`` later."""
    while True:
        stop = min(m + step, len(w) - p)
        differs = w[m:stop] != w[m + p : stop + p]
        if differs.any():
            return m + int(differs.argmax())
        if stop == len(w) - p:
            return stop
        m, step = stop, 2 * step


def _z_backward(w: np.ndarray, m: int, p: int, step: int) -> int:
    """Where the words that equal those ``p`` later begin, going back from ``m``."""
    while m:
        stop = max(0, m - step)
        differs = w[stop:m] != w[stop + p : m + p]
        if differs.any():
            return m - int(differs[::-1].argmax())
        m, step = stop, 2 * step
    return 0


def fragments(pieces: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """``(piece, period, begin, right)``: in ``[begin, right)`` of a piece each word equals that a period later.

    The stretches are as long as their piece allows and hold at least two octaves; only smallest periods.
    """
    rank = sorted(range(len(pieces)), key=lambda i: -len(pieces[i]))
    sizes = np.array([len(pieces[i]) for i in rank], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    w = np.empty(int((sizes + 1).sum()), np.int64)
    for k, i in enumerate(rank):  # a word of its own ends each piece, so nothing agrees across
        w[starts[k] : starts[k] + sizes[k]] = pieces[i]
        w[starts[k] + sizes[k]] = -1 - k
    n = len(w)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(w.view(np.uint64)) * _powers(_BASE, n), out=sums[1:])
    unshift = _powers(_INVERSE, n)
    covered = np.zeros(n, np.int64)  # the end of what a smaller period explains
    octave = 1
    while len(sizes) and sizes[0] >= EXPONENT * octave:
        live = int(np.searchsorted(-sizes, -EXPONENT * octave, "right"))
        n = int(starts[live - 1] + sizes[live - 1] + 1)
        found = []
        last = (0, 0)
        for m, p in _meetings(sums, unshift, n, octave, covered):
            if last[0] == p and m < last[1]:
                continue
            right = _z_forward(w[:n], m, p, 2 * octave)
            last = (p, right)
            if right - m >= 2 * octave:  # hashes only propose
                found.append((p, _z_backward(w, m, p, 2 * octave), right))
        for p, begin, right in found:
            k = int(np.searchsorted(starts, begin, "right")) - 1
            yield rank[k], p, begin - int(starts[k]), right - int(starts[k])
            span = covered[begin : right + p]
            np.maximum(span, right + p, out=span)
        octave *= 2


def _meetings(sums: np.ndarray, unshift: np.ndarray, n: int, octave: int, covered: np.ndarray) -> list[tuple[int, int]]:
    """Boundaries and periods of the octave, by period, where blocks of two octaves agree unexplained."""
    blocks = (sums[2 * octave : n + 1] - sums[: n + 1 - 2 * octave]) * unshift[: n + 1 - 2 * octave]
    rows = len(blocks) // octave - 1
    if rows < 1:
        return []
    later = blocks[octave : octave * (rows + 1)].reshape(rows, octave)
    row, shift = np.nonzero(later == blocks[: octave * rows : octave, None])
    m, p = row * octave, shift + octave
    new = covered[m] < m + p + 2 * octave
    m, p = m[new], p[new]
    order = np.lexsort((m, p))
    return list(zip(m[order].tolist(), p[order].tolist(), strict=True))


_FOUND = "array<struct<period:bigint,begin:bigint,right:bigint>>"


def _solved(docs: DataFrame, id: str, text: str, rewrite: Callable | None, size: int) -> DataFrame:
    """``(key, id, words, plain, found)``: fragments of every row; the words only where there are some."""
    kind = docs.schema[id].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for run in texts(batch.column(1), _SLICE):
                ids = batch.column(0).slice(run.first, len(run))
                words = [run.text(i).split() for i in range(len(run))]  # bytes split at ASCII white space
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(ids.to_pylist(), words, strict=True)]
                known: dict[bytes, int] = {}
                number = known.setdefault
                pieces, origin = [], []
                for i, row in enumerate(words):
                    codes = np.fromiter((number(w, len(known)) for w in row), np.int64, len(row))
                    for begin, end, low, high in tiles(len(row), size):
                        pieces.append(codes[begin:end])
                        origin.append((i, begin, low, high))
                found: list[list[dict]] = [[] for _ in words]
                for piece, period, begin, right in fragments(pieces):
                    i, base, low, high = origin[piece]
                    if low <= period < high:
                        found[i].append({"period": period, "begin": base + begin, "right": base + right})
                joined = [b" ".join(w) for w in words]
                columns = [
                    pa.array(np.arange(key, key + len(run))),
                    ids,
                    pa.array([j.decode() if f else None for j, f in zip(joined, found, strict=True)], pa.string()),
                    pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
                    pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in ("period", "begin", "right")]))),
                ]
                key += len(run)
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "words", "plain", "found"])

    return docs.select(id, text).mapInArrow(
        kernel, f"key bigint, id {kind}, words string, plain string, found {_FOUND}"
    )


def stitched(found: DataFrame) -> DataFrame:
    """``(key, start, length, period)``: whole runs from the fragments ``found(key, period, begin, right)``."""
    by_run = W.partitionBy("key", "period").orderBy("begin", "right")
    reached = F.max("right").over(by_run.rowsBetween(W.unboundedPreceding, -1))
    opens = (reached.isNull() | (F.col("begin") > reached)).cast("int")
    rows = found.withColumn("opens", opens).withColumn("number", F.sum("opens").over(by_run))
    rows = rows.groupBy("key", "period", "number").agg(F.min("begin").alias("start"), F.max("right").alias("right"))
    rows = rows.withColumn("length", F.col("right") - F.col("start") + F.col("period"))
    whole = (F.col("length") >= EXPONENT * F.col("period")) & (F.col("length") >= LEAST_WORDS)
    return rows.filter(whole).select("key", "start", "length", "period")


def _with_runs(solved: DataFrame) -> DataFrame:
    """``(id, words, runs)`` of the rows with fragments; ``runs`` is NULL where none of them makes a run."""
    runs = stitched(solved.select("key", F.inline("found")))
    runs = runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    return solved.filter(F.size("found") > 0).join(runs, "key", "left").select("id", "words", "runs")


def _collapsed(words: str, runs: list[dict]) -> str:
    """The words without what a run repeats after its first period."""
    row = words.split(" ")
    kept = np.ones(len(row), bool)
    for r in runs:
        kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
    return " ".join(w for w, k in zip(row, kept.tolist(), strict=True) if k)


def _summed(words: str, runs: list[dict]) -> tuple:
    """The answer row of a text; ``runs`` ascend by start and period."""
    best: dict | None = None
    for r in runs:  # the greater of two quotients, exactly
        if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
            best = r
    lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
    shown = [None] * 4
    if best is not None:
        shown = [best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]]
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, _collapsed(words, runs))]
    return (len(runs), *shown, *digests)


def periodic_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", rewrite: Callable | None = None, tile: int = TILE
) -> DataFrame:
    """The runs of every row of ``docs``, summed up in ``(id, n_runs, start, length, period, exponent_milli,
    runs_sha256, collapsed_sha256)``.

    The run given is that with the greatest length over period (then the first, then the shortest period);
    without runs the four are NULL. ``runs_sha256`` is over the lines ``start,length,period`` of all runs,
    ``collapsed_sha256`` over the words, joined by one space, without those that a run repeats after its
    first period. ``rewrite(id, words)`` may change the list of words (bytes) beforehand. A NULL or empty
    text has no words. Repeated rows, equal and NULL ids are rows of their own; other columns are not read;
    an empty table gives an empty result.
    """
    solved = written(_solved(docs, id, text, rewrite, tile), "periods-solved")
    kind = docs.schema[id].dataType.simpleString()
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    digests = ["runs_sha256", "collapsed_sha256"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("words"), batch.column("runs"), strict=True)
            table = list(zip(*(_summed(w.as_py(), r.as_py() or []) for w, r in rows), strict=True))
            if table:
                arrays = [pa.array(c, pa.int64()) for c in table[:5]] + [pa.array(c, pa.string()) for c in table[5:]]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=[id, *names, *digests])

    longs = ", ".join(f"{c} bigint" for c in names)
    schema = f"`{id}` {kind}, {longs}, {', '.join(f'{c} string' for c in digests)}"
    some = _with_runs(solved).mapInArrow(kernel, schema)
    columns = [F.col("id").alias(id), F.lit(0).cast("bigint").alias("n_runs")]
    columns += [F.lit(None).cast("bigint").alias(c) for c in names[1:]]
    columns += [F.lit(hashlib.sha256(b"").hexdigest()).alias(digests[0]), F.col("plain").alias(digests[1])]
    return some.unionByName(solved.filter(F.size("found") == 0).select(*columns))


def runs(docs: DataFrame, id: str = "doc_id", text: str = "text", tile: int = TILE) -> DataFrame:
    """``(id, start, length, period, text)``: one row per run of a text, with the words of its first period."""
    solved = written(_solved(docs, id, text, None, tile), "periods-solved")
    rows = _with_runs(solved).select("id", F.split("words", " ").alias("words"), F.explode("runs").alias("run"))
    first = F.array_join(F.slice("words", F.col("run.start") + 1, F.col("run.period")), " ")
    return rows.select(F.col("id").alias(id), "run.start", "run.length", "run.period", first.alias("text"))


def planted(id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of which a tenth of the ids, by checksum, repeat from some place on with some period."""
    mark = 1 if id is None else zlib.crc32(str(id).encode())
    n, g = len(words), mark // 10
    if mark % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
