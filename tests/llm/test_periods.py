"""Periodic runs against a plain scan of every period."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from strandwork.llm import periods
from strandwork.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("key", "id", "words", "found", "period", "start", "plain")],
    ]
)


def naive_runs(words):
    """(start, length, period), smallest periods only."""
    found = {}
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    w = np.array([code[x] for x in words], np.int64)
    n = len(w)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[False], w[:-q] == w[q:], [False]])
        cuts = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
            length = b - a + q
            if length >= 4 * q and (a, length) not in found:
                found[a, length] = q
    return sorted((a, length, q) for (a, length), q in found.items() if length >= 6)


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(doc, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    words = planted(doc, words) if plant else words
    runs = naive_runs(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
    lines = "".join(f"{a},{length},{q}\n" for a, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *shown, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def odd_texts():
    random = np.random.default_rng(3)
    out = [None, "", " \n\t", "one", "a " * 6, "a " * 5, "a b " * 4, "a b a b a b a", "É é " * 9 + "  x"]
    for size, letters in ((300, 2), (700, 3), (2000, 2), (900, 1), (1500, 400)):
        out.append(" ".join(f"w{i}" for i in random.integers(0, letters, size)))
    for _ in range(12):  # nested and neighbouring runs
        parts = []
        for _ in range(6):
            unit = [f"u{i}" for i in random.integers(0, 3, random.integers(1, 25))]
            parts += unit * int(random.integers(1, 9)) + unit[: int(random.integers(0, len(unit)))]
        unit = parts[: int(random.integers(1, 60))]
        out.append("\n".join(parts + unit * 5))
    fib, last = ["a", "b"], ["a"]
    while len(fib) < 1500:
        fib, last = fib + last, fib
    out += [" ".join(fib), "\t".join(fib[:200] * 5), " ".join(f"x{i % 700}" for i in range(2900))]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("tile", [periods.TILE, 64, 256])
def test_against_scan(spark, tile):
    texts = list(enumerate(odd_texts())) + [(None, "r s " * 50), (3, "one"), (3, "one")]
    table = spark.createDataFrame([(*t, *["x"] * 7) for t in texts], SCHEMA).repartition(3)
    answer = periods.periodic_runs(table, rewrite=periods.planted, tile=tile)
    assert rows(answer) == sorted((expected(*t) for t in texts), key=repr)


def test_without_planting_and_text_ids(spark):
    texts = [(f"d{i}", t) for i, t in enumerate(odd_texts())]
    table = spark.createDataFrame(texts, "doc_id string, text string")
    want = [expected(*t, plant=False) for t in texts]
    assert rows(periods.periodic_runs(table, tile=128)) == sorted(want, key=repr)
    listed = periods.runs(table).groupBy("doc_id").count().collect()
    assert {r[0]: r[1] for r in listed} == {w[0]: w[1] for w in want if w[1]}
    row = periods.runs(spark.createDataFrame([("a", "x y " * 9)], table.schema)).collect()
    assert [tuple(r) for r in row] == [("a", 0, 18, 2, "x y")]


def test_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id for r in docs if len(r.text or "") < 40_000}
    want = [expected(*r) for r in docs if r.doc_id in short]
    answer = QUERIES["op12_runs"](spark, SMALL)
    assert answer.count() == len(docs)
    assert rows(answer.filter(answer.doc_id.isin(short))) == sorted(want, key=repr)


def test_text_beyond_a_tile_and_a_slice(spark):
    random = np.random.default_rng(1)
    unit = [f"long{i}" for i in range(21_000)]
    words = [f"w{i}" for i in random.integers(0, 50_000, 30_000)] + unit * 5 + ["end"] + ["z"] * 70_000
    table = spark.createDataFrame([(11, " ".join(words)), (12, "plain text")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in periods.periodic_runs(table).collect()}
    assert (got[11].n_runs, got[11].start, got[11].length, got[11].period) == (2, 135_001, 70_000, 1)
    runs = f"{30_000},{105_000},{21_000}\n{135_001},{70_000},{1}\n"
    assert got[11].runs_sha256 == hashlib.sha256(runs.encode()).hexdigest()
    kept = words[:51_000] + ["end", "z"]
    assert got[11].collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
    assert got[12].n_runs == 0


def test_tiles_cover_every_period():
    for n in (1, 50, 64, 65, 1000, 70_000):
        found = list(periods.tiles(n, 64))
        for period in (1, 2, 7, 8, 9, 100, n // 4):
            if 1 <= period <= n // 4:
                mine = [t for t in found if t[2] <= period < t[3]]
                assert {i for a, b, _, _ in mine for i in (a, b)} >= {0, n}


def test_empty(spark):
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0
