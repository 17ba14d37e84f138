"""Chunks of texts, and a packed exchange of 64-bit keys between chunks and buckets of keys.

An operator that asks about every n-gram or position of a corpus has more keys than it can send as rows.
Here every task packs its texts into chunks. A chunk asks about its distinct keys: sorted, cut into
buckets by their leading bits, and stored as compressed differences. Spark groups the questions by
bucket, each bucket reduces the values of equal keys over all chunks, and answers every chunk in the
order of its keys. The chunks are a table bucketed by chunk number, so answers meet them without moving
the texts again.

A key reaches a bucket at most once per chunk, so one with a third of all occurrences is no hot key, and
hashed keys fill the buckets evenly. There are never more questions than distinct keys of the chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.store import fresh_folder
from strandwork.llm.words import Texts, texts

#: Bytes of text in a chunk (a longer text is a chunk of its own), and keys that a bucket holds on average.
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1_000_000


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as bytes: each byte place of all numbers together, compressed where that helps."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    places = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [bytes([width])]
    for place in range(width):
        raw = np.ascontiguousarray(places[:, place]).tobytes()
        small = squeeze(raw)
        packed = len(small) < len(raw)
        body = small if packed else raw
        parts.append(len(body).to_bytes(8, "little") + bytes([packed]) + body)
    return b"".join(parts)


def unpack(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers of ``pack`` as unsigned 64-bit integers."""
    width, at = data[0], 1
    places = np.zeros((n, 8), np.uint8)
    for place in range(width):
        size, packed = int.from_bytes(data[at : at + 8], "little"), data[at + 8]
        body = data[at + 9 : at + 9 + size]
        raw = zstandard.ZstdDecompressor().decompress(body) if packed else body
        places[:, place] = np.frombuffer(raw, np.uint8)
        at += 9 + size
    return places.view("<u8").reshape(-1)


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed numbers as unsigned ones, small for small."""
    values = values.astype(np.int64)
    return ((values << 1) ^ (values >> 63)).view(np.uint64)


def unzigzag(values: np.ndarray) -> np.ndarray:
    return ((values >> np.uint64(1)) ^ (np.uint64(0) - (values & np.uint64(1)))).view(np.int64)


def bucket_bits(keys: int, least: int) -> int:
    """Leading bits that name the bucket, for so many keys over all chunks and at least ``least`` buckets."""
    return (max(1, keys // BUCKET_KEYS, least) - 1).bit_length()


QUESTION = "kind int, bucket bigint, chunk bigint, n bigint, keys binary, vals binary"
ANSWER = "kind int, bucket bigint, chunk bigint, n bigint, vals binary"


def questions(chunk: int, kind: int, keys: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """One row per bucket that the distinct ascending ``keys`` fall into."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    opens = np.flatnonzero(np.diff(bucket, prepend=-1))
    closes = np.append(opens[1:], len(keys))
    spans = list(zip(opens.tolist(), closes.tolist(), strict=True)) if len(keys) else []
    columns = [
        pa.array([kind] * len(spans), pa.int32()),
        pa.array([int(bucket[a]) for a, _ in spans], pa.int64()),
        pa.array([chunk] * len(spans), pa.int64()),
        pa.array([b - a for a, b in spans], pa.int64()),
        pa.array([pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in spans], pa.binary()),
        pa.array([pack(zigzag(values[a:b])) for a, b in spans], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "bucket", "chunk", "n", "keys", "vals"])


#: From the values of all chunks in order of their keys, and where each key begins, one value per key.
Reduce = Callable[[np.ndarray, np.ndarray], np.ndarray]


def total(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def smallest(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(values, starts)


def answered(asked: DataFrame, reduce: Reduce, owned: bool = False) -> DataFrame:
    """For each question its values after ``reduce`` over the equal keys of all chunks.

    With ``owned`` a value is doubled, plus one in one of the chunks that ask about its key.
    """

    def one_bucket(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk", kind="stable")
        sizes = group["n"].to_numpy()
        keys = np.concatenate(
            [np.cumsum(unpack(k, n), dtype=np.uint64) for k, n in zip(group["keys"], sizes, strict=True)]
        )
        values = np.concatenate([unzigzag(unpack(v, n)) for v, n in zip(group["vals"], sizes, strict=True)])
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        opens = np.ones(len(keys), bool)
        opens[1:] = ranked[1:] != ranked[:-1]
        reduced = reduce(values[order], np.flatnonzero(opens))[np.cumsum(opens) - 1]
        out = np.empty(len(keys), np.int64)
        out[order] = 2 * reduced + opens if owned else reduced
        parts = np.split(out, np.cumsum(sizes)[:-1])
        return group[["kind", "bucket", "chunk", "n"]].assign(vals=[pack(zigzag(p)) for p in parts])

    return asked.groupBy("kind", "bucket").applyInPandas(one_bucket, ANSWER)


def answer_values(cell: list[dict] | None, kind: int) -> np.ndarray:
    """The answers of one kind in the order of the chunk's keys."""
    rows = sorted((r for r in cell or () if r["kind"] == kind), key=lambda r: r["bucket"])
    return np.concatenate([np.empty(0, np.int64), *[unzigzag(unpack(r["vals"], r["n"])) for r in rows]])


@dataclass
class Chunk:
    """Texts back to back, their ids, and the answers that the chunk has got so far."""

    number: int
    ids: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    answers: list[dict]

    def runs(self, size: int) -> Iterator[Texts]:
        """The texts in runs of about ``size`` bytes."""
        i, n = 0, len(self.ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + size, "right")) - 1)
            yield Texts(i, self.data[self.starts[i] : self.starts[j]], self.starts[i : j + 1] - self.starts[i])
            i = j


class TextChunks:
    """The ids and texts of a table as a written table of chunks."""

    def __init__(self, docs: DataFrame, id: str, text: str, name: str, chunk_bytes: int = CHUNK_BYTES):
        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            base, number = TaskContext.get().partitionId() << 32, 0
            held: list[tuple[pa.Array, Texts]] = []
            size = 0

            def sealed() -> pa.RecordBatch:
                nonlocal number
                ids = pa.concat_arrays([h[0] for h in held])
                starts = np.cumsum([0, *np.concatenate([np.diff(h[1].starts) for h in held])])
                data = b"".join(h[1].data.tobytes() for h in held)
                number += 1
                columns = [
                    pa.array([base + number - 1], pa.int64()),
                    pa.array([len(data)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    pa.array([starts], pa.list_(pa.int64())),
                    pa.array([data], pa.binary()),
                ]
                return pa.RecordBatch.from_arrays(columns, names=["chunk", "n_bytes", "ids", "starts", "data"])

            for batch in batches:
                for run in texts(batch.column(1), chunk_bytes // 8):
                    if held and size + len(run.data) > chunk_bytes:
                        yield sealed()
                        held, size = [], 0
                    held.append((batch.column(0).slice(run.first, len(run)), run))
                    size += len(run.data)
            if held:
                yield sealed()

        session = docs.sparkSession
        self.partitions = max(1, int(session.conf.get("spark.sql.shuffle.partitions")))
        schema = "chunk bigint, n_bytes bigint, ids array<bigint>, starts array<bigint>, data binary"
        rows = docs.select(F.col(id).cast("bigint"), F.col(text).cast("binary")).mapInArrow(kernel, schema)
        self.table = f"{name}_{uuid.uuid4().hex}"
        writer = rows.write.format("parquet").bucketBy(self.partitions, "chunk").option("compression", "zstd")
        writer.option("path", fresh_folder(docs, name)).saveAsTable(self.table)
        self.rows = session.table(self.table)
        self.n_bytes = self.rows.agg(F.sum("n_bytes")).first()[0] or 0

    def map(self, kernel: Callable[[Chunk], Iterator[pa.RecordBatch]], schema: str, *answers: DataFrame) -> DataFrame:
        """``kernel`` over all chunks, each with its ``answers``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = batch.column(1)[i].values
                    cells = [batch.column(j)[i].as_py() or [] for j in range(4, batch.num_columns)]
                    chunk = Chunk(
                        batch.column(0)[i].as_py(),
                        ids.fill_null(NO_ID).to_numpy(zero_copy_only=False),
                        batch.column(2)[i].values.to_numpy(),
                        np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8),
                        [row for cell in cells for row in cell],
                    )
                    yield from kernel(chunk)

        rows = self.rows.select("chunk", "ids", "starts", "data")
        for i, table in enumerate(answers):
            packed = table.groupBy("chunk").agg(
                F.collect_list(F.struct("kind", "bucket", "n", "vals")).alias(f"answers_{i}")
            )
            rows = rows.join(packed, "chunk", "left")
        return rows.mapInArrow(run, schema)


#: Stands for a NULL id: larger than any other.
NO_ID = np.iinfo(np.int64).max


def id_column(ids: np.ndarray) -> pa.Array:
    """Ids with NULL where there was none."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)
