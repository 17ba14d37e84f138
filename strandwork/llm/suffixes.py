"""Exact substring dedup by distributed prefix doubling with discarding.

The rank of a position is a 64-bit fingerprint of the bytes that begin there, so equal prefixes have equal
ranks on every machine. Ranks double: that of 2h bytes is made from the pair (rank of h at p, rank of h at
p + h), for 8, 16 and 32 bytes and then ``length``. Spark brings equal ranks together, and positions whose
rank is unique are discarded before the next, longer round:

1. whole texts: of equal ones only the smallest id goes on;
2. sampled positions at ``SAMPLED`` bytes. In every ``length``-byte string the positions with the smallest
   rank are sampled, the same ones in every copy. A string whose sampled prefix is in one text only is
   unique and is discarded;
3. the strings that are left, at ``length`` bytes: the smallest id that has each of them.

Equality is that of 64-bit fingerprints. Among 10^8 different strings the chance of any false match is
about 3 in 10^4; no text is compared across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwork.llm.chunks import (
    NO_ID,
    QUESTION,
    Chunk,
    TextChunks,
    answer_values,
    answered,
    bucket_bits,
    id_column,
    questions,
    smallest,
    total,
)
from strandwork.llm.store import written

#: Bytes of the prefix that is ranked at sampled positions, and leading bits that are enough to discard by it.
SAMPLED = 20
_SAMPLE_BITS = 44
_RUN_BYTES = 1 << 20
TEXT, SAMPLE, STRING = 0, 1, 2


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    r = first * np.uint64(0x9E3779B97F4A7C15)
    r ^= r >> np.uint64(32)
    r += second
    r *= np.uint64(0xD6E8FEB86659FD93)
    r ^= r >> np.uint64(29)
    r *= np.uint64(0xBF58476D1CE4E5B9)
    r ^= r >> np.uint64(32)
    return r


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number (none for fewer than eight bytes)."""
    n = len(data) - 7
    if n <= 0:
        return np.empty(0, np.uint64)
    return np.ndarray((n,), "<u8", buffer=np.ascontiguousarray(data).data, strides=(1,)).astype(np.uint64)


def doubled(ranks: np.ndarray, shift: int) -> np.ndarray:
    """Ranks ``shift`` bytes longer: of each position with the one ``shift`` further on."""
    return paired(ranks[: max(0, len(ranks) - shift)], ranks[shift:])


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = pick(values[:-have], values[have:])
        have *= 2
    return pick(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def string_keys(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the ``length``-byte strings at some positions: 16 and 32 bytes, then the last 32 as well."""
    whole = eights(data)

    def sixteen(shift: int) -> np.ndarray:
        return paired(whole[at + shift], whole[at + shift + 8])

    last = length - 32
    return paired(paired(sixteen(0), sixteen(16)), paired(sixteen(last), sixteen(last + 16)))


def _coarse(ranks: np.ndarray) -> np.ndarray:
    drop = np.uint64(64 - _SAMPLE_BITS)
    return ranks >> drop << drop


def _text_keys(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Long enough texts and fingerprints of them."""
    at = np.flatnonzero(np.diff(chunk.starts) >= length)
    data = chunk.data
    digests = [hashlib.sha256(data[chunk.starts[i] : chunk.starts[i + 1]]).digest()[:8] for i in at.tolist()]
    return at, np.frombuffer(b"".join(digests), "<u8").astype(np.uint64)


def _first_of(chunk: Chunk, length: int) -> np.ndarray:
    """Whether each text is no copy of one with a smaller id."""
    at, keys = _text_keys(chunk, length)
    least = answer_values(chunk.answers, TEXT)
    first = np.ones(len(chunk.ids), bool)
    if len(at):
        first[at] = least[np.unique(keys, return_inverse=True)[1]] >= chunk.ids[at]
    return first


@dataclass
class Stretches:
    """The strings of a run of texts, as stretches that share their sampled position.

    ``rank`` is that of the sampled prefix: the smallest one in every string of the stretch. It is the
    same wherever the string is found, so strings with different ranks are different.
    """

    data: np.ndarray
    starts: np.ndarray  # of the texts in ``data``, one more at the end
    rows: np.ndarray  # of the texts in the chunk
    begin: np.ndarray
    size: np.ndarray
    rank: np.ndarray

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """Positions of the strings in the wanted stretches."""
        begin, size = self.begin[wanted], self.size[wanted]
        stops = np.cumsum(size)
        return np.repeat(begin - (stops - size), size) + np.arange(int(stops[-1]) if len(stops) else 0)


def _stretches(chunk: Chunk, length: int) -> Iterator[Stretches]:
    """Of the texts that are first of their kind and long enough, in runs."""
    first = _first_of(chunk, length)
    for run in chunk.runs(_RUN_BYTES):
        sizes = np.diff(run.starts)
        mine = np.flatnonzero(first[run.first : run.first + len(run)] & (sizes >= length))
        if len(mine) == 0:
            continue
        spans = zip(run.starts[mine].tolist(), run.starts[mine + 1].tolist(), strict=True)
        data = np.concatenate([run.data[a:b] for a, b in spans])
        starts = np.concatenate([[0], np.cumsum(sizes[mine])])
        sixteen = doubled(eights(data), 8)
        more = SAMPLED - 16
        ranks = _coarse(paired(sixteen[: len(sixteen) - more], sixteen[more:]))
        least = sliding(ranks, length - SAMPLED + 1, np.minimum)
        changes = np.ones(len(least), bool)
        changes[1:] = least[1:] != least[:-1]
        # Strings must not cross into the next text.
        over = starts[1:-1] - length + 1
        changes[over] = True
        changes[starts[1:-1]] = True
        begin = np.flatnonzero(changes)
        size = np.diff(begin, append=len(least))
        text = np.searchsorted(starts, begin, "right") - 1
        inside = begin <= starts[text + 1] - length
        begin, size = begin[inside], size[inside]
        yield Stretches(data, starts, run.first + mine, begin, size, least[begin])


def _sample_keys(found: list[Stretches]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sampled ranks of a chunk, and 2 where two of its texts have it, else 1."""
    keys = np.concatenate([np.empty(0, np.uint64), *[f.rank for f in found]])
    rows = np.concatenate([np.empty(0, np.int64), *[f.rows[f.text_of(f.begin)] for f in found]])
    order = np.argsort(keys, kind="stable")  # rows ascend within a key
    keys, rows = keys[order], rows[order]
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[1:] != keys[:-1]
    opens = np.flatnonzero(opens)
    closes = np.append(opens[1:], len(keys)) - 1
    return keys[opens], 1 + (rows[opens] != rows[closes])[: len(opens)]


@dataclass
class Left:
    """The strings of a chunk that are left after the sampled round, in ascending order of keys."""

    order: np.ndarray  # into the strings in order of position
    opens: np.ndarray  # where each distinct key begins
    keys: np.ndarray
    rows: np.ndarray  # by position
    places: np.ndarray  # in the text, by position


def _left(chunk: Chunk, length: int) -> Left:
    found = list(_stretches(chunk, length))
    samples = _sample_keys(found)[0]
    known = samples[answer_values(chunk.answers, SAMPLE) >= 2]
    keys, rows, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for f in found:
        if len(known) == 0:
            break
        again = known[np.minimum(np.searchsorted(known, f.rank), len(known) - 1)] == f.rank
        at = f.places(again)
        text = f.text_of(at)
        keys.append(string_keys(f.data, at, length))
        rows.append(f.rows[text])
        places.append(at - f.starts[text])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    opens = np.ones(len(keys), bool)
    opens[1:] = keys[1:] != keys[:-1]
    return Left(order, opens, keys, np.concatenate(rows), np.concatenate(places))


def deduplicated(
    docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50, keep_text: bool = False
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``docs``, and ``kept`` if asked for.

    A byte is removed if a ``length``-byte string that covers it also begins in a text with a smaller id,
    judged on the texts as they came; ``n_spans`` counts maximal removed runs. Ids are whole numbers; a
    NULL id is larger than any other, and equal ids are not smaller than each other, so repeated rows
    keep what only they share. NULL and empty texts have no bytes; texts below ``length`` bytes lose
    nothing. ``kept`` is binary, as a cut may split a character. Other columns are not read; an empty
    table gives an empty result.
    """
    if length < 32 + 16 or length < 2 * SAMPLED:
        raise ValueError("strings of 48 bytes and more only")
    chunks = TextChunks(docs, id, text, "suffixes")
    least = chunks.partitions
    sample_bits, string_bits = bucket_bits(chunks.n_bytes // 16, least), bucket_bits(chunks.n_bytes // 4, least)

    def ask_texts(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        at, keys = _text_keys(chunk, length)
        unique, inverse = np.unique(keys, return_inverse=True)
        ids = np.full(len(unique), NO_ID)
        np.minimum.at(ids, inverse, chunk.ids[at])
        yield questions(chunk.number, TEXT, unique, ids, bucket_bits(0, least))

    def ask_samples(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        yield questions(chunk.number, SAMPLE, *_sample_keys(list(_stretches(chunk, length))), sample_bits)

    def ask_strings(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        left = _left(chunk, length)
        opens = np.flatnonzero(left.opens)
        ids = chunk.ids[left.rows[left.order]]
        least = np.minimum.reduceat(ids, opens) if len(opens) else ids
        yield questions(chunk.number, STRING, left.keys[opens], least, string_bits)

    def cut(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        left = _left(chunk, length)
        least = answer_values(chunk.answers, STRING)
        gone = np.zeros(len(left.keys), bool)
        if len(gone):
            gone[left.order] = least[np.cumsum(left.opens) - 1] < chunk.ids[left.rows[left.order]]
        places, rows = left.places[gone], left.rows[gone]
        opens = np.flatnonzero(np.diff(rows, prepend=-1))
        ends = [*opens[1:].tolist(), len(rows)]
        edges = {int(rows[a]): places[a:b] for a, b in zip(opens.tolist(), ends, strict=False)}
        yield _results(chunk, _first_of(chunk, length), edges, length, id, keep_text)

    texts_seen = written(answered(chunks.map(ask_texts, QUESTION), smallest), "suffixes-texts")
    samples = written(answered(chunks.map(ask_samples, QUESTION, texts_seen), total), "suffixes-samples")
    strings = written(answered(chunks.map(ask_strings, QUESTION, texts_seen, samples), smallest), "suffixes-strings")
    schema = f"`{id}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return chunks.map(cut, schema + ", kept binary" * keep_text, texts_seen, samples, strings)


def _results(chunk: Chunk, first: np.ndarray, edges: dict, length: int, id: str, keep_text: bool) -> pa.RecordBatch:
    removed, spans, digests, kept = [], [], [], []
    for i in range(len(chunk.ids)):
        data = chunk.data[chunk.starts[i] : chunk.starts[i + 1]]
        gone = 0
        runs = 0
        if not first[i]:
            gone, runs, data = len(data), 1, data[:0]
        elif i in edges:
            steps = np.zeros(len(data) + 1, np.int32)
            steps[edges[i]] += 1  # distinct places
            steps[edges[i] + length] -= 1
            covered = np.cumsum(steps[:-1]) > 0
            gone = int(covered.sum())
            runs = int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum())
            data = data[~covered]
        removed.append(gone)
        spans.append(runs)
        digests.append(hashlib.sha256(data).hexdigest())
        kept.append(data.tobytes() if keep_text else None)
    columns = [
        id_column(chunk.ids),
        pa.array(np.diff(chunk.starts), pa.int64()),
        pa.array(removed, pa.int64()),
        pa.array(spans, pa.int64()),
        pa.array(digests, pa.string()),
    ]
    names = [id, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if keep_text:
        columns.append(pa.array(kept, pa.binary()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(columns, names=names)
