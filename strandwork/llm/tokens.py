"""Token ids as files of canonical length-limited Huffman code.

Texts are tokenised once. Code lengths come from the counts of the ids over all texts and are limited, so
that one table decodes any code. The ids are written in ascending order of document as blocks of whole
documents, each decodable on its own; inside a block, bit-offset checkpoints every ``STRIDE`` ids let
many places be decoded at the same time.

The files are Parquet: a block is a row, which Spark commits and any store of the cluster can hold. A
folder has ``codebook`` (id, length) and ``blocks`` (part, block, start inside the part, ids of documents,
ids per document, checkpoints, code bits). Parts and blocks ascend with the documents.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.llm.store import fresh_folder, written
from strandwork.llm.words import Texts, prefix_sums, range_hashes, texts

STRIDE = 1024
BLOCK_IDS = 1 << 16
MOST_BITS = 16

_RUN_BYTES = 256 << 10
#: Bytes that a worker keeps of pieces it has encoded, and of pieces that it encodes at a time.
_KEPT_BYTES = 32 << 20
_LINE_BYTES = 64 << 10
#: Pieces whose values are gathered at a time.
_GATHERED = 1 << 15
#: Ids of one part of the files.
_PART_IDS = 32 << 20


# -- tokenising


class PieceEncoder:
    """Ids of whole texts, put together from the ids of pieces that repeat.

    The pre-tokeniser of byte-level BPE never joins what stands before a space that precedes a word, nor
    the words on both sides of a newline. Between such places a text is cut into pieces, each distinct
    piece is encoded once by the tokenizers library, and remembered by the worker for later batches, up to
    a number of bytes; beyond them, pieces that came once are forgotten. Pieces are found by a hash, and
    every one is compared with the bytes remembered. A text with any other white space, where these places differ, is encoded whole, as is one with a piece
    that shares its hash with another.
    """

    _shared: dict[str, PieceEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else None
        self.words = _WordIds(self.tokenizer)
        self.forget()

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        """The encoder of this Python worker, kept between tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int32)  # of each key, ascending keys
        self.runs = np.empty(0, np.uint8)  # of each key: the runs it was in, 255 for any more
        self.begin = _Grown(np.zeros(1, np.int64))  # of each slot in ``ids``, one more at the end
        self.ids = _Grown(np.empty(0, np.uint32))
        self.bytes_begin = _Grown(np.zeros(1, np.int64))  # the same for the text of the pieces
        self.bytes = _Grown(np.empty(0, np.uint8))

    def kept_bytes(self) -> int:
        held = (self.begin, self.ids, self.bytes_begin, self.bytes)
        return self.keys.nbytes + self.slot.nbytes + self.runs.nbytes + sum(h.data.nbytes for h in held)

    def forget_rare(self) -> None:
        """Keeps the pieces of most runs, half of the bytes at most; what they earned counts half from here on."""
        size = 37 + 4 * np.diff(self.begin.array)[self.slot] + np.diff(self.bytes_begin.array)[self.slot]
        held = np.cumsum(np.bincount(self.runs, weights=size, minlength=256)[::-1])[::-1]
        least = max(2, int(np.argmax(np.append(held, 0) <= _KEPT_BYTES // 2)))
        kept = np.flatnonzero(self.runs >= least)
        kept = kept[np.argsort(self.slot[kept])]  # slots keep their order
        slots, keys, runs = self.slot[kept], self.keys[kept], self.runs[kept] >> 1
        ids, begin = _gathered(self.ids.array, self.begin.array, slots)
        data, bytes_begin = _gathered(self.bytes.array, self.bytes_begin.array, slots)
        self.begin, self.ids, self.bytes_begin, self.bytes = map(_Grown, (begin, ids, bytes_begin, data))
        order = np.argsort(keys)
        self.keys, self.slot, self.runs = keys[order], order.astype(np.int32), runs[order]

    def encode(self, run: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a run of texts, and how many each text has."""
        odd = _odd(run)
        while True:
            begin, row = _pieces(run, ~odd)
            end = np.append(begin[1:], len(run.data))
            last = np.append(row[1:] != row[:-1], True) if len(row) else np.empty(0, bool)
            end[last] = run.starts[row[last] + 1]
            keys = range_hashes(prefix_sums(run.data), begin, end)
            distinct, first, at = np.unique(keys, return_index=True, return_inverse=True)
            slots = self._slots(run, distinct, begin[first], end[first])[at]
            other = self._differ(run, slots, begin, end)
            if not other.any():
                break
            odd[row[other]] = True
        offsets = self.begin.array
        lengths = offsets[slots + 1] - offsets[slots]
        stops = np.cumsum(lengths)
        total = int(stops[-1]) if len(stops) else 0
        source = np.repeat(offsets[slots] - (stops - lengths), lengths)
        source += np.arange(total)
        ids = self.ids.array[source]
        sizes = np.bincount(row, weights=lengths, minlength=len(run)).astype(np.int64)
        if odd.any():
            ids, sizes = self._with_odd(run, odd, ids, sizes)
        return ids, sizes

    def _differ(self, run: Texts, slots: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces whose bytes are not those remembered."""
        offsets = self.bytes_begin.array
        sizes = end - begin
        differ = offsets[slots + 1] - offsets[slots] != sizes
        same = np.flatnonzero(~differ)
        tiled = len(same) == len(begin) and int(sizes.sum()) == len(run.data)  # then pieces follow each other
        sizes, stops = sizes[same], np.cumsum(sizes[same])
        steps = np.arange(int(stops[-1]) if len(stops) else 0)
        mine = run.data if tiled else run.data[np.repeat(begin[same] - (stops - sizes), sizes) + steps]
        steps += np.repeat(offsets[slots[same]] - (stops - sizes), sizes)
        theirs = self.bytes.array[steps]
        differ[same[np.searchsorted(stops, np.flatnonzero(mine != theirs), "right")]] = True
        return differ

    def _with_odd(self, run: Texts, odd: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        cuts = np.cumsum(sizes)[:-1]
        parts = np.split(ids, cuts)
        for i in np.flatnonzero(odd).tolist():
            encoded = self.tokenizer.encode_batch_fast([run.text(i).decode()], add_special_tokens=False)[0]
            parts[i] = np.array(encoded.ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _slots(self, run: Texts, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.kept_bytes() > _KEPT_BYTES:
            self.forget_rare()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        if not known.all():
            self._learn(run, keys[~known], begin[~known], end[~known])
            at = np.searchsorted(self.keys, keys)
        self.runs[at] += self.runs[at] < 255
        return self.slot[at].astype(np.int64)

    def _learn(self, run: Texts, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        slots = len(self.begin.array) - 1 + np.arange(len(keys))
        stops = np.cumsum(end - begin)
        data = run.data.tobytes()
        for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(stops // _LINE_BYTES)) + 1):
            whole = [data[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist(), strict=True)]
            ids, lengths = self._ids(whole)
            self.begin.add(self.begin.array[-1] + np.cumsum(lengths))
            self.ids.add(ids)
            self.bytes.add(np.frombuffer(b"".join(whole), np.uint8))
            self.bytes_begin.add(self.bytes_begin.array[-1] + np.cumsum(end[part] - begin[part]))
        places = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, places, keys)
        self.slot = np.insert(self.slot, places, slots)
        self.runs = np.insert(self.runs, places, 0)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces: straight from the merges where the words are plain, else by the whole tokenizer."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stops = np.cumsum(sizes)
        single = self.words.single(np.frombuffer(b"".join(pieces), np.uint8), stops - sizes, stops)
        flat, lengths = self.words.merged([pieces[i] for i in np.flatnonzero(single).tolist()])
        if single.all():
            return flat, lengths
        others = [pieces[i].decode() for i in np.flatnonzero(~single).tolist()]
        found = self.words.of(others)
        rest = [i for i, f in enumerate(found) if f is None]
        if rest:
            ids, counts = self._encoded([others[i] for i in rest])
            for i, part in zip(rest, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                found[i] = part.tolist()
        every = np.empty(len(pieces), np.int64)
        every[single], every[~single] = lengths, np.fromiter(map(len, found), np.int64, len(found))
        mine = np.repeat(single, every)
        out = np.empty(len(mine), np.uint32)
        out[mine], out[~mine] = flat, np.fromiter(chain.from_iterable(found), np.uint32)
        return out, every

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one line are encoded together, with a newline after each, and cut at its id again."""
        plain = np.array([self.newline is not None and "\n" not in p and bool(p.strip(" ")) for p in pieces], bool)
        lines = "".join([p + "\n" for p, ok in zip(pieces, plain, strict=True) if ok]) + "."
        rest = [p for p, ok in zip(pieces, plain, strict=True) if not ok]
        lengths = np.zeros(len(pieces), np.int64)
        joined, *singles = self.tokenizer.encode_batch_fast([lines, *rest], add_special_tokens=False)
        flat = np.array(joined.ids, np.uint32)
        cuts = np.flatnonzero(flat == self.newline)
        if len(cuts) != plain.sum():
            raise ValueError("the tokenizer joins newlines with words; pieces cannot be told apart")
        lengths[plain] = np.diff(cuts, prepend=-1) - 1
        alone = [np.array(s.ids, np.uint32) for s in singles]
        lengths[~plain] = [len(s) for s in alone]
        kept = np.delete(flat[: int(cuts[-1]) + 1] if len(cuts) else flat[:0], cuts)
        if not alone:
            return kept, lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        mine = np.repeat(plain, lengths)
        out[mine], out[~mine] = kept, np.concatenate(alone)
        return out, lengths


#: Fixed value: how byte-level BPE cuts a text into words.
_WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Letters up to here are letters in any version of Unicode.
_PLAIN = "\u0250"
#: How byte-level BPE shows a space.
_LETTER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[ord(c) for c in string.ascii_letters]] = True
_DIGIT[[ord(c) for c in string.digits]] = True
#: Words that are merged in one call.
_MERGED = 64


class _WordIds:
    """Ids of the words of plain pieces, straight from the library's merges, which is all that is left to do.

    Only for a byte-level BPE without normaliser; pieces with later letters, or with a token that the
    tokenizer takes out beforehand, are left to it.
    """

    def __init__(self, tokenizer):
        from tokenizers.models import BPE

        cut = {} if tokenizer.pre_tokenizer is None else json.loads(tokenizer.pre_tokenizer.__getstate__())
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        self.usable = plain and tokenizer.normalizer is None and isinstance(tokenizer.model, BPE)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.model = tokenizer.model
        self.find = regex.compile(_WORD).findall
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
        self.apart = self.usable and self._apart(tokenizer)
        # A token without a blank may be taken out of the midst of such a piece.
        self.lone = self.apart and not any(a.lstrip(" ").isalnum() for a in self.added)

    def _apart(self, tokenizer) -> bool:
        """Is there a byte that no text holds and that merges with nothing? Words on both sides of it stay apart."""
        model = json.loads(tokenizer.to_str())["model"]
        special = ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
        self.mark = chr(self.letters[0xFF])
        self.mark_id = tokenizer.token_to_id(self.mark)
        return (
            not any(model.get(name) for name in special)
            and self.mark_id is not None
            and sum(self.mark in token for token in model["vocab"]) == 1
        )

    def single(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces that are one word as they are: letters below ``_PLAIN`` only, or digits only, after a space or none."""
        if not self.lone:
            return np.zeros(len(begin), bool)
        body = begin + (data[begin] == 0x20)
        same = np.zeros(len(begin), bool)
        letter = _LETTER[data]
        lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8)
        lead &= (data[:-1] != 0xC3) | ((data[1:] != 0x97) & (data[1:] != 0xB7))  # signs of multiplication and division
        letter[:-1] |= lead
        letter[1:] |= lead
        for kind in (letter, _DIGIT[data]):
            sums = np.zeros(len(data) + 1, np.int32)
            np.cumsum(kind, out=sums[1:])
            same |= sums[end] - sums[body] == end - body
        return same & (body < end)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of single words, and how many each has; they are not kept, as their pieces are."""
        ids = []
        for i in range(0, len(words), _MERGED):
            line = b"\xff".join([*words[i : i + _MERGED], b""]).decode("latin-1").translate(self.letters)
            ids.append(np.array([t.id for t in self.model.tokenize(line)], np.uint32))
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        ends = flat == (self.mark_id if ids else 0)
        return flat[~ends], np.diff(np.flatnonzero(ends), prepend=-1) - 1

    def of(self, pieces: list[str]) -> list[list[int] | None]:
        """Ids of pieces of any words, None for those that are left to the tokenizer."""
        found: list[list[int] | None] = [None] * len(pieces)
        if not self.apart:
            return found
        mine = [i for i, p in enumerate(pieces) if (p.isascii() or max(p) < _PLAIN) and not any(a in p for a in self.added)]
        words = [self.find(pieces[i]) for i in mine]
        flat, lengths = self.merged([w.encode() for w in chain.from_iterable(words)])
        stops = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, words)])].tolist()
        ids = flat.tolist()
        for i, a, b in zip(mine, stops[:-1], stops[1:], strict=True):
            found[i] = ids[a:b]
        return found


def _gathered(values: np.ndarray, begin: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some slots back to back, and where each begins (one more at the end)."""
    sizes = begin[slots + 1] - begin[slots]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], values.dtype)
    for i in range(0, len(slots), _GATHERED):
        j = min(i + _GATHERED, len(slots))
        shift = np.repeat(begin[slots[i:j]] - starts[i:j], sizes[i:j])
        out[starts[i] : starts[j]] = values[shift + np.arange(starts[i], starts[j])]
    return out, starts


class _Grown:
    """An array that grows at its end, by a quarter at a time."""

    def __init__(self, first: np.ndarray):
        self.data, self.size = first, len(first)

    @property
    def array(self) -> np.ndarray:
        return self.data[: self.size]

    def add(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.data):
            wider = np.empty(max(size, len(self.data) * 5 // 4), self.data.dtype)
            wider[: self.size] = self.array
            self.data = wider
        self.data[self.size : size] = values
        self.size = size


def _odd(run: Texts) -> np.ndarray:
    """Texts with white space other than space and newline (or with bytes that may be such)."""
    data = run.data
    if len(data) == 0:
        return np.zeros(len(run), bool)
    flag = (data == 0x09) | ((data >= 0x0B) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x1F))
    second = data[1:]
    lead = data[:-1]
    flag[:-1] |= (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
    flag[:-1] |= ((lead == 0xE1) & (second == 0x9A)) | ((lead == 0xE3) & (second == 0x80))
    flag[:-1] |= (lead == 0xE2) & ((second == 0x80) | (second == 0x81))
    sums = np.concatenate([[0], np.cumsum(flag)])
    return sums[run.starts[1:]] > sums[run.starts[:-1]]


_STOP, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True
_ALNUM[[ord(c) for c in string.ascii_letters + string.digits]] = True


def _pieces(run: Texts, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, and their rows, in the ``wanted`` texts.

    A piece is a space and a word, a word, a newline, or white space before those. A word ends ahead of a
    stop that follows an ASCII letter or digit.
    """
    data, n = run.data, len(run.data)
    blank = (data == 0x20) | (data == 0x0A)
    opens = np.zeros(n + 1, bool)
    before = np.ones(n + 1, bool)
    before[1:] = blank
    before[run.starts] = True
    word = ~blank
    starts = np.flatnonzero(word & before[:-1])
    first = np.zeros(n + 1, bool)
    first[run.starts] = True
    inside = ~first[starts]  # else nothing is before it in its text
    previous = starts[inside] - 1
    spaced = data[previous] == 0x20
    opens[previous] = True  # a space goes with the word, a newline stands alone
    opens[starts] = True
    opens[starts[inside][spaced]] = False
    ends = np.flatnonzero(word[:-1] & blank[1:]) + 1 if n else np.empty(0, np.int64)
    opens[ends] = True
    stops = np.flatnonzero(_STOP[data[1:]] & _ALNUM[data[:-1]]) + 1 if n else np.empty(0, np.int64)
    opens[stops] = True
    opens[run.starts] = True
    # Where a text begins with a space before a word, that space is the begin of the piece already.
    begin = np.flatnonzero(opens[:n])
    row = np.searchsorted(run.starts, begin, "right") - 1
    keep = wanted[row]
    return begin[keep], row[keep]


def encoded(docs: DataFrame, id: str, text: str, tokenizer: str, end_id: int) -> DataFrame:
    """``(id, crc, place, n, ids)``: packed ids of each text with the end id, and what orders equal ids.

    Each task adds a row without ``n``, whose ``ids`` are the ids it has used and how often, as longs.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        place = TaskContext.get().partitionId() << 40
        counts, kind = _Counts(), None
        for batch in batches:
            kind = batch.column(0).type
            for run in texts(batch.column(1), _RUN_BYTES):
                ids, sizes = encoder.encode(run)
                counts.add(ids)
                counts.add(np.full(len(run), end_id))
                parts = [np.append(p, np.uint32(end_id)) for p in np.split(ids, np.cumsum(sizes)[:-1])]
                columns = [
                    batch.column(0).slice(run.first, len(run)),
                    pa.array([zlib.crc32(p.astype("<u4")) for p in parts], pa.int64()),
                    pa.array(np.arange(place, place + len(run))),
                    pa.array(sizes + 1),
                    pa.array([_packed(p) for p in parts], pa.binary()),
                ]
                place += len(run)
                yield pa.RecordBatch.from_arrays(columns, names=["id", "crc", "place", "n", "ids"])
        if kind is not None:
            nothing = [pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 3]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array([counts.packed()], pa.binary())], names=["id", "crc", "place", "n", "ids"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, text).mapInArrow(kernel, f"id {kind}, crc bigint, place bigint, n bigint, ids binary")


class _Counts:
    """How often ids were used."""

    def __init__(self):
        self.sums = np.zeros(1 << 16, np.int64)

    def add(self, ids: np.ndarray) -> None:
        found = np.bincount(ids)
        if len(found) > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros(len(found) - len(self.sums), np.int64)])
        self.sums[: len(found)] += found

    def packed(self) -> bytes:
        used = np.flatnonzero(self.sums)
        return np.concatenate([used, self.sums[used]]).tobytes()


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes for each id where that is enough, else four."""
    return ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype(np.int64)


# -- the code


def code_lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``most`` bits (package-merge); ``counts`` are positive."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    if n > 1 << most:
        raise ValueError("more ids than codes of that length")
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        joined = np.concatenate([leaves, pairs])
        rank = np.argsort(joined, kind="stable")
        level = joined[rank]
        is_leaf.append(rank < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for leaf in reversed(is_leaf):
        mine = int(leaf[:take].sum())
        lengths[:mine] += 1
        take = 2 * (take - mine)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Codebook:
    """Canonical code: ``ids`` ascending with their lengths; codes follow from those alone."""

    ids: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        self.most = max(1, int(self.lengths.max(initial=1)))
        order = np.lexsort((self.ids, self.lengths))
        codes = np.zeros(len(self.ids), np.uint64)
        steps = np.uint64(1) << (self.most - self.lengths[order]).astype(np.uint64)
        left = np.cumsum(steps) - steps
        codes[order] = left >> (self.most - self.lengths[order]).astype(np.uint64)
        self.codes = codes
        size = int(self.ids.max(initial=0)) + 1
        self.length_of = np.zeros(size, np.int64)
        self.length_of[self.ids] = self.lengths
        self.code_of = np.zeros(size, np.uint64)
        self.code_of[self.ids] = codes
        repeats = steps.astype(np.int64)
        self.table = np.zeros(1 << self.most, np.int64)
        self.table_length = np.ones(1 << self.most, np.int64)
        filled = int(repeats.sum())
        self.table[:filled] = np.repeat(self.ids[order], repeats)
        self.table_length[:filled] = np.repeat(self.lengths[order], repeats)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Code bits of ``ids``, and the bit offset of every ``STRIDE``-th one."""
        lengths = self.length_of[ids]
        stops = np.cumsum(lengths)
        offsets = stops - lengths
        shift = (64 - lengths - (offsets & 31)).astype(np.uint64)
        window = self.code_of[ids] << shift
        word = offsets >> 5
        size = int(stops[-1] + 31) // 32 + 1 if len(ids) else 1
        # Codes share no bit, so sums of halves below 2^32 are exact in doubles.
        high = np.bincount(word, weights=(window >> np.uint64(32)).astype(np.float64), minlength=size)
        low = np.bincount(word + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
        bits = (high[:size] + low[:size]).astype(">u4").tobytes()
        return bits[: (int(stops[-1]) + 7) // 8 if len(ids) else 0], offsets[::STRIDE]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks ``(bits, checkpoints, number of ids)``: all stretches between checkpoints in step."""
        sizes = [len(bits) + 8 for bits, _, _ in blocks]
        data = np.frombuffer(b"".join(bits + b"\0" * 8 for bits, _, _ in blocks), np.uint8)
        windows = np.ndarray((max(0, len(data) - 3),), ">u4", buffer=data.data, strides=(1,))
        bases = np.cumsum([0, *sizes])[:-1]
        bit = np.concatenate([np.asarray(c, np.int64) + 8 * b for (_, c, _), b in zip(blocks, bases, strict=True)])
        counts = [np.minimum(STRIDE, n - STRIDE * np.arange(len(c))) for _, c, n in blocks]
        lane_count = np.concatenate(counts).astype(np.int64)
        out = np.zeros((len(bit), STRIDE), np.int64)
        order = np.argsort(-lane_count, kind="stable")
        bit, lane_count = bit[order], lane_count[order]
        most, mask = self.most, (1 << self.most) - 1
        decoded = np.zeros((STRIDE, len(bit)), np.int64)
        live = len(bit)
        for step in range(STRIDE):
            while live and lane_count[live - 1] <= step:
                live -= 1
            if not live:
                break
            at = bit[:live]
            code = (windows[at >> 3].astype(np.int64) >> (32 - most - (at & 7))) & mask
            decoded[step, :live] = self.table[code]
            bit[:live] = at + self.table_length[code]
        out[order] = decoded.T
        ends = np.cumsum([len(c) for _, c, _ in blocks])
        lanes = np.split(out, ends[:-1])
        return [lane.reshape(-1)[:n] for lane, (_, _, n) in zip(lanes, blocks, strict=True)]


# -- files


def _block_schema(kind: str) -> str:
    return (
        f"part int, block bigint, start bigint, n_ids bigint, doc_ids array<{kind}>, sizes array<bigint>, "
        "checkpoints array<bigint>, bits binary"
    )


def write_ids(docs: DataFrame, id: str, text: str, tokenizer: str, end_id: int, most_bits: int = MOST_BITS) -> str:
    """Tokenise ``docs`` and write them in ascending order of ``id``; returns the folder.

    Each document is its whole text (NULL: empty) and the end id. NULL ids come first; rows with equal ids
    are ordered by the checksum of their token ids, so only equal rows can change places. Ids are of any
    type with an order. Other columns are not read; an empty table gives a folder without blocks.
    """
    both = written(encoded(docs, id, text, tokenizer, end_id), "tokens-ids")
    rows = both.filter("n IS NOT NULL")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                used, times = np.frombuffer(data.as_buffer(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(times)], names=["token", "count"])

    counts = both.filter("n IS NULL").select("ids").mapInArrow(unpack, "token bigint, count bigint")
    # One row per id in use: at most the size of the tokenizer's vocabulary.
    counts = counts.groupBy("token").agg(F.sum("count").alias("count")).orderBy("token").toArrow()
    ids = counts["token"].to_numpy()
    lengths = code_lengths(counts["count"].to_numpy(), max(most_bits, len(ids).bit_length()))
    session = docs.sparkSession
    folder = fresh_folder(docs, "token-files")
    book = pa.table({"token": pa.array(ids, pa.int64()), "length": pa.array(lengths, pa.int32())})
    session.createDataFrame(book, "token bigint, length int").coalesce(1).write.parquet(f"{folder}/codebook")
    held = session.sparkContext.broadcast((ids, lengths))  # bounded by the vocabulary

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codebook(*held.value)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        id_type: pa.DataType = pa.int64()
        doc_ids: list = []
        held_ids: list[np.ndarray] = []
        size = 0

        def sealed() -> pa.RecordBatch:
            bits, checkpoints = code.encode(np.concatenate(held_ids))
            row = [[part], [block], [start], [size], [doc_ids], [[len(h) for h in held_ids]], [checkpoints], [bits]]
            kinds = [pa.int32(), *[pa.int64()] * 3, pa.list_(id_type), *[pa.list_(pa.int64())] * 2, pa.binary()]
            names = ["part", "block", "start", "n_ids", "doc_ids", "sizes", "checkpoints", "bits"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            cells = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            for doc, n, data in cells:
                doc_ids.append(doc)
                held_ids.append(_unpacked(data.as_buffer(), n))
                size += n
                if size >= BLOCK_IDS:
                    yield sealed()
                    start, block = start + size, block + 1
                    doc_ids, held_ids, size = [], [], 0
        if held_ids:
            yield sealed()

    total = int(counts["count"].to_numpy().sum()) if len(ids) else 0
    parts = max(1, int(session.conf.get("spark.sql.shuffle.partitions")), -(-total // _PART_IDS))
    order = ["id", "crc", "place"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "n", "ids")
    ranged.mapInArrow(pack, _block_schema(rows.schema["id"].dataType.simpleString())).write.option("compression", "none").parquet(f"{folder}/blocks")
    return folder


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files of ``folder``.

    ``start`` counts the ids of all documents before it. With ``digest`` the ids come as ``ids_crc32``,
    the checksum of their little-endian unsigned 32-bit form, instead.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    book = spark.read.parquet(f"{folder}/codebook").orderBy("token").toArrow()  # bounded by the vocabulary
    held = spark.sparkContext.broadcast((book["token"].to_numpy(), book["length"].to_numpy().astype(np.int64)))
    last = ("ids_crc32", "bigint") if digest else ("ids", "array<bigint>")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Codebook(*held.value)
        for batch in batches:
            some: list[dict] = []
            for i in range(batch.num_rows):
                some.append({name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)})
                if len(some) == 16 or i + 1 == batch.num_rows:
                    yield from _documents(code, some, digest)
                    some = []

    rows = blocks.select("part", "start", "n_ids", "doc_ids", "sizes", "checkpoints", "bits").mapInArrow(
        kernel, f"part int, doc_id {kind}, start bigint, n_tokens bigint, {last[0]} {last[1]}"
    )
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids_of_part"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("of"), F.coalesce(F.sum("ids_of_part").over(before), F.lit(0)).alias("base"))
    # One row per part, as many as shuffle partitions.
    out = rows.join(F.broadcast(bases), F.col("part") == F.col("of"))
    return out.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", last[0])


def _documents(code: Codebook, rows: list[dict], digest: bool) -> Iterator[pa.RecordBatch]:
    blocks = [
        (r["bits"].as_py(), r["checkpoints"].values.to_numpy(), r["n_ids"].as_py()) for r in rows
    ]
    for row, ids in zip(rows, code.decode(blocks), strict=True):
        sizes = row["sizes"].values.to_numpy()
        stops = np.cumsum(sizes)
        parts = np.split(ids, stops[:-1])
        if digest:
            tail = pa.array([zlib.crc32(p.astype("<u4")) for p in parts], pa.int64())
        else:
            tail = pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))
        columns = [
            pa.array([row["part"].as_py()] * len(sizes), pa.int32()),
            row["doc_ids"].values,
            pa.array(row["start"].as_py() + stops - sizes),
            pa.array(sizes),
            tail,
        ]
        names = ["part", "doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)
