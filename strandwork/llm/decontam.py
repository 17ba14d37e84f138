"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton of all items is streamed over the words of each document. Its state gives the longest
suffix read so far that occurs in some item; where that reaches a window's length, the window's words
are hits. A run of words that no item knows is skipped without being streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.words import ALNUM, LOWERED, Texts, prefix_sums, range_hashes, texts, words

#: Words of items per automaton. Items beyond it go to further automata, so that driver and tasks hold one at a time.
BLOCK_WORDS = 250_000


def normalised(text: bytes) -> list[bytes]:
    """Lower-case words: runs of ASCII letters, digits and anything outside ASCII."""
    run = Texts(0, LOWERED[np.frombuffer(text, np.uint8)], np.array([0, len(text)]))
    found = words(run, ALNUM)
    whole = run.data.tobytes()
    return [whole[a:b] for a, b in zip(found.begin.tolist(), found.end.tolist(), strict=True)]


class Automaton:
    """Suffix automaton of several word sequences, and which items own its windows."""

    def __init__(self, items: Sequence[tuple[str, list[bytes]]], window: int = 10):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [0]
        self.size = [0]
        coded = []
        for item, tokens in items:
            if tokens:
                codes = [self.ids.setdefault(t, len(self.ids)) for t in tokens]
                coded.append((item, codes))
                state = 0
                for code in codes:
                    state = self._append(state, code)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        self.owners: dict[int, set[str]] = {}  # state of a full window: the items that contain it
        self.short: dict[int, list[tuple[int, str]]] = {}  # state of a shorter item: its length and id
        for item, codes in coded:
            self._own(item, codes)
        self.near = self._nearest_short()
        self.hashes = self._hashes()

    def _append(self, last: int, code: int) -> int:
        target = self.next[last].get(code)
        if target is not None:
            return target if self.size[target] == self.size[last] + 1 else self._split(last, code, target)
        state = self._state(self.size[last] + 1, {})
        while code not in self.next[last]:
            self.next[last][code] = state
            if last == 0:
                return state  # links to the root
            last = self.link[last]
        target = self.next[last][code]
        exact = self.size[target] == self.size[last] + 1
        self.link[state] = target if exact else self._split(last, code, target)
        return state

    def _state(self, size: int, arcs: dict[int, int], link: int = 0) -> int:
        self.next.append(arcs)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, last: int, code: int, target: int) -> int:
        """A copy of ``target`` that holds only what ends the strings of ``last`` with ``code``."""
        copy = self._state(self.size[last] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while self.next[last].get(code) == target:
            self.next[last][code] = copy
            if last == 0:
                break
            last = self.link[last]
        return copy

    def shortened(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of what ``state`` holds."""
        while self.size[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _own(self, item: str, codes: list[int]) -> None:
        state = 0
        for i, code in enumerate(codes):
            state = self.next[state][code]
            if i + 1 >= self.window:
                self.owners.setdefault(self.shortened(state, self.window), set()).add(item)
        if len(codes) < self.window:
            self.short.setdefault(self.shortened(state, len(codes)), []).append((len(codes), item))

    def _nearest_short(self) -> list[int]:
        """For each state, itself or the closest suffix state that ends a shorter item; -1 if none does."""
        near = [-1] * len(self.size)
        for state in sorted(range(len(self.size)), key=self.size.__getitem__):
            if state in self.short:
                near[state] = state
            elif state:
                near[state] = near[self.link[state]]
        return near

    def _hashes(self) -> np.ndarray:
        known = list(self.ids)
        data = np.frombuffer(b"".join(known), np.uint8)
        ends = np.cumsum([0, *map(len, known)])
        return np.sort(range_hashes(prefix_sums(data), ends[:-1], ends[1:]))

    def stream(self, tokens: list[bytes]) -> Iterator[tuple[int, int, str]]:
        """``(first, last + 1, item)`` of every occurrence of a window in ``tokens``."""
        arcs, link, size, near, window = self.next, self.link, self.size, self.near, self.window
        get = self.ids.get
        state = length = 0
        for i, token in enumerate(tokens):
            code = get(token, -1)
            while state and code not in arcs[state]:
                state = link[state]
                length = size[state]
            state = arcs[state].get(code, 0)
            length = length + 1 if state else 0
            if length >= window:
                for item in self.owners[self.shortened(state, window)]:
                    yield i + 1 - window, i + 1, item
            at = near[state]
            while at >= 0:
                for n, item in self.short[at]:
                    if n <= length:
                        yield i + 1 - n, i + 1, item
                at = near[link[at]] if at else -1


def _blocks(items: DataFrame, id: str, text: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in runs of at most ``block_words`` words (or one item), read one partition at a time."""
    block, size = [], 0
    for row in items.select(F.coalesce(F.col(id).cast("string"), F.lit("")), F.col(text).cast("binary")).toLocalIterator():
        tokens = normalised(bytes(row[1] or b""))
        if block and size + len(tokens) > block_words:
            yield block
            block, size = [], 0
        if tokens:
            block.append((row[0], tokens))
            size += len(tokens)
    yield block


def _scan(run: Texts, automata: list, spans: bool) -> list[tuple[int, set[str], list[tuple[int, int]], int]]:
    """For each text: hit words, items, hit byte ranges (with ``spans``) and number of words."""
    lower = Texts(run.first, LOWERED[run.data], run.starts)
    found = words(lower, ALNUM)
    hashes = range_hashes(prefix_sums(lower.data), found.begin, found.end)
    n = len(hashes)
    hit = np.zeros(n + 1, np.int32)
    owners: dict[int, set[str]] = {}
    whole = lower.data.tobytes()
    for holder in automata:
        automaton: Automaton = holder.value
        if len(automaton.hashes) == 0:
            continue
        at = np.minimum(np.searchsorted(automaton.hashes, hashes), len(automaton.hashes) - 1)
        known = np.zeros(n + 2, bool)
        known[1:-1] = automaton.hashes[at] == hashes
        opens = known[1:-1] & ~known[:-2]
        closes = known[1:-1] & ~known[2:]
        if n:  # a run ends with its text
            changes = found.row[1:] != found.row[:-1]
            opens[1:] |= known[2:-1] & changes
            closes[:-1] |= known[1:-2] & changes
        begins, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = ends - begins >= automaton.shortest
        for a, b in zip(begins[long].tolist(), ends[long].tolist(), strict=True):
            tokens = [whole[x:y] for x, y in zip(found.begin[a:b].tolist(), found.end[a:b].tolist(), strict=True)]
            for x, y, item in automaton.stream(tokens):
                hit[a + x] += 1
                hit[a + y] -= 1
                owners.setdefault(int(found.row[a]), set()).add(item)
        if len(automata) > 1:
            holder.unpersist_local()
    covered = np.cumsum(hit[:-1]) > 0
    out = []
    for i in range(len(run)):
        a, b = found.first[i], found.first[i + 1]
        ranges = []
        if spans and i in owners:
            mask = np.diff(np.concatenate([[0], covered[a:b].view(np.int8), [0]]))
            origin = run.starts[i]
            ranges = [
                (int(found.begin[a + x] - origin), int(found.end[a + y - 1] - origin))
                for x, y in zip(np.flatnonzero(mask == 1), np.flatnonzero(mask == -1), strict=True)
            ]
        out.append((int(covered[a:b].sum()), owners.get(i, set()), ranges, int(b - a)))
    return out


class _Held:
    """A broadcast automaton that a task with several of them drops after use."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Automaton:
        return self.broadcast.value

    def unpersist_local(self) -> None:
        self.broadcast.__dict__.pop("_value", None)


def automata(
    docs: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
) -> list[_Held]:
    """The items as broadcast automata of at most ``block_words`` words (or one item) each."""
    context = docs.sparkSession.sparkContext
    blocks = _blocks(items, item_id, item_text, block_words)
    return [_Held(context.broadcast(Automaton(block, window))) for block in blocks]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
    cleaned: bool = False,
    max_coverage: float = 1.0,
) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items_sha256, contaminated)`` for every row of ``docs``.

    A window is ``window`` consecutive words of an item, or a whole shorter item that has words. All
    words inside an occurrence are hit, overlaps once. ``cleaned`` adds ``clean``: the text without its
    hit spans (each with the bytes between its words), or NULL where more than ``max_coverage`` of the
    words are hit. A NULL text is empty and has no words; items without words own no window and are
    never found; items with equal text are all found; a NULL item id is an empty one, and items with equal
    ids count once. Repeated rows and NULL ids are scored like any
    other row; other columns are not read; empty tables give no rows and no hits.

    The items are the stated query set: they are held as automata of at most ``block_words`` words, so
    memory does not follow the number of items.
    """
    holders = automata(docs, items, item_id, item_text, window, block_words)
    names = [id, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in texts(batch.column(1)):
                rows = _scan(run, holders, cleaned)
                columns = [
                    batch.column(0).slice(run.first, len(run)),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(r[1])).encode()).hexdigest() for r in rows]),
                    pa.array([r[0] > 0 for r in rows]),
                ]
                if cleaned:
                    columns.append(pa.array([_cut(run.text(i), r, max_coverage) for i, r in enumerate(rows)]))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *["clean"] * cleaned])

    return docs.select(id, text).mapInArrow(kernel, schema + ", clean string" * cleaned)


def _cut(text: bytes, row: tuple, max_coverage: float) -> str | None:
    hit, _, ranges, n = row
    if hit > max_coverage * n:
        return None
    kept, at = [], 0
    for a, b in ranges:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]).decode()


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    max_coverage: float = 0.0,
    **how,
) -> DataFrame:
    """The rows of ``docs`` with all their columns, without hit spans; gone beyond ``max_coverage`` hit words.

    With the coverage of 0 every document with a hit goes and no text changes.
    """
    at = docs.columns.index(text)
    holders = automata(docs, items, **how)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in texts(batch.column(at)):
                rows = _scan(run, holders, True)
                part = batch.slice(run.first, len(run))
                kept = [r[0] <= max_coverage * r[3] for r in rows]
                if any(r[0] for r, k in zip(rows, kept, strict=True) if k):
                    old = part.column(at).to_pylist()
                    new = [
                        _cut(run.text(i), r, max_coverage) if r[0] and kept[i] else old[i] for i, r in enumerate(rows)
                    ]
                    part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(kernel, docs.schema)
