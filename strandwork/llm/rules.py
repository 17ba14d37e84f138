"""Quality rules from repetition coverage.

Rolling hashes of several n-gram lengths are taken over the words of each text in numpy. What counts is
the share of characters that lie inside n-grams or lines found more than once in the same text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandwork.llm.words import NOT_SPACE, Texts, mixed, per_row, prefix_sums, range_hashes, texts, words

# Largest share of characters inside repeated n-grams, by n, and the symbols that are counted.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
SYMBOLS = b"#*$%&|<>"

_BASE_WINDOW = 8
_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Limits:
    """A text is kept if it has enough words and stays at or below every share."""

    min_words: int = 20
    repeat_words: float = 0.30
    ngrams: dict[int, float] = field(default_factory=lambda: dict(NGRAM_LIMITS))
    dup_lines: float = 0.30
    dup_line_chars: float = 0.20
    symbols_per_word: float = 0.10


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    if len(keys) == 0:
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _covered(keys: np.ndarray, valid: np.ndarray, n: int, count: int) -> np.ndarray:
    """Words inside an n-gram that its text has more than once; ``keys`` are by first word."""
    at = np.flatnonzero(valid)
    at = at[repeated(keys[at])]
    edges = np.zeros(count + 1, np.int32)
    edges[at] += 1
    np.subtract.at(edges, at + n, 1)
    return np.cumsum(edges[:-1]) > 0


def measures(run: Texts, lengths: list[int]) -> dict[str, np.ndarray]:
    """Counts per text; ``dup_chars_n`` are the characters of words inside repeated n-grams."""
    found = words(run, NOT_SPACE)
    count = len(found.begin)
    sums = prefix_sums(run.data)
    points = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum((run.data & 0xC0) != 0x80, out=points[1:])
    chars = points[found.end] - points[found.begin]
    symbols = np.zeros(256, bool)
    symbols[list(SYMBOLS)] = True
    marks = np.zeros(len(run.data) + 1, np.int64)
    np.cumsum(symbols[run.data], out=marks[1:])
    out = {
        "n_words": found.counts,
        "word_chars": per_row(chars, found.first),
        "n_symbols": marks[run.starts[1:]] - marks[run.starts[:-1]],
    }
    salt = mixed(np.arange(1, len(run) + 1, dtype=np.uint64))[found.row]
    unit = range_hashes(sums, found.begin, found.end)
    rolled = unit.copy()
    for n in range(2, max(*lengths, _BASE_WINDOW) + 1):
        if n > count:
            break
        rolled = rolled[:-1] * _STEP + unit[n - 1 :]
        if n in lengths or n == _BASE_WINDOW:
            valid = found.row[: count - n + 1] == found.row[n - 1 :]
            inside = _covered(mixed(rolled) ^ salt[: len(rolled)], valid, n, count)
            out[f"dup_chars_{n}"] = per_row(chars * inside, found.first)
            if n == _BASE_WINDOW:
                out["n_repeat_words"] = per_row(inside, found.first)
    for name in ["n_repeat_words", *[f"dup_chars_{n}" for n in lengths]]:
        out.setdefault(name, np.zeros(len(run), np.int64))
    return out | _lines(run, found.begin, found.row, chars, sums)


def _lines(run: Texts, begin: np.ndarray, row: np.ndarray, chars: np.ndarray, sums: np.ndarray) -> dict:
    """Lines with a word: how many, how many equal an earlier one of their text, and the characters of those."""
    breaks = np.flatnonzero(run.data == 0x0A)
    opens = np.union1d(run.starts[:-1], breaks + 1)
    opens = opens[opens < len(run.data)]
    line = np.searchsorted(opens, begin, "right") - 1  # of each word
    used, first_word = np.unique(line, return_index=True)
    if len(used) == 0:
        zero = np.zeros(len(run), np.int64)
        return {"n_lines": zero, "n_dup_lines": zero, "dup_line_chars": zero}
    owner = row[first_word]
    stops = np.append(opens[1:], len(run.data))[used]
    stops -= run.data[stops - 1] == 0x0A
    keys = range_hashes(sums, opens[used], stops) ^ mixed(owner.astype(np.uint64) + np.uint64(1))
    weight = np.add.reduceat(chars, first_word)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order][1:] == keys[order][:-1]
    n = len(run)
    return {
        "n_lines": np.bincount(owner, minlength=n),
        "n_dup_lines": np.bincount(owner[again], minlength=n),
        "dup_line_chars": np.bincount(owner[again], weights=weight[again], minlength=n).astype(np.int64),
    }


def verdicts(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """``(base_failed, kept)`` per text."""
    n_words, chars = m["n_words"], m["word_chars"]
    failed = (n_words < limits.min_words) | (m["n_repeat_words"] > limits.repeat_words * n_words + 1e-9)
    good = ~failed
    for n, most in limits.ngrams.items():
        good &= m[f"dup_chars_{n}"] <= most * chars + 1e-9
    good &= m["n_dup_lines"] <= limits.dup_lines * m["n_lines"] + 1e-9
    good &= m["dup_line_chars"] <= limits.dup_line_chars * chars + 1e-9
    good &= m["n_symbols"] <= limits.symbols_per_word * n_words + 1e-9
    return failed, good


def quality(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    limits: Limits | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """The counts and the verdict of every row of ``docs``, as the columns below (``text`` too if asked for).

    Words are cut at ASCII white space, lines at newlines; a line counts if it has a word. A text fails
    the base rules with fewer than ``min_words`` words or too many words inside repeated 8-word windows;
    it is kept if it passes them and every share stays within its limit. A NULL or empty text has no
    words and fails. Repeated rows and NULL ids are judged like any other; other columns are not read; an
    empty table gives an empty result. N-grams and lines are compared by 64-bit hashes within one text.
    """
    limits = limits or Limits()
    lengths = sorted(limits.ngrams)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars"]
    counts += [f"dup_chars_{n}" for n in lengths]
    names = [id, *[text] * keep_text, *counts, "base_failed", "kept"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in texts(batch.column(1)):
                m = measures(run, lengths)
                rows = batch.slice(run.first, len(run))
                columns = [rows.column(0), *[rows.column(1)] * keep_text]
                columns += [pa.array(m[c].astype(np.int64)) for c in counts]
                columns += [pa.array(v) for v in verdicts(m, limits)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id].dataType.simpleString()
    schema = [f"`{id}` {kind}", *[f"`{text}` string"] * keep_text, *[f"{c} bigint" for c in counts]]
    return docs.select(id, text).mapInArrow(kernel, ", ".join([*schema, "base_failed boolean", "kept boolean"]))


def good_documents(docs: DataFrame, text: str = "text", limits: Limits | None = None) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns."""
    limits = limits or Limits()
    lengths, at = sorted(limits.ngrams), docs.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in texts(batch.column(at)):
                kept = verdicts(measures(run, lengths), limits)[1]
                yield batch.slice(run.first, len(run)).filter(pa.array(kept))

    return docs.mapInArrow(kernel, docs.schema)
