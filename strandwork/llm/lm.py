"""Language-model scoring with a weighted backoff automaton.

Each n-gram of the training texts is an arc from the state of its history; a state's failure arc leads to
the next shorter history. The weights come from Dirichlet smoothing:

    P(w | h) = (c(hw) + a P(w | h')) / (c(h) + a),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

so an arc carries log P of its n-gram, a failure arc log(a / (c(h) + a)). The strength ``a`` is the one of
a fixed grid with the best leave-one-out likelihood of all training tokens.

The counts are gathered over all training texts by the packed exchange of ``chunks``: each chunk gets the
counts of exactly the n-grams that occur in it, which make the part of the automaton its texts can reach.
Its histories become numbered states. From the state it has reached a text takes the arc of the next token,
or failure arcs until there is one, and adds up the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

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
    total,
)
from strandwork.llm.store import written
from strandwork.llm.words import LOWERED, NOT_SPACE, Texts, mixed, prefix_sums, range_hashes, words

STRENGTHS = (1.0, 10.0, 100.0, 1_000.0, 10_000.0, 100_000.0)
_END = np.uint64(0xE4D0E4D0E4D0E4D0)
_BEGIN = np.uint64(0xB0B0B0B0B0B0B0B0)
_RUN_BYTES = 1 << 20


def in_training(id: int | None, folds: int, held: int) -> bool:
    """Whether the id's checksum leaves its text in the training part; NULL counts as the empty string."""
    return zlib.crc32(b"" if id is None else str(id).encode()) % folds != held


class Tokens:
    """The tokens of a chunk: lower-case words and one end per text, as distinct n-grams of each order."""

    def __init__(self, chunk: Chunk, order: int, folds: int, held: int):
        parts, counts = [], []
        for run in chunk.runs(_RUN_BYTES):
            lower = Texts(run.first, LOWERED[run.data], run.starts)
            found = words(lower, NOT_SPACE)
            hashes = range_hashes(prefix_sums(lower.data), found.begin, found.end)
            parts.append(np.insert(hashes, found.first[1:], _END))
            counts.append(found.counts + 1)
        tokens = np.concatenate([np.empty(0, np.uint64), *parts])
        self.counts = np.concatenate([np.empty(0, np.int64), *counts])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        ids = [None if i == NO_ID else i for i in chunk.ids.tolist()]
        self.training = np.array([in_training(i, folds, held) for i in ids], bool)
        train = np.repeat(self.training, self.counts)
        self.place = place = np.arange(len(tokens)) - np.repeat(self.starts[:-1], self.counts)
        # An n-gram reaches back over at most one begin mark; the key tells how long it is.
        self.keys: list[np.ndarray] = []
        self.at: list[np.ndarray] = []  # n-gram of each position, by order
        self.trained: list[np.ndarray] = []
        gram = tokens
        for n in range(1, order + 1):
            if n > 1:
                before = np.empty_like(tokens)
                before[n - 1 :] = tokens[: len(tokens) - n + 1]
                before[place == n - 2] = _BEGIN
                longer = mixed(before * np.uint64(2 * n + 1) + mixed(gram))
                gram = np.where(place >= n - 2, longer, gram)
            keys, at = np.unique(gram, return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            self.trained.append(np.bincount(at, weights=train, minlength=len(keys)).astype(np.int64))


class Automaton:
    """The states, arcs and failure arcs that the texts of one chunk can reach, with a weight per strength.

    State 0 is the empty history and state 1 the begin of a text; further states are the n-grams below the
    full order that training has. The root has an arc for every token, so a traversal always goes on.
    ``counts[n - 1]`` are the training counts of the distinct n-grams of order n, ``begins`` those of a
    text's begin.
    """

    ROOT, BEGIN = 0, 1

    def __init__(
        self, tokens: Tokens, counts: list[np.ndarray], n_tokens: int, n_words: int, begins: int, strengths: Sequence[float]
    ):
        self.tokens, self.counts, self.begins = tokens, counts, begins
        self.n_tokens, self.n_words = n_tokens, n_words
        self.strengths = np.array(strengths)
        self.n_words_here = len(counts[0])
        self._number_states()
        self._draw_arcs()

    def unigram(self, less: int = 0) -> np.ndarray:
        """P(w) of the distinct tokens, with ``less`` occurrences of the token left out."""
        return (np.maximum(self.counts[0] - less, 0) + 0.5) / (self.n_tokens - less + 0.5 * (self.n_words + 1))

    def _seen_at(self, n: int) -> np.ndarray:
        """For each distinct n-gram a position where it ends, -1 for what is no n-gram but a shorter one at a begin."""
        where = np.full(len(self.counts[n - 1]), -1)
        whole = np.flatnonzero(self.tokens.place >= n - 2)
        where[self.tokens.at[n - 1][whole]] = whole
        return where

    def _history(self, n: int, at: np.ndarray) -> np.ndarray:
        """Training count of the history of the n-gram that ends at each position."""
        before = self.counts[n - 2][self.tokens.at[n - 2][at - 1]]
        return np.where(self.tokens.place[at] == 0, self.begins, before)

    def _number_states(self) -> None:
        self.state: list[np.ndarray] = []  # of each distinct n-gram, by order; -1 where it is none
        sizes, fail = [0, self.begins], [self.ROOT, self.ROOT]
        for n in range(1, len(self.counts)):
            where = self._seen_at(n)
            mine = np.flatnonzero((self.counts[n - 1] > 0) & (where >= 0))
            state = np.full(len(where), -1)
            state[mine] = len(sizes) + np.arange(len(mine))
            shorter = self.state[n - 2][self.tokens.at[n - 2][where[mine]]] if n > 1 else np.full(len(mine), self.ROOT)
            self.state.append(state)
            sizes += self.counts[n - 1][mine].tolist()
            fail += shorter.tolist()
        self.fail = np.array(fail)
        self.failure = np.log10(self.strengths / (np.array(sizes)[:, None] + self.strengths))

    def _longest(self, at: np.ndarray, most: int) -> np.ndarray:
        """The state of the longest history of at most ``most`` tokens that ends at each position."""
        out = np.full(len(at), self.ROOT)
        for n in range(1, min(most, len(self.state)) + 1):
            state = self.state[n - 1][self.tokens.at[n - 1][at]]
            known = (state >= 0) & (self.tokens.place[at] >= n - 2)
            out[known] = state[known]
        return out

    def _draw_arcs(self) -> None:
        self.root = np.repeat(np.log10(self.unigram())[:, None], len(self.strengths), axis=1)
        keys, weights = [np.empty(0, np.int64)], [np.empty((0, len(self.strengths)))]
        for n in range(2, len(self.counts) + 1):
            where = self._seen_at(n)
            at = where[(where >= 0) & (self.counts[n - 1] > 0)]
            if n == 2:
                source = np.where(self.tokens.place[at] == 0, self.BEGIN, self.state[0][self.tokens.at[0][at - 1]])
            else:
                source = self.state[n - 2][self.tokens.at[n - 2][at - 1]]
            keys.append(source * self.n_words_here + self.tokens.at[0][at])
            weights.append(np.log10(self._chance(at, n)))
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        self.keys, self.weight = flat[order], np.concatenate(weights)[order]

    def _chance(self, at: np.ndarray, most: int, less: int = 0) -> np.ndarray:
        """P(token | up to ``most - 1`` tokens ahead of it) at some positions, one column per strength."""
        chance = np.repeat(self.unigram(less)[self.tokens.at[0][at]][:, None], len(self.strengths), axis=1)
        for n in range(2, most + 1):
            count = np.maximum(self.counts[n - 1][self.tokens.at[n - 1][at]] - less, 0)[:, None]
            history = np.maximum(self._history(n, at) - less, 0)[:, None]
            longer = (count + self.strengths * chance) / (history + self.strengths)
            chance = np.where((self.tokens.place[at] >= n - 2)[:, None], longer, chance)
        return chance

    def traverse(self) -> np.ndarray:
        """log10 weight of every text, one column per strength.

        The state that a traversal carries to a token is the longest history known there, so the states of a
        run of tokens are set side by side, and all of them take their arcs, or failure arcs until there is one.
        """

        def weights(at: np.ndarray) -> np.ndarray:
            state = np.where(
                self.tokens.place[at] == 0, self.BEGIN if self.state else self.ROOT, self._longest(at - 1, len(self.state))
            )
            token = self.tokens.at[0][at]
            total = np.zeros((len(at), len(self.strengths)))
            waiting = np.arange(len(at))
            while len(waiting):
                here, word = state[waiting], token[waiting]
                key = here * self.n_words_here + word
                arc = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
                root = here == self.ROOT
                taken = ~root & (self.keys[arc] == key) if len(self.keys) else np.zeros(len(key), bool)
                total[waiting[taken]] += self.weight[arc[taken]]
                total[waiting[root]] += self.root[word[root]]
                back = ~(taken | root)
                waiting = waiting[back]
                total[waiting] += self.failure[here[back]]
                state[waiting] = self.fail[here[back]]
            return total

        return self._per_text(weights)

    def left_out(self) -> np.ndarray:
        """log10 chance of every text with each token's own occurrence left out of all counts (training texts)."""
        return self._per_text(lambda at: np.log10(self._chance(at, len(self.counts), 1)))

    def _per_text(self, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sums over the tokens of each text, a run of tokens at a time."""
        counts = self.tokens.counts
        text = np.repeat(np.arange(len(counts)), counts)
        out = np.zeros((len(counts), len(self.strengths)))
        for i in range(0, len(text), 1 << 18):
            at = np.arange(i, min(len(text), i + (1 << 18)))
            for k, column in enumerate(values(at).T):
                out[:, k] += np.bincount(text[at], weights=column, minlength=len(counts))
        return out


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums per text; every text has at least its end."""
    return np.add.reduceat(values, starts[:-1]) if len(starts) > 1 else np.empty(0)


def scored(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    order: int = 2,
    folds: int = 5,
    held: int = 1,
    strengths: Sequence[float] = STRENGTHS,
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs``.

    Training texts are those whose ``crc32(id as text) % folds`` is not ``held``. A NULL or empty text is
    one end token; a NULL id counts as the empty string. ``n_known`` are the tokens seen in training,
    ``base_score`` the log10 chance under P(w) alone, ``score`` under the whole model of n-grams up to
    ``order``. Repeated rows count and are scored each; ids are whole numbers; other columns are not
    read; without training texts all tokens share the chance of an unknown one; an empty table gives an
    empty result. N-grams are told apart by 64-bit hashes.
    """
    chunks = TextChunks(docs, id, text, "lm")
    bits = bucket_bits(chunks.n_bytes // 8, chunks.partitions)

    def ask(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(chunk, order, folds, held)
        for n, (keys, trained) in enumerate(zip(tokens.keys, tokens.trained, strict=True), 1):
            yield questions(chunk.number, n, keys, trained, bits)

    counts = written(answered(chunks.map(ask, QUESTION), total, owned=True), "lm-counts")

    def sizes(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        values = answer_values(chunk.answers, 1)
        owned = values[(values & 1) == 1] >> 1
        ids = [None if i == NO_ID else i for i in chunk.ids.tolist()]
        begins = sum(in_training(i, folds, held) for i in ids)
        row = [[int(owned.sum())], [int((owned > 0).sum())], [begins]]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in row], names=["tokens", "words", "begins"])

    unigrams = counts.filter("kind = 1")
    sums = chunks.map(sizes, "tokens bigint, words bigint, begins bigint", unigrams)
    n_tokens, n_words, begins = (v or 0 for v in sums.agg(F.sum("tokens"), F.sum("words"), F.sum("begins")).first())

    def score(chunk: Chunk) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(chunk, order, folds, held)
        held_counts = [answer_values(chunk.answers, n) >> 1 for n in range(1, order + 1)]
        automaton = Automaton(tokens, held_counts, n_tokens, n_words, begins, strengths)
        scores, left_out = automaton.traverse(), automaton.left_out() * tokens.training[:, None]
        known = (held_counts[0] > 0)[tokens.at[0]]
        columns = [
            id_column(chunk.ids),
            pa.array(~tokens.training),
            pa.array(tokens.counts),
            pa.array(_per_text(known.astype(np.int64), tokens.starts).astype(np.int64)),
            pa.array(_per_text(np.log10(automaton.unigram())[tokens.at[0]], tokens.starts)),
            pa.array(scores.tolist(), pa.list_(pa.float64())),
            pa.array(left_out.tolist(), pa.list_(pa.float64())),
        ]
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "scores", "left_out"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = (
        "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, "
        "scores array<double>, left_out array<double>"
    )
    rows = written(chunks.map(score, schema, counts), "lm-scores")
    likelihoods = rows.agg(*[F.sum(F.get("left_out", F.lit(i))) for i in range(len(strengths))]).first()
    best = max(range(len(strengths)), key=lambda i: likelihoods[i] or 0.0)
    return rows.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n_tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        F.get("scores", F.lit(best)).alias("score"),
    )
