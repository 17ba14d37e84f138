"""Repair of conversation structure with Four-Russians block tables.

The rows of a conversation, in order of their turns, must have role initials of the form ``(s?(ua)+)?``.
They are kept (0), given another role (3), deleted (4, forced for blank and repeated rows) or new empty
rows are inserted (3); a truncated row that stays costs 3 more. The cheapest edits follow from the cost
to go from each of four states (nothing yet, after the system row, after a user row, after an assistant
row). Less its minimum that vector of four costs takes few values, so the step over any block of
``BLOCK`` symbols is one entry of a table: vector and block give the vector before the block.

Blocks are looked up from the last row to the first. Then every block is expanded against that direction,
that is in reading order, where the ASCII-least of equally cheap edits is a choice step by step.

Rows are put in order by ranges of (conversation, turn), so a long conversation lies in several parts.
For the pieces at the ends of a part the step is worked out for every vector and state at once; these
small maps, one row per part, are chained and give each part what enters it from its neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.llm.store import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK = 4
#: Rows of one part; their narrow columns are held by a task.
PART_ROWS = 1_000_000

SPACE = " \t\n\x0b\f\r"
INITIALS = "sua"
OTHER, DELETED, FILL = 3, 8, 9  # symbols: initial (0-3), plus 4 where truncated; forced deletion; no row
SYMBOLS = 10
STATES = 4
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}  # (state, initial): next state
MADE = (2, 2, 3, 2)  # state after a row made to fit: user, but assistant after a user
MADE_ROLE = ("user", "user", "assistant", "user")
LAST = (0, 2 * INSERT, INSERT, 0)  # cost to go after the last row


def _options(state: int, symbol: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` of what can happen to a row, by letter."""
    if symbol == DELETED:
        return [("D", DELETE, state)]
    late = TRUNCATED if symbol >= 4 else 0
    out = [("D", DELETE, state)]
    if (state, symbol % 4) in KEPT:
        out.append(("K", KEEP + late, KEPT[state, symbol % 4]))
    return [*out, ("R", REROLE + late, MADE[state])]


def _before(togo: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cost to go ahead of a row, insertions ahead of it included, from the cost to go behind it."""
    if symbol == FILL:
        return togo
    costs = [min(cost + togo[to] for _, cost, to in _options(q, symbol)) for q in range(STATES)]
    for _ in range(STATES):
        costs = [min(costs[q], INSERT + costs[MADE[q]]) for q in range(STATES)]
    return tuple(costs)


def _edits(state: int, symbol: int, togo: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least letters of a cheapest way over one row, and the state behind it."""
    if symbol == FILL:
        return "", state
    here, letters = _before(togo, symbol), ""
    while True:
        options = {x: to for x, cost, to in _options(state, symbol) if cost + togo[to] == here[state]}
        if here[state] == INSERT + here[MADE[state]]:
            options["I"] = MADE[state]
        letter = min(options)
        letters, state = letters + letter, options[letter]
        if letter != "I":
            return letters, state


@dataclass
class Tables:
    """Transitions of normalised cost vectors over symbols and over blocks, and the edits of every step."""

    vectors: list[tuple[int, ...]]
    one: np.ndarray  # [vector behind, symbol] -> vector ahead
    block: np.ndarray  # [vector behind, block] -> vector ahead
    letters: list[str]
    edit: np.ndarray  # [state, symbol, vector behind] -> index into letters
    to: np.ndarray  # [state, symbol, vector behind] -> state behind

    def backward(self, blocks: np.ndarray, first: np.ndarray, count: np.ndarray, last: np.ndarray):
        """Runs of blocks (``first``, ``count``) by lookup from their ends, in step.

        Returns the vector behind each block, run after run, and the vector ahead of each run.
        """
        begin = np.cumsum(count) - count
        behind = np.zeros(int(count.sum()), np.int16)
        order = np.argsort(-count, kind="stable")
        at = last.astype(np.int16).copy()
        counts = count[order]
        for step in range(int(count.max(initial=0))):
            live = order[: np.searchsorted(-counts, -step, "left")]
            place = count[live] - 1 - step
            behind[begin[live] + place] = at[live]
            at[live] = self.block[at[live], blocks[first[live] + place]]
        return behind, at

    def forward(self, symbols: np.ndarray, first: np.ndarray, count: np.ndarray, behind: np.ndarray, state: np.ndarray):
        """Edits of every row of the runs, whose blocks are expanded, and the state behind each run."""
        begin = np.cumsum(count) - count
        edits = np.zeros((len(behind), BLOCK), np.int16)
        order = np.argsort(-count, kind="stable")
        state = state.astype(np.int16).copy()
        counts = count[order]
        for step in range(int(count.max(initial=0))):
            live = order[: np.searchsorted(-counts, -step, "left")]
            block, at = symbols[first[live] + step], behind[begin[live] + step]
            inner = [at]
            for k in range(BLOCK - 1, 0, -1):
                inner.append(self.one[inner[-1], block[:, k]])
            q = state[live]
            for k in range(BLOCK):
                v = inner[BLOCK - 1 - k]
                edits[begin[live] + step, k] = self.edit[q, block[:, k], v]
                q = self.to[q, block[:, k], v]
            state[live] = q
        return edits, state


@cache
def tables() -> Tables:
    vectors, found = [LAST], {LAST: 0}
    rows: list[list[int]] = []
    for vector in vectors:  # grows until closed
        row = []
        for symbol in range(SYMBOLS):
            costs = _before(vector, symbol)
            least = min(costs)
            key = tuple(c - least for c in costs)
            if key not in found:
                found[key] = len(vectors)
                vectors.append(key)
            row.append(found[key])
        rows.append(row)
    one = np.array(rows, np.int16)
    at = np.arange(len(vectors), dtype=np.int16).reshape(-1, *[1] * BLOCK)
    for k in reversed(range(BLOCK)):
        at = one[at, np.arange(SYMBOLS).reshape(1, *[SYMBOLS if j == k else 1 for j in range(BLOCK)])]
    letters: dict[str, int] = {}
    shape = (STATES, SYMBOLS, len(vectors))
    edit, to = np.zeros(shape, np.int16), np.zeros(shape, np.int16)
    for q, s, v in np.ndindex(shape):
        text, to[q, s, v] = _edits(q, s, vectors[v])
        edit[q, s, v] = letters.setdefault(text, len(letters))
    return Tables(vectors, one, at.reshape(len(vectors), -1), list(letters), edit, to)


def _last_edits(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (LAST[state] // INSERT)


# -- rows, faults, order


def damaged(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text)`` of rows with planted faults, chosen by a checksum of conversation and turn.

    Of 20 remainders 0 drops the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets
    the role to user. NULL texts and roles become one space, as NULLs do in the checksum.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = convs.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"),
        (F.crc32(key) % 20).alias("fault"),
    ).filter("fault <> 0")
    what = F.col("fault")
    body = F.when(what == 1, "").when(what == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    who = F.when(what == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(what == 3, 2).otherwise(1)))
    return rows.select("conv", "turn", who.alias("role"), body.alias("text"), copies.alias("copy")).drop("copy")


def _mark(text: Column) -> Column:
    return F.unhex(F.md5(text))


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, mark, n, fault, symbol)``: the distinct rows of ``rows(conv, turn, role, text)``.

    ``mark`` stands for the text and ``n`` counts equal rows, of which all but the first are repeated ones.
    ``fault`` is that of the first: blank, duplicate (role and text seen earlier), truncated or none. The
    first of a role and text is found with a ``min``, and only repeated ones are joined back.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = rows.select(
        "conv", "turn", "role", _mark(F.col("text")).alias("mark"), (bare == "").alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("late"),
    )
    turns = narrow.groupBy("conv", "turn", "role", "mark").agg(
        F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("late").alias("late")
    )
    turns = written(turns, "dialog-turns")
    again = turns.groupBy("conv", "role", "mark").agg(
        F.count("*").alias("times"), F.min(F.struct("turn")).alias("first")  # a NULL turn is the least
    )
    again = again.filter("times > 1").select(*[F.col(c).alias(f"{c}_") for c in ("conv", "role", "mark")], "first")
    same = F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("mark") == F.col("mark_"))
    seen = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    initial = F.position(F.left("role", F.lit(1)), F.lit(INITIALS))
    initial = F.when((F.col("role") == "") | (initial == 0), OTHER).otherwise(initial - 1)
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("late"), "truncated").otherwise("none")
    out = turns.join(again, same, "left").withColumn("fault", fault)
    gone = F.col("fault").isin("blank", "duplicate")
    symbol = F.when(gone, DELETED).otherwise(initial + F.when(F.col("fault") == "truncated", 4).otherwise(0))
    return out.select("conv", "turn", "role", "mark", "n", "fault", symbol.cast("int").alias("symbol"))


ORDER = ["conv", "turn", "role", "mark"]


def _in_order(turns: DataFrame) -> tuple[DataFrame, int]:
    """``turns`` with ``part`` and ``at``: parts are ranges of conversations and turns, ``at`` ascends."""
    parts = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns.count() // PART_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in ORDER]
    ranged = turns.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    return written(ranged, "dialog-order"), parts


@dataclass
class _Part:
    """The rows of a part: runs of blocks, one run for each conversation, filled up in front."""

    symbols: np.ndarray  # [block, place]
    blocks: np.ndarray
    first: np.ndarray
    count: np.ndarray
    place: np.ndarray  # of each row in the flattened symbols

    @classmethod
    def of(cls, symbols: np.ndarray, begins: np.ndarray) -> _Part:
        sizes = np.diff(np.append(begins, len(symbols)))
        count = -(-sizes // BLOCK)
        first = np.cumsum(count) - count
        place = np.repeat((first + count) * BLOCK - sizes, sizes) + np.arange(len(symbols)) - np.repeat(begins, sizes)
        flat = np.full(int(count.sum()) * BLOCK, FILL, np.int16)
        flat[place] = symbols
        grid = flat.reshape(-1, BLOCK)
        blocks = grid.astype(np.int64) @ (SYMBOLS ** np.arange(BLOCK)[::-1])
        return cls(grid, blocks, first, count, place)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, which arrive together and in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = batch.slice(a, b - a)
            if held and piece.num_rows and held[0].column("part")[0] != piece.column("part")[0]:
                yield pa.Table.from_batches(held)
                held = []
            if piece.num_rows:
                held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _begins(table: pa.Table) -> np.ndarray:
    """Where conversations begin in a part."""
    return np.concatenate([[0], np.flatnonzero(table["opens"].to_numpy(zero_copy_only=False)[1:]) + 1])


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: the vector ahead of its first conversation for every one behind it, and for its last
    conversation the state behind it for every (vector behind, state ahead)."""
    known = tables()
    n = len(known.vectors)
    vectors, states = np.repeat(np.arange(n), STATES), np.tile(np.arange(STATES), n)
    for table in _by_part(batches):
        part = _Part.of(table["symbol"].to_numpy(), _begins(table))
        runs = [(np.full(n * STATES, part.first[i]), np.full(n * STATES, part.count[i])) for i in (0, -1)]
        _, ahead = known.backward(part.blocks, *runs[0], vectors)
        behind, _ = known.backward(part.blocks, *runs[1], vectors)
        _, state = known.forward(part.symbols, *runs[1], behind, states)
        names = [table["conv"].cast(pa.string())[i].as_py() for i in (0, -1)]
        row = [table["part"][0].as_py(), *names, len(part.first) == 1, ahead[::STATES].tolist(), state.tolist()]
        fields = ["part", "first", "last", "single", "ahead", "state"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.list_(pa.int32())] * 2]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=fields)


def _borders(maps: list) -> dict[int, tuple[int, int, bool]]:
    """For each part the vector behind its last row, the state ahead of its first, and whether its last run ends."""
    maps = sorted(maps, key=lambda m: m["part"])
    joins = [a["last"] == b["first"] for a, b in zip(maps, maps[1:], strict=False)] + [False] * bool(maps)
    vector = [0] * len(maps)
    for i in range(len(maps) - 2, -1, -1):
        after = maps[i + 1]
        if joins[i]:
            vector[i] = after["ahead"][vector[i + 1] if after["single"] else 0]
    state = [0] * len(maps)
    for i in range(1, len(maps)):
        before = maps[i - 1]
        if joins[i - 1]:
            state[i] = before["state"][vector[i - 1] * STATES + (state[i - 1] if before["single"] else 0)]
    return {m["part"]: (v, q, not j) for m, v, q, j in zip(maps, vector, state, joins, strict=True)}


def edits(turns: DataFrame) -> DataFrame:
    """``turns`` (see ``faults``) with ``edits``, the letters for the first of the equal rows, and ``tail``.

    Insertions stand ahead of their row's letter; ``tail`` has those behind a conversation's last row. All
    but the first of ``n`` equal rows are deleted.
    """
    ordered, parts = _in_order(written(turns, "dialog-faults"))
    kept = {f.name: f.dataType.simpleString() for f in turns.schema}
    own = ordered.repartition(parts, "part").sortWithinPartitions("part", "at")
    # The flag is made here, since Arrow compares no columns of any type with NULLs.
    flagged = own.mapInArrow(_opening, own.schema.simpleString()[7:-1] + ",opens:boolean")
    narrow = flagged.select("part", "conv", "symbol", "opens")
    schema = "part int, first string, last string, single boolean, ahead array<int>, state array<int>"
    maps = narrow.mapInArrow(_maps, schema).collect()  # one row per part
    borders = _borders(maps)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()
        letters = pa.array(known.letters)
        for table in _by_part(batches):
            vector, state, ends = borders[table["part"][0].as_py()]
            part = _Part.of(table["symbol"].to_numpy(), _begins(table))
            last, states = (np.zeros(len(part.first), np.int64) for _ in range(2))
            last[-1], states[0] = vector, state
            behind, _ = known.backward(part.blocks, part.first, part.count, last)
            found, after = known.forward(part.symbols, part.first, part.count, behind, states)
            tails = np.full(table.num_rows, "", object)
            closing = np.append(_begins(table)[1:], table.num_rows) - 1
            tails[closing] = [_last_edits(int(q)) for q in after]
            if not ends:
                tails[-1] = ""
            done = table.select(list(kept)).append_column("edits", letters.take(pa.array(found.reshape(-1)[part.place])))
            yield from done.append_column("tail", pa.array(tails, pa.string())).combine_chunks().to_batches()

    columns = ", ".join(f"`{name}` {kind}" for name, kind in kept.items())
    return flagged.mapInArrow(kernel, f"{columns}, edits string, tail string")


def _opening(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether a row has another conversation or part than the one ahead of it."""
    before: object = None
    for batch in batches:
        keys = list(zip(batch.column("conv").to_pylist(), batch.column("part").to_pylist(), strict=True))
        opens = [key != old for key, old in zip(keys, [before, *keys[:-1]], strict=True)]
        before = keys[-1] if keys else before
        yield batch.append_column("opens", pa.array(opens, pa.bool_()))


# -- results


class _Digest:
    """What is counted, and hashed, while the rows of one conversation go by."""

    def __init__(self, conv):
        self.conv = conv
        self.audit: list[str] = []
        self.hash = hashlib.sha256()
        self.lines = 0
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.initial: str | None = None
        self.turns: list[int] = []  # least, greatest, how many

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def turn(self, row: dict) -> None:
        n, fault, turn, initial = row["n"], row["fault"], row["turn"], row["role"][:1]
        if fault != "none":
            self.count[fault] += 1
        self.count["blank" if fault == "blank" else "duplicate"] += n - 1
        self.count["illegal"] += n - 1 + (self.initial is not None and self.initial + initial not in ("su", "ua", "au"))
        self.initial = initial
        if turn is not None and (not self.turns or self.turns[1] != turn):
            self.turns = [self.turns[0] if self.turns else turn, turn, (self.turns[2] if self.turns else 0) + 1]
        letters = row["edits"] + "D" * (n - 1) + row["tail"]
        costs = {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}
        late = TRUNCATED if fault == "truncated" and row["edits"][-1] in "KR" else 0
        self.count["cost"] += late + sum(cost * letters.count(x) for x, cost in costs.items())
        self.audit.append(letters)

    def row(self) -> list:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return [self.conv, gaps, *self.count.values(), "".join(self.audit), self.hash.hexdigest()]


class _Walk:
    """Goes through the rows of ``_stream`` and gives the repaired rows ``(letter, turn, role, text)``."""

    def __init__(self):
        self.state, self.edit = 0, None

    def made(self, letters: str, turn) -> Iterator[tuple]:
        for _ in letters:
            yield "I", turn, MADE_ROLE[self.state], ""
            self.state = MADE[self.state]

    def step(self, row: dict) -> Iterator[tuple]:
        if row["kind"] == 0:
            self.state, self.edit = 0, None
        elif row["kind"] == 1:
            self.edit = row
            yield from self.made(row["edits"][:-1], row["turn"])
        elif self.edit is not None:  # the first text of its row; equal ones are deleted
            letter = self.edit["edits"][-1]
            if letter == "K":
                yield "K", row["turn"], row["role"], row["text"]
                self.state = KEPT[self.state, INITIALS.index(row["role"][0])]
            elif letter == "R":
                yield "R", row["turn"], MADE_ROLE[self.state], row["text"]
                self.state = MADE[self.state]
            yield from self.made(self.edit["tail"], row["turn"])
            self.edit = None


def _stream(rows: DataFrame, every: DataFrame) -> DataFrame:
    """For each conversation a mark (kind 0), and its edits (1), each ahead of the texts it is about (2).

    A conversation is one run of rows: its answer is a single row, with a checksum over all its texts.
    """
    done = edits(faults(rows))
    turn = rows.schema["turn"].dataType.simpleString()
    columns = {"turn": turn, "role": "string", "mark": "binary", "n": "bigint", "fault": "string"}
    columns |= dict.fromkeys(("edits", "tail", "text"), "string")

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        have = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
        return df.select("conv", F.lit(kind).alias("kind"), *have)

    marks = shaped(every.distinct(), 0)
    texts = shaped(rows.withColumn("mark", _mark(F.col("text"))), 2)
    both = marks.unionByName(shaped(done, 1)).unionByName(texts).withColumn("mark_only", F.col("kind") == 0)
    order = [F.col("conv").asc_nulls_first(), F.col("mark_only").desc()]
    order += [F.col(c).asc_nulls_first() for c in ("turn", "role", "mark", "kind")]
    return both.repartition("conv").sortWithinPartitions(*order).drop("mark_only", "mark")


def audited(rows: DataFrame, conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per id in ``conversations(conv)``: faults, cost and letters of the cheapest repair, checksum.

    ``rows(conv, turn, role, text)`` has no NULL in role and text (see ``damaged``). Rows are taken by turn
    (NULL first), of equal turns by role and a checksum of the text. A conversation without rows has zeros,
    no letters and the checksum of an empty string; a NULL id is a conversation like any other. Equal rows
    are repeated rows. Other columns are not read. Empty tables give an empty result.
    """
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, digest = _Walk(), None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if digest is not None:
                        done.append(digest.row())
                    digest = _Digest(row["conv"])
                elif row["kind"] == 1:
                    digest.turn(row)
                for _, _, role, text in walk.step(row):
                    digest.line(role, text)
            kind = batch.schema.field("conv").type
            yield from packed(done, kind)
        if digest is not None:
            yield from packed([digest.row()], kind)

    def packed(done: list[list], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        if done:
            kinds = [kind, *[pa.int64()] * len(names), pa.string(), pa.string()]
            arrays = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[conv, *names, "audit", "repaired_sha256"])

    kind = rows.schema["conv"].dataType.simpleString()
    columns = ", ".join(f"{c} bigint" for c in names)
    every = conversations.select(F.col(conv).alias("conv"))
    return _stream(rows, every).mapInArrow(kernel, f"`{conv}` {kind}, {columns}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame) -> DataFrame:
    """``(conv, place, edit, turn, role, text)``: the rows of ``rows(conv, turn, role, text)`` after their repair.

    ``place`` numbers the rows of a conversation from 0; ``edit`` is K (kept), R (another role) or I (a new
    row, with the turn of the row it was inserted at).
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, place = _Walk(), 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                place = 0 if row["kind"] == 0 else place
                for edit, turn, role, text in walk.step(row):
                    done.append([row["conv"], place, edit, turn, role, text])
                    place += 1
            if done:
                kinds = [batch.schema.field("conv").type, pa.int64(), pa.string(), batch.schema.field("turn").type]
                kinds += [pa.string()] * 2
                arrays = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["conv", "place", "edit", "turn", "role", "text"])

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))
    schema = f"conv {conv}, place bigint, edit string, turn {turn}, role string, text string"
    return _stream(rows, rows.select("conv")).mapInArrow(kernel, schema)
