"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.llm import dialogs
from strandwork.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
FINAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        what = zlib.crc32(key.encode()) % 20
        if what == 0:
            continue
        if what == 1:
            text = ""
        if what == 2:
            text = re.sub("[.!?]", "", text)
        if what == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def cheapest(rows):
    """Least (cost, letters) over all ways, a state at a time; and the repaired rows."""
    seen, kinds = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\f\r")
        if not bare:
            kinds.append("blank")
        elif (role, text) in seen:
            kinds.append("duplicate")
        else:
            kinds.append("none" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    ways = {"": (0, "", ())}  # initial of the last repaired row: cost, letters, rows

    def inserted(ways):
        ways = dict(ways)
        for _ in range(4):
            for state, (cost, letters, done) in list(ways.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    to = follow.get((state, initial))
                    new = (cost + 3, letters + "I", (*done, f"{role}:"))
                    if to and (to not in ways or new < ways[to]):
                        ways[to] = new
        return ways

    for (_, _, role, text), kind in zip(rows, kinds, strict=True):
        after = {}

        def offer(state, new, after=after):
            if state not in after or new < after[state]:
                after[state] = new

        late = 3 if kind == "truncated" else 0
        for state, (cost, letters, done) in inserted(ways).items():
            offer(state, (cost + 4, letters + "D", done))
            if kind in ("blank", "duplicate"):
                continue
            to = follow.get((state, role[:1]))
            if to:
                offer(to, (cost + late, letters + "K", (*done, f"{role}:{text}")))
            for initial, name in (("u", "user"), ("a", "assistant")):
                to = follow.get((state, initial))
                if to:
                    offer(to, (cost + 3 + late, letters + "R", (*done, f"{name}:{text}")))
        ways = after
    cost, letters, done = min(v for k, v in inserted(ways).items() if k in ("", "a"))
    assert FINAL.fullmatch("".join(d[0] for d in done))
    return kinds, cost, letters, "\n".join(done)


def text_key(text):
    return hashlib.md5(text.encode()).digest()


def expected(rows):
    convs = {r[0] for r in rows}
    out = {}
    after = damaged(rows)
    for conv in convs:
        mine = [r for r in after if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), text_key(r[3])))
        kinds, cost, letters, text = cheapest(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        faults = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(table):
    answer = dialogs.audited(dialogs.damaged(table), table)
    rows = answer.collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("conv", "mark", "kind", "n", "part", "fault", "symbol", "edits")],
    ]
)


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA).repartition(3)


def odd_rows():
    roles = ["system", "user", "assistant", "tool", None, "", "u"]
    texts = ["Hello there.", "cut off", "", None, " \n\t", "What?", "Yes! ", "." * 3, "x" * 100_000 + "."]
    rows = []
    for conv in range(120):
        for turn in range(conv % 13):
            k = zlib.crc32(f"{conv}/{turn}".encode())
            rows.append((conv, turn if k % 11 else None, roles[k % (3 if conv % 2 else 7)], texts[k // 7 % 9] if conv % 3 else f"t {turn}."))
    rows += [(None, i % 4, ["user", "assistant"][i % 2], f"text {i}.") for i in range(9)]
    rows += [(500, None, None, None)] * 3 + [(501, 7, "user", "Same.")] * 40
    rows += [(502, i, ["user", "assistant"][(i + i // 37) % 2], f"long {i}" + "." * (i % 19 != 0)) for i in range(3000)]
    rows += [(503, i, "assistant", f"only {i}.") for i in range(15)] + [(504, -3, "system", "alone.")]
    return rows


def test_against_search(spark):
    rows = odd_rows()
    assert found(table_of(spark, rows)) == expected(rows)


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    answer = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_dialogs"](spark, SMALL).collect()}
    assert answer == expected(rows)


def test_parts_and_ties(spark):
    """A conversation over many parts gives what a single part gives."""
    rows = [(1, i, "sua"[zlib.crc32(b"%d" % i) % 3] + "x", f"t{i % 50}" + "." * (i % 4 > 0)) for i in range(700)]
    table = table_of(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert found(table) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty(spark):
    table = table_of(spark, [])
    assert found(table) == {}
    assert dialogs.repaired(dialogs.damaged(table)).count() == 0


def test_text_ids_and_repaired_rows(spark):
    rows = [(f"c{i % 3}", i // 3, ["user", "assistant", "user"][i % 3], f"words {i}.") for i in range(30)]
    schema = "conv_id string, turn int, role string, text string"
    table = spark.createDataFrame(rows, schema)
    want = expected(rows)
    assert found(table) == want
    fixed = dialogs.repaired(dialogs.damaged(table)).orderBy("conv", "place").collect()
    for conv, group in itertools.groupby(fixed, key=lambda r: r.conv):
        lines = [f"{r.role}:{r.text}" for r in group]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == want[conv][-1]


def test_tables_are_closed_and_small():
    known = dialogs.tables()
    assert len(known.vectors) < 100
    assert known.block.shape == (len(known.vectors), dialogs.SYMBOLS**dialogs.BLOCK)


def test_narrow_columns_only(spark):
    table = table_of(spark, odd_rows()[:50])
    plan = dialogs.faults(dialogs.damaged(table).withColumn("extra", F.lit(1)))
    assert plan.columns == ["conv", "turn", "role", "mark", "n", "fault", "symbol"]
