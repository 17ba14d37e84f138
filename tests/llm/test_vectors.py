"""Near-duplicate vectors against all cosines."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from strandwork.llm import vectors
from strandwork.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("row", "id", "key", "leader", "size", "cell", "a", "n", "component")],
    ]
)


def expected(rows, threshold=0.93):
    """(id, n_links, component_id, kept) and the smallest cosine among links, from all pairs."""
    links = collections.defaultdict(set)
    usable = [
        i for i, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    groups = collections.defaultdict(list)
    for i in usable:
        groups[rows[i][2], len(rows[i][1])].append(i)
    for at in groups.values():
        x = np.array([np.float32(rows[i][1]) for i in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for r, c in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if r != c:
                links[at[r]].add(at[c])
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - part:
                part.add(j)
                todo.append(j)
        seen |= part
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (rows[j][0], len(links[j]), least, rows[j][0] == least)
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA).repartition(5)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near(random, base, angle):
    """A vector at ``angle`` from ``base``."""
    side = random.standard_normal(len(base))
    side -= side @ base * base
    return math.cos(angle) * base + math.sin(angle) * side / np.linalg.norm(side)


def odd_rows(seed, limit=math.acos(0.93)):
    """Crowds of copies, near copies, chains and balls about the threshold, but no cosine at it."""
    random = np.random.default_rng(seed)
    rows = []

    def add(vector, label, times=1):
        scale = float(random.uniform(0.1, 30))
        for _ in range(times):
            rows.append((len(rows) * 7 % 4001, [float(np.float32(x * scale)) for x in vector], label))

    for label in (1, 2):
        for _ in range(150):
            base = random.standard_normal(64)
            base /= np.linalg.norm(base)
            add(base, label)
            for angle in random.uniform(0, 1.3 * limit, int(random.integers(0, 4))):
                add(near(random, base, angle), label)
        crowd = random.standard_normal(64)
        crowd /= np.linalg.norm(crowd)
        add(crowd, label, 40)
        for _ in range(150):
            add(near(random, crowd, random.uniform(0, 0.04)), label)
        for _ in range(40):  # a second ball, so far that some of its members are linked with the first
            add(near(random, near(random, crowd, limit * 0.97), 0.03), label)
        other = near(random, crowd, limit)
        for _ in range(30):
            add(near(random, other, random.uniform(0, 0.03)), label)
    base = rows[0][1]
    rows += [(9001, base, None), (9002, None, 1), (9003, [0.0] * 64, 1), (9004, [*base[:-1], None], 1), (9005, [], 1)]
    rows += [(9006, [*base[:-1], math.inf], 1), (9007, [*base[:-1], math.nan], 1), (9008, base[:10], 1), (9009, base[:10], 1)]
    rows += [(None, base, 1), (None, [-x for x in base], 2), (9010, base, 3), (9010, base, 3), (9011, [1e-30] * 64, 4), (9012, [1e30] * 64, 4)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_cosines(spark, seed):
    rows = odd_rows(seed)
    want = expected(rows)
    answer = got(vectors.near_duplicates(table_of(spark, rows)))
    assert len(answer) == len(want)
    found, all_links = sum(r[1] for r in answer), sum(r[1] for r in want)
    assert 0.995 * all_links <= found <= all_links
    # Pairs at the very threshold may be missed, nothing else, and none is made up.
    least, most = (collections.defaultdict(int) for _ in range(2))
    for r in answer:
        least[r[0]] += r[1]
    for r in want:
        most[r[0]] += r[1]
    assert all(0 <= most[k] - least[k] <= 1 + most[k] // 20 for k in most)
    groups = [len({(r[0], r[2]) for r in found} & {(r[0], r[2]) for r in want}) for found in (answer, want)]
    assert groups[0] >= 0.98 * groups[1]


def test_close_pairs_are_all_found(spark):
    random = np.random.default_rng(9)
    rows = []
    for i in range(300):
        base = random.standard_normal(64)
        base /= np.linalg.norm(base)
        for angle in (0, *random.uniform(0, math.acos(0.98), i % 5)):
            rows.append((len(rows), [float(x) for x in near(random, base, angle)], i % 2))
    want = expected(rows)
    answer = got(vectors.near_duplicates(table_of(spark, rows)))
    assert len(set(answer) & set(want)) >= len(rows) - 2


def test_recall_at_the_threshold(spark):
    """Pairs with cosines just above 0.93: at least 0.9 of them are found, and none below."""
    random = np.random.default_rng(4)
    rows = []
    for i in range(600):
        base = random.standard_normal(64)
        base /= np.linalg.norm(base)
        angle = math.acos(0.93) * (0.995 if i % 2 else 1.005)
        rows += [(2 * i, [float(x) for x in base], 0), (2 * i + 1, [float(x) for x in near(random, base, angle)], 0)]
    answer = {r[0]: r[1] for r in vectors.near_duplicates(table_of(spark, rows)).collect()}
    assert sum(answer[2 * i] for i in range(1, 600, 2)) >= 0.97 * 300
    assert sum(answer[2 * i] for i in range(0, 600, 2)) == 0


def test_result_does_not_depend_on_partitions(spark):
    rows = odd_rows(3)
    first = got(vectors.near_duplicates(table_of(spark, rows)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        second = got(vectors.near_duplicates(table_of(spark, rows).repartition(11)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(set(first) ^ set(second)) <= 0.05 * len(first)


def test_other_types(spark):
    rows = [("b", [1.0, 2.0, 3.0], "x"), ("a", [2.0, 4.0, 6.0], "x"), ("c", [1.0, 2.0, 3.0], "y"), ("d", [3.0, -1.0, 0.0], "x")]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    want = [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("d", 0, "d", True)]
    assert got(vectors.near_duplicates(table)) == want


def test_query_on_the_small_table(spark):
    data = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    assert got(QUERIES["op11_vectors"](spark, SMALL)) == sorted(expected([tuple(r) for r in data]), key=repr)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_unbiased():
    """The code of one side and the four-bit form of the other give the inner product, on average."""
    random = np.random.default_rng(2)
    x = random.standard_normal(64)
    x /= np.linalg.norm(x)
    y = near(random, x, 0.5)
    values = []
    for number in range(400):
        turned, other = vectors.rotation(64, number) @ x, vectors.rotation(64, number) @ y
        factor = np.abs(turned).sum() / 8
        values.append(np.sign(turned) @ other / (8 * factor))
    assert abs(np.mean(values) - math.cos(0.5)) < 4 * np.std(values) / 20
