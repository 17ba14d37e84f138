"""Grouped statistics without a shuffle of the source, ranks and densities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.functions import attach as attaching
from strandwork.operators import bins, errors, metrics, target


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes(children.apply(i))


def moves_source_rows(df):
    """Whether rows of the source are shuffled as they are, not as partial aggregates."""

    def raw(plan):
        if "Aggregate" in plan.nodeName():
            return False
        children = plan.children()
        return plan.nodeName() == "Range" or any(raw(children.apply(i)) for i in range(children.size()))

    return any(n.nodeName() == "Exchange" and raw(n) for n in nodes(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def without_automatic_broadcasts(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def rows_of(spark, n=3000):
    skewed = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("g")
    return spark.range(0, n, 1, 5).select(skewed, F.rand(3).alias("truth"), F.randn(4).alias("error"), F.lit("x" * 50).alias("text"))


def test_source_rows_stay_where_they_are(spark, without_automatic_broadcasts):
    rows = rows_of(spark)
    labelled = rows.withColumn("split", F.lit("train"))
    parameters = target.train_parameters(labelled, "truth", ["g"])
    tables = [
        target.standardize_target(labelled, "truth", parameters, ["g"]),
        target.restore_target(labelled, ["truth"], parameters, ["g"]),
        errors.error_profile(rows, "truth", "error", by=["g"]),
        errors.density(rows, "error", by=["g"]),
        errors.joint_bins(rows, "truth", "error", by=["g"]),
        bins.bin_histogram(rows, "truth", by=["g"]),
    ]
    assert not any(map(moves_source_rows, tables))
    assert moves_source_rows(rows.join(rows.groupBy("g").count(), "g"))  # what the test would find


def test_pieces_of_a_large_group_table(spark, monkeypatch):
    rows = rows_of(spark).withColumn("g", F.when(F.col("g") == 5, None).otherwise(F.col("g")))
    stats = rows.groupBy("g").agg(F.count("*").alias("n"))
    whole = sorted(map(tuple, attaching.attach(rows, stats, ["g"]).select("g", "n").collect()), key=repr)
    monkeypatch.setattr(attaching, "SMALL_BYTES", 20)
    pieces = attaching.attach(rows, stats, ["g"])
    assert plan_of(pieces).count("BroadcastHashJoin") > 2
    assert sorted(map(tuple, pieces.select("g", "n").collect()), key=repr) == whole


def ranks(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_average_ranks(spark, parts):
    random = np.random.default_rng(parts)
    data = [(int(g), float(v)) for g, v in zip(random.integers(0, 3, 900), random.integers(0, 60, 900), strict=True)]
    data = [(g, 7.0 if i % 3 == 0 else v) for i, (g, v) in enumerate(data)] + [(9, 1.0), (9, 1.0), (None, 2.0)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = spark.createDataFrame(data, "g int, v double")
        found = sorted(map(tuple, metrics.average_ranks(df, "v", by=["g"]).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for group in {g for g, _ in data}:
        mine = [v for g, v in data if g == group]
        want += [(group, v, r) for v, r in zip(mine, ranks(mine), strict=True)]
    assert found == sorted(want, key=repr)


def test_a_hot_value_lies_in_several_parts(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        mark = F.xxhash64("v", F.monotonically_increasing_id())
        dealt = df.withColumn("m", mark).repartitionByRange(12, "v", "m").filter("v = 5.0")
        assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() >= 3
        assert metrics.average_ranks(df, "v").filter("v = 5.0").select("rank").distinct().count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_spearman_leaves_out_what_is_no_number(spark):
    data = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 5.0), (None, 1.0), (math.nan, 3.0), (5.0, math.nan)]
    row = metrics.spearman(spark.createDataFrame(data, "t double, p double"), "t", "p").first()
    x, y = ranks([1.0, 2.0, 3.0, 4.0]), ranks([2.0, 1.0, 5.0, 5.0])
    assert row.n == 4 and row.spearman == pytest.approx(np.corrcoef(x, y)[0, 1])
    quality = metrics.regression_metrics(spark.createDataFrame(data, "t double, p double"), "t", "p").first()
    assert quality.n == 4 and quality.mse == pytest.approx((1 + 1 + 4 + 1) / 4)


def test_density_within_its_bound(spark):
    random = np.random.default_rng(5)
    values = np.concatenate([random.normal(0, 1, 400), random.normal(6, 0.2, 200), [30.0], [0.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    n, s = len(values), values.std(ddof=1)
    h = s * n**-0.2
    for r in errors.density(df, "x", points=64).collect():
        exact = np.exp(-0.5 * ((r.x - values) / h) ** 2).sum() / (n * h * math.sqrt(2 * math.pi))
        assert abs(r.density - exact) <= 1e-12 / h


def test_density_moves_cells_not_values(spark):
    rows = rows_of(spark, 20_000)
    plan = errors.density(rows, "error")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [x#" not in plan and "cell#" in plan


def test_no_task_ranks_many_rows(spark, monkeypatch):
    """The parts of a ranking follow the rows, not the session's number of partitions."""
    from strandwork.operators import metrics

    monkeypatch.setattr(metrics, "RANK_ROWS", 50)
    kept = []
    written = metrics.written
    monkeypatch.setattr(metrics, "written", lambda df, name: kept.append(written(df, name)) or kept[-1])
    rows = spark.range(1000).select("id", (F.col("id") * 7 % 250).cast("double").alias("v"))
    got = {r.id: r.rank for r in metrics.average_ranks(rows, "v").collect()}
    values = sorted(i * 7 % 250 for i in range(1000))
    assert got == {i: values.index(i * 7 % 250) + 2.5 for i in range(1000)}
    assert max(r["count"] for r in kept[0].groupBy("_part").count().collect()) < 150
