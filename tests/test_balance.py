import pytest
from pyspark.sql import functions as F

from strandwork.operators import balance, metrics

# Fixed values: (n_a, n_b, desired, max_upsampling, a, b).
SIZES = [
    (2, 10, 0.5, 1.0, 4, 4),
    (2, 10, 0.5, 0.0, 2, 2),
    (2, 10, 0.5, 2.0, 6, 6),
    (2, 10, 0.25, 0.0, 2, 6),
    (10, 2, 0.5, 0.0, 2, 2),
    (4, 5, 0.5, 1.0, 5, 5),
    (5, 5, 0.5, 0.0, 5, 5),
    (4, 6, 0.4, 0.0, 4, 6),
]
# Fixed values: (tn, fp, fn, tp, accuracy, f1, matthew).
MATRICES = [
    (14010, 3518, 2275, 8692, 0.79670117564485, 0.7500539327781854, 0.5819310790218084),
    (15946, 1582, 581, 10386, 0.9240919459554308, 0.9056899934597776, 0.8446274284615868),
]


@pytest.mark.parametrize("case", SIZES)
def test_target_sizes(spark, case):
    n_a, n_b, desired, up, a, b = case
    frame = spark.createDataFrame([(n_a, n_b)], "x long, y long")
    sizes = frame.select(balance.balanced_sizes(F.col("x"), F.col("y"), desired=desired, max_upsampling=up).alias("s"))
    assert tuple(sizes.first()["s"]) == (a, b)


@pytest.mark.parametrize("desired", [0.0, 0.6])
def test_rejects_impossible_balance(spark, desired):
    with pytest.raises(ValueError):
        balance.balanced_sizes(F.lit(1), F.lit(2), desired=desired)


@pytest.mark.parametrize("case", MATRICES)
def test_classification_measures(spark, case):
    frame = spark.createDataFrame([case[:4]], "tn long, fp long, fn long, tp long")
    cells = [F.col(c) for c in frame.columns]
    row = frame.select(*[m(*cells) for m in metrics.CLASSIFICATION.values()]).first()
    assert list(row) == pytest.approx(case[4:], abs=1e-12)


def test_undefined_measures_are_zero(spark):
    frame = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    row = metrics.classification_metrics(frame, "t", "p").first()
    assert (row.accuracy, row.f1, row.matthew) == (1.0, 0.0, 0.0)


def labelled(spark, small, big):
    return spark.range(small + big).select("id", (F.col("id") < small).cast("int").alias("label"))


@pytest.mark.parametrize("keep", [False, True])
def test_upsampling_reaches_exact_sizes(spark, keep):
    rows = balance.balance_classes(labelled(spark, 100, 300), "label", ["id"], max_upsampling=1.0, keep_originals=keep)
    counts = {r["label"]: (r["n"], r["d"]) for r in rows.groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()}
    assert counts[0] == (200, 200)
    assert counts[1][0] == 200
    assert (counts[1][1] == 100) if keep else (counts[1][1] < 100)


def test_balance_is_stable_under_repartitioning(spark):
    rows = labelled(spark, 50, 400)
    one = balance.balance_classes(rows.repartition(1), "label", ["id"], seed=3)
    many = balance.balance_classes(rows.repartition(7), "label", ["id"], seed=3)
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in many.collect()}
    assert one.count() == 100


def test_strata_balance_separately(spark):
    rows = spark.range(300).select(
        "id", F.when(F.col("id") < 150, "a").alias("g"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label")
    )
    out = balance.balance_classes(rows, "label", ["id"], by=["g"])
    assert {(r.g, r.label): r["count"] for r in out.groupBy("g", "label").count().collect()} == {
        ("a", 0): 15, ("a", 1): 15, (None, 0): 15, (None, 1): 15,
    }


def test_constant_class_weights(spark):
    rows = spark.createDataFrame([(1,), (1,)], "y int")
    assert {r.label: r.weight for r in balance.class_weights(rows, "y").collect()} == {0: None, 1: 1.0}
