"""Sinks that can be written again, user reducers, summaries taken on the way."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandwork.operators import filters, history
from strandwork.sources import tables

LOG = "run string, metric string, step int, value string, n int"


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG)


def read(spark, path):
    return sorted(map(tuple, tables.read_history(spark, path).collect()), key=repr)


def test_an_append_twice_changes_nothing_and_the_last_written_wins(spark, tmp_path):
    path = f"{tmp_path}/log"
    first = log_of(spark, [("007", "train/F1", 1, "0.5", 1), ("007", "train/F1", 1, "0.25", 2), ("b", "train_f1", 1, "1.5", 1),
                           (None, "x", None, "3", 1), ("b", "bad", 1, "n/a", 1), ("b", "nan", 1, "NaN", 1)])
    tables.append_history(first, path, order="n")
    once = read(spark, path)
    tables.append_history(first, path, order="n")
    assert repr(read(spark, path)) == repr(once)
    assert [r[:3] for r in once] == [("007", "train/F1", 1), ("b", "nan", 1), ("b", "train_f1", 1), (None, "x", None)]
    assert once[0][3] == 0.25
    tables.append_history(log_of(spark, [("007", "train/F1", 1, "0.75", 1), ("007", "train/F1", 2, "9", 1), (None, "x", None, "4", 1)]), path, order="n")
    now = {r[:3]: r[3] for r in read(spark, path)}
    assert now["007", "train/F1", 1] == 0.75 and now["007", "train/F1", 2] == 9 and now[None, "x", None] == 4
    assert now["b", "train_f1", 1] == 1.5 and len(now) == 5


def test_only_touched_folders_are_written_anew(spark, tmp_path):
    path = f"{tmp_path}/log"
    tables.append_history(log_of(spark, [(f"r{i}", "m", 1, "1", 1) for i in range(200)]), path)
    before = {f for f in tmp_path.glob("log/part=*/*.parquet")}
    tables.append_history(log_of(spark, [("r1", "m", 2, "1", 1)]), path)
    after = {f for f in tmp_path.glob("log/part=*/*.parquet")}
    assert len({f.parent for f in before - after}) == 1 and len(read(spark, path)) == 201


def test_report_and_last_repeat(spark):
    rows = spark.createDataFrame([("a", "f1", 1, 0.9, 1), ("a", "f1", 2, 0.4, 2), ("a", "f1", 2, 0.3, 3), ("a", "r2", 1, float("nan"), 4)],
                                 "run string, metric string, step int, value double, n int")
    last = history.once_per_step(rows, "n")
    assert {tuple(r) for r in last.filter("metric = 'f1'").collect()} == {("a", "f1", 1, 0.9), ("a", "f1", 2, 0.3)}
    row = history.report(last, ["f1", "none"]).first()
    assert (row.run, row.f1, row.none) == ("a", 0.3, None)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_user_reducer(spark, by):
    df = spark.range(0, 5000, 1, 6).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("g"), F.col("id").alias("v"))

    def partial(rows):
        return pd.DataFrame({"n": [len(rows)], "top": [rows["v"].max()]})

    def merge(states):
        return pd.DataFrame({"n": [states["n"].sum()], "top": [states["top"].max()]})

    found = filters.reduce_batches(df, partial, merge, "n long, top long", by)
    want = df.groupBy(*by).agg(F.count("*").alias("n"), F.max("v").alias("top"))
    assert sorted(map(tuple, found.select(*by, "n", "top").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert filters.reduce_batches(df.limit(0), partial, merge, "n long, top long", by).count() == 0


def test_measures_are_taken_while_splits_are_written(spark, tmp_path):
    df = spark.range(30).withColumn("split", F.when(F.col("id") < 20, "train").otherwise("test"))
    seen = tables.save_splits(df, f"{tmp_path}/d", measures={"n": F.count(F.lit(1)), "n_train": F.count_if(F.col("split") == "train")})
    assert seen == {"n": 30, "n_train": 20} and tables.load_splits(spark, f"{tmp_path}/d", "test").count() == 10


def test_regressor_rows_are_computed_once(spark, monkeypatch):
    """The scans for the bins read a table of the job, which is gone when the job is done."""
    from pathlib import Path

    from strandwork.plans import jobs

    read = []
    undersample = jobs.bins.undersample_bins
    monkeypatch.setattr(jobs.bins, "undersample_bins", lambda df, *a, **b: read.extend(df.inputFiles()) or undersample(df, *a, **b))
    rows = spark.range(60).select("id", F.repeat(F.lit("abc"), F.col("id").cast("int") + 1).alias("seq"), (F.col("id") % 7).cast("double").alias("y"))
    done = jobs.regressor_data(rows, id="id", sequence="seq", value="y", split_mode="random", num_bins=5)
    assert read and all("regressor-data" in f for f in read)
    assert not any(Path(f.removeprefix("file://")).exists() for f in read)
    assert done.data.count() > 0 and done.bins.count() == 5
