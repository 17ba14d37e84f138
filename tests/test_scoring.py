"""Linear baselines on hashed k-grams."""

from pyspark.sql import functions as F

from strandwork.operators import scoring


def test_grams_are_hashed_once_for_all_passes_of_a_fit(spark, monkeypatch):
    tables = []
    written = scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    rows = spark.range(60).select("id", F.md5(F.col("id").cast("string")).alias("seq"), (F.col("id") % 2).cast("double").alias("y"))
    for train in (scoring.train_classifier, scoring.train_regressor):
        model = train(rows, "seq", "y", features=256, iterations=5)
        found = scoring.apply_model(model, rows, "seq", ["id", "y"])
        assert found.columns == ["id", "y", "prediction"]
        assert found.agg(F.corr("y", "prediction")).first()[0] > 0.8
    assert [t.columns for t in tables] == [["y", "_features"]] * 2 and all(t.inputFiles() for t in tables)
