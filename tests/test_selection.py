import pytest
from pyspark.sql import functions as F

from strandwork.operators import bins, filters, selection, split, target
from strandwork.sources import tables


def test_first_n_is_exact_and_whole_when_short(spark):
    rows = spark.range(1000)
    for n in (0, 1, 137, 1000, 5000):
        assert selection.first_n(rows, ["id"], n, seed=1).count() == min(n, 1000)


def test_first_n_does_not_depend_on_bucket_digits(spark):
    rows = spark.range(500)
    chosen = [{r.id for r in selection.first_n(rows, ["id"], 123, seed=1, digits=d).collect()} for d in (1, 4)]
    assert chosen[0] == chosen[1]


def test_shuffled_position_is_dense(spark):
    rows = spark.range(400).withColumn("g", F.col("id") % 3)
    placed = selection.shuffled_position(rows, ["id"], seed=5, by=["g"], digits=1).collect()
    for g in range(3):
        own = sorted(r.position for r in placed if r.g == g)
        assert own == list(range(len(own)))


def test_key_position_equals_order(spark):
    rows = spark.range(0, 2000, 7).select((F.lit(5000) - F.col("id")).alias("k")).repartition(6)
    placed = sorted((r.k, r.position) for r in selection.key_position(rows, ["k"]).collect())
    assert [p for _, p in placed] == list(range(len(placed)))


def test_gather_repeats(spark):
    placed = spark.range(10).select("id", F.col("id").alias("position"))
    wanted = spark.createDataFrame([(3,), (3,), (7,), (99,)], "position long")
    assert sorted(r.id for r in selection.gather(placed, wanted).collect()) == [3, 3, 7]


def test_splits(spark):
    rows = spark.range(1001).withColumn("g", F.when(F.col("id") % 11 > 0, F.col("id") % 11))
    random = split.random_split(rows, ["id"], fraction=0.15)
    assert random.filter("split = 'test'").count() == 151
    grouped = split.group_split(rows, "g", fraction=0.3)
    assert split.leaking_groups(grouped, "g").count() == 0
    assert grouped.filter("split = 'train'").select("g").distinct().count() == 7
    assert grouped.count() == 1001


def test_split_modes(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "x y z"), (4, None)], "id long, taxonomy string")
    assert split.split_table(rows, 1, key=["id"], fraction=0.5).count() == 3
    with pytest.raises(ValueError):
        split.split_table(rows, "other", key=["id"])
    with pytest.raises(ValueError):
        split.random_split(rows, ["id"], fraction=1.0)


def test_bin_cap_falls_through_to_largest(spark):
    sizes = spark.createDataFrame([(1, 5), (2, 2), (3, 0)], "bin int, n_before long")
    row = bins.bin_caps(sizes, min_kept=100).first()
    assert (row.cap, row.reached) == (5, False)
    assert bins.bin_caps(sizes, min_kept=4).first().cap == 2
    assert bins.bin_caps(sizes, max_bin_size=3).first().cap == 3


def test_undersampling_cuts_every_bin(spark):
    rows = spark.range(900).select("id", F.sqrt(F.col("id").cast("double")).alias("y"))
    rows = rows.unionByName(spark.createDataFrame([(9999, float("nan"))], "id long, y double"))
    kept, sizes = bins.undersample_bins(rows, "y", ["id"], num_bins=10, max_bin_size=40)
    assert kept.count() == sizes.agg(F.sum("n_after")).first()[0] == sum(min(40, r.n_before) for r in sizes.collect())
    assert sizes.count() == 10


def test_standardised_train_split(spark):
    rows = split.random_split(spark.range(200).select("id", (F.col("id") * 3.5).alias("y")), ["id"])
    parameters = target.train_parameters(rows, "y")
    scaled = target.standardize_target(rows, "y", parameters)
    stats = {r.split: r for r in target.split_stats(scaled, "y").collect()}
    assert stats["train"].mean == pytest.approx(0, abs=1e-12) and stats["train"].std == pytest.approx(1)
    assert {r.split: r.null_loss for r in target.null_baseline(scaled, "y").collect()}["train"] == pytest.approx(1)
    back = target.restore_target(scaled, ["y"], parameters)
    assert back.filter(F.abs(F.col("y") - F.col("id") * 3.5) > 1e-9).count() == 0


def test_source_sample_comes_before_filters(spark):
    proteins = spark.range(100).select(F.col("id").cast("string").alias("pid"), F.expr("repeat('A', 51)").alias("protein_seq"), (F.col("id") % 10).alias("taxid"))
    taxa = spark.range(9).select(F.col("id").alias("taxid"), F.when(F.col("id") % 2 == 0, 40.0).alias("temperature"))
    options = dict(on="taxid", sequence="protein_seq", value="temperature", min_length=50, max_length=51)
    assert tables.source_rows(proteins, taxa, **options).count() == 0
    assert tables.source_rows(proteins, taxa, max_inclusive=True, **options).count() == 50
    sampled = tables.source_rows(proteins, taxa, max_inclusive=True, sample=40, key=["pid"], **options)
    assert 0 < sampled.count() < 40


def test_validity(spark):
    rows = spark.createDataFrame([("AB",), ("A B",)], "s string")
    assert filters.invalid_sequences(rows, "s").count() == 1
    with pytest.raises(Exception, match="contains a space"):
        filters.require_valid(rows, "s").collect()


def test_sinks_round_trip(spark, tmp_path):
    rows = split.random_split(spark.range(20).withColumn("y", F.col("id") * 1.0), ["id"])
    tables.save_splits(rows, f"{tmp_path}/data")
    test = tables.load_splits(spark, f"{tmp_path}/data", "test")
    assert test.count() == 3 and "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().toString()
    tables.save_parameters(target.train_parameters(rows, "y"), f"{tmp_path}/parameters")
    assert tables.load_parameters(spark, f"{tmp_path}/parameters").columns == ["train_mean", "train_std"]
    history = spark.createDataFrame([("r", "loss", 1, "0.5"), ("r", "loss", 2, "n/a")], "run string, metric string, step int, value string")
    tables.append_history(history, f"{tmp_path}/history")
    assert spark.read.parquet(f"{tmp_path}/history").count() == 1
    tables.append_summary(rows.groupBy().count(), f"{tmp_path}/summary")
    tables.append_summary(rows.groupBy().count(), f"{tmp_path}/summary")
    assert spark.read.json(f"{tmp_path}/summary").count() == 2


def test_history_tsv(spark, tmp_path):
    (tmp_path / "eval_r2.tsv").write_text("step\teval_r2\n0\t0.5\n0\t0.5\n1\t0.6\n")
    (tmp_path / "loss.tsv").write_text("step\tloss\n0\t1.5\n")
    rows = tables.read_history_tsv(spark, str(tmp_path), "run1")
    assert {(r.metric, r.step, r.value) for r in rows.collect()} == {("eval_r2", 0, 0.5), ("eval_r2", 1, 0.6), ("loss", 0, 1.5)}


def test_batches(spark):
    doubled = filters.map_batches(spark.range(10), lambda f: f.assign(id=f["id"] * 2), "id long", batch_rows=3)
    assert sorted(r.id for r in doubled.collect()) == list(range(0, 20, 2))
    assert filters.filter_batches(spark.range(10), lambda s: s > 6, ["id"]).count() == 3


def test_row_operators_accept_a_stream(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit("MABC").alias("s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("x double, s string").parquet(f"{tmp_path}/in")
    out = filters.length_range(filters.label_window(stream, "x", 2.0, 8.0), "s", 1, 10)
    query = out.writeStream.format("memory").queryName("labelled").trigger(availableNow=True).option(
        "checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(60)
    assert spark.table("labelled").count() == 5


def test_first_n_is_exact_for_keys_with_separators_and_nulls(spark):
    keys = [("a|b", "c"), ("a", "b|c"), (None, "x"), ("x", None)]
    df = spark.createDataFrame(keys, "k string, l string")
    for n in range(5):
        assert selection.first_n(df, ["k", "l"], n, seed=3).count() == n
