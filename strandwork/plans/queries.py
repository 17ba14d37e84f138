"""Registered queries: every operator on the driver's tables, whole tables each."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.functions import sequences
from strandwork.functions.attach import attach
from strandwork.functions.labels import argmax
from strandwork.operators import (
    balance,
    bins,
    encoding,
    errors,
    filters,
    history,
    linear,
    metrics,
    neardup,
    scoring,
    selection,
    split,
    target,
)
from strandwork.plans import jobs
from strandwork.sources.session import shared_folder
from strandwork.sources.tables import (
    append_history,
    load_clusters,
    load_parameters,
    load_splits,
    read_history,
    source_rows,
    spread,
)

SEED = 7
LOW, HIGH = 20.0, 100.0
TYPES = ["click", "error", "purchase", "signup", "view"]
LSH = neardup.Similarity(threshold=0.6)
EXACT = neardup.Similarity(threshold=0.6, candidates="prefix", verify="exact", pivots=neardup.MAX_WIDTH)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(column: str, digits: int = 6):
    return F.round(F.col(column), digits).alias(column)


# -- sources, filters, labels


def _joined(spark, sf, **options) -> DataFrame:
    rows = source_rows(
        table(spark, sf, "documents").select("doc_id", "text", "source"),
        table(spark, sf, "labels").select("doc_id", "quality"),
        on="doc_id",
        sequence="text",
        value="quality",
        min_length=50,
        max_length=2000,
        **options,
    )
    return rows.select("doc_id", "source", "quality", F.length("text").alias("length"))


def join_length_exclusive(spark, sf):
    return _joined(spark, sf)


def join_length_inclusive(spark, sf):
    return _joined(spark, sf, max_inclusive=True)


def source_sample(spark, sf):
    return _joined(spark, sf, sample=200, key=["doc_id"], seed=SEED)


def invalid_sequences(spark, sf):
    return filters.invalid_sequences(table(spark, sf, "documents"), "text").select("doc_id", "n_chars")


def _labelled(spark, sf) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return filters.label_window(events, "value", LOW, HIGH)


def window_label(spark, sf):
    return _labelled(spark, sf)


def class_ratio(spark, sf):
    ratio = balance.class_ratio(_labelled(spark, sf), "labels", ["event_type"])
    return ratio.select("event_type", "n_rows", "n_positive", r("ratio"))


def class_weights(spark, sf):
    weights = balance.class_weights(_labelled(spark, sf), "labels", ["event_type"])
    return weights.select("event_type", "label", r("weight"))


# -- balancing, bins, positions


def balance_sizes(spark, sf):
    return balance.class_targets(_labelled(spark, sf), "labels", desired=0.4, max_upsampling=0.25, by=["event_type"])


def balanced_down(spark, sf):
    rows = balance.balance_classes(_labelled(spark, sf), "labels", ["event_id"], seed=SEED)
    return rows.select("event_id", "labels")


def balanced_up(spark, sf):
    rows = balance.balance_classes(_labelled(spark, sf), "labels", ["event_id"], max_upsampling=1.0, seed=SEED)
    return rows.groupBy("event_id", "labels").agg(F.count(F.lit(1)).alias("copies"))


def _orders(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")


def bin_histogram(spark, sf):
    sizes = bins.bin_histogram(_orders(spark, sf), "o_totalprice", 20)
    return sizes.select("bin", r("lo", 4), r("hi", 4), "n_before")


def bin_cap(spark, sf):
    by = ["o_orderpriority"]
    return bins.bin_caps(bins.bin_histogram(_orders(spark, sf), "o_totalprice", 20, by), min_kept=0.5, by=by)


def bin_undersample(spark, sf):
    rows, _ = bins.undersample_bins(_orders(spark, sf), "o_totalprice", ["o_orderkey"], num_bins=20, seed=SEED)
    return rows.select("o_orderkey", "o_totalprice")


def shuffled_positions(spark, sf):
    placed = selection.shuffled_position(_orders(spark, sf), ["o_orderkey"], seed=SEED, by=["o_orderpriority"])
    return placed.select("o_orderkey", "o_orderpriority", "position")


def gather_positions(spark, sf):
    placed = selection.key_position(_orders(spark, sf).select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    wanted = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("position"))
    picked = selection.gather(placed, wanted)
    return picked.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


# -- splits and targets


def random_split(spark, sf):
    rows = split.random_split(_orders(spark, sf), ["o_orderkey"], fraction=0.15, seed=SEED)
    return rows.select("o_orderkey", "split")


def _grouped(spark, sf) -> DataFrame:
    return split.group_split(_orders(spark, sf), "o_custkey", fraction=0.15, seed=SEED)


def group_split(spark, sf):
    return _grouped(spark, sf).select("o_orderkey", "o_custkey", "split")


def prefix_split(spark, sf):
    rows = split.prefix_split(table(spark, sf, "part"), "p_name", 0, fraction=0.3, seed=SEED)
    return rows.select("p_partkey", "p_name_prefix", "split")


def split_leakage(spark, sf):
    rows = split.random_split(_orders(spark, sf), ["o_orderkey"], fraction=0.15, seed=SEED)
    return split.leaking_groups(rows, "o_custkey")


def split_leakage_grouped(spark, sf):
    return split.leaking_groups(_grouped(spark, sf), "o_custkey").agg(F.count(F.lit(1)).alias("n_leaking"))


def split_stats(spark, sf):
    return target.split_stats(_grouped(spark, sf), "o_totalprice").select("split", "n", r("mean", 3), r("std", 3))


def _scaled(spark, sf):
    rows = _grouped(spark, sf)
    parameters = target.train_parameters(rows, "o_totalprice")
    return target.standardize_target(rows, "o_totalprice", parameters), parameters


def standardized(spark, sf):
    return _scaled(spark, sf)[0].select("o_orderkey", "split", r("o_totalprice"))


def unstandardized(spark, sf):
    rows, parameters = _scaled(spark, sf)
    return target.restore_target(rows, ["o_totalprice"], parameters).select("o_orderkey", r("o_totalprice", 4))


def null_baseline(spark, sf):
    losses = target.null_baseline(_scaled(spark, sf)[0], "o_totalprice")
    return losses.select("split", "n", r("sum_square", 4), r("null_loss"))


# -- sequences and near-duplicates


def _texts(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "source", "text"))


def _documents(spark, sf) -> DataFrame:
    """Sequences may not contain spaces."""
    texts = _texts(spark, sf)
    return texts.select("doc_id", "source", F.replace("text", F.lit(" "), F.lit("")).alias("seq"))


def kgrams(spark, sf):
    grams = F.array_sort(sequences.kgrams(F.col("seq"), 3))
    rows = _documents(spark, sf).select("doc_id", grams.alias("grams"))
    return rows.select("doc_id", F.size("grams").alias("n_grams"), F.md5(F.array_join("grams", "")).alias("digest"))


def minhash_signatures(spark, sf):
    rows = neardup.signatures(_documents(spark, sf), id="doc_id", sequence="seq")
    text = F.array_join(F.transform("signature", lambda x: x.cast("string")), ",")
    return rows.select(F.col("id").alias("doc_id"), text.alias("signature"))


def _found(spark, sf, how=LSH):
    return neardup.find_near_duplicates(_documents(spark, sf), id="doc_id", sequence="seq", how=how)


def lsh_pairs(spark, sf):
    return _found(spark, sf).edges.select("a", "b", r("similarity"))


def exact_pairs(spark, sf):
    return _found(spark, sf, EXACT).edges.select("a", "b", r("similarity"))


def dedup_clusters(spark, sf):
    return neardup.clusters(_found(spark, sf)).withColumn("copies", F.when(F.col("is_extreme"), F.col("copies")))


def dedup_representatives(spark, sf):
    return neardup.representatives(_found(spark, sf))


def dedup_seeded(spark, sf):
    """Representatives of a scan in random order, by exact similarity."""
    return neardup.representatives(_found(spark, sf, replace(EXACT, order_seed=SEED)))


def dedup_rows(spark, sf):
    rows, _ = neardup.deduplicate(_documents(spark, sf), id="doc_id", sequence="seq", how=LSH)
    return rows.select("doc_id", "source")


def dedup_summary(spark, sf):
    documents = _documents(spark, sf)
    return neardup.summary(documents, _found(spark, sf))


def normalized_sequence(spark, sf):
    rows = _texts(spark, sf)
    return rows.select("doc_id", F.md5(sequences.normalized(F.col("text"))).alias("digest"))


def _digested(coded: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("input_ids", lambda x: x.cast("string")), ",")
    filled = F.aggregate("attention_mask", F.lit(0), lambda acc, x: acc + x)
    return coded.select("doc_id", F.md5(text).alias("digest"), filled.alias("n_tokens"))


def encoded_tokens(spark, sf):
    rows = _texts(spark, sf).select("doc_id", "text")
    words = F.split("text", "")
    return _digested(encoding.encode(rows, words, encoding.fit_vocabulary(rows, words), length=512, keep=["doc_id"]))


def encoded_words(spark, sf):
    """Whole words; those of a single document are unknown."""
    rows = table(spark, sf, "documents").select("doc_id", "text")
    words = F.split(F.lower("text"), " ")
    return _digested(encoding.encode(rows, words, encoding.fit_vocabulary(rows, words, min_rows=2), length=512, keep=["doc_id"]))


def encoded_sequences(spark, sf):
    """Normalised sequences, with the letters of the sequences of one source as vocabulary."""
    rows = table(spark, sf, "documents").select("doc_id", "source", F.translate("text", "uzob", "UZOB").alias("text"))
    words = F.split(sequences.normalized(F.col("text")), " ")
    own = rows.filter(F.col("source") == rows.agg(F.min("source")).first()[0])
    return _digested(encoding.encode(rows, words, encoding.fit_vocabulary(own, words), length=256, keep=["doc_id"]))


# -- classification


def argmax_labels(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", argmax(F.col("embedding")).alias("prediction"))


def weighted_log_loss(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"), (F.col("label") % 2).alias("label")
    )
    weights = balance.class_weights(rows, "label")
    return metrics.weighted_log_loss(rows, "logits", "label", weights).select(r("log_loss"))


def _judged(spark, sf) -> DataFrame:
    documents = table(spark, sf, "documents").select(
        "doc_id", "source", (F.col("n_chars") > 1000).cast("int").alias("prediction")
    )
    return documents.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


def confusion(spark, sf):
    return metrics.confusion(_judged(spark, sf), "quality", "prediction")


def classification_metrics(spark, sf):
    scores = metrics.classification_metrics(_judged(spark, sf), "quality", "prediction", ["source"])
    return scores.select("source", "tn", "fp", "fn", "tp", r("accuracy"), r("f1"), r("matthew"))


# -- regression


def _predicted(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_linestatus",
        "l_returnflag",
        F.col("l_extendedprice").alias("truth"),
        (F.col("l_quantity") * 2000.0).alias("prediction"),
    )


def regression_metrics(spark, sf):
    scores = metrics.regression_metrics(_predicted(spark, sf), "truth", "prediction", ["l_returnflag"])
    return scores.select("l_returnflag", "n", r("mse", 1), r("mae", 4), r("r2"))


def spearman(spark, sf):
    rho = metrics.spearman(_predicted(spark, sf), "truth", "prediction", ["l_returnflag"])
    return rho.select("l_returnflag", "n", r("spearman"))


def _profile(spark, sf) -> DataFrame:
    rows = errors.with_error(_predicted(spark, sf), "truth", "prediction")
    return errors.error_profile(rows, "truth", "error", bins=10, by=["l_linestatus"])


def error_profile(spark, sf):
    names = ["mid", "mean_error", "std_error", "lo", "hi"]
    return _profile(spark, sf).select("l_linestatus", "bin", "n", *[r(c, 3) for c in names])


def _pairs(spark, sf) -> DataFrame:
    return errors.error_pairs(_profile(spark, sf), bins=10, by=["l_linestatus"])


def error_pairs(spark, sf):
    return _pairs(spark, sf).select("l_linestatus", "low_bin", "high_bin", r("dT", 3), r("total_error", 3))


def error_trend(spark, sf):
    line = errors.error_trend(_pairs(spark, sf), ["l_linestatus"])
    return line.select("l_linestatus", "n", r("slope"), r("intercept", 3), r("r2"))


def overlap_probability(spark, sf):
    rows = errors.overlap_probability(_pairs(spark, sf))
    return rows.select(
        "l_linestatus", "low_bin", "high_bin", r("crossing", 3), "is_fallback", r("overlap_probability")
    )


def density_grid(spark, sf):
    rows = errors.density(table(spark, sf, "events"), "value", by=["event_type"])
    return rows.select("event_type", "point", r("x", 4), r("density", 9))


def joint_bins(spark, sf):
    return errors.joint_bins(_predicted(spark, sf), "truth", "prediction", edges=20)


# -- histories


def _history(spark, sf) -> DataFrame:
    """Events as a metric log in which every record was written twice."""
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"),
        F.col("event_type").alias("metric"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step"),
        "value",
    )
    return rows.unionByName(rows)


def metric_history(spark, sf):
    return history.prefixed(history.once_per_step(_history(spark, sf)), "model_")


def metric_pivot(spark, sf):
    return history.pivot_metrics(_history(spark, sf), TYPES)


def latest_metrics(spark, sf):
    return history.latest_metrics(history.once_per_step(_history(spark, sf)))


def best_step(spark, sf):
    return history.best_step(history.once_per_step(_history(spark, sf)), "view")


def logs_to_columns(spark, sf):
    rows = table(spark, sf, "events")
    step = F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step")
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    is_error = F.col("event_type") == "error"
    clean = rows.filter(~is_error).select("event_id", step, F.col("value").alias("loss"))
    failed = rows.filter(is_error).select("event_id", step, k)
    return history.logs_to_columns(clean, [failed])


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def history_log(spark, sf):
    """Events as a metric log that was appended in three parts, the second of them twice; the last event counts."""
    rows = table(spark, sf, "events").filter(~F.isnan("value")).select(
        F.col("user_id").cast("string").alias("run"),
        F.concat(F.lit("Eval/"), "event_type").alias("metric"),
        F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step"),
        "value",
        "event_id",
    )
    folder = _folder(spark, "history")
    third = rows.agg((F.max("event_id") / 3).alias("third")).first()[0]
    parts = [rows.filter(F.least(F.floor(F.col("event_id") / F.lit(third)), F.lit(2)) == i) for i in range(3)]
    for i in (0, 1, 1, 2):
        append_history(parts[i], folder, order="event_id")
    return read_history(spark, folder)


def latest_report(spark, sf):
    return history.report(history.once_per_step(_history(spark, sf)), TYPES)


def user_map(spark, sf):
    def shorten(frame):
        return frame.assign(text=frame["text"].str[:20], n=frame["text"].str.count("e"))

    rows = table(spark, sf, "documents").select("doc_id", "text")
    return filters.map_batches(rows, shorten, "doc_id long, text string, n long", batch_rows=500)


def user_filter(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    kept = filters.filter_batches(rows, lambda text, n: (text.str.count("a") * 20 > n), ["text", "n_chars"])
    return kept.select("doc_id", "n_chars")


def user_reduce(spark, sf):
    """A user's reducer: rows, characters and the longest text of each source."""
    import pandas as pd

    def partial(frame):
        return pd.DataFrame({"n": [len(frame)], "chars": [frame["n_chars"].sum()], "longest": [frame["n_chars"].max()]})

    def merge(states):
        return pd.DataFrame({"n": [states["n"].sum()], "chars": [states["chars"].sum()], "longest": [states["longest"].max()]})

    rows = table(spark, sf, "documents").select("source", "n_chars")
    return filters.reduce_batches(rows, partial, merge, "n long, chars long, longest long", by=["source"])


# -- models


WEIGHTS = [((i * 37) % 64 - 31.5) / 32.0 for i in range(64)]


def batch_score(spark, sf):
    rows = scoring.batch_score(
        table(spark, sf, "embeddings"),
        id="vec_id",
        feature="embedding",
        truth="label",
        factory=scoring.linear_scorer(WEIGHTS, 0.5),
    )
    return rows.select("id", "truth", r("prediction", 4))


def _report(model, spark, held_out: DataFrame) -> DataFrame:
    """Coefficients and held-out losses as ``(name, value)``."""
    losses = held_out.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in held_out.columns])))
    return model.table(spark).unionByName(losses).select("name", r("value"))


def train_classifier(spark, sf):
    """Class-weighted logistic regression on two named features, judged on held-out rows."""
    chars, words = F.length("text"), F.size(F.split("text", " "))
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    rows = rows.select("doc_id", "quality", F.log1p(chars).alias("size"), (chars / words).alias("word_length"))
    rows = split.random_split(rows, ["doc_id"], fraction=0.3, seed=SEED)
    train, test = (rows.filter(F.col("split") == name) for name in ("train", "test"))
    weights = balance.class_weights(train, "quality").withColumnRenamed("label", "quality")
    model = linear.fit_logistic(attach(train, weights, ["quality"]), ["size", "word_length"], "quality", weight="weight")
    weighed = attach(test, weights, ["quality"]).withColumn("chance", model.chance())

    def loss(chance):
        each = F.col("quality") * F.log(chance) + (1 - F.col("quality")) * F.log(1 - chance)
        return -F.sum(F.col("weight") * each) / F.sum("weight")

    return _report(model, spark, weighed.agg(loss(F.col("chance")).alias("log_loss"), loss(F.lit(0.5)).alias("null_loss")))


def train_regressor(spark, sf):
    """Least squares on two named features and a standardised label, judged on held-out rows."""
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.col("l_extendedprice").cast("double").alias("labels")
    )
    rows = split.random_split(rows, ["l_orderkey", "l_linenumber"], fraction=0.15, seed=SEED)
    rows = target.standardize_target(rows, "labels", target.train_parameters(rows, "labels"))
    model = linear.fit_least_squares(rows.filter(F.col("split") == "train"), ["l_quantity", "l_tax"], "labels")
    test = rows.filter(F.col("split") == "test").withColumn("prediction", model.score())
    losses = test.agg(metrics.mse(F.col("labels"), F.col("prediction")).alias("mse"), F.avg(F.col("labels") * F.col("labels")).alias("null_mse"))
    return _report(model, spark, losses)


def grams_classifier(spark, sf):
    rows = _documents(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    weights = balance.class_weights(rows, "quality").withColumnRenamed("label", "quality")
    rows = rows.join(F.broadcast(weights), "quality")
    model = scoring.train_classifier(rows, "seq", "quality", weight="weight")
    return scoring.apply_model(model, rows, "seq", ["doc_id", "quality"])


def grams_regressor(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("seq"), F.col("n_chars").cast("double").alias("labels")
    )
    rows = split.random_split(rows, ["doc_id"], fraction=0.15, seed=SEED)
    rows = target.standardize_target(rows, "labels", target.train_parameters(rows, "labels"))
    model = scoring.train_regressor(rows.filter(F.col("split") == "train"), "seq", "labels")
    return scoring.apply_model(model, rows, "seq", ["doc_id", "split", "labels"])


# -- whole jobs


def _classifier(spark, sf):
    rows = _documents(spark, sf).withColumn("size", F.length("seq").cast("double"))
    return jobs.classifier_data(
        rows,
        id="doc_id",
        sequence="seq",
        value="size",
        window=(1000.0, 2000.0),
        group="source",
        how=LSH,
        keep=["doc_id", "source", "labels"],
        seed=SEED,
    )


def classifier_data(spark, sf):
    return _classifier(spark, sf).data


def _regressor(spark, sf):
    rows = _documents(spark, sf).withColumn("size", F.length("seq").cast("double"))
    return jobs.regressor_data(
        rows, id="doc_id", sequence="seq", value="size", group="source", how=LSH,
        keep=["doc_id", "labels"], seed=SEED,
    )


def regressor_data(spark, sf):
    return _regressor(spark, sf).data.select("doc_id", "split", r("labels"))


def classifier_saved(spark, sf):
    """The classifier job written to its sinks; the test split and the summary as they are read back."""
    folder = _folder(spark, "classifier")
    summary = jobs.save(_classifier(spark, sf), folder)
    test = load_splits(spark, f"{folder}/data", "test").select("doc_id", "source", "labels")
    clusters = load_clusters(spark, f"{folder}/clusters").agg(F.count(F.lit(1)).alias("n_in_clusters"))
    columns = ["n_train", "n_test", r("mean_train"), r("mean_test")]
    return attach(attach(test, summary.select(*columns)), clusters)


def regressor_saved(spark, sf):
    """The regressor job written to its sinks; rows in original units from splits and parameters read back."""
    folder = _folder(spark, "regressor")
    summary = jobs.save(_regressor(spark, sf), folder)
    rows = target.restore_target(load_splits(spark, f"{folder}/data"), ["labels"], load_parameters(spark, f"{folder}/parameters"))
    columns = ["n_train", "n_test", *[r(c, 4) for c in ("mean_train", "std_train", "mean_test", "std_test")]]
    return attach(rows.select("doc_id", "split", r("labels", 4)), summary.select(*columns))


def prediction_report(spark, sf):
    report = jobs.prediction_report(_predicted(spark, sf), "truth", "prediction", by=["l_returnflag", "l_linestatus"])
    return report.trend.select("l_returnflag", "l_linestatus", "n", r("slope"), r("intercept", 3), r("r2"))


QUERIES = {
    f.__name__: f
    for f in (
        join_length_exclusive,
        join_length_inclusive,
        source_sample,
        invalid_sequences,
        window_label,
        class_ratio,
        class_weights,
        balance_sizes,
        balanced_down,
        balanced_up,
        bin_histogram,
        bin_cap,
        bin_undersample,
        shuffled_positions,
        gather_positions,
        random_split,
        group_split,
        prefix_split,
        split_leakage,
        split_leakage_grouped,
        split_stats,
        standardized,
        unstandardized,
        null_baseline,
        kgrams,
        minhash_signatures,
        lsh_pairs,
        exact_pairs,
        dedup_clusters,
        dedup_representatives,
        dedup_seeded,
        dedup_rows,
        dedup_summary,
        normalized_sequence,
        encoded_tokens,
        encoded_words,
        encoded_sequences,
        argmax_labels,
        weighted_log_loss,
        confusion,
        classification_metrics,
        regression_metrics,
        spearman,
        error_profile,
        error_pairs,
        error_trend,
        overlap_probability,
        density_grid,
        joint_bins,
        metric_history,
        metric_pivot,
        latest_metrics,
        best_step,
        logs_to_columns,
        batch_score,
        train_classifier,
        train_regressor,
        grams_classifier,
        grams_regressor,
        classifier_data,
        regressor_data,
        classifier_saved,
        regressor_saved,
        history_log,
        latest_report,
        user_map,
        user_filter,
        user_reduce,
        prediction_report,
    )
}
