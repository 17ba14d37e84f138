"""Model quality measures as aggregates.

Measures are expressions over the columns ``truth`` and ``prediction``; a run
over many models is one ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.attach import attach, join_by
from strandwork.functions.binning import usable
from strandwork.functions.labels import cross_entropy
from strandwork.sources.session import held, written

#: Rows that one task ranks.
RANK_ROWS = 500_000


def confusion(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, tn, fp, fn, tp)``: rows are the truth, read left to right."""
    t, p = F.col(truth), F.col(prediction)
    return df.groupBy(*by).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def accuracy(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return F.try_divide((tn + tp).cast("double"), tn + fp + fn + tp)


def f1(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """F1 of class 1; 0 where there is nothing to find or found."""
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def matthews(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    """Matthews correlation; 0 where a margin is empty. Products are taken in double."""
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return F.coalesce(F.try_divide(tp * tn - fp * fn, scale), F.lit(0.0))


CLASSIFICATION: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "accuracy": accuracy,
    "f1": f1,
    "matthew": matthews,
}


def classification_metrics(
    df: DataFrame, truth: str, prediction: str, by: Sequence[str] = (), metrics: dict | None = None
) -> DataFrame:
    """Counts of the confusion matrix and the measures derived from them."""
    table = confusion(df, truth, prediction, by)
    cells = [F.col(c) for c in ("tn", "fp", "fn", "tp")]
    return table.withColumns({name: m(*cells) for name, m in (metrics or CLASSIFICATION).items()})


def weighted_log_loss(
    df: DataFrame, logits: str, label: str, weights: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """``(*by, log_loss)``: mean cross-entropy weighted by ``weights(label, weight)``.

    The per-class sums are formed first, so the weights meet one row per class.
    """
    losses = df.withColumn("_loss", cross_entropy(F.col(logits), F.col(label)))
    sums = losses.groupBy(*by, F.col(label).alias("label")).agg(
        F.sum("_loss").alias("loss"), F.count("_loss").alias("n")
    )
    keys = [*[c for c in by if c in weights.columns], "label"]
    joined = join_by(sums, weights, keys)
    return joined.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("weight") * F.col("loss")), F.sum(F.col("weight") * F.col("n"))).alias("log_loss")
    )


def mse(truth: Column, prediction: Column) -> Column:
    return F.avg((prediction - truth) * (prediction - truth))


def mae(truth: Column, prediction: Column) -> Column:
    return F.avg(F.abs(prediction - truth))


def r2(truth: Column, prediction: Column) -> Column:
    """1 - residual / total sum of squares; NULL for a constant truth."""
    return 1.0 - F.try_divide(mse(truth, prediction), F.var_pop(truth))


REGRESSION: dict[str, Callable[[Column, Column], Column]] = {"mse": mse, "mae": mae, "r2": r2}


def regression_metrics(
    df: DataFrame,
    truth: str,
    prediction: str,
    by: Sequence[str] = (),
    metrics: dict | None = None,
    digits: int | None = None,
) -> DataFrame:
    """All measures in one pass over the rows with a number on both sides; ``digits`` rounds them for reports."""
    df = df.filter(usable(F.col(truth)) & usable(F.col(prediction)))
    measures = {name: m(F.col(truth), F.col(prediction)) for name, m in (metrics or REGRESSION).items()}
    if digits is not None:
        measures = {name: F.round(m, digits) for name, m in measures.items()}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[m.alias(name) for name, m in measures.items()])


def average_ranks(df: DataFrame, column: str, *, by: Sequence[str] = (), into: str = "rank") -> DataFrame:
    """``df`` with the rank of ``column`` among the rows of ``by``, from 1; equal values share the middle one.

    Rows are dealt by ranges of the value and, among equal ones, at random, so that a value held by a third
    of the rows lies in several parts. Each part ranks its own rows. Only what a part has at its two ends can
    go on in another part: from the counts of these, a few numbers per part, every part learns how many rows
    come ahead of it and how often its first and last value occur in all.
    """
    # A part is sorted by one task: there are as many as it takes, whatever the session's number.
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANK_ROWS))
    mark = F.xxhash64(*df.columns, F.monotonically_increasing_id())
    ranged = df.withColumn("_mark", mark).repartitionByRange(parts, *by, column, "_mark").drop("_mark")
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()), "ranks")
    groups = [*by, "_part"]
    ends = ranged.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(column).alias("_low"), F.max(column).alias("_high")
    )
    ends = held(ends)[0]
    marked = attach(ranged.select(*groups, column), ends.select(*groups, "_low", "_high"), groups)
    counts = marked.groupBy(*groups).agg(
        F.count_if(F.col(column) == F.col("_low")).alias("_lows"), F.count_if(F.col(column) == F.col("_high")).alias("_highs")
    )
    ahead = F.sum("_rows").over(_ordered(by, "_part")) - F.col("_rows")
    ends = join_by(ends, counts, groups).withColumn("_ahead", ahead)
    # One row for each end; a part with a single value has one.
    low = F.struct(F.col("_low").alias("_value"), F.col("_ahead").alias("_smaller"), F.col("_lows").alias("_times"))
    smaller = F.col("_ahead") + F.col("_rows") - F.col("_highs")
    high = F.struct(F.col("_high").alias("_value"), smaller.alias("_smaller"), F.col("_highs").alias("_times"))
    both = F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high))
    shared = ends.select(*groups, F.inline(both))
    whole = shared.groupBy(*by, "_value").agg(F.min("_smaller").alias("_smaller"), F.sum("_times").alias("_times"))
    middle = (F.col("_smaller") + (F.col("_times") + 1) / 2.0).alias("_middle")
    whole = held(whole.select(*by, "_value", middle))[0]
    for name in ("_low", "_high"):
        found = whole.withColumnsRenamed({"_value": name, "_middle": f"{name}_rank"})
        ends = join_by(ends, found, [*by, name])
    joined = attach(ranged, ends.select(*groups, "_low", "_high", "_ahead", "_low_rank", "_high_rank"), groups)
    joined = joined.repartition(parts, *groups)
    local = Window.partitionBy(*groups).orderBy(column)
    rank = F.rank().over(local)
    times = F.count(F.lit(1)).over(Window.partitionBy(*groups, column))
    own = F.col("_ahead") + rank + (times - 1) / 2.0
    value = F.col(column)
    rank = F.when(value == F.col("_low"), F.col("_low_rank")).when(value == F.col("_high"), F.col("_high_rank")).otherwise(own)
    return joined.withColumn(into, rank).select(*df.columns, into)


def _ordered(by: Sequence[str], order: str) -> Window:
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(order)


def spearman(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, n, spearman)`` with average ranks for ties.

    Each side is ranked by one range sort (see ``average_ranks``); there is no join on values. Ranks are
    centred on their known mean before they are multiplied. Rows with a NULL or NaN on either side are left
    out. NULL where one side is constant.
    """
    t, p = F.col(truth).cast("double"), F.col(prediction).cast("double")
    rows = df.select(*by, t.alias("t"), p.alias("p")).filter(usable(F.col("t")) & usable(F.col("p")))
    ranked = average_ranks(average_ranks(rows, "t", by=by, into="rank_t"), "p", by=by, into="rank_p")
    ranked = attach(ranked, rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total")), by)
    middle = (F.col("total") + 1) / 2.0
    x, y = F.col("rank_t") - middle, F.col("rank_p") - middle
    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")
    )
    rho = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    return sums.select(*by, "n", rho.alias("spearman"))
