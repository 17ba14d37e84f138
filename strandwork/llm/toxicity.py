"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered. One weight per hashed word is shared by all thresholds: the chance that a text is
above grade k is sigmoid(score - threshold_k). The expected severity is the sum of those chances.

Where labels only tell toxic texts from others, the upper grades are weak labels: toxic texts of the sample are
ranked by the share of their words that are typical of toxic texts, and cut into equal parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.keys import order_hash
from strandwork.llm.words import ALNUM, LOWERED, Texts, mixed, prefix_sums, range_hashes, texts, words


#: Lengths in bytes of the word beginnings that are features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)


@dataclass
class OrdinalModel:
    """Weights by feature, and ascending thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, score: np.ndarray) -> np.ndarray:
        """Chance to be above grade k, one column per threshold."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -50, 50)))


def features(run: Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(row, feature)`` of a run of texts, by row: lower-case words, and beginnings of longer ones."""
    lower = Texts(run.first, LOWERED[run.data], run.starts)
    found = words(lower, ALNUM)
    sums = prefix_sums(lower.data)
    pairs = []
    for length in (0, *PREFIXES):
        at = found.end - found.begin > length
        begin = found.begin[at]
        hashes = range_hashes(sums, begin, begin + length if length else found.end)
        feature = (mixed(hashes + np.uint64(length)) % np.uint64(buckets)).astype(np.int64)
        pairs.append(found.row[at] * buckets + feature)
    pairs = np.unique(np.concatenate(pairs))
    return pairs // buckets, pairs % buckets


def training_rows(docs: DataFrame, labels: DataFrame, id: str, text: str, grade: str, most: int, buckets: int) -> pa.Table:
    """``(grade, features)`` of at most ``most`` labelled ids, the first by a hash, in the order of that hash.

    Of several texts with one id the first by a hash is taken.
    """
    chosen = labels.filter(F.col(grade).isNotNull() & F.col(id).isNotNull())
    chosen = chosen.select(F.col(id).alias("id"), F.col(grade).cast("int").alias("grade")).distinct()
    chosen = chosen.withColumn("order", order_hash(["id"], 11)).orderBy("order", "grade").limit(most)
    own = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"))
    picked = own.join(F.broadcast(chosen), F.col("doc") == F.col("id"))  # at most ``most`` narrow rows
    picked = picked.groupBy("order", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in texts(batch.column(2)):
                row, feature = features(run, buckets)
                cuts = np.searchsorted(row, np.arange(len(run) + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(feature.astype(np.int32)))
                columns = [batch.column(k).slice(run.first, len(run)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, lists], names=["order", "grade", "features"])

    found = picked.mapInArrow(kernel, "order string, grade int, features array<int>").toArrow()
    return found.sort_by([("order", "ascending"), ("grade", "ascending")]).drop_columns(["order"])


def weak_grades(rows: pa.Table, grades: int, buckets: int, least: int = 4) -> pa.Table:
    """``rows`` with grade 0 as it is, and the others regraded 1 to ``grades - 1`` by evidence.

    A feature is typical if at least ``least`` rows have it and it is ``e`` times likelier in a row above 0
    than in one of grade 0. The evidence of a row is the share of its features that are typical; rows above
    0 are cut at its quantiles into as many parts as there are grades above 0.
    """
    y = rows["grade"].to_numpy() > 0
    if not y.any() or y.all():
        return rows
    lists = rows["features"].combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy()
    feature, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), lengths)
    upper, lower = (np.bincount(feature[mine[row]], minlength=buckets) for mine in (y, ~y))
    odds = np.log((upper + 0.5) / (y.sum() + 1)) - np.log((lower + 0.5) / ((~y).sum() + 1))
    typical = (odds > 1) & (upper + lower >= least)
    evidence = np.bincount(row, weights=typical[feature], minlength=len(y)) / np.maximum(lengths, 1)
    cuts = np.quantile(evidence[y], np.arange(1, grades - 1) / (grades - 1))
    new = np.where(y, 1 + np.searchsorted(cuts, evidence, "right"), 0)
    return rows.set_column(0, "grade", pa.array(new, pa.int32()))


def fit(rows: pa.Table, grades: int, buckets: int, rounds: int = 200, l1: float = 2e-4, least: int = 4) -> OrdinalModel:
    """Proximal gradient descent with momentum on the cumulative-link likelihood; l1 sets idle weights to 0.

    Features that fewer than ``least`` rows have get no weight. Without rows, or with one grade only, the
    thresholds follow the counts and all weights are 0.
    """
    rows = rows.combine_chunks()
    y = np.asarray(rows["grade"].to_numpy(), np.int64)
    column = rows["features"].combine_chunks() if len(rows) else pa.array([], pa.list_(pa.int32()))
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int32()))
    feature = np.asarray(column.flatten(), np.int64)
    lengths = np.diff(np.asarray(column.offsets)) if len(y) else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(y)), lengths)
    common = np.bincount(feature, minlength=buckets) >= least
    keep = common[feature]
    feature, row = feature[keep], row[keep]
    above = y[:, None] > np.arange(grades - 1)
    rate = np.clip((above.sum(axis=0) + 0.5) / (len(y) + 1.0), 1e-4, 1 - 1e-4)
    model = OrdinalModel(np.zeros(buckets), np.maximum.accumulate(np.log(1 / rate - 1)))
    if len(y) == 0 or y.min() == y.max():
        return model
    step = np.zeros(buckets)
    step[common] = 1.0 / np.sqrt(np.bincount(feature, minlength=buckets)[common] / len(y))
    w = look = model.weights
    cuts = look_cuts = model.thresholds
    momentum = 1.0
    rate_of_descent = 0.05
    for _ in range(rounds):
        score = np.bincount(row, weights=look[feature], minlength=len(y))
        slope, cut_slope = _slopes(score, y, look_cuts)
        gradient = np.bincount(feature, weights=slope[row], minlength=buckets) / len(y)
        moved = look - rate_of_descent * step * gradient * 10
        shrink = rate_of_descent * step * 10 * l1
        new = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        new_cuts = np.maximum.accumulate(look_cuts - rate_of_descent * 10 * cut_slope / len(y))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        drag = (momentum - 1) / following
        look, look_cuts = new + drag * (new - w), np.maximum.accumulate(new_cuts + drag * (new_cuts - cuts))
        w, cuts, momentum = new, new_cuts, following
    return OrdinalModel(w, cuts)


def _slopes(score: np.ndarray, y: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of -log P(grade = y) by the score and by each threshold.

    P(y) = A - B with A the chance to be above y - 1 and B to be above y; its derivative by the score is
    (A(1-A) - B(1-B)) / (A - B) = 1 - A - B.
    """
    n, k = len(y), len(cuts)
    above = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts, -50, 50)))
    full = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
    a, b = full[np.arange(n), y], full[np.arange(n), y + 1]
    gap = np.maximum(a - b, 1e-9)
    by_cut = np.zeros(k + 2)
    np.add.at(by_cut, y, a * (1 - a) / gap)
    np.add.at(by_cut, y + 1, -b * (1 - b) / gap)
    return a + b - 1, by_cut[1:-1]


def severity(
    docs: DataFrame,
    labels: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    grade: str = "grade",
    grades: int = 3,
    most: int = 8_000,
    buckets: int = 1 << 18,
    weak: bool = False,
) -> DataFrame:
    """``(id, n_features, severity, p_toxic, grade, toxic)`` for every row of ``docs``.

    The model is fitted on at most ``most`` labelled rows (a documented bound, the first by a hash of the
    id), with grades 0 to ``grades - 1`` in ``labels(id, grade)``; ``weak`` takes any grade above 0 for toxic
    and makes the grades itself (see ``weak_grades``). ``severity`` is the expected grade,
    ``p_toxic`` the chance to be above 0, ``toxic`` whether that is at least one half, ``grade`` the
    number of thresholds passed with at least one half. A NULL, empty or wordless text has no features
    and gets the base chance. NULL labels are not used; repeated rows and NULL ids are scored like any
    other; labels without a text are ignored; other columns are not read; without labels the chance is
    even at worst; an empty table gives an empty result. Texts are scored whole.
    """
    rows = training_rows(docs, labels, id, text, grade, most, buckets)
    model = fit(weak_grades(rows, grades, buckets) if weak else rows, grades, buckets)
    held = docs.sparkSession.sparkContext.broadcast(model)  # ``buckets`` weights, whatever the data

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            for run in texts(batch.column(1)):
                row, feature = features(run, buckets)
                score = np.bincount(row, weights=fitted.weights[feature], minlength=len(run))
                above = fitted.exceed(score)
                columns = [
                    batch.column(0).slice(run.first, len(run)),
                    pa.array(np.bincount(row, minlength=len(run)).astype(np.int64)),
                    pa.array(above.sum(axis=1)),
                    pa.array(above[:, 0]),
                    pa.array((above >= 0.5).sum(axis=1).astype(np.int32)),
                    pa.array(above[:, 0] >= 0.5),
                ]
                names = [id, "n_features", "severity", "p_toxic", "grade", "toxic"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, n_features bigint, severity double, p_toxic double, grade int, toxic boolean"
    return docs.select(id, text).mapInArrow(kernel, schema)
