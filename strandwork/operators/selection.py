"""Exact-n selection, dense positions and draws without a global sort.

Rows are ordered by the seeded hash of their key. A histogram over the leading
hash digits (small, combined map-side) locates the bucket in which the n-th row
lies; only that bucket is ranked. The result is one cut-off hash per stratum, and
choosing the rows is then a comparison inside the scan: no shuffle of the data.
Keys must be unique within a stratum.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.attach import join_by, join_small
from strandwork.functions.keys import draw, order_hash
from strandwork.sources.session import cut_lineage, held

BUCKET_DIGITS = 4  # 65,536 hash buckets per stratum
CHUNK = 65_536

Take = Callable[[Column], Column] | DataFrame


def _stratum(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def _histogram(df: DataFrame, key: Sequence[str], seed: int, by: Sequence[str], digits: int):
    keyed = df.withColumn("_hash", order_hash(key, seed)).withColumn("_bucket", F.substring("_hash", 1, digits))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    stratum = _stratum(by)
    counts = counts.select(
        "*",
        (F.sum("_n").over(stratum.orderBy("_bucket")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(stratum).alias("_total"),
    )
    return keyed, counts


def hash_cutoffs(
    df: DataFrame,
    key: Sequence[str],
    take: Take,
    *,
    seed: int,
    by: Sequence[str] = (),
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """One row ``(*by, _cut)`` per stratum: the hash of its ``take``-th row.

    ``take`` is a function of the stratum's row count, or a table ``(*by, _take)``.
    Strata that take nothing have no row.
    """
    keyed, counts = _histogram(df.select(*by, *[c for c in key if c not in by]), key, seed, by, digits)
    if isinstance(take, DataFrame):
        counts = join_by(counts, take, by)
        wanted = F.col("_take")
    else:
        wanted = take(F.col("_total"))
    need = F.least(wanted.cast("bigint"), F.col("_total")) - F.col("_before")
    edge = counts.withColumn("_need", need).filter("_need > 0 and _need <= _n").select(*by, "_bucket", "_need")
    inside = join_small(keyed, edge, [*by, "_bucket"])
    rank = F.row_number().over(_stratum([*by, "_bucket"]).orderBy("_hash"))
    ranked = inside.withColumn("_rank", rank).filter("_rank = _need")
    return held(ranked.select(*by, F.col("_hash").alias("_cut")))[0]


def mark_first(
    df: DataFrame,
    key: Sequence[str],
    take: Take,
    *,
    seed: int,
    into: str,
    by: Sequence[str] = (),
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Add a boolean column: is the row among the first ``take`` of its stratum?"""
    cuts = hash_cutoffs(df, key, take, seed=seed, by=by, digits=digits)
    return mark_below(df, cuts, key, seed=seed, into=into, by=by)


def mark_below(
    df: DataFrame, cuts: DataFrame, key: Sequence[str], *, seed: int, into: str, by: Sequence[str] = ()
) -> DataFrame:
    """Compare every row with the cut-off of its stratum."""
    if by:
        joined = join_small(df, cuts, by, "left")
        chosen = F.coalesce(order_hash(key, seed) <= F.col("_cut"), F.lit(False))
        return joined.withColumn(into, chosen).drop("_cut")
    row = cuts.first()
    return df.withColumn(into, order_hash(key, seed) <= F.lit(row["_cut"]) if row else F.lit(False))


def first_n(
    df: DataFrame,
    key: Sequence[str],
    take: int | Take,
    *,
    seed: int,
    by: Sequence[str] = (),
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Exactly ``take`` random rows per stratum (all of them where it has fewer)."""
    wanted = (lambda total, n=take: F.lit(n)) if isinstance(take, int) else take
    marked = mark_first(df, key, wanted, seed=seed, into="_chosen", by=by, digits=digits)
    return marked.filter("_chosen").drop("_chosen")


def fraction_sample(df: DataFrame, fraction: float, *, seed: int) -> DataFrame:
    """Cheap approximate sample: one pass, no counting."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def shuffled_position(
    df: DataFrame,
    key: Sequence[str],
    *,
    seed: int,
    by: Sequence[str] = (),
    into: str = "position",
    digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Dense 0..n-1 position per stratum in the seeded random order.

    Ranks are taken inside hash buckets, which are even by construction, so no
    stratum is ever sorted in one task.
    """
    # One non-NULL stratum key lets the join and the ranking share a single shuffle.
    stratum = F.coalesce(F.to_json(F.struct(*by)), F.lit("")) if by else F.lit("")
    groups = ["_stratum", "_bucket"]
    keyed, counts = _histogram(df.withColumn("_stratum", stratum), key, seed, ["_stratum"], digits)
    joined = join_by(keyed, counts.select(*groups, "_before"), groups)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy("_hash"))
    return joined.withColumn(into, F.col("_before") + rank - 1).drop("_hash", "_before", *groups)


def running_total(
    df: DataFrame, order: Sequence[str], amount: Column, *, by: Sequence[str] = (), into: str = "before"
) -> DataFrame:
    """Sum of ``amount`` over the rows that come earlier in ``order`` (per ``by``).

    The table is range-partitioned and the partition number is stored with a
    checkpoint, so sums inside ranges plus range offsets add up to the global
    running total without a single-task window. ``order`` must be unique per ``by``.
    """
    session = df.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", amount).repartitionByRange(parts, *by, *order)
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    groups = [*by, "_range"]
    sums = ranged.groupBy(*groups).agg(F.sum("_amount").alias("_sum"))
    offset = F.sum("_sum").over(_stratum(by).orderBy("_range")) - F.col("_sum")
    offsets = sums.select(*groups, offset.alias("_offset"))
    inner = F.sum("_amount").over(
        Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = join_small(ranged, offsets, groups)
    return joined.withColumn(into, F.col("_offset") + inner - F.col("_amount")).drop("_amount", "_range", "_offset")


def key_position(df: DataFrame, key: Sequence[str], *, into: str = "position") -> DataFrame:
    """Dense 0..n-1 position in key order."""
    return running_total(df, key, F.lit(1).cast("bigint"), into=into)


def gather(df: DataFrame, positions: DataFrame, *, on: str = "position") -> DataFrame:
    """Rows of a positioned table picked by a list of positions, which may repeat.

    Repeats are counted first, so a position asked for a million times crosses
    the shuffle once.
    """
    counted = positions.groupBy(on).agg(F.count(F.lit(1)).alias("_times"))
    joined = df.join(counted, on)
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_copy", "_times")


def redraw(df: DataFrame, key: Sequence[str], targets: DataFrame, *, seed: int, by: Sequence[str]) -> DataFrame:
    """Sample with replacement: ``_take`` rows per stratum of ``targets``, all redrawn."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"))
    wanted = join_by(targets, counts, by)
    chunks = wanted.filter("_take > 0").withColumn(
        "_chunk", F.explode(F.expr(f"sequence(0L, (_take - 1) div {CHUNK})"))
    )
    spread = chunks.repartition(*by, "_chunk")
    number = F.explode(
        F.sequence(F.col("_chunk") * CHUNK, F.least(F.col("_take"), (F.col("_chunk") + 1) * CHUNK) - 1)
    )
    draws = spread.select(*by, "_total", number.alias("_number"))
    hits = draws.select(*by, draw(F.col("_number"), F.col("_total"), seed).alias("_at"))
    hits = hits.groupBy(*by, "_at").agg(F.count(F.lit(1)).alias("_times"))
    growing = join_by(df, targets.select(*by, F.lit(True).alias("_grows")), by).drop("_grows")
    placed = shuffled_position(growing, key, seed=seed, by=by, into="_at")
    joined = join_by(placed, hits, [*by, "_at"])
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_times"))).drop("_copy", "_times", "_at")
