"""Error analysis of a numeric prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.attach import attach, join_by
from strandwork.functions.binning import cut_edges, digitize, label_edges, locate, usable
from strandwork.functions.gaussian import normal_cdf
from strandwork.functions.labels import residual
from strandwork.sources.session import held


def with_error(df: DataFrame, truth: str, prediction: str, *, into: str = "error") -> DataFrame:
    return df.withColumn(into, residual(F.col(prediction), F.col(truth)))


def error_profile(
    df: DataFrame, truth: str, error: str, *, bins: int = 10, by: Sequence[str] = (), band: float = 1.0
) -> DataFrame:
    """``(*by, bin, mid, n, mean_error, std_error, lo, hi)`` per bin of the truth.

    Empty bins are listed with NULL statistics; a bin of one row has no sample
    deviation. ``lo`` and ``hi`` are mean -/+ ``band`` deviations.
    """
    frame = cut_edges(df, truth, bins, by)
    edges = frame.select(*by, F.col("edges").alias("_edges"))
    rows = attach(df.filter(usable(F.col(truth))).select(*by, truth, error), edges, by)
    rows = locate(rows, F.col(truth), F.col("_edges"), bins + 1, into="bin", right=True)
    sums = rows.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error"), F.stddev_samp(error).alias("std_error")
    )
    mids = frame.select(*by, F.posexplode("mids").alias("at", "mid"))
    mids = mids.select(*by, (F.col("at") + 1).alias("bin"), "mid")
    table = join_by(mids, sums, [*by, "bin"], "left")
    return table.select(
        *by,
        "bin",
        "mid",
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        "mean_error",
        "std_error",
        (F.col("mean_error") - band * F.col("std_error")).alias("lo"),
        (F.col("mean_error") + band * F.col("std_error")).alias("hi"),
    )


def error_pairs(profile: DataFrame, *, bins: int = 10, by: Sequence[str] = (), z: float = 2.0) -> DataFrame:
    """Bin pairs (low, high) with dT >= 0 and their total error band.

    Every bin names its partners (its own and the higher bins, at most ``bins``),
    which are then fetched by an equi-join on group and bin number. Midpoints
    rise with the bin number, so this is the condition dT >= 0.
    """
    columns = {"mid": "low_mid", "mean_error": "low_mean", "std_error": "low_std"}
    low = profile.select(*by, F.col("bin").alias("low_bin"), *[F.col(a).alias(b) for a, b in columns.items()])
    low = low.withColumn("high_bin", F.explode(F.sequence(F.col("low_bin"), F.lit(bins))))
    high = profile.select(
        *by,
        F.col("bin").alias("high_bin"),
        *[F.col(a).alias(b.replace("low", "high")) for a, b in columns.items()],
    )
    pairs = join_by(low, high, [*by, "high_bin"])
    total = F.abs(F.col("high_mean") - z * F.col("high_std")) + F.abs(F.col("low_mean") + z * F.col("low_std"))
    return pairs.withColumn("dT", F.col("high_mid") - F.col("low_mid")).withColumn("total_error", total)


def error_trend(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of the total error over dT."""
    y, x = F.col("total_error"), F.col("dT")
    return pairs.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def overlap_probability(pairs: DataFrame) -> DataFrame:
    """Adds ``crossing``, ``is_fallback`` and ``overlap_probability`` for dT > 0.

    Two Gaussians stand at ``low_mean`` and ``dT + high_mean``. Where their
    densities cross between the means, the mass on the wrong sides of the crossing
    is added up. Without such a crossing the point 1.0 is used and flagged; rows
    with missing or zero deviations, or complex crossings only, are dropped.
    """
    m1, s1 = F.col("low_mean"), F.col("low_std")
    m2, s2 = F.col("dT") + F.col("high_mean"), F.col("high_std")
    ready = pairs.filter((F.col("dT") > 0) & (s1 > 0) & (s2 > 0) & usable(m1) & usable(m2))
    p1, p2 = 0.5 / (s1 * s1), 0.5 / (s2 * s2)
    ready = ready.withColumns(
        {
            "_m2": m2,
            "_a": p1 - p2,
            "_b": 2.0 * (m2 * p2 - m1 * p1),
            "_c": m1 * m1 * p1 - m2 * m2 * p2 - F.log(s2 / s1),
        }
    )
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    ready = ready.withColumn("_d", F.when(a != 0, b * b - 4 * a * c).otherwise(F.lit(0.0)))
    ready = ready.filter("_d >= 0")
    # The stable pair of roots: q/a and c/q.
    q = -0.5 * (b + F.when(b < 0, -F.sqrt("_d")).otherwise(F.sqrt("_d")))
    ready = ready.withColumn("_q", q)
    one = F.when(a != 0, F.try_divide(F.col("_q"), a)).otherwise(F.try_divide(-c, b))
    two = F.when(a != 0, F.try_divide(c, F.col("_q")))

    def between(x):
        return (x > m1) & (x < F.col("_m2"))

    root = F.when(between(two), two).when(between(one), one)
    ready = ready.withColumn("_root", root)
    crossed = ready.withColumn("crossing", F.coalesce("_root", F.lit(1.0))).withColumn(
        "is_fallback", F.col("_root").isNull()
    )
    x = F.col("crossing")
    chance = 1.0 - normal_cdf((x - m1) / s1) + normal_cdf((x - F.col("_m2")) / s2)
    return crossed.withColumn("overlap_probability", chance).drop("_m2", "_a", "_b", "_c", "_d", "_q", "_root")


# exp(-x*x/2) is 0 in double precision beyond this many deviations.
REACH = 39.0
#: Cells per bandwidth, and powers of the distance from a cell's middle that are added up.
CELLS, POWERS = 8, 8


def density(
    df: DataFrame, column: str, *, points: int = 200, cut: float = 3.0, by: Sequence[str] = ()
) -> DataFrame:
    """Gaussian kernel density on a grid, bandwidth by Scott's rule.

    The grid runs from the minimum to the maximum, extended by ``cut`` bandwidths. A value goes to one of
    ``CELLS`` cells a bandwidth, where the powers of its distance ``d`` (in bandwidths) from the middle are
    added up before anything is shuffled; the kernel around the middle times Hermite polynomials gives back
    the sum of the kernels of all values. What the series leaves out is, for a value, at most
    ``max|He_8(u) exp(-u*u/2)| / 8! / 16^8``, which is 6.1e-13 of a kernel's height. The number of cells
    follows the range in bandwidths, not the rows.
    """
    x = F.col(column)
    rows = df.filter(usable(x)).select(*by, x.cast("double").alias("x"))
    base = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    h = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    stats = base.filter("s > 0").select(
        *by, "n", "lo", h.alias("h"), (F.col("lo") - cut * h).alias("start"), (F.col("hi") + cut * h).alias("stop")
    )
    stats = held(stats.withColumn("step", (F.col("stop") - F.col("start")) / (points - 1)))[0]
    at = (F.col("x") - F.col("lo")) / F.col("h")
    placed = attach(rows, stats.select(*by, "lo", "h"), by).withColumn("at", at)
    placed = placed.withColumn("cell", F.floor(F.col("at") * CELLS))
    placed = placed.withColumn("d", F.col("at") - (F.col("cell") + 0.5) / CELLS)
    powers = [F.lit(1.0)]
    for _ in range(POWERS - 1):
        powers.append(powers[-1] * F.col("d"))
    cells = placed.groupBy(*by, "cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    cells = attach(cells, stats.select(*by, "lo", "h", "start", "step"), by)
    middle = F.col("lo") + (F.col("cell") + 0.5) / CELLS * F.col("h")
    place = (middle - F.col("start")) / F.col("step")
    reach = (REACH + 1) * F.col("h") / F.col("step")
    first = F.greatest(F.ceil(place - reach), F.lit(0)).cast("int")
    last = F.least(F.floor(place + reach), F.lit(points - 1)).cast("int")
    visits = cells.withColumn("middle", middle).withColumn("_g", F.explode(F.sequence(first, last)))
    visits = visits.withColumn("u", (F.col("start") + F.col("_g") * F.col("step") - F.col("middle")) / F.col("h"))
    u = F.col("u")
    hermite, factorial, total = [F.lit(1.0), u], 1.0, F.col("m0")
    for k in range(1, POWERS):
        factorial *= k
        total = total + F.col(f"m{k}") * hermite[k] / factorial
        hermite.append(u * hermite[k] - k * hermite[k - 1])
    sums = visits.groupBy(*by, "_g").agg(F.sum(F.exp(-0.5 * u * u) * total).alias("mass"))
    grid = stats.withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    table = join_by(grid, sums, [*by, "_g"], "left")
    root = F.sqrt(2 * F.pi())
    return table.select(
        *by,
        F.col("_g").alias("point"),
        (F.col("start") + F.col("_g") * F.col("step")).alias("x"),
        # Far out the series may end a hair below zero.
        (F.greatest(F.coalesce("mass", F.lit(0.0)), F.lit(0.0)) / (F.col("n") * F.col("h") * root)).alias("density"),
    )


def joint_bins(
    df: DataFrame, first: str, second: str, *, edges: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Counts of the joint distribution on equal-width bins of both columns."""
    rows = df.filter(usable(F.col(first)) & usable(F.col(second)))
    for column, name in ((first, "bin_1"), (second, "bin_2")):
        rows = digitize(rows, column, label_edges(rows, column, edges, by), edges, by=by, into=name)
    return rows.groupBy(*by, "bin_1", "bin_2").agg(F.count(F.lit(1)).alias("n"))
