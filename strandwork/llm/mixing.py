"""Mixing sources to target weights by weighted fair queueing.

Every source sends its documents in a seeded random order, then once more. A document's virtual finish
time is the source's words sent up to and with it, divided by the source's target. Over all sources the
documents are put into ranges of that time and taken in its order until the total budget is used up: at
any time each source has sent the same share of its target. Only the range in which the budget ends, and
of its finer ranges again the one in which it ends, has to be sorted to find the last document. Column
expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.attach import attach, join_by, join_small
from strandwork.llm.store import free_name, written
from strandwork.llm.units import counted, expanded

#: Hexadecimal digits of the random order that make the ranges in a source, and ranges of virtual time up to 1.
RANGE_DIGITS = 3
RANGES = 4096
SEED = 7


def word_count(text: Column) -> Column:
    """Words cut at ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row per source.

    The sources by code point (NULL last) weigh ``weights`` in turn and share ``share`` times all sizes.
    No target exceeds ``repeats`` times its source; the excess goes to the others by weight. In order of
    limit per weight the sources that reach their limit come first, so one running sum finds them.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight.cast("bigint")).withColumn("cap", F.col("source_size") * repeats)
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    used = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onwards = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - used) / onwards)
    rows = rows.withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    # The level of the first source that stays below its limit holds for all after it.
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _order(id: Column, seed: int) -> Column:
    """The random order of a source's documents."""
    return F.md5(F.concat_ws("|", F.coalesce(id.cast("string"), F.lit("")), F.lit(str(seed))))


def _queued(docs: DataFrame, id: str, source: str, text: str, seed: int, sizes_to_targets) -> DataFrame:
    """Every row with its source's target and ``before``: the words its source sends ahead of it in a round."""
    rows = docs.select(
        F.col(id).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")
    )
    units = counted(rows, "mixing-units").withColumn("order", _order(F.col("id"), seed))
    units = units.withColumn("range", F.substring("order", 1, RANGE_DIGITS)).withColumn("words", F.col("size") * F.col("n"))
    sums = written(units.groupBy("source", "range").agg(F.sum("words").alias("words")), "mixing-ranges")
    goals = sizes_to_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    same = F.col("source").eqNullSafe(F.col("s"))
    offsets = offsets.join(goals.withColumnRenamed("source", "s"), same).drop("s")
    offsets = offsets.withColumnsRenamed({"source": "s", "range": "r"})
    in_range = W.partitionBy("source", "range").orderBy("order", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = units.withColumn("inside", F.coalesce(F.sum("words").over(in_range), F.lit(0)))
    placed = placed.join(offsets, same & (F.col("range") == F.col("r")))
    before = (F.col("offset") + F.col("inside")).alias("before")
    placed = written(placed.select("id", "source", "size", "n", "source_size", "target", before), "mixing-queue")
    return expanded(placed, "copy").withColumn("before", F.col("before") + F.col("copy") * F.col("size"))


def mixed_sources(
    docs: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    repeats: int = 2,
    seed: int = SEED,
) -> DataFrame:
    """``(id, source, size, source_size, target, copy, times, taken)`` for every row of ``docs``.

    ``size`` counts the words of the text (NULL and empty: 0), ``times`` says how often the mix takes the
    row (0 to ``repeats``), ``taken`` is ``times * size``, and ``copy`` numbers rows with equal id, source
    and size. Each source's ``taken`` differs from its ``target`` by about one document. Rows without
    words are never taken. A NULL source is a source of its own, the last one; a NULL id is ordered like
    an empty one. Equal ids and repeated rows are separate rows. The order depends on id and ``seed``
    alone, so reruns agree. Other columns are not read; an empty table gives an empty result.
    """
    queue = written(
        _queued(docs, id, source, text, seed, lambda s: targets(s, weights, share, repeats)), "mixing-rows"
    )
    budget = queue.agg(F.sum("size") * F.lit(float(share))).first()[0] or 0.0
    turns = [F.col("before") + F.col("size") + F.lit(k) * F.col("source_size") for k in range(repeats)]
    finish = [F.when(F.col("size") > 0, F.try_divide(t, F.col("target"))) for t in turns]

    def time_range(time: Column) -> Column:
        return F.floor(RANGES * RANGES * F.when(time <= 1, time).otherwise(1 + F.ln(time)))

    def place(k: int, time: Column) -> Column:
        return F.struct(time.alias("time"), "source", "id", F.lit(k).alias("turn"), "size", "copy")

    sent = queue.select("size", F.explode(F.array(*[place(k, t) for k, t in enumerate(finish)])).alias("at"))
    sent = sent.filter("at.time IS NOT NULL").withColumn("fine", time_range(F.col("at.time")))
    sent = sent.withColumn("coarse", F.expr(f"fine div {RANGES}"))
    last, reached, before = None, None, 0
    for name in ("coarse", "fine"):
        ranges = sent.groupBy(name).agg(F.sum("size").alias("words"))
        ranges = ranges.withColumn("upto", F.lit(before) + F.sum("words").over(W.orderBy(name)))
        cut = ranges.filter(F.col("upto") > budget).orderBy(name).first()
        if cut is None:
            break
        reached, before = cut[name], cut["upto"] - cut["words"]
        sent = sent.filter(F.col(name) == reached)
    if reached is not None:
        order = W.orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
        inside = sent.withColumn("upto", F.lit(before) + F.sum("size").over(order))
        last = inside.filter(F.col("upto") <= budget).agg(F.max("at").alias("at"))
    times = F.lit(0)
    if last is not None:
        queue = attach(queue, last)  # one row, the last document taken
    for k, time in enumerate(finish):
        if reached is None:
            chosen = time.isNotNull()
        else:
            at_cut = (time_range(time) == reached) & (place(k, time) <= F.col("at"))
            chosen = F.coalesce((time_range(time) < reached) | at_cut, F.lit(False))
        times = times + chosen.cast("int")
    columns = [F.col("id").alias(id), F.col("source").alias(source), "size", "source_size", "target", "copy"]
    out = queue.select(*columns, times.alias("times"))
    return out.withColumn("taken", F.col("times") * F.col("size"))


def mixed_documents(
    docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", repeats: int = 2, **how
) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mixed_sources`` takes it.

    In the order of its documents a source gives a whole number of them in every round, so what is taken
    follows from the last one of each source and round, and rows are compared with these where they are; no
    text is shuffled. Of rows with equal id, source and size, where the budget ends among them, the first by
    a hash of the text are taken; equal rows take each other's place. Names of columns do not matter.
    """
    name = free_name(docs, "mix")
    place, mark, here, number, cuts = (f"{name}_{x}" for x in ("place", "mark", "here", "number", "cuts"))
    seed = how.get("seed", SEED)
    plan = mixed_sources(docs, id, source, text, repeats=repeats, **how)
    own = F.struct(_order(F.col(id), seed).alias("order"), F.col(id).alias("id"), F.col("size").alias("size"))
    taken = [F.sum((F.col("times") > k).cast("bigint")).alias(f"n{k}") for k in range(repeats)]
    units = plan.filter("size > 0").groupBy(F.col(source).alias(name), own.alias("at")).agg(F.count("*").alias("n"), *taken)
    last = [
        F.max(F.when(F.col(f"n{k}") > 0, F.struct("at", F.col(f"n{k}").alias("taken"), "n"))) for k in range(repeats)
    ]
    ends = units.groupBy(name).agg(F.array_compact(F.array(*last)).alias(cuts))  # one row per source
    size = word_count(F.col(text))
    mine = F.struct(_order(F.col(id), seed).alias("order"), F.col(id).alias("id"), size.alias("size"))
    rows = docs.withColumn(name, F.col(source).cast("string")).withColumn(place, mine).filter(F.col(place)["size"] > 0)
    rows = join_small(rows, ends, [name])
    within = F.col(place)
    whole = F.filter(cuts, lambda c: (within < c["at"]) | ((within == c["at"]) & (c["taken"] == c["n"])))
    split = F.exists(cuts, lambda c: F.coalesce((within == c["at"]) & (c["taken"] < c["n"]), F.lit(False)))
    # The budget ends inside one unit of a source and round at most. Its rows are written, so that every one is
    # counted and numbered in the same place.
    parts = rows.filter(split).withColumn(here, F.spark_partition_id()).withColumn(mark, F.xxhash64(text))
    parts = written(parts, "mixing-parts")
    groups = [name, place, mark, here]
    counts = parts.groupBy(*groups).agg(F.count("*").alias(number))
    ahead = W.partitionBy(name, place).orderBy(mark, here).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.withColumn(number, F.coalesce(F.sum(number).over(ahead), F.lit(0)))
    turn = F.row_number().over(W.partitionBy(*groups).orderBy(F.lit(1)))
    parts = join_by(parts, counts, groups).withColumn(number, F.col(number) + turn)
    some = F.filter(cuts, lambda c: (within < c["at"]) | ((within == c["at"]) & (F.col(number) <= c["taken"])))

    def repeated(df: DataFrame, rounds: Column) -> DataFrame:
        again = df.withColumn(cuts, F.explode(F.sequence(F.lit(0), F.size(rounds)))).filter(F.col(cuts) > 0)
        return again.select(*[F.col(f"`{c}`") for c in docs.columns])

    return repeated(rows.filter(~split), whole).unionByName(repeated(parts, some))
