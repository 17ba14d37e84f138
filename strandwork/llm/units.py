"""Equal rows as one row with a count, and back: a key with a third of all rows is then no hot group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.llm.store import written

#: Copies that one task makes of one row.
CHUNK = 10_000


def counted(df: DataFrame, name: str) -> DataFrame:
    """The distinct rows of ``df`` with their number ``n``, written."""
    return written(df.groupBy(*df.columns).agg(F.count("*").alias("n")), name)


def expanded(df: DataFrame, index: str) -> DataFrame:
    """Each row of the written table ``df`` ``n`` times, numbered from 0 in ``index``; long runs are spread."""
    few = df.filter(F.col("n") <= CHUNK).withColumn(index, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    chunks = F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk")
    many = df.filter(F.col("n") > CHUNK).select("*", chunks).repartition(*df.columns, "chunk")
    first = F.col("chunk") * CHUNK
    last = F.least(first + CHUNK, F.col("n")) - 1
    return few.unionByName(many.withColumn(index, F.explode(F.sequence(first, last))).drop("chunk")).drop("n")
