"""Sources and sinks of the preparation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwork.operators.neardup import nested_clusters
from strandwork.operators.selection import first_n
from strandwork.sources.session import written

PROTEINS = T.StructType(
    [
        T.StructField("pid", T.StringType()),
        T.StructField("protein_seq", T.StringType()),
        T.StructField("taxid", T.LongType()),
    ]
)
TAXA = T.StructType(
    [
        T.StructField("taxid", T.LongType()),
        T.StructField("temperature", T.DoubleType()),
        T.StructField("taxonomy", T.StringType()),
    ]
)
HISTORY_TSV = T.StructType([T.StructField("step", T.IntegerType()), T.StructField("value", T.DoubleType())])
KEYS = ("run", "metric", "step")
HISTORY = "run string, metric string, step int, value double"
HISTORY_PARTS = 64
PARAMETERS = "train_mean double, train_std double"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Give a plain file scan at least one partition per core.

    For columns that take long to process (texts) in a file of a single row
    group. A scan that already has enough splits, as any large table has, is
    returned unchanged, so no data is shuffled for it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(4 * cores)


def source_rows(
    records: DataFrame,
    groups: DataFrame,
    *,
    on: str,
    sequence: str,
    value: str,
    min_length: int,
    max_length: int,
    max_inclusive: bool = False,
    sample: int | None = None,
    key: list[str] | None = None,
    seed: int = 0,
) -> DataFrame:
    """Records joined with their group attributes, then filtered.

    The join is a plain equi-join: Catalyst broadcasts ``groups`` if its size
    allows, otherwise adaptive execution splits a group that holds much of the
    table. A ``sample`` is taken after the join and before the filters, so fewer
    rows than asked for come out. NULL values are removed at the scan of
    ``groups`` unless a sample must see them.
    """
    if sample is None:
        groups = groups.filter(F.col(value).isNotNull())
    joined = records.join(groups, on)
    if sample is not None:
        joined = first_n(joined, key, sample, seed=seed)
    size = F.length(sequence)
    upper = size <= max_length if max_inclusive else size < max_length
    return joined.filter((size > min_length) & upper & F.col(value).isNotNull())


def save_splits(
    df: DataFrame, path: str, mode: str = "errorifexists", measures: dict[str, Column] | None = None
) -> dict[str, object]:
    """Parquet, one folder per split; returns ``measures`` (aggregates), taken while the rows are written."""
    if not measures:
        df.write.mode(mode).partitionBy("split").parquet(path)
        return {}
    seen = Observation()
    df.observe(seen, *[m.alias(name) for name, m in measures.items()]).write.mode(mode).partitionBy("split").parquet(path)
    return seen.get


def load_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """All splits, or one of them, in which case only its folder is read."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def append_summary(row: DataFrame, path: str) -> None:
    """Append a one-row run summary as JSON."""
    row.write.mode("append").json(path)


def save_parameters(parameters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Standardisation parameters next to the data."""
    parameters.write.mode(mode).json(path)


def load_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARAMETERS).json(path)


def append_history(history: DataFrame, path: str, order: str | None = None) -> None:
    """Add ``history(run, metric, step, value)`` to the metric log in ``path``.

    A key ``(run, metric, step)`` has one value, the one written last: a later append replaces an earlier
    one, and within one append the greatest ``order`` counts (without it the greatest value). So an append
    that is repeated, after a failure or by mistake, changes nothing. Values that are not numbers are left
    out; names stay as they are. Runs are dealt into ``HISTORY_PARTS`` folders, of which only those that an
    append touches are written anew, all at the end of the job.
    """
    spark = history.sparkSession
    number = F.expr("try_cast(value AS double)")
    rank = F.struct(F.col(order) if order else F.lit(0), number)
    rows = history.filter(number.isNotNull()).groupBy("run", "metric", "step").agg(F.max_by(number, rank).alias("value"))
    part = F.pmod(F.xxhash64("run"), F.lit(HISTORY_PARTS)).cast("int")
    rows = written(rows.withColumn("part", part), "history-new")
    touched = [r.part for r in rows.select("part").distinct().collect()]  # HISTORY_PARTS at most
    try:
        old = _history(spark, path).filter(F.col("part").isin(touched))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        keys = [F.col(c).eqNullSafe(F.col(f"new_{c}")) for c in KEYS]
        new = rows.select(*[F.col(c).alias(f"new_{c}") for c in KEYS])
        rows = written(rows.unionByName(old.join(new, reduce(Column.__and__, keys), "left_anti")), "history-merged")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("part").parquet(path)


def _history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{HISTORY}, part int").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """``(run, metric, step, value)`` of the metric log in ``path``."""
    return _history(spark, path).drop("part")


def read_history_tsv(spark: SparkSession, path: str, run: str) -> DataFrame:
    """``(run, metric, step, value)`` from one tab-separated file per metric, which has the file's name."""
    rows = spark.read.schema(HISTORY_TSV).option("sep", "\t").option("header", True).csv(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.tsv$", "")
    return rows.select(F.lit(run).alias("run"), name.alias("metric"), "step", "value")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Ragged JSON records as one table; fields a record lacks are NULL."""
    return spark.read.json(path)


def save_clusters(clusters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Duplicate clusters as nested JSON."""
    nested_clusters(clusters).write.mode(mode).json(path)


CLUSTERS = "cluster_id {0}, page bigint, members array<struct<id: {0}, is_extreme: boolean, copies: bigint>>"


def load_clusters(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """``(cluster_id, id, is_extreme, copies)`` from the nested JSON."""
    pages = spark.read.schema(CLUSTERS.format(id_type)).json(path)
    return pages.select("cluster_id", F.inline("members"))
