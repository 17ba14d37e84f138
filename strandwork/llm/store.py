"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from strandwork.sources.session import shared_folder


def fresh_folder(df: DataFrame, name: str) -> str:
    """An unused path below the session's shared folder."""
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` as a committed Parquet table: cuts the lineage, and what reads it survives lost executors."""
    folder = fresh_folder(df, name)
    df.write.option("compression", codec).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores ahead of it as it takes that no column of ``df`` begins like it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name
