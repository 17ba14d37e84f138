"""Sharding by jump consistent hashing, in column expressions.

A key jumps through the shard counts at which it would move, with random numbers that depend on the key
and the number of the jump; the last jump below the shard count is its shard. There is no ring table,
and one more shard takes its share of the keys from all others and moves nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandwork.functions.attach import join_by
from strandwork.llm.store import written
from strandwork.llm.units import counted, expanded

_SPAN = float(1 << 32)
_RANGES = 4096


def jump_shards(key: Column, counts: Sequence[int]) -> Column:
    """Struct ``shard_<count>`` with the shard of ``key`` for each shard count."""
    name = F.coalesce(key.cast("string"), F.lit(""))

    def jump(state: Column, step: Column) -> Column:
        digest = F.md5(F.concat_ws("|", name, step.cast("string")))
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 1
        bucket = state["next"]
        following = F.floor((bucket + 1) * F.lit(_SPAN) / number).cast("bigint")
        shards = [F.when(bucket < n, bucket).otherwise(state[f"shard_{n}"]).alias(f"shard_{n}") for n in counts]
        return F.when(bucket < max(counts), F.struct(following.alias("next"), *shards)).otherwise(state)

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("next"), *[zero.alias(f"shard_{n}") for n in counts])
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(counts) + 1)), start, jump)


def sharded(docs: DataFrame, shards: int, id: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    ``size`` is the UTF-8 length of the text plus ``overhead``. ``law`` is "key": id and number of shards
    alone decide the shard, and ``grown_shard``, the one with a shard more, is the same or the new one.
    ``slot`` numbers the rows of a shard without gaps from 0, by id within ranges of its hash. A NULL or
    empty text has no bytes and checksum 0; a NULL id is placed like an empty key. Rows with equal ids
    share a shard and have slots of their own; other columns are not read; an empty table gives an empty
    result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    size = (F.octet_length(body) + overhead).cast("bigint")
    rows = docs.select(F.col(id).alias("id"), size.alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    units = counted(rows, "shards-units").withColumn("at", jump_shards(F.col("id"), [shards, shards + 1]))
    range_of = F.pmod(F.xxhash64("id"), F.lit(_RANGES))
    units = units.select(
        "*", F.col(f"at.shard_{shards}").alias("shard"), F.col(f"at.shard_{shards + 1}").alias("grown"), range_of.alias("range")
    ).drop("at")
    sums = units.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    earlier = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("shard", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    inside = W.partitionBy("shard", "range").orderBy("id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    placed = units.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = written(join_by(placed, offsets, ["shard", "range"]).drop("range"), "shards-placed")
    slot = F.col("offset") + F.col("inside") + F.col("copy")
    return expanded(placed, "copy").select(
        F.col("id").alias(id),
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        slot.cast("bigint").alias("slot"),
        F.col("grown").cast("int").alias("grown_shard"),
    )
