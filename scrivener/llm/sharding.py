"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import md5_fraction

#: Documents of a shard are numbered in so many parts, so that a shard is never one task.
PARTS = 4096


def _score(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.log(md5_fraction(F.concat(key, F.lit(f":{shard}")))) / float(weight)).alias("score"), F.lit(shard).alias("shard"))


def winner(key: Column, weights: Sequence[float]) -> Column:
    """(score, shard) of the shard whose weighted score for the key wins: -ln(u) / weight is least, u a hash of key and shard.

    A shard's scores don't depend on the others: when one is added, rows only move into it, and when one is
    taken away, only its rows move.  Shards of weight 0 get nothing.
    """
    return F.array_min(F.array(*[_score(key, i, w) for i, w in enumerate(weights) if w > 0]))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    return winner(key, weights)["shard"]


def shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id", text_col: str = "text", new_weight: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``shard`` depends on doc_id and the weights only; ``grown_shard`` is the shard with one more of weight
    ``new_weight``.  ``slot`` numbers a shard's rows from 0 without gaps, in order of a hash of doc_id: rows
    are numbered within parts of a shard, and each part starts where the one before it ends.  Null text has
    no bytes; rows without doc_id share one key and so a shard, within which their text's CRC spreads them; repeated rows
    share a shard and have a slot each.  No rows give none.  Other columns, whatever their names, are not read; a long
    text counts in whole.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # a shard more is one score more: it takes a row only by beating the winner of the others
    placed = base.select("*", F.explode(F.array(winner(key, weights))).alias("won"))
    grown = F.least(F.col("won"), _score(key, len(weights), new_weight))["shard"] if new_weight > 0 else F.col("won.shard")
    order = F.md5(F.concat(key, F.when(F.col("doc_id").isNull(), F.concat(F.lit(":"), F.col("text_crc32").cast("string"))).otherwise("")))
    placed = placed.select("doc_id", "size", "text_crc32", F.col("won.shard").alias("shard"), grown.alias("grown_shard"), order.alias("order"))
    placed = placed.withColumn("part", F.conv(F.substring("order", 1, 3), 16, 10).cast("int") % PARTS)
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("order", "doc_id", "text_crc32", "size")))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).select("shard", "part", "start")
    return numbered.join(starts, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("at") - 1).alias("slot"), "grown_shard")
