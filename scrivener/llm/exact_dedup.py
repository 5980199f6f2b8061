"""Exact duplicates: a 128-bit content hash, then a comparison of bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import materialize, squeezed


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts count as equal when identical after each run of white space becomes one blank; null is the empty
    text.  The smallest doc_id of a group stays; where one doc_id is repeated with equal texts, only one of
    its rows does.  A null doc_id stays only if its whole group has none.  No rows give none.  Other columns, whatever
    their names, are not read; long texts are compared in whole.

    Groups form by digest, and the least and the greatest text of each, combined before the shuffle, show
    whether its bytes are all equal; so the texts are shuffled once, and a group of copies sends one text from
    each task.  Only if some digest holds different texts (a collision) its rows are grouped again by the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), squeezed(F.col(text_col).cast("string")).alias("norm"))
    rows = rows.select("doc_id", F.unhex(digest(F.col("norm"))).alias("h"), "norm")
    compared = rows.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("norm").alias("first"), F.max("norm").alias("last"))
    groups = materialize(compared.select("h", "keep_id", "group_size", (F.col("first") != F.col("last")).alias("mixed")))

    # repeated rows are one with a count until the end
    hashed = rows.select("doc_id", "h", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("h", "sha", "doc_id").agg(F.count("*").alias("copies"))
    pure = groups.where("not mixed").select("h", "keep_id", "group_size")
    out = hashed.join(pure, "h").select("doc_id", "sha", "copies", "keep_id", "group_size")
    mixed = groups.where("mixed").select("h")
    if not mixed.isEmpty():
        told = rows.join(mixed, "h")
        own = told.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        again = told.groupBy("norm", "doc_id").agg(F.count("*").alias("copies")).join(own, "norm")
        out = out.union(again.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "copies", "keep_id", "group_size"))
    each = out.select("doc_id", "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return each.select("doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
