"""From raw documents to tokens: five stages, each on everything that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import bpe, line_chunks, mixing, quality, wide_simhash
from scrivener.llm.common import discard, materialize, small_batches, table
from scrivener.llm.queries import RANKS


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that importance resampling towards those labelled good leaves out.

    Texts are scored once.  Null, empty and wordless texts weigh 0 and are judged by that; rows that share a doc_id share
    their noise, and equal rows stay or go together.  Without labels of both kinds all stay; no rows give none.
    Columns of any name are carried along; long texts are scored in whole.
    """
    scored = quality.resample(docs, table(spark, sf_dir, "labels"), carry=True)[0]
    return scored.where("kept").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated runs of two or more lines out of the texts; a document of which nothing is left goes.

    Null texts stay null and empty ones empty; n_chars follows the text.  A null doc_id comes after all others; equal rows
    are treated alike.  No rows give none.  Columns of any name are carried along; long texts take part in whole.
    """
    other = F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")])
    left = line_chunks.remove_repeated_runs(docs.select("doc_id", "text", other.alias("row")), carry=["row"])
    some = (F.col("n_removed") == 0) | (F.regexp_replace("kept", r"[\x20\x09-\x0D]+", "") != "")
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.where(some).select(*[(made[c] if c in made else F.col("row")[f"_{i}"]).alias(c) for i, c in enumerate(docs.columns)])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id, then text hash; null ids come last.

    Linked are documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.  At 0.8 about
    ten of a SimHash's 64 bits differ, too many for masks, so the SimHash has 9,216 votes: candidates meet by the strongest of
    them, pass by differing bits, and are confirmed on their whole sets.
    Texts without words, null ones among them, form one group.  Rows that share doc_id and text count as one document, of
    which one stays; they are put together before the shuffle.  No rows give none.  Columns of any name are carried along;
    long texts are compared in whole.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "part")
    keep = materialize(wide_simhash.groups(docs, width=5).groupBy("root").agg(F.min(place).alias("k")).select("k.*").distinct())
    keys = ["no_id", "id", "part"]
    part = F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("part")
    each = docs.select(F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), part, F.struct(*docs.columns).alias("row"))
    # of equal rows any one stays, which makes no difference but in other columns
    return each.groupBy(*keys).agg(F.first("row").alias("row")).join(keep, keys, "left_semi").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes its words, rounded to whole documents; 0 times drops it.

    The words taken of a document are whole passes but for one document of a shard, so little is rounded.  Null, empty and
    wordless texts have no words to take and go.  Rows that share a doc_id share their number of copies.  No rows give
    none.  Columns of any name are carried along; long texts count in whole.
    """
    share = mixing.mix(docs).groupBy("doc_id").agg(F.round(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))).cast("int").alias("times")).where("times > 0")
    named = materialize(share.withColumnRenamed("doc_id", "id"))
    # the whole row goes under one name, so that no column can clash
    # one plan at every size: a broadcast would only hold for small corpora
    taken = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(named.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, checked by decoding: a text's own bytes and those decoded have equal hashes.

    Null is the empty text, which has no ids.  Each row gives one, so copies give as many; no rows give none.  Other
    columns, whatever their names, are not read; long texts are encoded in whole.
    """
    small_batches(spark)
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: SQL has no SimHash, tokenizer or resampling; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        past, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(past)
    return STAGES[-1][1](spark, docs, sf_dir)
