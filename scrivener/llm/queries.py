"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.llm import bpe, exact_dedup, fim, knn, line_chunks, minhash, mixing, quality, quotes, sharding, simhash, substring, trie
from scrivener.llm.common import table

#: Where the rank file of the BPE query is; the driver of a cluster may put another path here.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.reply_order(table(spark, sf_dir, "conversations"))
    return linked.withColumn("own_sha256", F.sha2("own_text", 256)).drop("own_text")


def op4_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_chunks.remove_repeated_runs(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"), [1.0] * 24)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0].select("doc_id", F.round("weight", 6).alias("weight"), "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = trie.shared_starts(trie.turns_of(table(spark, sf_dir, "conversations")))
    return trie.prefix_trie(turns, convs).drop("node", "parent")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_voronoi_top_k": op4_voronoi_top_k,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op6_line_runs": op6_line_dedup,  # the name it had before both were one
    "op7_mixing": op7_mixing,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_minhash": op11_minhash,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op3_quotation_linking": quotes.ORACLE,
    "op4_voronoi_top_k": knn.ORACLE,
    "op6_line_dedup": line_chunks.ORACLE,
    "op6_line_runs": line_chunks.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op10_substring_dedup": substring.ORACLE,
    "op11_minhash": minhash.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_prefix_trie": trie.ORACLE,
    "op5_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256
from d join g on d.norm = g.norm""",
}
