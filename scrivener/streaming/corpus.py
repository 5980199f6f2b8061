"""The row-wise operators on a stream: they need no state, so the batch functions serve as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scrivener.functions import text as t
from scrivener.operators import cleaning, retrieval
from scrivener.sources.readers import CORPUS


def read_corpus_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Corpus rows of JSON-lines files as they arrive."""
    rows = spark.readStream.schema(CORPUS).option("maxFilesPerTrigger", files_per_batch).json(path)
    return rows.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), "contract_id", F.lit(""))).withColumn("seq", F.lit(0).cast("long"))


def cleaned_stream(rows: DataFrame, language: str = "ru") -> DataFrame:
    """Filtered, cleaned and anonymised sections of a stream."""
    docs = retrieval.corpus_documents(rows, language).drop("seq")
    return cleaning.anonymise(docs, "text")


def first_seen(rows: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose folded text has not come before within the watermark; the state is bounded by ``delay``."""
    return rows.withColumn("_key", F.xxhash64(t.fold_case(F.col("text")), F.length("text"))).withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, once for what is there now; a restart goes on where it stopped."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
