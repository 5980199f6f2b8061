"""Quality by importance resampling over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.llm.common import materialize, md5_fraction, mix, word_hashes

#: Hash buckets of the n-gram models, and labelled rows that are used at most.
BUCKETS, LABELLED = 1 << 18, 20_000
#: Added to each bucket's count in either model, at the size of the target text.
SMOOTHING = 4.0
#: Longer texts weigh as much as so many n-grams with their mean ratio, so that length alone decides nothing.
SPAN = 64


def ngrams(data: bytes, buckets: int) -> np.ndarray:
    """The buckets of a text's words and pairs of neighbouring words."""
    words = word_hashes(data)
    with np.errstate(over="ignore"):
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    """Per task, each bucket's count over all texts and over those of the target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, buckets), np.int64)
        for b in batches:
            for text, label in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist()):
                n = np.bincount(ngrams(text.as_py() or b"", buckets), minlength=buckets)
                sums[0] += n
                if label:
                    sums[1] += n
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(s[at]) for s in sums]], names=["bucket", "raw", "good"])

    return run


def sampled_labels(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """At most ``limit`` labelled ids, picked by hash: _id, good (the least quality of an id is over 0), held_out (half of them)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return picked.select(F.col("doc_id").alias("_id"), "good", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("held_out"))


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, limit: int = LABELLED) -> np.ndarray:
    """Per bucket, the log of its probability in the target text over that in the raw text.

    Target: the documents labelled good, of the half of the sample that is not held out.  Raw: all documents.
    Both are counted in one pass, and only sums by bucket come to the driver.  The raw counts are scaled to the
    target's size before smoothing, so that what neither has much of weighs little.
    """
    sample = F.broadcast(sampled_labels(labels, limit).where("good and not held_out"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text")).join(sample, F.col("_doc") == F.col("_id"), "left").select("text", "good")
    sums = texts.mapInArrow(_counts(buckets), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).toPandas().to_numpy()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    if len(sums):
        raw[sums[:, 0].astype(np.int64)], good[sums[:, 0].astype(np.int64)] = sums[:, 1], sums[:, 2]
    return np.log((good + SMOOTHING) / (raw * (good.sum() / max(raw.sum(), 1.0)) + SMOOTHING))


def log_weight(ratios: np.ndarray):
    """Function of a text column: the sum of the log ratios of its n-grams, scaled down to SPAN of them."""
    buckets = len(ratios)

    def weight(text: str | None) -> float:
        found = ngrams((text or "").encode(), buckets)
        return float(ratios[found].sum(dtype=np.float64)) * SPAN / max(SPAN, len(found))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(weight).astype("float64")

    return score


def best_cut(scored: DataFrame) -> float | None:
    """The log weight that best parts good from bad rows, by the sum of both classes' shares on the right side.

    ``scored``: the labelled rows, weight and good.  None without both classes.  The labelled sample is bounded.
    """
    rows = scored.where("weight is not null and good is not null").toPandas()
    good, bad = np.sort(rows.weight[rows.good].to_numpy()), np.sort(rows.weight[~rows.good].to_numpy())
    if not len(good) or not len(bad):
        return None
    edges = np.unique(np.concatenate([good, bad]))
    middle = np.concatenate([[edges[0] - 1], (edges[:-1] + edges[1:]) / 2, [edges[-1] + 1]])
    right = (len(good) - np.searchsorted(good, middle)) / len(good) + np.searchsorted(bad, middle) / len(bad)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(middle[best[0]])


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of column key (long, 0 or more), exactly, 16 bits at a time; None if there are fewer.

    Each of four rounds counts the rows by their next bits, at most 65,536 sums; no row comes to the driver.
    """
    high = 0
    for shift in (48, 32, 16, 0):
        inside = keys.where(F.shiftright("key", shift + 16) == high) if shift < 48 else keys
        counts = {r.b: r.n for r in inside.groupBy(F.shiftright("key", shift).bitwiseAND(0xFFFF).alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                high = high << 16 | b
                break
            k -= counts[b]
        else:
            return None
    return high


def gumbel_key(weight: Column, id_col: Column, seed: int) -> Column:
    """Log weight plus seeded Gumbel noise, as a long of 0 or more in steps of 2**-20."""
    noise = -F.log(-F.log(md5_fraction(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))))
    return F.floor((weight + noise) * float(1 << 20)).cast("long") + F.lit(1 << 62)


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0, buckets: int = BUCKETS, limit: int = LABELLED, carry: bool = False) -> tuple[DataFrame, Column, Column]:
    """Scores of all documents, and the columns that repeat the choice on any table with doc_id and text.

    Scores: doc_id, weight (log p_target / p_raw of the whole text, scaled to SPAN n-grams), key (weight plus Gumbel noise), kept.
    The k documents with the highest keys stay, which samples k by importance without replacement; documents
    that tie with the last of them stay too.  k is the number of documents whose weight is over the cut that
    best parts good from bad in the held-out half of the labelled sample; without labels of both kinds all stay.  Texts without
    words weigh 0, as null and empty ones do.  Rows that share a doc_id share their noise, so equal rows are treated alike;
    rows without one share theirs too.  No rows give none.  Other columns, whatever their names, are not read; with
    ``carry`` the scores hold each row as a struct ``row``, so that a choice needs no second pass over the texts.
    """
    ratios = log_ratios(docs, labels, buckets, limit).astype(np.float32)
    score = log_weight(ratios)
    scores = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("weight"), *([F.struct(*[F.col(c) for c in docs.columns]).alias("row")] if carry else [])))
    sample = F.broadcast(sampled_labels(labels, limit).where("held_out"))
    # one row an id, however many rows share one, so that as many come to the driver as labels were sampled
    cut = best_cut(scores.join(sample, F.col("doc_id") == F.col("_id")).groupBy("_id", "good").agg(F.avg("weight").alias("weight")))
    keyed = scores.withColumn("key", gumbel_key(F.col("weight"), F.col("doc_id"), seed))
    least = None if cut is None else kth_largest(keyed.select("key"), scores.where(F.col("weight") > cut).count())
    kept = F.lit(True) if cut is None else F.lit(False) if least is None else F.col("key") >= least
    key = gumbel_key(score(F.col("text").cast("string")), F.col("doc_id"), seed)
    keep = F.lit(True) if cut is None else F.lit(False) if least is None else key >= least
    return keyed.withColumn("kept", kept), key, keep
