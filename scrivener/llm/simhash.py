"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import blocks, connected_components, materialize

BITS = 64
#: Buckets over this size are divided by more of the bits that their members may still differ in.
BUCKET = 128


def shingle_hashes(data: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a text in UTF-8, block by block; a text of fewer words is one shingle."""
    n, tail = 0, []
    for part in blocks(data.lower()):
        words = tail + part.split()
        if len(words) < width:
            tail = words
            continue
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts, stops = (ends - lengths).tolist(), ends[width - 1 :].tolist()
        h = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
        yield h
        n += len(h)
        tail = words[len(words) - width + 1 :] if width > 1 else []
    if not n and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text in UTF-8: a bit is 1 if set in over half the shingles' XXH64."""
    votes, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(data, width, seed):
        for at in range(0, len(h), 1 << 14):
            votes += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << int(i) for i in np.flatnonzero(2 * votes > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row.  Null and wordless texts get 0; repeated rows get a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fps = np.array([fingerprint(x.as_py() or b"", width, seed) for x in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int) -> list[int]:
    """2**(radius+1) - 1 masks such that any ``radius`` bits are all outside some mask.

    Bit i gets a nonzero vector of radius+1 binary digits; mask v holds the bits whose vector has odd inner
    product with v.  The vectors of ``radius`` bits span no more than a hyperplane, so some v is orthogonal
    to all of them, and texts that differ in those bits only agree under mask v.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if bin(v & (i % n + 1)).count("1") % 2) for v in range(1, n + 1)]


def _finer(mask: int, radius: int, parts: int = 8) -> list[int]:
    """Masks within a bucket: its free bits in parts, of which any ``radius`` are left out."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    part = [sum(1 << i for i in free[k::parts]) for k in range(parts)]
    every = (1 << BITS) - 1
    return [every & ~sum(out) for out in combinations(part, radius)]


def close_pairs(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs a < b (signed) of the distinct values in column fp that differ in 1 to ``radius`` bits.

    Each value goes into a bucket of every mask's table.  A bucket of over BUCKET values is divided again by
    the bits that its mask leaves free; such a part holds at most 2**(bits left out) distinct values, so the
    work stays in proportion to the values and no pair is lost.
    """
    masks = covering_masks(radius)
    entries = fps.select("fp").distinct().select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("e")).select("fp", "e.t", "e.k")
    # written, so that the join below may divide a bucket that very many values share
    shared = materialize(entries.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    held = entries.join(shared, ["t", "k"])
    small = held.where(F.col("n") <= BUCKET).select("fp", F.col("t").cast("int"), "k")
    finer = [[F.struct(F.lit(100 + 100 * t + s).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for s, m in enumerate(_finer(mask, radius))] for t, mask in enumerate(masks)]
    per_table = F.when(F.lit(False), F.array(*finer[0]))
    for t, options in enumerate(finer):
        per_table = per_table.when(F.col("t") == t, F.array(*options))
    large = held.where(F.col("n") > BUCKET).select("fp", F.explode(per_table).alias("e")).select("fp", "e.t", "e.k")
    all_ = small.union(large)
    other = all_.select(F.col("fp").alias("fp2"), "t", "k")
    near = F.expr(f"fp < fp2 and bit_count(fp ^ fp2) <= {radius}")
    return all_.join(other, ["t", "k"]).where(near).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (smallest doc_id reachable over links).

    Documents whose fingerprints differ in ``radius`` or fewer bits are linked.  Copies are one fingerprint in
    the search.  Null and wordless texts share fingerprint 0 and are linked like any other.  Repeated rows
    stay; a null doc_id takes part, but names no component unless all its members lack one.  No rows give none.
    Other columns, whatever their names, are not read; long texts are hashed block by block, in whole.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(close_pairs(fps, radius))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(named)  # so that a very large component may be divided, too
    labels = rooted.join(named, "root").select(F.col("fp").alias("fp_"), "component_id")
    return fps.join(labels, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")
