"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of all contracts here: ASCII blanks only.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Hand Python 1000 texts at a time: ten times fewer than Spark's default, so that workers stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset (tests), a new temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors.

    The table replaces the shuffles that made it, so their files go when it is written.  ``discard`` deletes it; those
    that a returned DataFrame still reads stay until the folder's owner clears it.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return _named(spark.read.schema(df.schema).parquet(path), path)


def _named(df: DataFrame, path: str | None) -> DataFrame:
    df._scratch = path
    return df


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing will read again, wherever the shared folder is."""
    for df in tables:
        path = df.__dict__.get("_scratch")
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def n_words(text: Column) -> Column:
    """Number of words, without building the array of words; null counts as none."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), f"{WORD}{SPACE}*", "x")
    return F.length(F.translate(one_each, BLANKS, "")).cast("long")


def squeezed(text: Column) -> Column:
    """Each run of white space as one blank; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def md5_fraction(key: Column) -> Column:
    """A fraction strictly between 0 and 1 from 52 bits of the key's MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def blocks(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes that end at white space, so that no word is cut."""
    at, gap = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(data) - at > size:
        found = gap.search(data, at + size)
        if not found:
            break
        yield data[at : found.end()]
        at = found.end()
    yield data[at:] if at else data


_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base modulo 2**64 and their inverses, at least n of each."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        base = _BASES[which]
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        with np.errstate(over="ignore"):
            both = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (base, inverse))
        have = _POWERS[which] = both
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _block_hashes(data: bytes, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    up, down = _powers(which, len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts > 256):  # polynomials of long words are easier to collide
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], int(_BASES[which]))
    return h, starts, ends


def word_hashes(data: bytes, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; ``which`` picks one of two independent functions."""
    parts = [_block_hashes(x, which)[0] for x in blocks(data)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def window_hashes(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words."""
    n = len(words)
    if n < width:
        return np.empty(0, np.uint64)
    out, step = [], 1 << 16
    up, down = _powers(which, min(n, step + width) + 1)
    with np.errstate(over="ignore"):
        for at in range(0, n - width + 1, step):
            part = words[at : at + step + width - 1]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
            out.append(mix((total[width:] - total[:-width]) * down[: len(part) - width + 1]))
    return out[0] if len(out) == 1 else np.concatenate(out)


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Label each node of ``links`` (long columns a, b) with the smallest node it reaches: columns node, root.

    Alternates two star contractions until the edges stay the same.  Each is a grouped minimum (combined
    before the shuffle) and a join, so no neighbourhood is ever gathered.  Both sides of each join are tables, so that
    Spark's skew join can divide the edges of a node with very many; tables of past rounds are deleted.
    """

    def large(e: DataFrame) -> tuple[DataFrame, DataFrame]:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        return materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")), least

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialize(down.groupBy("a").agg(F.min("b").alias("m")))
        made = materialize(down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(least)
        return made

    seen = F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")
    given = materialize(links.where("a != b").select("a", "b").distinct())
    edges = small(given)
    discard(given)
    before = edges.agg(*seen).first()
    for _ in range(rounds):
        middle, least = large(edges)
        past, edges = edges, small(middle)
        discard(past, middle, least)
        now = edges.agg(*seen).first()
        if now == before:
            return _named(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), edges._scratch)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
