"""Repeated passages by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import blocks, discard, materialize, window_hashes, word_hashes

#: Words of the grams that pick which windows can repeat at all.
GRAM = 10
_LAST = (1 << 63) - 1


def _running(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[: len(x) - step], x[step:])
        have += step
    return x


def _window_least(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram hashes of a text, and the least of them within each window."""
    grams = window_hashes(words, min(GRAM, window))
    width = window - min(GRAM, window) + 1
    return grams, _running(grams, width, np.minimum) if len(grams) >= width else grams[:0]


def _facts(window: int):
    """Of each text: number of words, 128 bits of its word sequence, and the grams that are least in a window.

    Equal windows have the same least gram, so a window can repeat only if that gram does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int64())
        for b in batches:
            n, ones, twos, picked = [], [], [], []
            for text in b.column(2).cast(pa.binary()):
                data = text.as_py() or b""
                words = word_hashes(data)
                n.append(len(words))
                ones.append(int(window_hashes(words, len(words))[0].astype(np.int64)) if len(words) else 0)
                other = word_hashes(data, 1) if len(words) >= window else words
                twos.append(int(window_hashes(other, len(other), 1)[0].astype(np.int64)) if len(other) else 0)
                _, least = _window_least(words, window)
                picked.append(np.unique(least).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(picked, kind)], names=["doc", "part", "n", "one", "two", "grams"])

    return run


def _probes(window: int, block: int):
    """In the windows whose least gram repeats: the hash of every run of ``block`` words, and whether it is
    one of the text's own blocks, which start at the multiples of ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, part, text, grams in zip(b.column("doc"), b.column("part"), b.column("text"), b.column("grams")):
                words = word_hashes(text.as_py().encode())
                _, least = _window_least(words, window)
                live = np.isin(least, np.asarray(grams.values).view(np.uint64))
                runs = window_hashes(words, block)
                starts = np.flatnonzero(live)
                at = np.flatnonzero(_covered(starts, starts + window - block + 1, len(runs))).astype(np.int32)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(runs[at].view(np.int64)), pa.array(np.full(len(at), doc.as_py())), pa.array(np.full(len(at), part.as_py())), pa.array(at), pa.array(at % block == 0)], names=["hash", "doc", "part", "at", "own"])

    return run


def _covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in an interval [start, stop); what sticks out on either side is cut off."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.clip(starts, 0, n), 1)
    np.add.at(change, np.clip(stops, 0, n), -1)
    return np.cumsum(change[:n]) > 0


def _windows(window: int, block: int):
    """128 bits of every window around a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, part, text, hits in zip(b.column("doc"), b.column("part"), b.column("text"), b.column("hits")):
                data = text.as_py().encode()
                one = window_hashes(word_hashes(data), window)
                hit = np.asarray(hits.values).astype(np.int64)
                at = np.flatnonzero(_covered(hit - (window - block), hit + 1, len(one))).astype(np.int32)
                if len(at):
                    two = window_hashes(word_hashes(data, 1), window, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(one[at].view(np.int64)), pa.array(two[at].view(np.int64)), pa.array(np.full(len(at), doc.as_py())), pa.array(np.full(len(at), part.as_py())), pa.array(at)], names=["one", "two", "doc", "part", "at"])

    return run


def _cut(window: int):
    """Take out the words that the given windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, whole, starts in zip(b.column("text"), b.column("whole"), b.column("starts")):
                out, at, removed = [], 0, 0
                begin = np.asarray(starts.values).astype(np.int64) if starts.is_valid else None
                for piece in blocks(text.as_py().encode()):
                    words = piece.split()
                    if whole.as_py():
                        removed += len(words)
                    elif begin is None:
                        out += words
                    else:
                        gone_here = _covered(begin - at, begin - at + window, len(words))
                        removed += int(gone_here.sum())
                        out += [w for w, x in zip(words, gone_here.tolist()) if not x]
                    at += len(words)
                n.append(at)
                gone.append(removed)
                kept.append(b" ".join(out).decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one blank).

    A word goes if it is in a run of ``window`` words that also starts in a document with a smaller doc_id.
    Null text has no words; a null doc_id comes after all others; rows that share a doc_id don't count against
    each other; repeated rows stay.  No rows give none.  Other columns, whatever their names, are not read; long texts
    are hashed and cut block by block, in whole.

    1. A text whose whole word sequence is in a smaller document goes entirely and takes no part below.
    2. A window can repeat only if its least gram is in two different texts; other windows are left out.
       This loses nothing and keeps most of a corpus out of the shuffles below.
    3. Index: the non-overlapping blocks of window // 2 words of each text.  Any window holds one whole.
       Probe: every run of as many words.  A hit is a run that is a block of a smaller document or, of a
       document, one that a larger one has.
    4. Extend: windows around hits are compared by 128 bits of all their words; neighbours make maximal repeats.
    """
    block = window // 2
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # (doc, part) is the row: texts that share a doc_id differ in part
    text = text.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("part"), "text")
    facts = materialize(text.select("doc", "part", "text").mapInArrow(_facts(window), "doc long, part long, n long, one long, two long, grams array<long>"))

    # written, so that Spark may divide the copies of one text
    least = materialize(facts.where(F.col("n") >= window).groupBy("n", "one", "two").agg(F.min("doc").alias("least")))
    copies = facts.select("doc", "part", "n", "one", "two").join(least, ["n", "one", "two"]).where("doc > least")
    whole = materialize(copies.select("doc", "part").distinct())

    grams = facts.select("doc", "part", F.struct("one", "two").alias("text"), F.explode("grams").alias("gram"))
    # written, so that in the joins below Spark may divide what a frequent key has
    shared = materialize(grams.groupBy("gram").agg(F.min("text").alias("first"), F.max("text").alias("last")).where("first != last").select("gram"))
    live = grams.select("doc", "part", "gram").join(shared, "gram").groupBy("doc", "part").agg(F.collect_set("gram").alias("grams"))
    live = materialize(live.join(whole, ["doc", "part"], "left_anti"))
    discard(facts, shared, least)

    sides = text.select("doc_id", "doc", "part", "text")
    probes = materialize(sides.join(live, ["doc", "part"]).select("doc", "part", "text", "grams").mapInArrow(_probes(window, block), "hash long, doc long, part long, at int, own boolean"))
    met = materialize(probes.groupBy("hash").agg(F.min(F.when(F.col("own"), F.col("doc"))).alias("first"), F.max("doc").alias("last")).where("first < last").select("hash"))
    discard(live)
    hits = materialize(probes.select("hash", "doc", "part", "at").join(met, "hash").groupBy("doc", "part").agg(F.collect_list("at").alias("hits")))

    discard(probes, met)
    windows = materialize(sides.join(hits, ["doc", "part"]).select("doc", "part", "text", "hits").mapInArrow(_windows(window, block), "one long, two long, doc long, part long, at int"))
    first = materialize(windows.groupBy("one", "two").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("one", "two", "first"))
    starts = materialize(windows.join(first, ["one", "two"]).where("first < doc").groupBy("doc", "part").agg(F.collect_list("at").alias("starts")))
    discard(hits, windows, first)

    cuts = starts.select("doc", "part", F.lit(False).alias("whole"), "starts").unionByName(whole.select("doc", "part", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts")))
    return sides.join(cuts, ["doc", "part"], "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "starts").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string")


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
k as (select s.doc_id, s.i, md5(array_to_string(d.w[s.i:s.i + 49], ' ')) as k from s join d on d.doc_id = s.doc_id),
f as (select k, min(doc_id) as first from k group by k),
r as (select distinct k.doc_id, k.i + o.o as pos from k join f on f.k = k.k and f.first < k.doc_id cross join (select unnest(range(0, 50)) as o) o),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
a as (select u.doc_id, count(*) as n, count(r.pos) as gone, string_agg(u.word, ' ' order by u.pos) filter (where r.pos is null) as kept from u left join r on r.doc_id = u.doc_id and r.pos = u.pos group by u.doc_id)
select d.doc_id, cast(coalesce(a.n, 0) as bigint) as n_words, cast(coalesce(a.gone, 0) as bigint) as n_removed, sha256(coalesce(a.kept, '')) as kept_sha256 from d left join a on a.doc_id = d.doc_id"""
