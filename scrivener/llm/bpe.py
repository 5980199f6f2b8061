"""Byte-level BPE over overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters that a chunk owns, and those of the next chunk that it reads besides.
CHUNK, OVERLAP = 16_384, 512
_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}
#: Output of a task goes on in batches of about this many bytes.
_BATCH = 8 << 20


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, loaded once a worker."""
    if (ranks_path, pattern) not in _LOADED:
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[ranks_path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[ranks_path, pattern]


def token_ids(enc: tiktoken.Encoding, match: regex.Pattern, text: str, most: int) -> np.ndarray:
    """The ids of a text.  The library's own matcher overruns its stack on a pre-token of about a million characters, so in a
    text of over ``most`` characters ``match`` finds the pre-tokens, and each is merged by itself."""
    if len(text) <= most:
        return np.array(enc.encode_ordinary(text), "<u4")
    parts, held = [], []
    for m in match.finditer(text):
        held += enc._encode_single_piece(m.group().encode())
        if len(held) > 1 << 16:
            parts.append(np.array(held, "<u4"))
            held = []
    return np.concatenate([*parts, np.array(held, "<u4")])


def _pieces(docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """(doc_id, digest, copies, k, start, piece) of the chunks of long texts, with ``overlap`` characters more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                whole = text.as_py()
                n = -(-len(whole) // step)
                key = hashlib.sha256(whole.encode()).digest()
                for at in range(0, n, 64):
                    ks = range(at, min(n, at + 64))
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(ks), pa.int64()), pa.array([key] * len(ks), pa.binary()), pa.array(list(ks), pa.int32()), pa.array([n] * len(ks), pa.int32()), pa.array([whole[k * step : (k + 1) * step + overlap] for k in ks], pa.string())], names=["doc_id", "digest", "k", "n", "piece"])

    return docs.mapInArrow(cut, "doc_id long, digest binary, k int, n int, piece string")


def _edges(pattern: str, step: int, overlap: int):
    """Of each chunk: the pre-token starts in its first ``overlap`` characters, and in those beyond its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = regex.compile(pattern)
        for b in batches:
            head, tail = [], []
            for piece, k, n in zip(b.column("piece"), b.column("k"), b.column("n")):
                text = piece.as_py()
                starts = [m.end() for m in match.finditer(text)]
                # a match that ends before the chunk does has seen what follows it, so its end is certain
                head.append([0, *(x for x in starts if x < overlap)] if k.as_py() else [])
                # a run of blanks ends one earlier before a word, so none may end where the text is cut
                tail.append([x - step for x in starts if step <= x < len(text) and not text[x - 1].isspace()] if k.as_py() + 1 < n.as_py() else [])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), b.column("k"), pa.array(head, kind), pa.array(tail, kind)], names=["doc_id", "digest", "k", "head", "tail"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", step: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) of every row: ids is binary, the token ids as little-endian unsigned 32-bit integers.

    A text of over ``step`` characters is cut into chunks that share ``overlap`` characters, which are split
    into pre-tokens in parallel.  The first start of a pre-token that both chunks of a joint find is where
    they agree from then on, for matches look only ahead: the text is cut there, unless after a blank.  Chunks that agree nowhere
    are taken together: a run of any length that is one pre-token is one piece.  Each piece is then encoded by itself and the ids
    are joined in order.
    A shorter text is one chunk.  Null is the empty text, which has no ids.  Repeated rows give equal rows; rows
    without doc_id are told apart by their text.  No rows give none.  Other columns, whatever their names, are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def to_ids(keys: list[str], text: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enc, match = encoding(ranks_path, pattern), regex.compile(pattern)
            for b in batches:
                at, size, ids = 0, 0, []
                for i, x in enumerate(b.column(text)):
                    ids.append(token_ids(enc, match, x.as_py(), step + overlap).tobytes())
                    size += len(ids[-1])
                    if size > _BATCH or i + 1 == b.num_rows:
                        yield pa.RecordBatch.from_arrays([*[b.column(k).slice(at, len(ids)) for k in keys], pa.array(ids, pa.binary())], names=[*keys, "ids"])
                        at, size, ids = i + 1, 0, []

        return run

    short = rows.where(F.length("text") <= step).mapInArrow(to_ids(["doc_id"], "text"), "doc_id long, ids binary")

    # repeated rows are one text with a count; grouping by chunk spreads a long text over tasks
    key = ["doc_id", "digest"]
    chunks = _pieces(rows.where(F.length("text") > step), step, overlap).groupBy(*key, "k").agg(F.first("piece").alias("piece"), F.first("n").alias("n"), F.count("*").alias("copies"))
    # both uses take all columns of the chunks, so that their shuffle is one
    edges = chunks.select(*key, "k", "n", "piece", "copies").mapInArrow(_edges(pattern, step, overlap), "doc_id long, digest binary, k int, head array<int>, tail array<int>")
    order = Window.partitionBy(*key).orderBy("k")
    cuts = edges.withColumn("next", F.array_min(F.array_intersect("tail", F.lead("head").over(order)))).withColumn("own", F.lag("next").over(order))
    cuts = cuts.withColumn("run", F.sum(F.when((F.col("k") > 0) & F.col("own").isNull(), 0).otherwise(1)).over(order))
    cuts = cuts.withColumn("size", F.count("*").over(Window.partitionBy(*key, "run")))
    cuts = cuts.select(*[F.col(c).alias(f"{c}_") for c in [*key, "k"]], F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("next", F.lit(0)).alias("next"), "run", "size")
    same = (F.col("doc_id").eqNullSafe(F.col("doc_id_"))) & (F.col("digest") == F.col("digest_")) & (F.col("k") == F.col("k_"))
    part = F.expr(f"substring(piece, own + 1, case when k + 1 = n then {step + overlap} else {step} + next - own end)")
    parts = chunks.join(cuts, same).select(*key, "run", "k", "size", "copies", part.alias("part"))
    # most runs are one chunk and need no grouping
    merged = parts.where("size > 1").groupBy(*key, "run").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("parts"), F.max("copies").alias("copies"))
    whole = parts.where("size = 1").select(*key, "run", "copies", "part").union(merged.select(*key, "run", "copies", F.concat_ws("", F.col("parts.part")).alias("part")))
    done = whole.mapInArrow(to_ids([*key, "run", "copies"], "part"), "doc_id long, digest binary, run long, copies long, ids binary")
    joined = done.groupBy(*key).agg(F.expr("listagg(ids, x'') within group (order by run)").alias("ids"), F.max("copies").alias("copies"))
    long = joined.select("doc_id", "ids", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("doc_id", "ids")
    return short.union(long)


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``decoded``, the bytes of the ids put together, to the (doc_id, ids) of ``encode``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for b in batches:
            at, size, out = 0, 0, []
            for i, x in enumerate(b.column("ids")):
                out.append(enc.decode_bytes(np.frombuffer(x.as_py(), "<u4").tolist()))
                size += len(out[-1]) * 3
                if size > _BATCH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(out)), b.column("ids").slice(at, len(out)), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])
                    at, size, out = i + 1, 0, []

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
