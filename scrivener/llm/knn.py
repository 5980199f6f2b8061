"""Exact top-k by inner product: a Voronoi join with bounds from summaries."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.common import materialize

#: Cells at most, data rows for each cell that is wanted, and rows of a cell that set a query's first threshold.
PIVOTS, CELL, CHAMPIONS = 256, 4_096, 16
#: Components that a task's block of data or queries holds at most, unless a few long rows hold more.
BLOCK, ROWS = 1 << 21, 256
#: Bounds are eased by this part, for rounding.
EASE = 1e-9


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) of each component as array<long>.  Left out: vectors that are null
    or hold null or non-finite components, and rows without an id.  Repeated equal rows become one."""
    x = F.col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def _matrix(arrays: pa.Array, dim: int) -> np.ndarray:
    flat = arrays.flatten().to_numpy(zero_copy_only=False) if len(arrays) else np.empty(0, np.int64)
    return flat.astype(np.int64).reshape(len(arrays), dim)


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = np.diff(np.asarray(b.column("v").offsets))
    for dim in np.unique(sizes).tolist():
        part = b.filter(pa.array(sizes == dim))
        yield dim, part, _matrix(part.column("v"), dim)


def _cells(pivots: dict[int, np.ndarray]):
    """The nearest pivot of each vector and the distance to it; cells of another length have the zero pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, x in _by_dim(b):
                p = pivots.get(dim, np.zeros((1, dim))).astype(float)
                x = x.astype(float)
                far = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None], 0))
                cell = far.argmin(1)
                dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(np.full(len(x), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt((x * x).sum(1)))], names=["vec_id", "v", "dim", "cell", "dist", "norm"])

    return run


def _routes(pivots: dict[int, np.ndarray], blocks: dict[int, list], champions: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """A query's rows for the blocks of data that can hold one of its ``k`` best.

    ``blocks``: per vector length (block, cell, radius, greatest norm).  For x within radius r of pivot c,
    q.x <= q.c + |q| r, and q.x <= |q| |x|.  A query has k partners at least as good as its k-th best champion,
    a real row each, so blocks under that score hold none that counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, part, q in _by_dim(b):
                held = blocks.get(dim, [])
                if not held:
                    continue
                ids = part.column("vec_id").to_numpy()
                best_ids, best = champions.get(dim, (np.empty(0, np.int64), np.zeros((0, dim), np.int64)))
                y, size = q.astype(float), np.sqrt((q.astype(float) ** 2).sum(1))
                centres = pivots.get(dim, np.zeros((1, dim))).astype(float)[[h[1] for h in held]]
                radius, norm = np.array([h[2] for h in held]), np.array([h[3] for h in held])
                most = np.minimum(y @ centres.T + size[:, None] * radius, size[:, None] * norm)
                most += EASE * (np.abs(most) + size[:, None] * (radius + norm) + 1)
                least = np.full(len(q), -np.inf)
                for at in range(0, len(q), 512):
                    found = np.where(ids[at : at + 512, None] != best_ids[None], scores(q[at : at + 512], best).astype(float), -np.inf)
                    if found.shape[1] >= k:
                        least[at : at + 512] = np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k]
                rows, cols = np.nonzero(most >= least[:, None])
                for at in range(0, len(rows), 4096):
                    pick = pa.array(rows[at : at + 4096])
                    block = pa.array(np.array([h[0] for h in held], np.int64)[cols[at : at + 4096]])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pick), dim, np.int32)), block, part.column("vec_id").take(pick), part.column("v").take(pick)], names=["dim", "block", "vec_id", "v"])

    return run


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    return (q.astype(float) @ x.astype(float).T).astype(np.int64) if bound < 2**53 else q @ x.T


def _solve(k: int):
    """The k best rows of a block of data for each query of a block of queries, ties to the smaller id."""

    def run(key: tuple, queries: pa.Table, data: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        data = data.sort_by("vec_id")
        ids = data.column("vec_id").to_numpy()
        x, q, qids = _matrix(data.column("v").combine_chunks(), dim), _matrix(queries.column("v").combine_chunks(), dim), queries.column("vec_id").to_numpy()
        out = ([], [], [])
        for at in range(0, len(q), 128):
            block = scores(q[at : at + 128], x) if len(x) else np.empty((len(q[at : at + 128]), 0), np.int64)
            for qid, s in zip(qids[at : at + 128].tolist(), block):
                other = np.flatnonzero(ids != qid)
                s = s[other]
                if len(s) > k:
                    edge = np.partition(s, len(s) - k)[len(s) - k]
                    over = np.flatnonzero(s > edge)
                    best = np.concatenate([over, np.flatnonzero(s == edge)[: k - len(over)]])
                else:
                    best = np.arange(len(s))
                out[0].append(np.full(len(best), qid))
                out[1].append(ids[other[best]])
                out[2].append(s[best])
        made = [np.concatenate(o) if o else np.empty(0, np.int64) for o in out]
        return pa.table({"query_id": pa.array(made[0], pa.int64()), "vec_id": pa.array(made[1], pa.int64()), "score": pa.array(made[2], pa.int64())})

    return run


def routed(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The data (dim, block, vec_id, v), each row in one block, and the queries, each in the blocks that it may need."""
    fine = quantised(vectors, id_col, vector_col, scale)
    n = vectors.count()
    wanted = pivots or min(PIVOTS, max(16, n // CELL))
    picked = defaultdict(set)
    for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).collect():
        picked[len(r.v)].add(tuple(r.v))
    centres = {dim: np.array(sorted(p), dtype=np.int64).reshape(len(p), dim) for dim, p in picked.items()}
    celled = materialize(fine.mapInArrow(_cells(centres), "vec_id long, v array<long>, dim int, cell int, dist double, norm double"))
    step = F.floor(F.log2(F.col("dist") + 1) * 8).cast("int")
    summary = celled.groupBy("dim", "cell", step.alias("step")).agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.max("norm").alias("norm")).orderBy("dim", "cell", "step").collect()
    # neighbouring steps of distance share a block until it is full; a crowded step has several blocks
    blocks, starts, last = defaultdict(list), [], None
    for s in summary:
        size = max(ROWS, BLOCK // max(s["dim"], 1))
        if last and last[:2] == (s["dim"], s["cell"]) and last[2] + s["n"] <= size:
            block, parts, last = starts[-1][3], 1, (*last[:2], last[2] + s["n"])
            number, cell, radius, norm = blocks[s["dim"]][-1]
            blocks[s["dim"]][-1] = (number, cell, max(radius, s["radius"]), max(norm, s["norm"]))
        else:
            block, parts = (starts[-1][3] + starts[-1][4] if starts else 0), -(-s["n"] // size)
            blocks[s["dim"]] += [(block + i, s["cell"], s["radius"], s["norm"]) for i in range(parts)]
            last = (s["dim"], s["cell"], s["n"] if parts == 1 else size)
        starts.append((s["dim"], s["cell"], s["step"], block, parts))
    named = celled.sparkSession.createDataFrame(starts, "d int, c int, s int, first long, parts int")
    data = celled.withColumn("step", step).join(F.broadcast(named), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")) & (F.col("step") == F.col("s")))
    data = data.select("dim", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"), "vec_id", "v")
    # the longest rows of a cell score best with the queries that point its way
    place = F.row_number().over(Window.partitionBy("dim", "cell").orderBy(F.col("norm").desc(), "vec_id"))
    champions = defaultdict(dict)
    for r in celled.withColumn("place", place).where(F.col("place") <= CHAMPIONS).select("dim", "vec_id", "v").collect():
        champions[r.dim].setdefault(r.vec_id, r.v)  # one row an id, so that k of them are k partners
    best = {dim: (np.array(list(x), np.int64), np.array(list(x.values()), np.int64).reshape(len(x), dim)) for dim, x in champions.items()}
    asked = celled.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    return data, materialize(asked.mapInArrow(_routes(centres, dict(blocks), best, k), "dim int, block long, vec_id long, v array<long>"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, pivots: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each query, the k candidates with the highest score.

    Queries: rows whose id is divisible by ``every``; candidates: all rows but those with the query's own id.
    Score: inner product of the components floor(scale * x), in 64 bits; vectors of other lengths are not
    compared.  Ties go to the smaller id; with fewer candidates all come.  Null vectors, and those with null or
    non-finite components, take no part, nor do rows without an id.  Equal repeated rows count once.  No rows give
    none; other columns, whatever their names, are not read; long vectors make blocks of fewer rows.

    1. Up to ``pivots`` vectors, picked by hash, part the data into Voronoi cells; a cell's rows are cut into
       blocks by their distance from the pivot.  Summaries of the blocks (radius, greatest norm) go to the driver.
    2. The longest few rows of each cell give every query a score that k others are sure to reach.
    3. A query goes to the blocks whose bound lets them reach that score: of the two sides the queries are the
       smaller one, so they are replicated where needed, and each data row is sent once for about BLOCK
       components of queries.
    4. Blocks are solved by themselves; the best of all blocks stay.
    """
    data, asked = routed(vectors, k, every, id_col, vector_col, scale, pivots)
    crowds = asked.groupBy(F.col("dim").alias("d"), F.col("block").alias("b")).agg(F.count("*").alias("n")).select("d", "b", F.ceil(F.col("n") / F.greatest(F.lit(ROWS), F.floor(F.lit(BLOCK) / F.greatest(F.col("d"), F.lit(1))))).cast("int").alias("crowd"))
    crowds = materialize(crowds)
    same = (F.col("dim") == F.col("d")) & (F.col("block") == F.col("b"))
    questions = asked.join(crowds, same).select("dim", "block", F.pmod(F.xxhash64("vec_id"), F.col("crowd")).cast("int").alias("qb"), "vec_id", "v")
    sent = data.join(crowds, same).select("dim", "block", F.explode(F.sequence(F.lit(0), F.col("crowd") - 1)).alias("qb"), "vec_id", "v")
    key = ["dim", "block", "qb"]
    found = questions.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_solve(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # equal ids with different vectors may meet a query more than once
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score from v q, v c where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5"""
