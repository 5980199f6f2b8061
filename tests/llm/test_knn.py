import random

import numpy as np
from pyspark.sql import functions as F

from helpers import rows
from scrivener.llm import knn


def brute(data, k=5):
    vecs = {}
    for i, v in data:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vecs[i] = [int(np.floor(256 * float(np.float32(x)))) for x in v]
    out = []
    for q, qv in vecs.items():
        if q % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(qv, v)), i) for i, v in vecs.items() if i != q and len(v) == len(qv)))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


def frame(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("cell", F.lit(1)).withColumn("v", F.lit("x"))


COLS = ("query_id", "rank", "vec_id", "score")


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(0)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    data = [(i, [float(x + rng.gauss(0, 0.05)) for x in rng.choice(centre)]) for i in range(600)]
    data += [(1000 + i, data[3][1]) for i in range(200)] + [(2000, data[3][1]), (2050, None), (2051, [float("nan")] * 8), (2052, [1.0, None] + [0.0] * 6), (2053, [float("inf")] * 8), (None, [0.0] * 8), (7, data[7][1])]
    data += [(3000, [1.0, 2.0]), (3001, [0.5, 0.5]), (3050, []), (3051, [])]
    assert rows(knn.top_k(frame(spark, data)), *COLS) == brute(data)
    monkeypatch.setattr(knn, "BLOCK", 8 * 40)
    monkeypatch.setattr(knn, "ROWS", 3)
    assert rows(knn.top_k(frame(spark, data), pivots=4), *COLS) == brute(data)


def test_clusters_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 20)
    monkeypatch.setattr(knn, "BLOCK", 1)
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    data = [(i, [float(x + rng.gauss(0, 0.01)) for x in centres[i % 20]]) for i in range(2000)]
    blocks, asked = knn.routed(frame(spark, data), pivots=40)
    assert blocks.count() == 2000 and blocks.select("vec_id").distinct().count() == 2000
    n_blocks, n_queries = blocks.select("block").distinct().count(), 40
    # of all pairs of queries and blocks that a plain product has, under a quarter are sent
    assert n_queries <= asked.count() < n_blocks * n_queries / 4
    assert rows(knn.top_k(frame(spark, data), pivots=40), *COLS) == brute(data)


def test_few_and_no_rows(spark):
    assert rows(knn.top_k(frame(spark, [(50, [1.0]), (51, [2.0]), (52, [-1.0])])), *COLS) == [(50, 1, 51, 131072), (50, 2, 52, -65536)]
    assert rows(knn.top_k(frame(spark, [(50, [1.0])])), *COLS) == []
    assert rows(knn.top_k(frame(spark, [])), *COLS) == []
    big = np.array([[1 << 40, 3]])
    assert knn.scores(big, np.array([[1 << 20, 1]])).tolist() == [[(1 << 60) + 3]]


def test_a_query_id_with_many_vectors(spark):
    data = [(50, [10.0 + i / 4, 0.0]) for i in range(12)] + [(i, [1.0 + i / 16, 0.5]) for i in range(1, 8)]
    vecs = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data]
    pairs = [(-(a[0] * b[0] + a[1] * b[1]), i) for q, a in vecs if q == 50 for i, b in vecs if i != 50]
    want = [(50, n + 1, i, -s) for n, (s, i) in enumerate(sorted(pairs)[:5])]
    assert rows(knn.top_k(frame(spark, data), pivots=4), *COLS) == want
