import random

import numpy as np
from pyspark.sql import functions as F

from helpers import clashing, documents
from scrivener.llm import quality


def corpus(n=400):
    rng = random.Random(8)
    clean, junk = [f"c{i}" for i in range(80)], [f"j{i}!!" for i in range(80)]
    data, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        data.append((i, " ".join(rng.choice(clean if good else junk) for _ in range(rng.randrange(20, 400)))))
        if i % 2:
            labels.append((i, int(good)))
    return data, labels


def test_keeps_good_and_rejects_bad(spark):
    data, labels = corpus()
    extra = [(900, None), (901, ""), (None, data[0][1]), (3, data[3][1])]
    docs = clashing(documents(spark, data + extra))
    lab = spark.createDataFrame([*labels, (None, 1), (7777, 0)], "doc_id long, quality int")
    scores, key, keep = quality.resample(docs, lab)
    got = scores.collect()
    assert len(got) == len(data) + len(extra)
    bad = {i for i, t in data if t.startswith("j")}
    for r in got:
        if r.doc_id is not None and r.doc_id < 900:
            assert r.kept == (r.doc_id not in bad)
        if r.doc_id in (900, 901):
            assert r.weight == 0 and r.kept
    again = {r.doc_id for r in docs.where(keep).select("doc_id").collect()}
    assert again == {r.doc_id for r in got if r.kept}


def test_counts_of_models_against_plain_counting(spark):
    data, labels = corpus(60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    b = 64
    train = {r._id for r in quality.sampled_labels(lab).collect() if r.good and not r.held_out}
    raw, good = np.zeros(b), np.zeros(b)
    for i, t in data:
        n = np.bincount(quality.ngrams(t.encode(), b), minlength=b)
        raw += n
        good += n * (i in train)
    want = np.log((good + quality.SMOOTHING) / (raw * good.sum() / raw.sum() + quality.SMOOTHING))
    assert np.allclose(quality.log_ratios(documents(spark, data), lab, b), want)
    words = "a b c a".encode()
    assert len(quality.ngrams(words, b)) == 7 and len(quality.ngrams(b"", b)) == 0


def test_kth_largest(spark):
    rng = random.Random(0)
    values = [rng.getrandbits(62) >> rng.randrange(40) for _ in range(500)] + [5] * 50 + [0]
    df = spark.createDataFrame([(v,) for v in values], "key long")
    for k in (1, 2, 30, 300, len(values)):
        assert quality.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, len(values) + 1) is None


def test_without_labels_or_rows(spark):
    data, _ = corpus(20)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(documents(spark, data), none)[0].where(~F.col("kept")).count() == 0
    assert quality.resample(documents(spark, []), none)[0].count() == 0
    assert quality.resample(documents(spark, data), none.union(spark.createDataFrame([(1, 1)], "doc_id long, quality int")))[0].where("kept").count() == 20


def test_weights_keys_and_choice_against_brute_force(spark):
    import hashlib
    import math

    data, labels = corpus(150)
    data += [(500, None), (501, ""), (502, "c1 j1!! c2"), (3, data[3][1])]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    docs, b = clashing(documents(spark, data)), 128
    found = quality.resample(docs, lab, seed=7, buckets=b, carry=True)[0].collect()
    ratios = quality.log_ratios(docs, lab, b).astype(np.float32)  # counted by hand in a test above

    def weigh(text):
        n = quality.ngrams((text or "").encode(), b)
        return float(ratios[n].sum(dtype=np.float64)) * quality.SPAN / max(quality.SPAN, len(n))

    def noisy(i, w):
        u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return math.floor((w - math.log(-math.log(u))) * (1 << 20)) + (1 << 62)

    sample = {r._id: r.good for r in quality.sampled_labels(lab).collect() if r.held_out}
    weights = [(i, weigh(t)) for i, t in data]
    good, bad = [w for i, w in weights if sample.get(i)], [w for i, w in weights if sample.get(i) is False]
    edges = sorted({*good, *bad})
    cuts = [edges[0] - 1, *[(x + y) / 2 for x, y in zip(edges, edges[1:])], edges[-1] + 1]
    right = lambda c: sum(w > c for w in good) / len(good) + sum(w < c for w in bad) / len(bad)
    cut = next(c for c in cuts if right(c) >= max(map(right, cuts)) - 1e-12)
    keys = sorted((noisy(i, w) for i, w in weights), reverse=True)
    least = keys[sum(w > cut for _, w in weights) - 1]
    want = sorted((i, round(w, 6), noisy(i, w), noisy(i, w) >= least) for i, w in weights)
    got = sorted((r.doc_id, round(r.weight, 6), r.key, r.kept) for r in found)
    assert [(a[0], a[1], a[3]) for a in got] == [(a[0], a[1], a[3]) for a in want] and all(abs(a[2] - c[2]) <= 1 for a, c in zip(got, want))
    assert sorted((r.row.doc_id, r.row.text or "") for r in found) == sorted((i, t or "") for i, t in data) and found[0].row.kept == 1
