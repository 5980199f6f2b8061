import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import clashing, documents, rows
from scrivener.llm import minhash

COLS = ("doc_id", "n_shingles", "component_id", "kept")


def shingles(text, width=2):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(data, width=2):
    sets = [shingles(t, width) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(data)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(data):
        if doc_id is not None:
            r = find(i)
            least[r] = min(doc_id, least.get(r, doc_id))
    out = []
    for i, (doc_id, _) in enumerate(data):
        c = least.get(find(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), c, doc_id == c))
    return sorted(out, key=repr)


def corpus(seed, n=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    data = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 250))]
        data.append(words)
        for changes in (1, 2, 8, 30):
            other = list(words)
            for at in rng.sample(range(len(other)), min(changes, len(other))):
                other[at] = f"new{rng.random()}"
            data.append(other)
    rng.shuffle(data)
    return [(i, " ".join(w)) for i, w in enumerate(data)]


def test_against_brute_force(spark):
    data = corpus(5)
    odd = [None, "", " \n", "Word", "word", "one two", "ONE  Two", "one two three", "É x y", "é x y", "long text here " * 40_000]
    data += [(1000 + i, t) for i, t in enumerate(odd)] + [(None, data[3][1]), (None, "alone here"), (None, None), (3, data[3][1]), (4, "other text"), (4, data[9][1])]
    assert rows(minhash.near_duplicates(clashing(documents(spark, data))), *COLS) == brute(data)
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


@pytest.mark.parametrize("spread", [4, 9, 14])
def test_crowded_buckets(spark, monkeypatch, spread):
    """Copies of one text around the similarity, some linked only over others, some with changes in common."""
    monkeypatch.setattr(minhash, "BUCKET", 4)
    rng = random.Random(spread)
    base, data = [f"b{i}" for i in range(120)], []
    for i in range(90):
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(spread)):
            words[at] = f"x{i % 7}.{at}" if rng.random() < 0.6 else f"y{i}.{at}"
        data.append((i, " ".join(words)))
    assert rows(minhash.near_duplicates(documents(spark, data)), *COLS) == brute(data)


def test_wider_shingles_of_the_given_documents(spark):
    """All pairs of five-word similarity 0.8 or more in the given table, counted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows(minhash.near_duplicates(docs, width=5), *COLS) == brute(data, 5)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    limit = minhash.most_differing(80)
    for percent in (95, 90, 80):
        errors = []
        for _ in range(40):
            both = rng.integers(0, 2**63, 9 * percent, dtype=np.uint64)
            own = rng.integers(0, 2**63, (2, 9 * (100 - percent) // 2), dtype=np.uint64)
            a, b = (minhash.odd_sketch(minhash.samples(np.concatenate([both, x]))) for x in own)
            differing = int(np.unpackbits((a ^ b).view(np.uint8)).sum())
            errors.append(minhash.similarity(differing) - percent / 100)
            assert differing <= limit
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    assert 0.6 < minhash.similarity(limit) < 0.72
    assert minhash.most_differing(90) < limit


def test_empty_plan_after_filter(spark):
    assert minhash.groups(documents(spark, [(1, "a b c")]).where(F.lit(False))).count() == 0
