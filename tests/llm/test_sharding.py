import zlib
from collections import Counter, defaultdict

from helpers import clashing, documents
from scrivener.llm.sharding import shards


def test_shards(spark):
    data = [(i, "é" * (i % 50)) for i in range(3000)] + [(3000, None), (None, "x"), (5, "é" * 5), (5, "other")]
    out = shards(clashing(documents(spark, data)), [1.0] * 24).collect()
    assert len(out) == len(data)
    slots, moved = defaultdict(list), 0
    texts = dict(data)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 24)
        moved += r.grown_shard == 24
        if r.doc_id not in (5, None):
            raw = (texts[r.doc_id] or "").encode()
            assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    assert 60 < moved < 200 and len({r.shard for r in out if r.doc_id == 5}) == 1
    again = shards(documents(spark, data).repartition(5), [1.0] * 24).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))


def test_weights(spark):
    df = documents(spark, [(i, "") for i in range(4000)])
    n = Counter(r.shard for r in shards(df, [3.0, 1.0, 0.0]).collect())
    assert n[2] == 0 and 2800 < n[0] < 3200
    wide = {r.doc_id: r.shard for r in shards(df, [3.0, 1.0, 2.0]).collect()}
    narrow = {r.doc_id: r.shard for r in shards(df, [3.0, 1.0]).collect()}
    assert all(wide[i] in (narrow[i], 2) for i in wide)
    assert shards(documents(spark, []), [1.0]).count() == 0


def test_the_least_score_wins(spark):
    import hashlib
    import math

    weights = [1.0, 2.5, 0.5, 1.0]
    score = lambda key, i, w: -math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w
    ids = [*range(-5, 400), None]
    for r in shards(documents(spark, [(i, f"text {i}") for i in ids]), weights, new_weight=0.7).collect():
        key = "null" if r.doc_id is None else r.doc_id
        own = [(score(key, i, w), i) for i, w in enumerate([*weights, 0.7])]
        assert r.shard == min(own[:4])[1] and r.grown_shard == min(own)[1]


def test_many_rows_without_an_id(spark):
    out = shards(documents(spark, [(None, f"text {i % 40}") for i in range(300)]), [1.0] * 3).collect()
    assert len({r.shard for r in out}) == 1 and sorted(r.slot for r in out) == list(range(300))
