import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from helpers import clashing, documents, rows
from scrivener.llm import simhash
from scrivener.llm.common import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for a, b in combinations(range(64), 2):
        assert any(not (m >> a & 1) and not (m >> b & 1) for m in masks)
    for m in masks:
        free = [i for i in range(64) if not m >> i & 1]
        for a, b in combinations(free, 2):
            assert any(not (x >> a & 1) and not (x >> b & 1) for x in simhash._finer(m, 2))


def test_fingerprint_of_blocks_equals_whole(monkeypatch):
    rng = random.Random(3)
    text = " ".join(rng.choice("alpha Beta gamma delta \n".split() + ["é"]) for _ in range(3000))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    from scrivener.llm import common

    monkeypatch.setattr(simhash, "blocks", lambda data: common.blocks(data, 50))
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    for short in ("", "  ", "One", "one Two", "a b c", None):
        assert simhash.fingerprint((short or "").encode()) == brute_fingerprint(short)


def test_pairs_against_brute_force_with_a_crowded_bucket(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 8)
    rng = random.Random(1)
    values = {rng.getrandbits(64) for _ in range(150)}
    centre = rng.getrandbits(64)
    for _ in range(250):
        x = centre
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    signed = [simhash._signed(x) for x in values]
    got = {(r.a, r.b) for r in simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(min(p), max(p)) for p in combinations(signed, 2) if bin((p[0] ^ p[1]) & (2**64 - 1)).count("1") <= 2}


def test_documents(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 900))]
        texts.append(" ".join(words))
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
            texts.append("  ".join(words))
    data = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (3, texts[3]), (903, "Word"), (904, "word"), (905, "a b")]
    df = clashing(documents(spark, data))
    fps = {i: brute_fingerprint(t) for i, t in data}
    want = components(fps, [p for p in combinations(fps, 2) if bin(fps[p[0]] ^ fps[p[1]]).count("1") <= 2])
    got = rows(simhash.near_duplicates(df), "doc_id", "fp", "component_id")
    assert got == sorted([(i, simhash._signed(fps[i]), want[i]) for i, _ in data], key=repr)
    assert rows(simhash.near_duplicates(df.where("doc_id < 0")), "doc_id") == []


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(1000, i) for i in range(500, 560)] + [(7, 7), (2000, 1999)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for l in links for x in l}
    want = components(nodes, links)
    assert got == {k: v for k, v in want.items() if k != v}
    assert connected_components(spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0
