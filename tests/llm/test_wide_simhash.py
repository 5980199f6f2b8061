import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import clashing, documents
from scrivener.llm import minhash, wide_simhash
from scrivener.llm.common import mix


def shingles(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute(data, width=5):
    sets = [shingles(t, width) for _, t in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(data)), 2):
        if sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    members = {}
    for i, (doc_id, _) in enumerate(data):
        members.setdefault(find(i), []).append(doc_id)
    return sorted(sorted(x) for x in members.values())


def got(found):
    return sorted(sorted(r.ids) for r in found.groupBy("root").agg(F.collect_list("doc_id").alias("ids")).collect())


def pair(rng, both, own, other):
    grams = rng.integers(0, 2**63, both + own + other, dtype=np.uint64)
    return grams[: both + own], np.concatenate([grams[:both], grams[both + own :]])


def test_votes_one_by_one():
    grams = np.random.default_rng(2).integers(0, 2**63, 300, dtype=np.uint64)
    want = [0] * 128
    for g in grams:
        for stream in range(2):
            x = int(mix(np.array([g], np.uint64) ^ wide_simhash._STREAMS[stream])[0])
            for i in range(64):
                want[64 * stream + i] += 1 if x >> i & 1 else -1
    votes = wide_simhash.votes(grams)
    assert votes[:128].tolist() == want
    strong = wide_simhash.strongest(votes)
    for block in range(2):
        part = want[64 * block : 64 * block + 64]
        assert abs(part[int(strong[block]) // 2]) == max(map(abs, part)) and (part[int(strong[block]) // 2] > 0) == strong[block] % 2
    bits = np.unpackbits(wide_simhash.of(grams)[1].view(np.uint8), bitorder="little")
    assert len(bits) == minhash.BITS and bits[:128].tolist() == [int(x > 0) for x in want]


@pytest.mark.parametrize("both, own, other", [(4, 0, 1), (8, 0, 2), (8, 1, 1), (40, 5, 5), (200, 25, 25), (200, 0, 50)])
def test_sets_of_the_similarity_meet_and_pass(both, own, other):
    rng = np.random.default_rng(both + other)
    limit, missed = wide_simhash.most_differing(80), 0
    for _ in range(60):
        a, b = (wide_simhash.of(x) for x in pair(rng, both, own, other))
        assert np.unpackbits((a[1] ^ b[1]).view(np.uint8)).sum() <= limit
        same = a[0] == b[0]
        missed += not any((same & np.roll(same, -i) & np.roll(same, -j)).any() for i, j in wide_simhash.OFFSETS)
    assert missed <= 1
    strangers = [wide_simhash.of(rng.integers(0, 2**63, both + own, dtype=np.uint64))[1] for _ in range(2)]
    assert np.unpackbits((strangers[0] ^ strangers[1]).view(np.uint8)).sum() > limit


def test_no_two_tables_share_two_blocks():
    tables = [{i, (i + a) % wide_simhash.BLOCKS, (i + b) % wide_simhash.BLOCKS} for a, b in wide_simhash.OFFSETS for i in range(wide_simhash.BLOCKS)]
    assert all(len(x) == 3 for x in tables) and all(len(x & y) < 2 for x, y in combinations(tables, 2))


def test_the_stage_meets_by_simhash(spark, monkeypatch):
    """Nothing is found by least shingles: without them the stage still finds near copies."""

    def never(*_):
        raise AssertionError("MinHash")

    monkeypatch.setattr(minhash, "MINHASH", minhash.Method(never, never, never))
    words = [f"w{i}" for i in range(120)]
    data = [(1, " ".join(words)), (2, " ".join([*words[:60], "new", *words[61:]])), (3, " ".join(words[::-1]))]
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, documents(spark, data), "").collect()} == {1, 3}


@pytest.mark.parametrize("spread", [9, 14, 20])
def test_crowded_buckets_of_two_families(spark, monkeypatch, spread):
    """Copies of two texts, of which some are linked only over others, some have changes in common and some are alone."""
    monkeypatch.setattr(minhash, "BUCKET", 4)
    rng = random.Random(spread)
    data = []
    for name in "ab":
        base = [f"{name}{i}" for i in range(150)]
        for i in range(60):
            words = list(base)
            for at in rng.sample(range(150), rng.randrange(spread)):
                words[at] = f"x{i % 7}.{at}" if rng.random() < 0.6 else f"y{i}.{at}"
            data.append((len(data), " ".join(words)))
    assert got(wide_simhash.groups(clashing(documents(spark, data)))) == brute(data)


def test_all_pairs_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(wide_simhash.groups(docs)) == brute(data)


def test_a_family_is_compared_once(spark, monkeypatch):
    """Sets that share crowded buckets of many tables are near one pivot, or few, and not near one for each bucket."""
    monkeypatch.setattr(minhash, "BUCKET", 4)
    seen = []
    real = minhash._changed_alike
    monkeypatch.setattr(minhash, "_changed_alike", lambda reach, *rest: (seen.append((reach.count(), reach.select("node").distinct().count())), real(reach, *rest))[1])
    rng = random.Random(1)
    base, data = [f"b{i}" for i in range(150)], []
    for i in range(120):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(14)):
            words[at] = f"y{i}.{at}"
        data.append((i, " ".join(words)))
    assert got(wide_simhash.groups(documents(spark, data))) == brute(data)
    assert seen[0][1] > 50 and seen[0][0] <= 1.2 * seen[0][1]


def test_keys_are_hardly_shared_by_chance_and_alike_sets_share_some(spark):
    """Of unlike sets a few in a thousand meet in some table: rows that meet by chance grow with the square of the corpus."""
    rng = np.random.default_rng(6)
    unlike = [wide_simhash.of(rng.integers(0, 2**63, 60, dtype=np.uint64))[0].tolist() for _ in range(1500)]
    held = spark.createDataFrame([(x,) for x in unlike], "s array<long>").select(F.posexplode(wide_simhash.keys(F.col("s"))).alias("t", "k"))
    assert held.groupBy("t", "k").count().where("count > 1").count() <= 15
    alike = [[x[0].tolist() for x in map(wide_simhash.of, pair(rng, 80, 10, 10))] for _ in range(200)]
    shared = F.exists(F.zip_with(wide_simhash.keys(F.col("a")), wide_simhash.keys(F.col("b")), lambda x, y: x == y), lambda x: x)
    assert spark.createDataFrame(alike, "a array<long>, b array<long>").where(~shared).count() <= 2


@pytest.mark.parametrize("first", [2, 30, 200])
def test_rounds_find_the_same_groups(spark, monkeypatch, first):
    """However many tables come first, families that meet later, sets that join one later and sets in none are compared."""
    monkeypatch.setattr(minhash, "BUCKET", 3)
    monkeypatch.setattr(wide_simhash, "SIMHASH", minhash.Method(wide_simhash.of, wide_simhash.keys, wide_simhash.most_differing, first=first, more=True))
    rng = random.Random(first)
    data = []
    for name in "abc":
        base = [f"{name}{i}" for i in range(150)]
        for i in range(40):
            words = list(base)
            for at in rng.sample(range(150), rng.randrange(1, 12)):
                words[at] = f"x{i % 5}.{at}" if rng.random() < 0.5 else f"y{i}.{at}"
            data.append((len(data), " ".join(words)))
    assert got(wide_simhash.groups(documents(spark, data))) == brute(data)


def rows_joined(spark, on):
    """Rows that inner joins on these columns have made in this session."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, total = store.executionsList(), 0
    for i in range(runs.size()):
        run = runs.apply(i).executionId()
        nodes, counts = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for j in range(nodes.size()):
            node = nodes.apply(j)
            if "Join" in node.name() and re.sub(r"#\d+L?", "", node.desc()).split(" ", 1)[1].startswith(f"[{on}], [{on}], Inner"):
                for n in range(node.metrics().size()):
                    metric = node.metrics().apply(n)
                    if metric.name() == "number of output rows" and counts.contains(metric.accumulatorId()):
                        total += int(counts.apply(metric.accumulatorId()).replace(",", ""))
    return total


def test_changes_that_many_share_make_few_rows(spark):
    """A pivot with changes of its own, from which all others differ in the same shingles."""
    rng = random.Random(3)
    base, data = [f"b{i}" for i in range(150)], []
    for i in range(150):
        words = list(base)
        for at in range(0, 150, 15) if i == 0 else rng.sample(range(150), 1 + i % 3):
            words[at] = f"y{i}.{at}"
        data.append((i, " ".join(words)))
    found = minhash.signatures(documents(spark, data), width=5, method=wide_simhash.SIMHASH)
    pivot = found.where("doc_id = 0").select(F.col("node").alias("pivot"))
    reach = found.crossJoin(pivot).withColumn("out", F.col("doc_id") % 50 == 1).withColumn("root", F.when(F.col("out"), F.col("node")).otherwise(F.col("pivot")))
    sets = minhash._sets(documents(spark, data), found, "doc_id", "text", 5)
    before = rows_joined(spark, "pivot, g")
    pairs = {(bytes(r.node), bytes(r.node2)) for r in minhash._changed_alike(reach, sets, 80, wide_simhash.SIMHASH).collect()}
    made = rows_joined(spark, "pivot, g") - before
    names = {bytes(r.node): r.doc_id for r in found.select("node", "doc_id").collect()}
    want = [shingles(t) for _, t in data]
    need = {(a, b) for a, b in combinations(range(1, 150), 2) if (a % 50 == 1 or b % 50 == 1) and 100 * len(want[a] & want[b]) >= 80 * len(want[a] | want[b])}
    alone = {i for i in range(1, 150) if 100 * len(want[i] & want[0]) >= 80 * len(want[i] | want[0])}
    assert {x for x in need if not set(x) <= alone} <= {tuple(sorted((names[a], names[b]))) for a, b in pairs}
    assert need and made <= 5000
