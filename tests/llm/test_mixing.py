import random
from collections import Counter, defaultdict

from helpers import clashing, documents, rows
from scrivener.llm import mixing


def water(sizes, weights=(5, 2, 1), cap=3):
    """Give out, cut at the cap, share the excess by weight, until nothing is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    open_, full, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > cap * sizes[s] + 1e-9}
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
        left -= sum(full[s] for s in over)
        open_ -= over
    return full


def sainte_lague(votes, seats):
    won = Counter()
    for _ in range(seats):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * won[p] + 1))
        won[best] += 1
    return won


def test_quotients_equal_the_plain_procedure(spark):
    rng = random.Random(2)
    data = [(g, p, float(rng.choice([0, 1, 7, 7, rng.randrange(1, 5000)])), seats) for g, seats in enumerate([0, 1, 5, 40, 333]) for p in range(rng.randrange(1, 12))]
    got = {(r.g, r.p): r.won for r in mixing.highest_quotients(spark.createDataFrame(data, "g long, p long, votes double, seats long"), ["g"], "votes", "seats", ["p"], "won").collect()}
    for g in range(5):
        votes = {p: v for h, p, v, _ in data if h == g}
        seats = next(s for h, _, _, s in data if h == g)
        want = sainte_lague(votes, seats) if sum(votes.values()) else Counter()
        assert {p: got[g, p] for p in votes} == {p: want[p] for p in votes}


def test_targets_and_taken(spark):
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * rng.randrange(0, 300)), rng.choice(["a", "b", "c", "a", "a", "é", "d", None])) for i in range(600)]
    data += [(700, None, "only"), (701, " \n", "a"), (702, "w", "e"), (702, "w", "e"), (None, "w w", "b")]
    df = clashing(documents(spark, data))
    out = mixing.mix(df, shard_rows=50)
    cols = ("doc_id", "size", "source_size", "target", "taken")
    got = rows(out, *cols)
    assert got == rows(mixing.mix(df.repartition(7), shard_rows=50), *cols) and len(got) == len(data)
    sizes, of = defaultdict(int), {}
    for i, t, s in data:
        sizes[s] += len((t or "").split())
        of[i] = s
    target = water(sizes)
    taken = Counter()
    for i, size, source_size, t, n in got:
        s = of[i]
        assert source_size == sizes[s] and abs(t - target[s]) < 1e-6 * max(1, t) and 0 <= n <= 3 * size
        taken[s] += n
    for s, t in target.items():
        assert abs(taken[s] - t) <= 12, (s, taken[s], t)


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert rows(mixing.mix(documents(spark, [(1, None), (2, "")])), "doc_id", "taken", "target") == [(1, 0, 0.0), (2, 0, 0.0)]


def test_small_sources_and_shards_meet_their_targets(spark):
    rng = random.Random(6)
    names = ["a"] * 2500 + ["b"] * 700 + [f"s{i}" for i in range(12) for _ in range(40)] + ["tiny", "tiny", "one"]
    data = [(i, " ".join(["w"] * rng.randrange(1, 20)), s) for i, s in enumerate(names)] + [(None, f"null {i}", "b") for i in range(300)]
    target, taken = {}, Counter()
    for r in mixing.mix(documents(spark, data), shard_rows=50).withColumnRenamed("source_size", "s").collect():
        target[r.target] = r.target
        taken[r.target] += r.taken
    assert len(target) >= 10
    for t in target:  # sources of one target come together, so the bound is for all of them
        many = round(taken[t] / t)
        assert many >= 1 and abs(taken[t] - many * t) <= many * max(2, 0.01 * t), (t, taken[t])
