import random

from helpers import clashing, documents, rows
from scrivener.llm.substring import remove_repeats

BIG = 1 << 63


def brute(data, window):
    seqs = [((BIG if i is None else i), (t or "").encode().split()) for i, t in data]
    first = {}
    for i, w in seqs:
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            first[key] = min(first.get(key, BIG + 1), i)
    out = []
    for (i, w), (doc_id, _) in zip(seqs, data):
        gone = set()
        for at in range(len(w) - window + 1):
            if first[tuple(w[at : at + window])] < i:
                gone |= set(range(at, at + window))
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def corpus(seed, window, n=80):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    pieces = [[word() for _ in range(rng.randrange(window // 2, 3 * window))] for _ in range(6)]
    data = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(pieces)
                a = rng.randrange(len(p))
                words += p[a : a + rng.randrange(1, len(p))]
            else:
                words += [word() for _ in range(rng.randrange(1, 2 * window))]
        data.append((rng.randrange(1000), rng.choice([" ", "\n", " \t"]).join(words)))
    data += [(5000, None), (5001, ""), (5002, data[0][1]), (data[1][0], data[1][1]), (None, data[2][1]), (None, data[2][1]), (5003, "one " * 3 * window), (5004, "one " * window), (5005, "one " * (window - 1)), (5006, "  ".join(data[0][1].split()))]
    return data


COLS = ("doc_id", "n_words", "n_removed", "kept")


def test_against_brute_force(spark):
    for seed, window in ((1, 50), (2, 20), (3, 7)):
        data = corpus(seed, window)
        assert rows(remove_repeats(clashing(documents(spark, data)), window=window), *COLS) == brute(data, window)


def test_blocks_and_no_rows(spark, monkeypatch):
    from scrivener.llm import common, substring

    monkeypatch.setattr(substring, "blocks", lambda d: common.blocks(d, 40))
    data = corpus(4, 10, 20)
    assert rows(remove_repeats(documents(spark, data), window=10), *COLS) == brute(data, 10)
    assert remove_repeats(documents(spark, [])).count() == 0
