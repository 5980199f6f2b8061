import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import rows
from scrivener.llm import trie

COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
KINDS = "conv_id long, turn int, role string, text string"


def ordered(data):
    """Turns of each conversation; equal numbers in order of role and of a hash, as stated."""
    by = defaultdict(list)
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(x[2], x[4]) for x in sorted(v, key=lambda x: x[:4])] for c, v in by.items()}


def branched(by):
    out = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = by.get(c - c % 20, [])[:h] + by[c][h:]
    return out


def brute(convs):
    """Every prefix of every conversation, and for each node a look at all the others."""
    members = defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, ids in members.items():
        words = len(path[-1][1].split()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(ids) - 1) * words
    out = []
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(path))
        parent = members[path[:-1]][0] if path else None
        out.append((ids[0], len(path), parent, len(ids), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    pool = ["hello", "how are you", "fine thanks and you", "", "  ", "bye now"]
    data = []
    for c in [*range(0, 90), *range(130, 150), 4095, 4096, 4100, 9000, 2**40 + 3]:
        for t in range(rng.randrange(7)):
            data.append((c, t, rng.choice(["user", "assistant"]), rng.choice(pool)))
    data += [(3, None, "user", "first of all"), (3, None, None, None), (5, 1, "user", "tie"), (5, 1, "user", "tie"), (5, 1, "bot", "tie"), (None, 1, "user", "nobody"), (77, 2, None, "x"), (40, 9, "use", "rab"), (41, 9, "user", "ab")]
    data += [(201, t, "user", f"deep {t}") for t in range(70)] + [(203, t, "user", f"deep {t}") for t in range(66)] + [(5000, t, "user", f"deep {t}") for t in range(70)]
    return data


@pytest.mark.parametrize("span", [20, 64, trie.SPAN])
def test_whole_conversations(spark, span):
    data = corpus()
    df = spark.createDataFrame(data, KINDS).select("*", *[F.lit(1).alias(x) for x in ("pos", "token", "words", "node", "shard", "parent", "depth")])
    assert rows(trie.prefix_trie(trie.turns_of(df), span=span), *COLS) == brute(ordered(data))


def test_branched_conversations(spark):
    data = corpus(2)
    made = branched(ordered(data))
    assert [] in made.values()  # some are left without turns
    got = trie.prefix_trie(*trie.shared_starts(trie.turns_of(spark.createDataFrame(data, KINDS))))
    assert rows(got, *COLS) == brute(made)


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    data = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert rows(trie.prefix_trie(*trie.shared_starts(trie.turns_of(df))), *COLS) == brute(branched(ordered(data)))


def test_empty_and_last_turns(spark):
    assert trie.prefix_trie(*trie.shared_starts(trie.turns_of(spark.createDataFrame([], KINDS)))).count() == 0
    turns = trie.turns_of(spark.createDataFrame([(1, 0, "user", "a b"), (2, 0, "user", "a b"), (2, 1, "bot", "c")], KINDS))
    got = {(r.depth, r.conv_id): r.words for r in trie.with_turns(trie.prefix_trie(turns), turns).collect()}
    assert got == {(0, 1): None, (1, 1): 2, (2, 2): 1}
