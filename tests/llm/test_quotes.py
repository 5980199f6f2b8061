import random
import re

from pyspark.sql import functions as F

from helpers import rows
from scrivener.llm.quotes import reply_order


def test_quotes_link_to_their_originals(spark):
    data = [
        (1, 0, "user", "Hello there\nfriend\n\nSecond passage"),
        (1, 1, "assistant", "> hello   THERE\n> friend\n\nMy answer"),
        (1, 2, "user", ">> Hello there\n>> friend\n> My answer\nThanks"),
        (1, 3, "assistant", "No quotes"),
        (2, 0, "user", "> Second passage\nA new thread"),
        (2, 1, "user", "> nobody wrote this"),
        (3, 5, "user", None),
        (3, 7, "user", ""),
        (4, 0, "user", "> later words"),
        (5, 0, "user", "later words"),
        (None, 1, "user", "> Second passage"),
        (6, 0, "user", "same"), (6, 0, "user", "same"),
    ]
    out = reply_order(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("hash", F.lit(1)).withColumn("lines", F.lit("x")).withColumn("passages", F.lit("x")))
    got = {(r.conv_id, r.turn): r for r in out.collect()}
    assert len(rows(out, "conv_id", "turn")) == len(data)
    link = lambda k: (got[k].parent_conv, got[k].parent_turn, got[k].root_conv, got[k].root_turn, got[k].depth, got[k].n_quoted, got[k].n_linked)
    assert link((1, 0)) == (None, None, 1, 0, 0, 0, 0)
    assert link((1, 1)) == (1, 0, 1, 0, 1, 1, 1)
    assert link((1, 2)) == (1, 1, 1, 0, 2, 2, 2)
    assert link((1, 3)) == (1, 2, 1, 0, 3, 0, 0)
    assert link((2, 0)) == (1, 0, 1, 0, 1, 1, 1)
    assert link((2, 1)) == (2, 0, 1, 0, 2, 1, 0)
    assert link((3, 7)) == (3, 5, 3, 5, 1, 0, 0)  # a gap in the turns parts nothing
    assert link((4, 0)) == (None, None, 4, 0, 0, 1, 0)
    assert link((None, 1)) == (None, None, None, 1, 0, 1, 0)
    assert got[1, 2].own_text == "Thanks" and got[1, 1].own_text == "My answer" and got[1, 0].own_text == "Hello there\nfriend\n\nSecond passage"


def test_long_chains_and_a_common_passage(spark):
    data = [(1, i, "user", f"message {i}") for i in range(100)] + [(c, 0, "user", "hi") for c in range(2, 300)] + [(400, 0, "user", "> hi")]
    got = {(r.conv_id, r.turn): r for r in reply_order(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[1, i].depth == i and got[1, i].root_turn == 0 for i in range(100))
    assert (got[400, 0].parent_conv, got[400, 0].depth) == (2, 1)
    assert reply_order(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def parsed(text):
    """(level, text) of the passages, line by line."""
    out, open_ = [], False
    for line in (text or "").split("\n"):
        marks = re.match(r"([ \t]*>)*", line).group()
        level, body = marks.count(">"), re.sub(r"^[ \t]+|[ \t\r]+$", "", line[len(marks):])
        if not body:
            open_ = False
        elif open_ and out[-1][0] == level:
            out[-1] = (level, out[-1][1] + "\n" + body)
        else:
            out.append((level, body))
            open_ = True
    return out


def brute(messages):
    """Parents, roots, depths and the order of all messages, by plain search over earlier ones."""
    key = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t.lower()).strip(" ")
    found = {m: parsed(t) for m, t in messages.items()}
    parent, linked = {}, {}
    for m in messages:
        links = []
        for i, (level, text) in enumerate(found[m]):
            if level:
                have = sorted(o for o in messages if any(lv == 0 and key(x) == key(text) for lv, x in found[o]))
                mine = [o for o in have if o[0] == m[0]]
                if mine and mine[0] < m:
                    links.append((level, i, mine[0]))
                elif have and have[0] < m:
                    links.append((level, i, have[0]))
        before = max((o for o in messages if o[0] == m[0] and o < m), default=None)
        parent[m], linked[m] = min(links)[2] if links else before, len(links)
    children = {}
    for m in messages:
        children.setdefault(parent[m], []).append(m)
    order = []

    def walk(m, root, depth):
        order.append((m, root, depth))
        after = min((o for o in messages if o[0] == m[0] and o > m), default=None)
        for c in sorted(children.get(m, []), key=lambda c: (c == after, c)):
            walk(c, root, depth + 1)

    for r in sorted(children.get(None, [])):
        walk(r, r, 0)
    return parent, linked, order, found


def test_generated_threads_against_brute_force(spark):
    rng = random.Random(12)
    messages, said = {}, []
    for conv in rng.sample(range(-3, 40), 25):
        for turn in sorted(rng.sample(range(-2, 3000), rng.randrange(1, 9))):
            parts = []
            for _ in range(rng.randrange(0, 3)):
                if said:
                    level, quote = rng.randrange(1, 4), rng.choice(said)
                    parts.append("\n".join(rng.choice([">", " >", "> "]) * level + (" " + x.upper() if rng.random() < 0.3 else x) for x in quote.split("\n")))
            for _ in range(rng.randrange(0, 3)):
                parts.append("\n".join(f"line {rng.randrange(60)}  of {rng.randrange(3)}" for _ in range(rng.randrange(1, 3))))
            messages[conv, turn] = rng.choice(["\n\n", "\n"]).join(parts) if parts else rng.choice([None, "", " \n>"])
            said += [t for level, t in parsed(messages[conv, turn]) if level == 0]
    parent, linked, order, found = brute(messages)
    assert sum(linked.values()) > 20 and max(d for _, _, d in order) > 5
    data = [(c, t, "user", x) for (c, t), x in messages.items()]
    got = {(r.conv_id, r.turn): r for r in reply_order(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect()}
    for m, r in got.items():
        assert (r.parent_conv, r.parent_turn) == (parent[m] or (None, None)) and r.n_linked == linked[m], m
        assert r.own_text == "\n\n".join(t for level, t in found[m] if level == 0) and r.n_quoted == sum(level > 0 for level, _ in found[m])
    assert [(m, (r.root_conv, r.root_turn), r.depth) for m, r in sorted(got.items(), key=lambda x: (x[1].root_conv, x[1].root_turn, x[1].thread_path))] == order
