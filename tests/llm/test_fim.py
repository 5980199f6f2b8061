import hashlib
import random
import re

from helpers import clashing, documents, rows
from scrivener.llm import fim

COLS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")


def plain(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", seed=7, rate=100, spm=50):
    """By slicing and joining, without rotations."""
    text = text or ""
    units = re.findall(pattern, text, re.S)
    n, h = len(units), hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), out


def corpus():
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "🙂", "\n", "\n", "\r", "<", ">", "<P", "S>", " ", " "]
    data = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(300)]
    odd = [None, "", "\n", "\n\n\n", "no end", "a<P>b\nc", "<S>", "x<M>", "<", "<P", "one\n"]
    return data + [(1000 + i, t) for i, t in enumerate(odd)] + [(None, "a\nb\nc\n"), (None, None), (7, "other\ntext\n"), (0, data[0][1]), (2000, "long line é\n" * 200_000)]


def test_against_slices_and_round_trip(spark):
    data = corpus()
    made = fim.fill_in_middle(clashing(documents(spark, data)))
    assert rows(made, *COLS) == sorted((plain(*x) for x in data), key=repr)
    assert {r[2] for r in rows(made, *COLS)} == {"plain", "psm", "spm"}
    assert rows(fim.restore(made), "doc_id", "restored") == sorted(((i, t or "") for i, t in data), key=repr)
    assert fim.restore(fim.fill_in_middle(documents(spark, []))).count() == 0


def test_units_rates_and_sentinels(spark):
    data = corpus()
    made = fim.fill_in_middle(documents(spark, data), seed=11, rate=40, spm=20, unit="character")
    assert rows(made, *COLS) == sorted((plain(i, t, ".", 11, 40, 20) for i, t in data), key=repr)
    assert rows(fim.restore(made), "doc_id", "restored") == sorted(((i, t or "") for i, t in data), key=repr)
    for bad in (("<a", "a>", "b"), ("x", "xy", "z"), ("", "b", "c"), ("aba", "c", "d")):
        try:
            fim.fill_in_middle(documents(spark, data), sentinels=bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_rotations_in_place(monkeypatch):
    monkeypatch.setattr(fim, "_SWAP", 3)
    rng = random.Random(1)
    for _ in range(300):
        data = bytearray(rng.randbytes(rng.randrange(40)))
        a, m, b = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        want = data[:a] + data[m:b] + data[a:m] + data[b:]
        fim.rotate(data, a, m, b)
        assert data == want
