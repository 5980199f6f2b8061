import random
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from scrivener.operators import joins


def test_ratios_of_many_pairs_at_once():
    rng = random.Random(7)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    forms, texts = ["", "a", "", word("ab", 210), word("abc", 199), word("ab", 190)], ["", "", "b", word("ab", 205), word("abc", 199), word("ab", 250)]
    for _ in range(1_500):
        letters, x = rng.choice(["ab", "abc ", "abcdefghijklmno  ", "éüß abcя😀"]), word("abc d", rng.randrange(60))
        forms.append(x if rng.random() < 0.5 else word(letters, rng.randrange(60)))
        texts.append(word(letters, rng.randrange(60)) if rng.random() < 0.5 else x[: rng.randrange(30)] + word(letters, 4) + x[rng.randrange(30) :])
    want = [SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(forms, texts)]
    assert joins._ratios(forms, texts).tolist() == want


def test_few_pairs_are_compared(monkeypatch):
    """Bounds by common subsequence leave out most known titles even where none is alike."""
    rng, compared, ratios = random.Random(8), [], joins._ratios
    word = lambda: " ".join("".join(rng.choice("abcdeilnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(5))
    known = pd.DataFrame({"known": [word() for _ in range(300)]}).assign(known_id=lambda d: d.known, ord=range(300))
    asked = pd.DataFrame({"key": [word() for _ in range(40)], "near": False})
    monkeypatch.setattr(joins, "_ratios", lambda a, b: compared.append(len(a)) or ratios(a, b))
    got = joins._most_similar(1.6)((), asked, known)
    for r in got.itertuples():
        fit = [(SequenceMatcher(None, r.key, k).ratio(), -i) for i, k in enumerate(known.known) if int(len(r.key) * 0.6) <= len(k) <= int(len(r.key) * 1.6)]
        assert (r.score, -r.ord) == max(fit)
    assert len(got) == 40 and sum(compared) < 0.25 * 40 * 300


def test_equal_titles_are_answered_alike(spark):
    to_id = spark.createDataFrame([("price of goods", "s1", 0)], "key string, section_id string, ord long")
    rows = spark.createDataFrame([(1, "Price of goods"), (2, "Price of goods"), (3, None), (4, ""), (5, "Prices of good")], "n int, section_title string")
    got = {r.n: (r.section_id, round(r.confidence, 3)) for r in joins.route_or_match(rows, to_id).select("n", "section_id", F.col("confidence")).collect()}
    assert got[1] == got[2] and got[3] == got[4] == ("", 0.0) and len(got) == 5
