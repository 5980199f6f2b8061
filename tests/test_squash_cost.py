import random
import re
import time

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions import text as t
from scrivener.operators import retrieval


def test_only_distances_that_may_hold_a_copy_are_tried():
    rng = random.Random(3)
    plain = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    copy = plain[100:160]
    of = lambda x: t._distances(np.frombuffer(x.encode("utf-32-le"), np.uint32), 35, 221).tolist()
    assert of(plain) == [] and of(plain[:1_000] + copy + " " + copy + plain[1_000:]) == [61]
    assert of("ab" * 300) == list(range(36, 222, 2))


def test_texts_without_copies_cost_little():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(4_000)) for _ in range(400)]
    began = time.process_time()
    assert not any(len(t._repeat_starts(x, 35, 220)) for x in texts)
    assert time.process_time() - began < 1.5


def test_every_copy_is_found():
    rng, again = random.Random(5), re.compile(r"(.{35,220})(?:\s*\1)+", re.DOTALL)
    for _ in range(300):
        parts = [x * rng.choice([1, 1, 2, 3]) + " " * rng.choice([0, 1, 3, 70]) for x in ("".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 260))) for _ in range(4))]
        x = "".join(parts)
        assert {m.start() for m in again.finditer(x)} <= set(t._repeat_starts(x, 35, 220).tolist())


def test_texts_outside_the_domain_are_left_out_before_copies_are_looked_for(spark, monkeypatch):
    @F.udf(T.StringType())
    def checked(x):
        if "stray" in x:
            raise ValueError("this text can't be wanted")
        return x

    monkeypatch.setattr(t, "squash_repeats", lambda *_: checked)
    due = "Payment of the invoice is due by bank transfer with VAT, and nothing else is asked of the payer at all. "
    rows = [(1, "1", "", "", "en", "A", due), (2, "2", "", "", "en", "B", "stray " * 40), (3, "3", "", "delivery_terms", "en", "C", "labelled as such " * 8)]
    df = spark.createDataFrame(rows, "seq long, doc_id string, section_group string, section_id string, language string, title string, text string")
    form = {"language_mode": "en"}
    assert [r.doc_id for r in retrieval.retrieve_payment_terms(form, df, 3).collect()] == ["1"]
    docs = retrieval._in_domain_of(form, df, (("delivery",), ()), True, F.col("section_id") == "delivery_terms")
    assert [(r.doc_id, r.domain) for r in docs.collect()] == [("3", False)]
