import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from helpers import clashing, documents
from scrivener.llm import bpe
from scrivener.llm.queries import RANKS

P = public_tokenizers.PATTERN


def expect(texts):
    enc = bpe.encoding(RANKS, P)
    return sorted((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in texts)


@pytest.mark.parametrize("step,overlap", [(50, 8), (64, 30), (16384, 512)])
def test_equals_the_library_and_round_trips(spark, step, overlap):
    rng = random.Random(step)
    atoms = ["the", " a", "  ", "\n", "\n\n", "don't", "é", "日本語", "123", "4567890", "!!", "\t", " 　", "\x1c", "\u0085", "🙂", "I'll", "x" * 70, " " * 90, "?" * 20, "ß", "ñ "]
    texts = [(i, "".join(rng.choice(atoms) for _ in range(rng.randrange(200)))) for i in range(60)]
    texts += [(100, None), (101, ""), (102, " "), (103, "a" * 1000), (104, " " * 1000), (105, "word " * 500), (106, "\n" * 333 + "x"), (0, texts[0][1]), (None, "word " * 100), (None, "other " * 100), (0, "again " * 50)]
    docs = clashing(documents(spark, texts))
    coded = bpe.encode(docs, RANKS, P, step=step, overlap=overlap)
    got = [(r.doc_id, bytes(r.ids)) for r in coded.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    enc = bpe.encoding(RANKS, P)
    want = [(i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()) for i, t in texts]
    assert sorted(got, key=key) == sorted(want, key=key)
    back = sorted((hashlib.sha256(bytes(r.decoded)).hexdigest() for r in bpe.decode(coded, RANKS, P).collect()))
    assert back == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in texts)


def test_no_rows(spark):
    assert bpe.encode(documents(spark, []), RANKS, P).count() == 0


@pytest.mark.parametrize("unit", [" ", "\n", "a", "!", "́", "é"])
def test_very_long_runs(spark, unit):
    """One pre-token of two million characters: no matcher's stack and no quadratic merging."""
    run = unit * 2_000_000
    data = [(1, "word " + run + "x"), (2, run), (3, "short" + unit * 20_000 + " text")]
    coded = bpe.decode(bpe.encode(documents(spark, data), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in coded} == dict(data)
    want = bpe.encoding(RANKS, public_tokenizers.PATTERN).encode_ordinary(data[2][1])
    assert np.frombuffer(next(r.ids for r in coded if r.doc_id == 3), "<u4").tolist() == want


@pytest.mark.parametrize("blank", ["\n\n", "\t\t", " \n", "\n \n\n", "  ", "　　"])
def test_joints_after_blanks(spark, blank):
    """A blank run's last character is a pre-token of its own if a word follows, also where the word begins a chunk."""
    data = [(k, "a" * k + blank + "xyz and more words to the end of it " * 6) for k in range(40, 60)]
    got = {r.doc_id: bytes(r.ids) for r in bpe.encode(documents(spark, data), RANKS, P, step=50, overlap=20).collect()}
    assert got == dict(expect(data))
