import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from helpers import clashing, documents, rows
from scrivener.llm.exact_dedup import exact_duplicates

TEXTS = [(5, "a b"), (2, "a  b"), (9, "a\tb"), (1, "a b "), (3, None), (4, ""), (7, "a b"), (8, "x"), (2, "a b"), (None, "x"), (None, "alone"), (11, "long " * 20000), (12, "long  " * 20000)]


def check(got):
    groups = defaultdict(list)
    for i, t in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda x: (x != keep, x is None, x or 0)):
            want.append((i, keep, len(ids), i == keep and not seen, hashlib.sha256(t.encode()).hexdigest()))
            seen = seen or i == keep
    assert got == sorted(want, key=repr)


COLS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact(spark):
    check(rows(exact_duplicates(clashing(documents(spark, TEXTS))), *COLS))
    assert exact_duplicates(documents(spark, [])).count() == 0


def test_collisions_are_told_apart_by_bytes(spark):
    check(rows(exact_duplicates(documents(spark, TEXTS), digest=lambda t: F.substring(F.md5(t), 1, 0 + 1)), *COLS))
    check(rows(exact_duplicates(documents(spark, TEXTS), digest=lambda t: F.lit("00")), *COLS))
