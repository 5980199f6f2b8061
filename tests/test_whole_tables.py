"""Queries that SQL can't say, against plain Python over all rows of a table."""

import functools
import hashlib
import os
import re
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivener.functions import predicates as p
from scrivener.functions import text as t
from scrivener.operators import joins, retrieval
from scrivener.plans import queries

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


@functools.cache
def squashed(x):
    again, before = re.compile(r"(.{35,220})(?:\s*\1)+", re.DOTALL), None
    while x != before:
        before, x = x, again.sub(r"\1", x)
    return x


def test_squash_repeats_of_all_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = {d: md5(squashed(x or "")) for d, x in zip(docs.doc_id, docs.text)}
    assert {r.doc_id: r.result_md5 for r in queries.QUERIES["squash_repeats"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["payment", "delivery"])
def test_retrieval_with_squashing(spark, name):
    """All documents through the retrieval's SQL, with the plain loop above where it squashes."""
    con = duckdb.connect()
    con.create_function("squashed", squashed, ["VARCHAR"], "VARCHAR")
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    words = (p.PAYMENT_FOR, p.PAYMENT_AGAINST) if name == "payment" else (p.DELIVERY_FOR, p.DELIVERY_AGAINST)
    asked = (retrieval.payment_query if name == "payment" else retrieval.delivery_query)(queries.FORM)
    want = con.execute(queries.retrieval_sql(*words, asked, "squashed")).fetchall()
    got = queries.QUERIES[f"retrieve_{name}_terms"](spark, SF).select("rank", "doc_id", "candidate_md5").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 7


@pytest.fixture(scope="module")
def titles(spark):
    """Normal forms of all candidates of all titles, and the map, from the operators that have SQL or tests of their own."""
    docs = queries.table(spark, SF, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    parted = docs.select("doc_id", "title", joins.title_candidates(F.col("title")).alias("c"), p.keyword_route(F.col("title")).alias("route")).collect()
    bench = queries.table(spark, SF, "benchmark").select("item_id", t.bare_title(F.substring_index(F.substring_index("text", "\n", 1), " ", 6)).alias("title")).orderBy("item_id").collect()
    known = {}
    for r in bench:
        if r.title:
            known[r.title.lower()] = f"s_{r.item_id}"
    return parted, known


def best_match(parts, known):
    best_id, best_score = None, 0.0
    for key in parts:
        found, score = known.get(key), 1.0
        if not found:
            found, score = None, 0.0
            for other, section in known.items():
                s = SequenceMatcher(None, key, other).ratio() if int(len(key) * 0.6) <= len(other) <= int(len(key) * 1.6) else 0.0
                if s > score:
                    found, score = section, s
            found = found if score >= 0.78 else None
        if score > best_score:
            best_id, best_score = found, score
    return best_id, best_score


def test_fuzzy_titles_of_all_documents(spark, titles):
    parted, known = titles
    matched = {r.title: best_match([c.key for c in r.c], known) for r in parted}
    want = {md5(x): (i, round(s, 6)) for x, (i, s) in matched.items()}
    assert {r.title_md5: (r.section_id, r.confidence) for r in queries.fuzzy_title_match(spark, SF).collect()} == want and len(want) > 500
    routed = {r.doc_id: (r.route, 0.9) if r.route else (matched[r.title][0] or "", matched[r.title][1]) for r in parted}
    got = {r.doc_id: (r.section_id, r.confidence) for r in queries.route_or_match(spark, SF).collect()}
    assert got == {d: (i, f"{s:.3f}") for d, (i, s) in routed.items()}


@pytest.mark.parametrize("by_first_letter", [False, True])
def test_blocks_and_ties(spark, monkeypatch, by_first_letter):
    import random

    monkeypatch.setattr(joins, "KNOWN_BLOCK", 7)
    monkeypatch.setattr(joins, "ASKED_BLOCK", 5)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(3, 9)))
    known, asked = list(dict.fromkeys(word() for _ in range(60))), [word() for _ in range(40)]
    to_id = spark.createDataFrame([(k, f"s{i}", i) for i, k in enumerate(known)], "key string, section_id string, ord long")
    got = {r.title: (r.section_id, r.confidence) for r in joins.match_titles(spark.createDataFrame([(x,) for x in asked], "title string"), to_id, 0.5, 1.6, by_first_letter, 12).collect()}
    for x in asked:
        fit = [k for k in known if int(len(x) * 0.6) <= len(k) <= int(len(x) * 1.6)]
        near = [k for k in fit if k[0] == x[0]]
        fit = near if by_first_letter and len(near) >= 12 else fit
        scored = [(SequenceMatcher(None, x, k).ratio(), -known.index(k)) for k in fit]
        score, at = max(scored, default=(0.0, 0))
        want = (f"s{known.index(x)}", 1.0) if x in known else (f"s{-at}" if score >= 0.5 else None, score)
        assert got[x] == want, x
