import hashlib
import random

import corpus_pipeline
from pyspark.sql import functions as F

from helpers import clashing, documents, rows
from scrivener.llm import line_chunks as lc

COLS = ("doc_id", "n_lines", "n_removed", "kept")


def brute(data):
    """Every run of two or more lines that begins at an earlier place is looked for, whatever its length."""
    keyed = sorted(((i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t) for i, t in data), key=lambda x: x[:3])
    places, out = {}, []
    for none, i, part, t in keyed:
        lines = (t or "").split("\n")
        for at in range(len(lines)):
            for end in range(at + 2, min(len(lines), at + 6) + 1):
                places.setdefault(tuple(lines[at:end]), (none, i, part, at))
    for none, i, part, t in keyed:
        lines, gone = (t or "").split("\n"), set()
        for at in range(len(lines)):
            for end in range(at + 2, min(len(lines), at + 6) + 1):
                if places[tuple(lines[at:end])] < (none, i, part, at):
                    gone |= set(range(at, end))
        stay = [x for n, x in enumerate(lines) if n not in gone]
        out.append((None if none else i, 0 if t is None else len(lines), 0 if t is None else len(gone), None if t is None else "\n".join(stay)))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(12)
    passage = [[f"p{k} line {i}" for i in range(12)] for k in range(4)]
    data = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            at = rng.randrange(10)
            lines += rng.choice(passage)[at : at + rng.randrange(1, 6)] if rng.random() < 0.5 else [f"own {rng.random()}" for _ in range(rng.randrange(6))]
        data.append((i, "\n".join(lines)))
    return data + [(100, None), (101, ""), (102, "\n\n\n\n"), (5, data[5][1]), (None, data[7][1]), (104, data[9][1]), (105, "x\nx")]


def test_against_brute_force_and_collisions(spark):
    data = corpus()
    assert rows(lc.remove_repeated_runs(clashing(documents(spark, data))), *COLS) == brute(data)
    assert rows(lc.remove_repeated_runs(documents(spark, data), digest=lambda t: F.substring(F.md5(t), 1, 2)), *COLS) == brute(data)
    assert lc.remove_repeated_runs(documents(spark, [])).count() == 0


def test_short_passages_and_runs_of_one_line_go_in_the_stage(spark):
    """Runs of two, four and six lines among foreign ones, and 180 copies of a line."""
    rng = random.Random(2)
    data, wanted = [], {}
    for n in (2, 4, 6):
        for k in range(10):
            run = [f"shared {n} {k} {i}" for i in range(n)]
            for _ in range(2):
                before, after = [[f"own {rng.random()}" for _ in range(3)] for _ in range(2)]
                wanted[len(data)] = before + (run if len(data) % 2 == 0 else []) + after
                data.append((len(data), "\n".join(before + run + after)))
    data.append((len(data), "\n".join(["head"] + ["same"] * 180 + ["foot"])))
    wanted[len(data) - 1] = ["head", "same", "foot"]
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.line_stage(spark, documents(spark, data), "").collect()}
    assert got == wanted


def test_chunks_resist_shifts(spark):
    """Lines put in before and between make no difference to what is found of the rest."""
    lines = [f"line {i}" for i in range(200)]
    moved = ["put in front", *lines[:90], "put between", *lines[90:]]
    got = {r.doc_id: r.kept for r in lc.remove_repeated_runs(documents(spark, [(1, "\n".join(lines)), (2, "\n".join(moved))])).collect()}
    assert got == {1: "\n".join(lines), 2: "put in front\nput between"}


def test_recall_on_the_given_documents(spark):
    """Every run of up to six lines that an earlier place has, looked for one by one, is gone, and nothing else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert rows(lc.remove_repeated_runs(docs), *COLS) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
