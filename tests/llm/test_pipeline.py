import random
from collections import Counter
from itertools import combinations

import corpus_pipeline

from helpers import clashing, documents


def corpus(spark, folder):
    rng = random.Random(9)
    clean, junk = [f"c{i}" for i in range(300)], [f"J{i}!!" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        good = i % 5 != 0
        text = "\n".join(" ".join(rng.choice(clean if good else junk) for _ in range(rng.randrange(8, 20))) for _ in range(6))
        rows.append((i, text, f"src{i % 4}"))
        labels.append((i, int(good), 0))
    for i in range(20):  # near copies of long documents, and copies
        rows.append((1000 + i, rows[i + 1][1], "src0"))
    rows += [(2000, None, "src1"), (2001, "", None), (2002, " \n ", "src1"), (None, rows[7][1] + " more", "src2")]
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, str(tmp_path))
    docs = clashing(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        out = stage(spark, docs, str(tmp_path))
        if name != "byte_bpe":
            assert out.columns == docs.columns
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == list(kept)
    junk = {i for i, t, _ in rows if t and t.startswith("J")}
    first = Counter(r.doc_id for r in kept["quality_classifier"])
    assert not set(first) & junk and all(first[i] for i, t, _ in rows if t and i not in junk and i is not None)
    for r in kept["line_dedup"]:
        assert r.text is None or r.n_chars == len(r.text)
    ids = Counter(r.doc_id for r in kept["simhash_near_dedup"])
    assert all(n == 1 for n in ids.values()) and all(ids[i] for i in range(240) if i not in junk)
    assert set(r.doc_id for r in kept["mixing"]) <= set(ids)
    assert Counter(r.doc_id for r in kept["byte_bpe"]) == Counter(r.doc_id for r in kept["mixing"])


def test_run_and_empty(spark, tmp_path):
    corpus(spark, str(tmp_path))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    docs = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_one_document_of_each_group_stays_by_row(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, c), (None, c), (None, None), (9, ""), (None, "z z z z z z"), (None, "z z z z z z")]
    out = corpus_pipeline.near_duplicate_stage(spark, clashing(documents(spark, rows)), str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), r.text) for r in out) == sorted([("1", a), ("2", b), ("4", c), ("9", ""), ("None", "z z z z z z")])
    assert corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows[:4]), str(tmp_path)).count() == 2


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return a == b or (a | b and 5 * len(a & b) >= 4 * len(a | b))


def planted(rng):
    vocabulary = [f"w{i}" for i in range(500)]
    data = []
    for i in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(100, 300))]
        data.append((len(data), " ".join(words)))
        for changes in (1, 2, 8, 30):
            other = list(words)
            for at in rng.sample(range(len(other)), changes):
                other[at] = f"new{rng.random()}"
            data.append((len(data), "  ".join(other)))
    return data


def groups_of(data):
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(data)), 2):
        if alike(data[a][1], data[b][1]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return [find(x) for x in range(len(data))]


def test_stage_drops_planted_near_copies(spark):
    data = planted(random.Random(4)) + [(900, None), (901, ""), (902, " \n"), (903, "Word"), (904, "word")]
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, clashing(documents(spark, data)), "").collect()}
    want = {data[i][0] for i, r in enumerate(groups_of(data)) if i == r}
    assert got == want and len(data) - len(want) > 40
