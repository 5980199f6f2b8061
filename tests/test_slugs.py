import random
import re

import pytest

from scrivener.operators import stats
from scrivener.plans import queries


def test_slugs_in_order(spark):
    rng = random.Random(3)
    titles = sorted({rng.choice(["a", "a_2", "A 2", "a_2_2", "b", "b 3", "c"]) + "!" * rng.randrange(6) for _ in range(60)})
    data = [(t, rng.randrange(5)) for t in titles]
    used, want = set(), []
    for title, count in sorted(data, key=lambda x: (-x[1], x[0])):
        slug = title.lower().strip("!").replace(" ", "_")
        name, n = slug, 1
        while name in used:
            n += 1
            name = f"{slug}_{n}"
        used.add(name)
        want.append((title, count, name))
    assert [tuple(r) for r in stats.unique_slugs(spark.createDataFrame(data, "title string, count long")).collect()] == want


def in_order(data):
    used, want = set(), []
    for title, count in sorted(data, key=lambda x: (-x[1], x[0])):
        slug = re.sub("[^a-z0-9]+", "_", title.lower()).strip("_")
        name, n = slug, 1
        while name in used:
            n += 1
            name = f"{slug}_{n}"
        used.add(name)
        want.append((title, count, name))
    return want


def test_numbered_titles_are_settled_without_a_common_task(spark, monkeypatch):
    """3,000 numbered titles, some of whose names others claim, and none of them settled in order."""
    data = [(f"Section {i}", 1) for i in range(1, 3000)] + [("SECTION", 9), ("Section", 5), ("section!", 3), ("Section 2!", 7), ("Section 17", 2), ("section 17", 0)]
    data = list({x.lower() + str(i): (x, c) for i, (x, c) in enumerate(data)}.values())
    data = [x for x in data if x != ("Section 17", 1)]
    real = stats._settled_together

    def watched(met):
        named, left = real(met)
        assert left.isEmpty()
        return named, left

    monkeypatch.setattr(stats, "_settled_together", watched)
    assert [tuple(r) for r in stats.unique_slugs(spark.createDataFrame(data, "title string, count long")).collect()] == in_order(data)


@pytest.mark.parametrize("seed,rounds", [(1, 12), (2, 12), (3, 1), (4, 2)])
def test_tangled_names(spark, monkeypatch, seed, rounds):
    monkeypatch.setattr(stats, "ROUNDS", rounds)
    rng = random.Random(seed)
    titles = sorted({rng.choice(["a", "a 2", "a 3", "a 2 2", "a 2 3", "b", "b 2", "c 7"]) + "!" * rng.randrange(5) for _ in range(40)})
    data = [(x, rng.randrange(6)) for x in titles]
    assert [tuple(r) for r in stats.unique_slugs(spark.createDataFrame(data, "title string, count long")).collect()] == in_order(data)


def test_many_titles_and_whole_titles(spark, tmp_path):
    many = spark.range(100_001).selectExpr("concat('title ', id, 'x') as title", "1L as count")
    assert stats.unique_slugs(many).select("section_id").distinct().count() == 100_001
    texts = [(0, "Payments due\nx"), (1, "Payable at once\nx"), (2, "Payments due\ny")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in queries.unique_section_ids(spark, str(tmp_path)).collect()] == [("Payments due", 2, "payments_due"), ("Payable at once", 1, "payable_at_once")]
