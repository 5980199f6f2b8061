from pyspark.sql import functions as F

from scrivener.plans import queries


def test_words_after_the_sixth_count(spark, tmp_path):
    titles = ["one two three four five six seven", "one two three four five six eight nine ten eleven twelve thirteen fourteen fifteen", "aa bb cc dd ee ff payment terms"]
    spark.createDataFrame([(i, f"{t}\nbody") for i, t in enumerate(titles)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.title_md5: r for r in queries.fuzzy_title_match(spark, str(tmp_path)).collect()}
    first, second, _ = [got[r.m] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(F.md5("t").alias("m")).collect()]
    assert len(got) == 3 and first.section_id == "s_1" and 0.78 <= first.confidence < 1 and second.section_id is None
    routed = {r.doc_id: r for r in queries.route_or_match(spark, str(tmp_path)).collect()}
    assert routed[2].section_id != "" and routed[2].confidence.replace(",", ".").startswith("0.9")
