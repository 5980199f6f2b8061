from scrivener.operators import cleaning


def test_texts_are_cleaned_once_for_result_and_report(spark):
    long = "The fee of 12 500 EUR is due within 10 days. " * 4
    rows = [(1, long), (2, long.upper().lower()), (3, long + "Other."), (4, "short"), (5, None)]
    unique, report = cleaning.clean_precedents(spark.createDataFrame(rows, "seq long, text string"))
    for df in (unique, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "[AMOUNT]" not in plan and "Generate" not in plan
    assert report.first().asDict() == {"input_count": 5, "output_count": 2, "dropped_empty": 2, "dropped_duplicates": 1, "total_replacements": 36}
    assert sorted(r.seq for r in unique.collect()) == [1, 3]
