import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrivener.functions import prompts
from scrivener.operators import generate
from scrivener.plans import pipelines


def echo():
    """A model that says its prompt back, with the temperature; within a function, so that workers need no test module."""

    def model(system, user, temperature, top_p):
        return pd.Series([None if "silent" in u else f"{u}|{t}" for u, t in zip(user, temperature)])

    return model


def check(c):
    return F.when(c.contains("bad"), "forbidden").when(c.contains("short") & ~c.contains("MORE"), "too_short").when(c.contains("never"), "too_short").when(c == "", "too_short")


def test_only_refused_rows_go_on(spark):
    rows = [(1, "s", "fine"), (2, "s", "bad"), (3, "s", "short"), (4, "s", "never"), (5, None, None), (6, "s", "silent"), (6, "s", "silent")]
    df = spark.createDataFrame(rows, "id int, system string, user string")
    got = sorted((r.id, r.text, r.code, r.attempts) for r in generate.in_rounds(df, echo(), check, "  MORE \n").collect())
    assert got == [(1, "fine|0.3", None, 1), (2, "bad|0.3", "forbidden", 1), (3, "short\n\nMORE\n|0.35", None, 2), (4, "never\n\nMORE\n|0.35", "too_short", 3), (5, "|0.3", None, 1), (6, "", "too_short", 3), (6, "", "too_short", 3)]
    assert generate.in_rounds(df, echo()).where("code is not null or attempts > 1").count() == 0
    assert generate.in_rounds(df.where("false"), echo(), check).count() == 0
    assert {r.attempts for r in generate.in_rounds(df, echo(), check, retries=0).collect()} == {1}
    with pytest.raises(ValueError):
        generate.in_rounds(df.withColumn("code", F.lit(1)), echo())


def test_texts_in_the_forms_language(spark):
    forms = spark.createDataFrame([(1, '{"language_mode": " EN "}'), (2, "{}"), (3, "no json")], "id int, form string").withColumn("snippets", F.array().cast("array<string>"))
    for name, section in (("payment_terms", prompts.PAYMENT), ("delivery_terms", prompts.DELIVERY)):
        got = {r.id: r for r in pipelines.generate_sections(forms, name, echo(), lambda c: F.lit("too_short")).collect()}
        assert "draft contracts" in got[1].system and "договоры" in got[2].system and got[2].system == got[3].system
        assert f"{section.number}.1., {section.number}.2." in got[1].text and "refused by a check" in got[1].text and "не прошел проверку" in got[2].text
        assert {r.attempts for r in got.values()} == {3}
