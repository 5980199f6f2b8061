from scrivener.sources import readers


def test_unquoted_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b;c\n1;"x;3\n1;2;3;4\n5;6\n;;\n', encoding="utf-8")
    df = readers.read_unquoted_csv(spark, str(tmp_path / "a.csv"), ";")
    assert sorted(map(tuple, df.collect())) == [("", "", ""), ("1", '"x', "3"), ("5", "6", "")]
    assert sorted(r.b for r in df.select("b").collect()) == ["", '"x', "6"] and df.count() == 3


def test_only_the_first_line_is_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\n﻿a;b\n1;2\na;b\n\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("﻿a;b\na;b\n3;4\n", encoding="utf-8")
    got = readers.read_unquoted_csv(spark, str(tmp_path), ";")
    assert sorted(map(tuple, got.collect())) == [("1", "2"), ("3", "4"), ("a", "b"), ("a", "b")] and len(got.columns) == 2
