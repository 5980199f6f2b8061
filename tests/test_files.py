import json
import os
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from scrivener.operators import segment
from scrivener.plans import pipelines
from scrivener.sources import files, readers, writers


def test_files_by_name_once(spark, tmp_path):
    rows = [("a", "1"), ("a", "2"), ("a_2", "3"), ("A", "4"), ("x/y:z", "5"), ("", "6"), ("..", "7"), (None, "8")]
    df = spark.createDataFrame(rows, "stem string, content string")
    named = files.unique_names(df.na.fill("", ["stem"]), "stem", ".txt", ["content"])
    names = {r.content: r.name for r in named.collect()}
    assert len({n.lower() for n in names.values()}) == len(rows) and names["1"] == "a.txt" and names["2"] == "a_2.txt" and names["3"] == "a__2.txt" and names["5"] == "x_y_z.txt"
    target = f"{tmp_path}/out"
    files.write_files(named, target)
    assert {open(f"{target}/{n}").read() for n in os.listdir(target)} == {c for _, c in rows} and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        files.write_files(named, target)
    files.write_files(named.where("false"), f"{tmp_path}/none")
    assert os.listdir(f"{tmp_path}/none") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    bad = spark.range(40).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 39, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception):
        files.write_files(bad, f"{tmp_path}/out")
    assert os.listdir(tmp_path) == []


def test_a_task_that_outlives_its_job_leaves_nothing(tmp_path):
    writer = files._FileWriter(f"{tmp_path}/out")
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([Row(name="late", content=b"x")]))
    assert os.listdir(tmp_path) == []


def test_docx_there_and_back(spark, tmp_path):
    rows = [("one", 0, "1. Title\nbody of it that is not short", "Normal"), ("one", 1, "a <b> & \x07 c", None), ("one", 2, "", "Heading 1"), ("two", 0, " kept blanks  ", "Heading 1")]
    files.write_files(files.docx_files(spark.createDataFrame(rows, "doc_id string, pos int, line string, style string")), f"{tmp_path}/in")
    got = sorted((os.path.basename(r.path), r.pos, r.line, r.style) for r in readers.read_docx(spark, f"{tmp_path}/in").collect())
    assert got == [("one.docx", 0, rows[0][2], "Normal"), ("one.docx", 1, "a <b> &  c", ""), ("one.docx", 2, "", "Heading 1"), ("two.docx", 0, " kept blanks  ", "Heading 1")]
    assert zipfile.ZipFile(f"{tmp_path}/in/one.docx").testzip() is None
    report = {os.path.basename(r.doc_id): (r.status, r.splits_done) for r in pipelines.write_healed(spark, f"{tmp_path}/in", f"{tmp_path}/out").collect()}
    healed = readers.read_docx(spark, f"{tmp_path}/out").where("path like '%one.docx'").orderBy("pos").collect()
    assert report["one.docx"] == ("ok", 1) and [(r.line, r.style) for r in healed[:2]] == [("1. Title", "Heading 1"), ("body of it that is not short", "Normal")]
    blocks = readers.read_docx(spark, f"{tmp_path}/in").select(F.col("path").alias("doc_id"), "pos", "line", "style")
    assert segment.heal_blocks(blocks).where("split").count() == 1


def test_json_files_marked_csv_and_joined_text(spark, tmp_path):
    df = spark.createDataFrame([("c1", 'say "x"'), ("c1", "two\nlines"), ("c2", None)], "contract_id string, text string")
    writers.write_json_files(df, f"{tmp_path}/json")
    assert sorted(os.listdir(f"{tmp_path}/json")) == ["c1.json", "c1_2.json", "c2.json"]
    assert json.load(open(f"{tmp_path}/json/c2.json")) == {"contract_id": "c2"}
    writers.write_marked_csv(df.coalesce(1), f"{tmp_path}/csv")
    part = next(x for x in os.listdir(f"{tmp_path}/csv") if x.startswith("part"))
    assert open(f"{tmp_path}/csv/{part}", encoding="utf-8").read() == '﻿"contract_id";"text"\n"c1";"say ""x"""\n"c1";"two\nlines"\n"c2";""\n'
    writers.write_csv(df, f"{tmp_path}/all", quote_all=True)
    assert any('"c1"' in open(f"{tmp_path}/all/{x}").read() for x in os.listdir(f"{tmp_path}/all") if x.endswith(".csv"))
    writers.write_joined_text(spark.createDataFrame([(2, "b"), (1, "a")], "seq int, text string"), f"{tmp_path}/txt", "all.txt")
    assert open(f"{tmp_path}/txt/all.txt").read() == "a\n\n" + "=" * 60 + "\n\nb"


def test_lines_of_files_in_several_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) if i % 7 else "" for i in range(2_000)]
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        got = readers.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4 or got.select("n").count() == 4_000
        rows = got.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("a.txt", "b.txt"):
        assert [r.value for r in sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.n)] == lines
        assert sorted(r.n for r in rows if r.path.endswith(name)) == list(range(1, 2_001))


def test_folders_are_listed_by_a_task_as_spark_lists_them(spark, tmp_path, monkeypatch):
    """A file for each name; hidden files and folders, lock files and other kinds are left out; the driver lists nothing."""
    one = files.docx_bytes([("text", None)])
    for name in ("a.docx", "sub/b c.docx", "sub/deep/%20d.docx", ".h.docx", "_h.docx", "_x=1/e.docx", "_h/f.docx", ".h/g.docx", "~$a.docx", "a.txt", "bad.docx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"no zip" if name == "bad.docx" else one)
    listed = {r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path").collect()}
    monkeypatch.setattr(type(spark.read), "load", None)
    got = readers.read_docx(spark, str(tmp_path)).collect()
    assert {r.path for r in got} == {x for x in listed if "~$" not in x} and len(got) == 5
    assert [r.path.rsplit("/", 1)[-1] for r in got if r.error] == ["bad.docx"]
    assert len(readers.read_docx(spark, f"file://{tmp_path}").collect()) == 5
    report, healed = pipelines.heal_folder(spark, str(tmp_path))[::-1]
    assert sorted(r.status[:5] for r in report.collect()) == ["error", *["no_ca"] * 4] and "error" not in healed.columns


def test_files_are_read_once_for_report_and_blocks(spark, tmp_path):
    files.write_files(files.docx_files(spark.createDataFrame([("one", 0, "1. Title\nbody of it that is not short", None)], "doc_id string, pos int, line string, style string")), f"{tmp_path}/in")
    healed, report = pipelines.heal_folder(spark, f"{tmp_path}/in")
    os.remove(f"{tmp_path}/in/one.docx")
    assert report.first().splits_done == 1 and [r.line for r in healed.orderBy("sub").collect()] == ["1. Title", "body of it that is not short"]
