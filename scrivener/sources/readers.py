"""Sources: DOCX, JSON, JSON lines, CSV."""

from __future__ import annotations

import io
import itertools
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrivener.functions import text as t
from scrivener.operators.tables import written
from scrivener.sources.files import place

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLOCKS = "path string, pos int, kind string, line string, style string, bold_ratio double, error string"


# ---- DOCX

def _paragraph(node, styles: dict[str, str]) -> tuple[str, str, float]:
    parts, bold = [], []
    for run in node.iter(f"{_W}r"):
        text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else x.text or "" for x in run if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br", f"{_W}cr"))
        parts.append(text)
        if text.strip():
            b = run.find(f"{_W}rPr/{_W}b")
            bold.append(b is not None and b.get(f"{_W}val") not in ("0", "false"))
    style = node.find(f"{_W}pPr/{_W}pStyle")
    key = style.get(f"{_W}val") if style is not None else ""
    return "".join(parts), styles.get(key, key), sum(bold) / len(bold) if bold else 0.0


def _walk(parent, kind: str, styles: dict[str, str]) -> Iterator[tuple[str, str, str, float]]:
    for child in parent:
        if child.tag == f"{_W}p":
            yield (kind, *_paragraph(child, styles))
        elif child.tag == f"{_W}tbl":
            for cell in (c for row in child.findall(f"{_W}tr") for c in row.findall(f"{_W}tc")):
                yield from _walk(cell, "t", styles)


def docx_blocks(content: bytes) -> list[tuple[str, str, str, float]]:
    """(kind, text, style name, share of bold runs) of the paragraphs in document order, tables and nested ones included."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        styles = {}
        if "word/styles.xml" in names:
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                styles[s.get(f"{_W}styleId")] = name.get(f"{_W}val") if name is not None else ""
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        return list(_walk(body, "p", styles))


#: Files that one task reads, at most about.
FILES = 2_000


def _own_folder(path: str) -> bool:
    """Whether tasks can list and open the files of a folder themselves; what else Spark reads goes through its reader."""
    if re.search(r"[*?\[\]{}\\]", path):
        return False
    try:
        there, folder = place(path)
        return there.get_file_info(folder).type == fs.FileType.Directory
    except Exception:  # a store that only Spark knows
        return False


def _names(path: str, suffix: str) -> Iterator[str]:
    """The files of a folder and of those in it, as Spark lists them: names that begin with a dot or underscore are hidden."""
    there, folder = place(path)
    local, waiting = isinstance(there, fs.LocalFileSystem), [folder]
    root = "file:" if local else path.rstrip("/")[: -len(folder.rstrip("/"))]
    hidden = lambda name: name.startswith(".") or name.startswith("_") and "=" not in name
    while waiting:
        at = waiting.pop()
        if local:  # one name after another, however many there are
            with os.scandir(at) as found:
                each = ((x.name, f"{at.rstrip('/')}/{x.name}", x.is_dir()) for x in found)
                for name, full, is_dir in each:
                    if not hidden(name):
                        if is_dir:
                            waiting.append(full)
                        elif name.endswith(suffix):
                            yield root + full
        else:
            for x in there.get_file_info(fs.FileSelector(at)):
                if not hidden(x.base_name):
                    if x.type == fs.FileType.Directory:
                        waiting.append(x.path)
                    elif x.base_name.endswith(suffix):
                        yield root + x.path


def _files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(path) of a folder's files, dealt over tasks; a task lists them, so the driver holds none however many they are."""
    path = path if re.match(r"^\w+:/", path) else os.path.abspath(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            names = _names(path, suffix)
            while part := list(itertools.islice(names, 10_000)):
                yield pd.DataFrame({"path": part})

    listed = written(spark.range(0, 1, 1, 1).mapInPandas(run, "path string"))
    n, tasks = listed.count(), 4 * spark.sparkContext.defaultParallelism
    return listed.repartition(max(-(-n // FILES), min(tasks, -(-n // 16)), 1), "path")


def read_docx(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Blocks of all DOCX files of a folder: path, pos, kind (p, or t in tables), line, style, bold_ratio, error.

    Word's lock files (~$...) are left out.  A file that can't be read gives one row with its error.
    """
    own = recursive and _own_folder(path)
    if own:
        files = _files(spark, path, ".docx").withColumn("content", F.lit(None).cast("binary"))
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", str(recursive).lower()).load(path)

    def content_of(file: str, content: bytes | None) -> bytes:
        if not own:
            return content
        if file.startswith("file:/"):
            with open(file[5:], "rb") as f:
                return f.read()
        there, name = place(file)
        with there.open_input_file(name) as f:
            return f.read()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows = [c.split()[0] for c in BLOCKS.split(", ")], []
        for b in batches:
            for file, content in zip(b.path, b.content):
                content = content_of(file, content)
                try:
                    rows += [(file, i, k, x, s, r, None) for i, (k, x, s, r) in enumerate(docx_blocks(content))]
                except Exception as e:  # any broken file is reported, not raised
                    rows.append((file, 0, None, None, None, None, f"{type(e).__name__}: {e}"))
                if len(rows) >= 2_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content").mapInPandas(run, BLOCKS)


def docx_text(blocks: DataFrame) -> DataFrame:
    """(path, text): body paragraphs first, then those of tables; non-empty lines."""
    fit = blocks.where(t.strip(t.filled(F.col("line"))) != "").withColumn("at", F.struct((F.col("kind") == "t").alias("table"), F.col("pos"), t.strip(F.col("line")).alias("line")))
    return fit.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["line"]), "\n").alias("text"))


# ---- JSON

#: Names under which contracts keep their sections, titles and texts.
SECTION_NAMES = ("sections", "segments", "clauses", "items")
TITLE_NAMES = ("title", "section_title", "heading", "name")
TEXT_NAMES = ("text", "content", "body")


def json_sections(c: Column) -> Column:
    """Array of (title, text) of a JSON contract: the first list under a known name, or a list at the top; null if there is none.

    Of each item the first non-empty title and text; both must be there.
    """
    v = F.try_parse_json(c)
    item = "array<variant>"
    lists = F.coalesce(F.try_variant_get(v, "$", item), *[F.try_variant_get(v, f"$.{n}", item) for n in SECTION_NAMES])
    first = lambda x, names: F.coalesce(*[F.nullif(F.try_variant_get(x, f"$.{n}", "string"), F.lit("")) for n in names])
    pairs = F.filter(F.transform(lists, lambda x: F.struct(first(x, TITLE_NAMES).alias("title"), first(x, TEXT_NAMES).alias("text"))), lambda x: x["title"].isNotNull() & x["text"].isNotNull())
    return F.when(F.size(pairs) > 0, pairs)


def json_status(c: Column) -> Column:
    """parse_error, unsupported_json_structure or ok."""
    return F.when(F.try_parse_json(c).isNull(), "parse_error").when(json_sections(c).isNull(), "unsupported_json_structure").otherwise("ok")


def read_json_contracts(spark: SparkSession, path: str) -> DataFrame:
    """(path, status, sections) of each JSON file of a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), "value")
    return files.select("path", json_status(F.col("value")).alias("status"), json_sections(F.col("value")).alias("sections"))


CORPUS = "doc_id string, contract_id string, section_group string, section_id string, language string, title string, text string"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Corpus rows of JSON lines, strictly: a broken line fails the job.  doc_id falls back to contract_id; seq is the order."""
    rows = spark.read.schema(CORPUS).json(path, mode="FAILFAST")
    named = rows.withColumn("doc_id", F.coalesce(F.nullif("doc_id", F.lit("")), "contract_id", F.lit("")))
    return named.withColumn("seq", F.monotonically_increasing_id())


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, value): the physical lines of text files, numbered from 1 in each, blank ones included.

    A file may be read in several splits.  A line's number is its place in its split, after all lines of the file's
    splits before; lines are counted by split, so no text is shuffled.
    """
    place = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path).select("value", *place, F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("path", "start").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.withColumn("before", before), ["path", "start"]).select("path", (F.col("before") + F.col("id") - F.col("first") + 1).alias("n"), "value")


def read_segmented(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of JSON lines, tolerantly: (contract_id, sections); lines that are broken or hold no list are skipped.

    A contract without id gets doc_<line>, the physical line from 1.
    """
    section = "struct<section_id:string,section_group:string,title:string,language:string,text:string>"
    v = numbered_lines(spark, path).where(t.strip(F.col("value")) != "").withColumn("v", F.try_parse_json("value"))
    got = v.select("n", F.try_variant_get("v", "$.contract_id", "string").alias("id"), F.try_variant_get("v", "$.sections", f"array<{section}>").alias("sections"))
    return got.where("sections is not null").select(F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("doc_"), F.col("n"))).alias("contract_id"), "sections")


def read_section_folder(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, text) of segmented documents, one JSON file each; unreadable files are skipped."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    v = files.select(F.try_parse_json("value").alias("v")).where("v is not null")
    items = F.try_variant_get("v", "$.sections", "array<struct<section:string,text:string>>")
    return v.select(F.try_variant_get("v", "$.file", "string").alias("file"), F.explode(items).alias("s")).select("file", "s.section", "s.text")


# ---- CSV

def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; found {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, sep: str = ",", required: list[str] | None = None, defaults: dict[str, str] | None = None) -> DataFrame:
    """All columns as text, quoted fields over several lines included; no nulls; a byte-order mark is taken off.

    ``defaults`` adds columns that the file lacks.
    """
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"')
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    for name, value in (defaults or {}).items():
        df = df if name in df.columns else df.withColumn(name, F.lit(value))
    return require_columns(df, required or []).na.fill("")


def read_unquoted_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; quotes are characters like others; lines with too many fields go, missing fields are empty.

    Blank lines go.  The first other line of each file is its header; a line like it further down is data.
    """
    names = spark.read.csv(path, header=True, sep=sep, quote="").columns
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    head = lines.groupBy("path").agg(F.min("n").alias("head"))
    fields = lines.join(head, "path").where("n > head").select(F.split("value", f"\\Q{sep}\\E", -1).alias("f"))
    return fields.where(F.size("f") <= len(names)).select(*[F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(c.lstrip("\ufeff")) for i, c in enumerate(names)])


def read_title_map(spark: SparkSession, path: str) -> DataFrame:
    """(seq, section_id, title), stripped, without rows that lack either."""
    rows = read_csv(spark, path, required=["section_id", "title"])
    fit = rows.select(F.monotonically_increasing_id().alias("seq"), t.strip(F.col("section_id")).alias("section_id"), t.strip(F.col("title")).alias("title"))
    return fit.where("section_id != '' and title != ''")
