"""Sinks: JSON lines, CSV reports, text artefacts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.functions import text as t
from scrivener.operators.joins import nest_sections
from scrivener.sources import files

SECTION_FIELDS = ["section_id", "section_group", "title", "language", "text"]


def nested_contracts(sections: DataFrame, by: str = "doc_id", source: str = "docx") -> DataFrame:
    """(contract_id, source, sections) with a contract's sections in order."""
    return nest_sections(sections, by, ["order"], SECTION_FIELDS).select(F.col(by).alias("contract_id"), F.lit(source).alias("source"), "sections")


def flat_corpus(sections: DataFrame, by: str = "doc_id", least: int = 80) -> DataFrame:
    """One row per section of at least ``least`` characters."""
    return sections.where(F.length("text") >= least).select(F.col(by).cast("string").alias("doc_id"), *SECTION_FIELDS)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_files(contracts: DataFrame, path: str, by: str = "contract_id") -> None:
    """One JSON file for each row, named by its id; equal names are numbered."""
    rows = contracts.select(F.col(by).cast("string").alias("stem"), F.to_json(F.struct(*contracts.columns)).alias("content"))
    files.write_files(files.unique_names(rows, "stem", ".json", ["content"]), path)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, quoteAll=quote_all, quote='"', escape='"')


def write_marked_csv(df: DataFrame, path: str, sep: str = ";") -> None:
    """CSV files that each begin with a byte-order mark and the header, as spreadsheets want it; every field is quoted."""
    options = {"sep": sep, "quoteAll": "true", "quote": '"', "escape": '"'}
    head = "\ufeff" + sep.join('"' + c.replace('"', '""') + '"' for c in df.columns)

    def marked(batches):
        first = True
        for b in batches:
            if first and b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
                first = False
            yield b

    df.select(F.to_csv(F.struct(*[t.filled(F.col(c)).alias(c) for c in df.columns]), options).alias("value")).mapInArrow(marked, "value string").write.mode("overwrite").text(path)


def write_joined_text(texts: DataFrame, path: str, name: str, order: str = "seq", col: str = "text") -> None:
    """The text of ``joined_text`` as the file ``name`` of a new folder."""
    files.write_files(joined_text(texts, order, col).select(F.lit(name).alias("name"), F.col("text").alias("content")), path)


def write_report(df: DataFrame, path: str) -> None:
    """Semicolons, every field quoted."""
    df.write.mode("overwrite").csv(path, header=True, sep=";", quoteAll=True, quote='"', escape='"')


def joined_text(texts: DataFrame, order: str = "seq", col: str = "text") -> DataFrame:
    """One row: a bounded number of texts in order, parted by a line of 60 equal signs."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, col))), lambda x: x[col])
    return texts.agg(F.array_join(parts, "\n\n" + "=" * 60 + "\n\n").alias("text"))


def confidence_text(c: Column) -> Column:
    return F.format_string("%.3f", c)
