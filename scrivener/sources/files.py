"""A sink that writes each row as a file of its own, and DOCX files as such rows."""

from __future__ import annotations

import io
import re
import time
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from scrivener.functions import text as t


#: How often an aborted job tries to delete its folder while tasks still write into it.
ABORTS = 50


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"^\w+:/", path) else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _FileWriter(DataSourceWriter):
    """Tasks write into a folder beside the target, which takes the target's place in one step once all are done.

    A task that runs again writes the same names with the same bytes, so nothing is left of a lost attempt.  Tasks don't make
    the folder: one that still runs when the job is aborted finds none and can't bring it back.
    """

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}.{uuid.uuid4().hex}"
        there, folder = place(self.staging)
        there.create_dir(folder, recursive=True)

    def write(self, rows: Iterator[Row]) -> _Written:
        there, folder = place(self.staging)
        n = 0
        for row in rows:
            with there.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(bytes(row.content))
            n += 1
        return _Written(n)

    def commit(self, messages: list[_Written | None]) -> None:
        there, folder = place(self.staging)
        _, target = place(self.path)
        there.create_dir(folder, recursive=True)  # also if there was no row
        there.move(folder, target)

    def abort(self, messages: list[_Written | None]) -> None:
        there, folder = place(self.staging)
        for attempt in range(ABORTS):
            if there.get_file_info(folder).type != fs.FileType.Directory:
                return
            try:
                there.delete_dir(folder)
            except OSError:  # a task that still runs has written into it meanwhile
                if attempt == ABORTS - 1:
                    raise
                time.sleep(0.1)


class NamedFiles(DataSource):
    """``df.write.format("named_files").mode("append").save(path)`` for rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _FileWriter(self.options["path"])


def unique_names(df: DataFrame, stem: str, suffix: str, order: list[str]) -> DataFrame:
    """Add ``name``: the stem, without what a file's name can't hold, and the suffix; equal ones get _2, _3 ... in order.

    A stem that ends in _<number> itself is written with one underscore more, so that it can't meet a numbered one.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(stem).cast("string"), r"[\\/:*?\"<>|\x00-\x1f]+", "_"), r"^\.+$|^$", "_")
    # "a_2" becomes "a__2", so that "a_2" is free for the second "a"
    clean = F.regexp_replace(clean, r"_(\d+)$", r"__$1")
    ranked = df.withColumn("_stem", clean).withColumn("_nth", F.row_number().over(Window.partitionBy(F.lower("_stem")).orderBy(*order)))
    name = F.when(F.col("_nth") == 1, F.col("_stem")).otherwise(F.concat_ws("_", "_stem", "_nth"))
    return ranked.withColumn("name", F.concat(name, F.lit(suffix))).drop("_stem", "_nth")


def write_files(df: DataFrame, path: str) -> None:
    """Write rows (name, content) as files of the folder ``path``, which must not be there yet, or fail as a whole.

    The folder may be anywhere that executors and driver both reach by one path or URI.
    """
    there, target = place(path)
    if there.get_file_info(target).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(NamedFiles)
    df.select("name", F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").save(path)


# ---- DOCX

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = (
    f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    '<Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/></Types>'
)
_LINKS = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/%s" Target="%s"/></Relationships>'
#: Characters that XML can't hold.
_BANNED = r"[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]"


def docx_bytes(paragraphs: list[tuple[str, str | None]]) -> bytes:
    """A DOCX file of (text, style name); line feeds within a text are line breaks.  Equal input gives equal bytes."""
    names = sorted({s for _, s in paragraphs if s})
    ids = {s: f"S{i}" for i, s in enumerate(names)}
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val={quoteattr(s)}/></w:style>' for s, i in ids.items())
    body = []
    for text, style in paragraphs:
        kind = f'<w:pPr><w:pStyle w:val="{ids[style]}"/></w:pPr>' if style else ""
        lines = [f'<w:t xml:space="preserve">{escape(x, {chr(13): "&#13;"})}</w:t>' for x in re.sub(_BANNED, "", text or "").split("\n")]
        body.append(f"<w:p>{kind}<w:r>{'<w:br/>'.join(lines)}</w:r></w:p>")
    parts = {
        "[Content_Types].xml": _TYPES, "_rels/.rels": _LINKS % ("officeDocument", "word/document.xml"), "word/_rels/document.xml.rels": _LINKS % ("styles", "styles.xml"),
        "word/styles.xml": f'{_HEAD}<w:styles xmlns:w="{_W}">{styles}</w:styles>', "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_W}"><w:body>{"".join(body)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def docx_files(blocks: DataFrame) -> DataFrame:
    """(name, content): a DOCX file for each doc_id of blocks (doc_id, pos, line, style, and sub where healed)."""
    order = ["pos", "sub"] if "sub" in blocks.columns else ["pos"]
    listed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(t.filled(F.col("line")).alias("line"), "style").alias("p")))).alias("all"))
    named = unique_names(listed.select("doc_id", F.transform("all", lambda x: x["p"]).alias("p")), "doc_id", ".docx", ["doc_id"])

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "content": [docx_bytes([(x["line"], x["style"]) for x in p]) for p in b.p]})

    return named.select("name", "p").mapInPandas(build, "name string, content binary")
