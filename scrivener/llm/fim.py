"""Fill-in-middle: a text's segments exchanged in place by rotations, and put back the same way."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of a reversal's side that are swapped at once; output of a task goes on in batches of about _BATCH bytes.
_SWAP, _BATCH = 1 << 16, 8 << 20


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text in UTF-8 end; a line holds its line feed."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def character_ends(data: np.ndarray) -> np.ndarray:
    """Where the code points of a text in UTF-8 end."""
    return np.append(np.flatnonzero((data[1:] & 0xC0) != 0x80) + 1, len(data)) if len(data) else np.empty(0, np.int64)


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"line": line_ends, "character": character_ends}


def _reverse(data: np.ndarray, start: int, end: int) -> None:
    """Turn data[start:end] round where it lies."""
    while end - start > 1:
        n = min(_SWAP, (end - start) // 2)
        left = data[start : start + n].copy()
        data[start : start + n] = data[end - n : end][::-1]
        data[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks data[start:middle] and data[middle:end] in place: each turned round, then both together."""
    view = np.frombuffer(data, np.uint8)
    _reverse(view, start, middle)
    _reverse(view, middle, end)
    _reverse(view, start, end)


def _code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draw(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of a document: two cuts, whether it changes at all, and its form."""
    digits = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in range(0, 32, 8))


def exchange(text: bytes, doc_id: int | None, seed: int, rate: int, spm: int, unit: str, sentinels: Sequence[bytes]) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    raw = np.frombuffer(text, np.uint8)
    ends = UNITS[unit](raw)
    n = len(ends)
    h1, h2, h3, h4 = draw(seed, doc_id)
    if not n or h3 % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    cuts = [0 if not k else int(ends[k - 1]) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    prefix, suffix, middle = sentinels
    out = bytearray(text)
    # from the back, so that the cuts still hold; each sentinel stands before its own segment
    out[cuts[1] : cuts[1]] = suffix
    out[cuts[0] : cuts[0]] = middle
    out[0:0] = prefix
    at = len(prefix) + cuts[0]
    second = at + len(middle) + cuts[1] - cuts[0]
    form = "spm" if h4 % 100 < spm else "psm"
    rotate(out, at if form == "psm" else 0, second, len(out))
    return n, form, _code_points(raw[: cuts[0]]), _code_points(raw[cuts[0] : cuts[1]]), bytes(out)


def rebuild(output: bytes, form: str, sentinels: Sequence[bytes]) -> bytes:
    """The text that ``exchange`` was given, from its output and form, by the inverse rotation."""
    if form == "plain":
        return output
    prefix, suffix, middle = sentinels
    out = bytearray(output)
    # no text with a sentinel is exchanged, and none begins as another ends, so each is found once
    at_suffix, at_middle = out.index(suffix), out.index(middle)
    if form == "psm":  # prefix, [suffix], [middle]
        start, length = at_suffix, at_middle - at_suffix
    else:  # [suffix], [prefix, middle]
        start, length = 0, out.index(prefix)
    rotate(out, start, start + length, len(out))
    for s in (suffix, middle, prefix):
        i = out.index(s)
        del out[i : i + len(s)]
    return bytes(out)


def _in_batches(values: Iterator[tuple], kinds: Sequence[pa.DataType], names: Sequence[str], sized: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Record batches of the rows, none much over _BATCH bytes; ``sized`` are the places of their long values."""
    held, size = [], 0
    for row in values:
        held.append(row)
        size += sum(len(row[i] or b"") for i in sized)
        if size > _BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=list(names))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=list(names))


def _checked(sentinels: Sequence[str]) -> list[bytes]:
    given = [s.encode() for s in sentinels]
    for a in given:
        for b in given:
            if not a or (a is not b and a in b) or any(a[-i:] == b[:i] for i in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError("sentinels must not be empty, hold each other or begin as another ends")
    return given


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", sentinels: Sequence[str] = SENTINELS,
) -> DataFrame:
    """One row per row: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Two cuts between a text's units (lines, or characters) part it into prefix, middle and suffix.  ``rate`` per cent
    of the texts are written as psm (prefix, suffix, middle), or in ``spm`` per cent of these as spm (suffix, prefix, middle),
    each segment after its sentinel; the others, empty texts and those that hold a sentinel stay plain, with null counts.
    The cuts and the form come from the SHA-256 of ``seed`` and doc_id alone, so reruns agree wherever they run.

    Null is the empty text.  Rows that share a doc_id share their numbers; without one all share those of "null".
    Repeated rows give equal rows and no rows none.  Columns of any other name are not read.  A text is exchanged in whole in
    its own row, in one copy and a buffer of fixed size, and nothing is shuffled.
    """
    marks = _checked(sentinels)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            rows = ((i.as_py(), *exchange(t.as_py() or b"", i.as_py(), seed, rate, spm, unit, marks)) for i, t in zip(ids, texts))
            for made in _in_batches(rows, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], [5]):
                yield made.set_column(5, "output", made.column(5).cast(pa.string()))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(exchanged: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Add ``restored``, the text before ``fill_in_middle``, to its rows; it is made from output and form alone."""
    marks = _checked(sentinels)
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outputs, at = b.column("output").cast(pa.binary()), 0
            rows = ((rebuild(o.as_py(), f.as_py(), marks),) for o, f in zip(outputs, b.column("form")))
            for made in _in_batches(rows, [pa.binary()], ["restored"], [0]):
                kept = b.slice(at, made.num_rows)
                yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in columns], made.column(0).cast(pa.string())], names=[*columns, "restored"])
                at += made.num_rows

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"
    return exchanged.select(*columns).mapInArrow(run, kinds)


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u, sha256('7:' || doc_id) as h from documents),
c as (select *, len(u) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as a, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as b,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 100 then 'plain'
    when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 50 then 'spm' else 'psm' end as form from d),
s as (select doc_id, n, form, text, array_to_string(u[1:least(a, b)], '') as p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') as m, array_to_string(u[greatest(a, b) + 1:], '') as s from c)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256 from s"""
