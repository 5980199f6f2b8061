"""Text normalisers: functions from a string Column to a Column, on the JVM unless said otherwise.

Null counts as the empty text throughout.  ``(?U)`` makes Java's classes Unicode-aware.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = "A-Za-zА-Яа-яЁё"
CYRILLIC = "А-Яа-яЁё"
NBSP = " "
#: Line ends, as far as text files use them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c worked out once however often f names it, inside lambdas too."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def rewrite(c: Column, *rules: tuple[str, str]) -> Column:
    """Apply (pattern, replacement) rules in order."""
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


def strip(c: Column) -> Column:
    """Without Unicode white space on either side."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lines(c: Column) -> Column:
    """Array of lines, stripped, without the empty ones."""
    return F.filter(F.transform(F.split(filled(c), LINE_END, -1), strip), lambda x: x != "")


def collapse_blanks(c: Column) -> Column:
    """Runs of blanks other than line feeds become one; stripped."""
    return strip(F.regexp_replace(filled(c), r"[ \t\r\f\x0b]+", " "))


def unify_newlines(c: Column) -> Column:
    """Line ends become line feeds, at most two in a row."""
    return rewrite(filled(c), (r"\r\n?", "\n"), (r"\n{3,}", "\n\n"))


def plain_spaces(c: Column) -> Column:
    """No-break spaces and tabs become single blanks; stripped."""
    return strip(rewrite(filled(c), (NBSP, " "), (r"[ \t]+", " ")))


def tidy(c: Column) -> Column:
    """``plain_spaces`` with at most two line feeds in a row."""
    return strip(rewrite(filled(c), (NBSP, " "), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")))


def narrow(c: Column) -> Column:
    """Stripped, then runs of two or more white spaces become a blank; a single tab stays."""
    return F.regexp_replace(strip(filled(c)), r"(?U)\s{2,}", " ")


def clean_page_text(c: Column) -> Column:
    """Without page footers; each line narrowed; at most one empty line in a row; line structure kept."""
    body = F.regexp_replace(filled(c), r"(?iU)Page\s+\d+\s+of\s+\d+", "")
    each = F.transform(F.split(body, LINE_END, -1), lambda x: strip(F.regexp_replace(x, r"(?U)\s{2,}", " ")))
    return strip(F.regexp_replace(F.array_join(each, "\n"), r"\n{3,}", "\n\n"))


def unify_dashes(c: Column) -> Column:
    """Dashes become hyphens, soft hyphens go, no-break spaces become blanks; blanks around line feeds go."""
    c = F.translate(filled(c), "–—− ­", "--- ")
    return strip(rewrite(c, (r"[ \t]+", " "), (r"(?U)\s+\n", "\n"), (r"(?U)\n\s+", "\n")))


def space_after_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{1,3})([.)])([A-Za-zА-Яа-я])", "$1$2 $3")


def canonical_heading(c: Column) -> Column:
    """A heading line in one form: ``12 - X`` and ``12.X`` become ``12. X``."""
    return strip(F.regexp_replace(space_after_number(unify_dashes(c)), r"(?sU)^\s*(\d{1,3})\s*-\s*(\S.*?)\s*$", "$1. $2"))


def unglue(c: Column) -> Column:
    """Blanks after punctuation and between letters and digits, and between Cyrillic and Latin letters."""
    return rewrite(filled(c), (f"([,;:])([{LETTERS}])", "$1 $2"), (rf"([{LETTERS}])((?U)\d)", "$1 $2"), (rf"((?U)\d)([{LETTERS}])", "$1 $2"), (f"([{CYRILLIC}])([A-Za-z])", "$1 $2"), (f"([A-Za-z])([{CYRILLIC}])", "$1 $2"))


def drop_placeholders(c: Column) -> Column:
    return F.regexp_replace(filled(c), r"\[[^\]]{1,120}\]", "")


#: Gaps of white space up to this length are compared as such; before longer ones every place is tried.
_GAP = 64


def _distances(codes: np.ndarray, least: int, most: int) -> np.ndarray:
    """Distances from ``least`` to ``most`` at which some stretch of ``least`` characters may agree, ascending; none is left out.

    A stretch of ``least`` holds a whole window of half as many characters from a place that is a multiple of that; windows
    are told apart by 64-bit hashes, of which equal ones can only add a distance.
    """
    width = (least + 1) // 2
    if most < least or len(codes) < width + least:
        return np.empty(0, np.int64)
    hashes, size = codes.astype(np.uint64) * _MIX[0] + _MIX[1], 1
    hashes ^= hashes >> np.uint64(29)
    while size < width:  # windows of twice the size, or of what is left
        step = min(size, width - size)
        hashes = (hashes[:-step] * _MIX[2]) ^ (hashes[step:] * _MIX[3])
        hashes ^= hashes >> np.uint64(31)
        size += step
    order = np.argsort(hashes, kind="stable")
    hashes, found = hashes[order], np.zeros(most + 1, bool)
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    near = 1
    while len(same):  # the next place with equal hash, the one after it ...
        d = order[same + near] - order[same]
        found[d[(d >= least) & (d <= most) & (order[same] % width == 0)]] = True
        same, near = same[d <= most], near + 1
        same = same[same + near < len(hashes)]
        same = same[hashes[same + near] == hashes[same]]
    return np.flatnonzero(found)


#: Odd multipliers of the hashes above.
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _repeat_starts(text: str, least: int, most: int) -> np.ndarray:
    """Places where a run of copies of ``least`` to ``most`` characters, with white space between, may begin, ascending.

    None is left out, and few are more.  Copies at a distance d agree over a stretch in which each character is that
    d places on, so for each distance that may have one the long stretches are found, in one pass over the text.
    """
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    gaps = [(m.start(), m.end()) for m in re.finditer(r"\s{2,}", text)]
    longest = max((end - start for start, end in gaps), default=1)
    far = _distances(codes, least, min(most + min(longest, _GAP), n - 1))
    if not len(far) and longest <= _GAP:
        return np.empty(0, np.int64)
    found = np.zeros(n, bool)
    space = np.zeros(n + 1, np.int64)  # how many blanks end right before a place
    for m in re.finditer(r"\s+", text):
        size = m.end() - m.start()
        space[m.start() + 1 : m.end() + 1] = np.arange(1, size + 1)
        if size > _GAP:
            found[max(0, m.start() - most) : m.start()] = True
    for d in far.tolist():
        breaks = np.flatnonzero(codes[d:] != codes[: n - d])
        edges = np.concatenate([[-1], breaks, [n - d]])
        for k in np.flatnonzero(np.diff(edges) > least).tolist():
            start, end = int(edges[k]) + 1, int(edges[k + 1])
            at = np.arange(start, end - least + 1)
            blanks = np.minimum(np.minimum(space[at + d], _GAP), d - least)
            found[at] |= (end - at >= d - blanks) & (d - blanks <= most)
    return np.flatnonzero(found)


def squash_repeats(least: int = 30, most: int = 220):
    """Function of a text column: a run of copies of ``least`` to ``most`` characters, with white space between,
    becomes one, until nothing changes.  SQL has no backreferences: Python, batch by batch.

    The pattern is tried only where a run may begin, so a pass takes time in proportion to the text.
    """

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        again = re.compile(rf"(.{{{least},{most}}})(?:\s*\1)+", re.DOTALL)

        def once(t: str) -> str:
            parts, end = [], 0
            for at in _repeat_starts(t, least, most).tolist():
                if at >= end and (m := again.match(t, at)):
                    parts += [t[end:at], m[1]]
                    end = m.end()
            return "".join([*parts, t[end:]]) if parts else t

        def squash(t: str | None) -> str:
            t = t or ""
            before = None
            while len(t) >= 2 * least and t != before:
                before, t = t, once(t)
            return t

        return texts.map(squash)

    return run


def smart_truncate(c: Column, most: int = 2600) -> Column:
    """At most ``most`` characters, cut after the last mark in the final 35 %, else hard; an ellipsis ends it."""
    low = int(most * 0.65)
    ended = lambda cut: F.when((cut == "") | cut.rlike(r"[.!?…]$"), cut).otherwise(F.concat(cut, F.lit("…")))

    def shorten(t: Column) -> Column:
        upto = F.regexp_extract(F.substring(t, low + 1, most - low), r"(?s)^.*[.!?;:\n]", 0)
        return bind(rstrip(bind(upto, lambda u: F.when(u != "", F.concat(F.substring(t, 1, low), u)).otherwise(F.substring(t, 1, most)))), ended)

    return bind(strip(filled(c)), lambda t: F.when(F.length(t) <= most, t).otherwise(shorten(t)))


def sentences(c: Column) -> Column:
    """Array of sentences: white space after ``.!?`` and before a capital or a digit parts them."""
    flat = strip(F.regexp_replace(filled(c), r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(flat, r"(?U)(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9])", -1), strip), lambda x: x != "")


def truncate_at_sentence(c: Column, most: int = 1500) -> Column:
    """Whole sentences up to ``most`` characters; a first one that is longer is cut at its last blank."""
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def add(a: Column, s: Column) -> Column:
        size = F.length(a["out"]) + F.when(a["out"] == "", 0).otherwise(1) + F.length(s)
        full = a["full"] | (size > most)
        return F.struct(F.when(full, a["out"]).when(a["out"] == "", s).otherwise(F.concat(a["out"], F.lit(" "), s)).alias("out"), full.alias("full"))

    def shorten(t: Column) -> Column:
        whole = lambda x: F.aggregate(x, start, add, lambda a: a["out"])
        hard = lambda x: strip(F.regexp_replace(F.substring(F.coalesce(F.get(x, F.lit(0)), t), 1, most), r"(?s) [^ ]*$", ""))
        return bind(sentences(t), lambda x: bind(whole(x), lambda kept: F.when(kept == "", hard(x)).otherwise(kept)))

    return bind(tidy(c), lambda t: F.when(F.length(t) <= most, t).otherwise(shorten(t)))


def fold_case(c: Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def dedupe_lines(rows: Column, window: int) -> Column:
    """Of an array of lines, those whose folded form is not among the last ``window`` kept; empty ones go.

    The fold carries the last keys, and lines in parts of 256, so that no step copies all lines kept so far.
    """
    clean = F.transform(F.filter(F.transform(rows, plain_spaces), lambda x: x != ""), lambda x: F.struct(x.alias("line"), fold_case(x).alias("key")))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("keys"), none.alias("part"), F.array().cast("array<array<string>>").alias("parts"))

    def add(a: Column, x: Column) -> Column:
        full = F.size(a["part"]) >= 256
        keys = F.concat(F.when(F.size(a["keys"]) >= window, F.slice(a["keys"], 2, window)).otherwise(a["keys"]), F.array(x["key"]))
        part = F.when(full, F.array(x["line"])).otherwise(F.concat(a["part"], F.array(x["line"])))
        parts = F.when(full, F.concat(a["parts"], F.array(a["part"]))).otherwise(a["parts"])
        return F.when(F.array_contains(a["keys"], x["key"]), a).otherwise(F.struct(keys.alias("keys"), part.alias("part"), parts.alias("parts")))

    return F.flatten(F.aggregate(clean, start, add, lambda a: F.concat(a["parts"], F.array(a["part"]))))


def caps_ratio(c: Column) -> Column:
    """Share of capitals among the Latin and Cyrillic letters; null without letters."""
    letters = F.regexp_replace(c, f"[^{LETTERS}]", "")
    return bind(letters, lambda x: F.length(F.regexp_replace(x, "[^A-ZА-ЯЁ]", "")) / F.nullif(F.length(x), F.lit(0)))


def looks_caps_heading(c: Column) -> Column:
    """At most 90 characters with four letters or more, over 88 % of them capitals."""
    letters = F.length(F.regexp_replace(c, f"[^{LETTERS}]", ""))
    return (letters >= 4) & (F.length(c) <= 90) & (F.coalesce(caps_ratio(c), F.lit(0.0)) > 0.88)


def drop_while(rows: Column, bad) -> Column:
    """An array without the leading items for which ``bad`` holds."""
    def cut(r: Column) -> Column:
        good = F.array_position(F.transform(r, lambda x: ~bad(x)), True)
        return bind(good, lambda g: F.when(g > 0, F.slice(r, F.greatest(g, F.lit(1)).cast("int"), F.size(r))).otherwise(F.slice(r, 1, 0)))

    return bind(rows, cut)


def drop_heading_echo(c: Column) -> Column:
    """Lines without the leading ones that look like headings in capitals."""
    return strip(F.array_join(drop_while(lines(c), looks_caps_heading), "\n"))


def drop_title_echo(title: Column, body: Column) -> Column:
    """An array of lines without the leading ones that repeat the title."""
    key = fold_case(plain_spaces(title))
    return drop_while(body, lambda x: fold_case(plain_spaces(F.regexp_replace(x, ":+$", ""))) == key)


@F.pandas_udf(T.StringType())
def compatible_form(texts: pd.Series) -> pd.Series:
    """NFKC, which Spark lacks."""
    return texts.map(lambda t: unicodedata.normalize("NFKC", t or ""))


def slug(c: Column) -> Column:
    """Of a text in NFKC: lower case, other than word characters as one underscore, ``s_`` before a digit."""
    made = rewrite(F.lower(strip(filled(c))), (r"(?U)[^\w]+", "_"), ("_+", "_"), ("^_|_$", ""))
    return bind(made, lambda s: F.when(s == "", "empty").when(s.rlike(r"(?U)^\d"), F.concat(F.lit("s_"), s)).otherwise(s))


#: Labels that may precede a number in a title.
TITLE_LABELS = ("section", "article", "clause", "chapter", "appendix", "annex", "schedule", "раздел", "статья", "глава", "приложение")


def bare_title(c: Column, loose: bool = False) -> Column:
    """A title without label, number, closing punctuation and ``(hereinafter ...)``.

    ``loose`` also takes off leading letters I, V, X, L and C that only begin a word.
    """
    edge = "" if loose else r"(?![^\W_])"
    t = F.translate(strip(filled(c)), " –—«»", ' --""')
    t = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    number = rf"([IVXLC]+{edge}|\d+)"
    t = rewrite(
        t,
        (rf"(?iU)^(?:\(?\s*(?:{'|'.join(TITLE_LABELS)})\s*){number}(?:\.\d+)*\s*[).\-:]?\s*", ""),
        (rf"(?iU)^\s*{number}(?:\.\d+){{0,3}}\s*[).\-:]?\s*", ""),
        (r"(?U)\s*[:;\-–]\s*$", ""),
    )
    return strip(F.regexp_replace(F.regexp_replace(strip(t), r"(?iU)\((?:hereinafter|далее)[^)]*\)", ""), r"(?U)\s+", " "))


def numberless_title(c: Column) -> Column:
    """A title without ``section`` or ``раздел`` and number."""
    t = F.regexp_replace(strip(filled(c)), r"(?U)\s+", " ")
    return strip(F.regexp_replace(t, r"(?iU)^(\(?\s*(section|раздел)\s*)?\s*\d+(\.\d+)*[).\-:]?\s*", ""))


def title_key(c: Column, style: str = "spaces") -> Column:
    """Title forms: ``spaces`` (white space collapsed), ``colon`` (and closing colons gone), ``number`` (№ set off)."""
    if style == "colon":
        return strip(F.regexp_replace(plain_spaces(c), ":+$", ""))
    t = strip(F.regexp_replace(filled(c), r"(?U)\s+", " "))
    return F.regexp_replace(t, r"(?U)№\s*(\d+)", "№ $1") if style == "number" else t


def first_word_after_number(c: Column) -> Column:
    return F.substring_index(strip(F.lower(F.regexp_replace(strip(filled(c)), r"(?U)^\d+(\.\d+)*[.)]\s*", ""))), " ", 1)


def sentence_key(c: Column) -> Column:
    """A form in which repeated sentences are equal."""
    t = F.regexp_replace(F.replace(F.lower(strip(filled(c))), F.lit("ё"), F.lit("е")), r"(?U)\s+", " ")
    return rewrite(t, (r'[«»"()]', ""), (r"[,:;]+", ","))


def dense_length(c: Column) -> Column:
    """Length without white space."""
    return F.length(F.regexp_replace(filled(c), r"(?U)\s+", ""))


def number_lines(c: Column) -> Column:
    """Without empty lines; exactly one blank after a number like 1.2."""
    t = F.regexp_replace(strip(filled(c)), r"\n\s*\n+", "\n")
    return strip(F.regexp_replace(t, r"(?mU)^\s*(\d+\.\d+)\.?\s+", "$1. "))


def tokens(c: Column) -> Column:
    """Array of lower-case words of Latin and Cyrillic letters and digits."""
    return F.regexp_extract_all(F.lower(filled(c)), F.lit("([A-Za-zА-Яа-яЁё0-9]+)"), 1)


def shingles(c: Column, k: int = 7) -> Column:
    """The set of runs of ``k`` tokens; empty for fewer tokens."""
    def runs(t: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(t) - k + 1), lambda i: F.array_join(F.slice(t, i, F.lit(k)), " "))
        return F.when(F.size(t) >= k, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return bind(tokens(c), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def count_words(c: Column, words: Sequence[str]) -> Column:
    """How many of the words the text contains; one that is listed twice counts twice."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.contains(c, F.lit(w)), 1).otherwise(0)
    return total
