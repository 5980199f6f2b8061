"""Joins of titles and segments with the title map."""

from __future__ import annotations

import itertools
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import predicates as p
from scrivener.functions import text as t
from scrivener.operators.tables import spread, written


def fill_titles(segments: DataFrame, titles: DataFrame) -> DataFrame:
    """Left join on section_id: ``final_title`` is the row's own title unless blank, else the map's.

    A map that repeats a section_id repeats its rows.
    """
    named = titles.select("section_id", F.col("title").alias("_mapped"))
    own = t.strip(t.filled(F.col("title")))
    return segments.join(named, "section_id", "left").withColumn("final_title", F.when(own != "", F.col("title")).otherwise(t.filled(F.col("_mapped")))).drop("_mapped")


def title_map(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (seq, section_id, title): title to id, where the last row wins, and id to title, where the first does."""
    fit = rows.select("seq", t.strip(t.filled(F.col("section_id"))).alias("section_id"), t.bare_title(F.col("title")).alias("title")).where("section_id != '' and title != ''")
    to_id = fit.groupBy(F.lower("title").alias("key")).agg(F.max_by("section_id", "seq").alias("section_id"), F.min("seq").alias("ord"))
    to_title = fit.groupBy("section_id").agg(F.min_by("title", "seq").alias("title"))
    return to_id, to_title


def title_candidates(title: Column) -> Column:
    """The title and its parts around ``/``, `` | `` and `` - ``, the first of each normalised form, in order."""
    whole = t.strip(t.filled(title))
    parts = F.transform(F.split(whole, r"(?U)\s*/\s*|\s+\|\s+|\s+-\s+", -1), t.strip)
    every = F.filter(F.transform(F.concat(F.array(whole), parts), lambda x: F.struct(x.alias("text"), F.lower(t.bare_title(x)).alias("key"))), lambda x: x["key"] != "")
    start = F.array().cast("array<struct<text:string,key:string>>")
    return F.aggregate(every, start, lambda out, x: F.when(F.exists(out, lambda o: o["key"] == x["key"]), out).otherwise(F.concat(out, F.array(x))))


#: Known titles and asked ones that are compared in one task, at most.
KNOWN_BLOCK, ASKED_BLOCK = 2_000, 2_000


def _letter_counts(texts: list[str], alphabet: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(alphabet)), np.int32)
    for row, x in zip(out, texts):
        for c in x:
            at = alphabet.get(c)
            if at is not None:
                row[at] += 1
    return out


#: Known titles that are first compared with a form, those with the highest bounds; pairs that are compared at once.
FIRST, PAIRS = 6, 512


_SHIFT = np.uint16(8)


def _matched(a: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """For each pair of texts (rows of codes, padded with zeros) the characters that SequenceMatcher matches, without junk.

    The longest common run, of equal ones the first in ``a``, then in ``b``; then the same to its left and to its right.  All runs
    of a level are found together, of all pairs.  Texts have at most 255 characters.
    """
    total = np.zeros(len(a), np.int64)
    row, a_from, a_to, b_from, b_to = np.arange(len(a)), np.zeros(len(a), np.int64), a_sizes.astype(np.int64), np.zeros(len(a), np.int64), b_sizes.astype(np.int64)
    while len(row):
        high, wide = int((a_to - a_from).max()), int((b_to - b_from).max())
        at_a, at_b = a_from + np.arange(high)[:, None], b_from + np.arange(wide)[:, None]
        # places beyond a part's end equal nothing
        x = np.where(at_a < a_to, a[row, np.minimum(at_a, a.shape[1] - 1)], a.dtype.type(0))
        y = np.where(at_b < b_to, b[row, np.minimum(at_b, b.shape[1] - 1)], b.dtype.type(1))
        place = (255 - np.arange(wide, dtype=np.uint16))[:, None]
        run, best, ends = np.zeros((wide + 1, len(row)), np.uint16), np.zeros(len(row), np.uint16), np.zeros(len(row), np.int64)
        for i in range(high):
            # how long the run that ends at each place is; the greatest, and of equal ones the first place
            run[1:] = (run[:-1] + 1) * (y == x[i])
            top = (run[1:] << _SHIFT | place).max(0)
            better = top | 255 > best | 255
            best, ends = np.where(better, top, best), np.where(better, i, ends)
        size = (best >> 8).astype(np.int64)
        np.add.at(total, row, size)
        i, j = a_from + ends + 1 - size, b_from + 255 - (best & 255) + 1 - size
        parts = [(row, a_from, i, b_from, j), (row, i + size, a_to, j + size, b_to)]
        keep = [(size > 0) & (p[2] > p[1]) & (p[4] > p[3]) for p in parts]
        row, a_from, a_to, b_from, b_to = (np.concatenate([p[k][fit] for p, fit in zip(parts, keep)]) for k in range(5))
    return total


def _codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Rows of numbers of characters, from 2 on, so that 0 and 1 are free."""
    found, numbers = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    out = np.zeros((len(texts), int(sizes.max())), np.uint8 if len(found) < 250 else np.uint32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = numbers + 2
    return out


def _ratios(forms: list[str], texts: list[str]) -> np.ndarray:
    """SequenceMatcher's ratio of each pair.  From 200 characters on it leaves out frequent ones: those pairs are its own."""
    out = np.zeros(len(forms))
    sizes = np.array([(len(x), len(y)) for x, y in zip(forms, texts)], np.int64).reshape(-1, 2)
    short = sizes.max(1, initial=0) < 200
    for i in np.flatnonzero(~short):
        out[i] = SequenceMatcher(None, forms[i], texts[i]).ratio()
    at = np.flatnonzero(short & (sizes.min(1, initial=200) > 0))
    at = at[np.argsort(sizes[at, 0], kind="stable")]  # texts of like lengths together
    for i in range(0, len(at), PAIRS):
        part = at[i : i + PAIRS]
        n, m = sizes[part, 0], sizes[part, 1]
        codes = _codes([forms[k] for k in part] + [texts[k] for k in part], np.concatenate([n, m]))
        common = _matched(codes[: len(part)], n, codes[len(part) :], m)
        out[part] = 2.0 * common / (n + m)
    return out


def _in_order(masks: dict[str, np.ndarray], sizes: np.ndarray, form: str) -> np.ndarray:
    """Lengths of the longest common subsequences with known titles of at most 64 characters, whose places are bits."""
    left = np.full(len(sizes), ~np.uint64(0))
    for c in form:
        mask = masks.get(c)
        if mask is not None:
            used = left & mask
            left = (left + used) | (left - used)
    return np.bitwise_count(~left).astype(np.int64)


def _most_similar(longest: float):
    """Of a block of asked forms, the most similar known title of a block: first the ones with the highest bound.

    The Ratcliff-Obershelp ratio is at most twice the letters in common, and twice the longest common subsequence, over both
    lengths.  The known titles with the highest bounds give each form a ratio; those whose bound reaches it are compared, too.
    """

    def run(key: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("ord")
        texts, ids, ords = known["known"].tolist(), known["known_id"].tolist(), known["ord"].tolist()
        alphabet = {c: i for i, c in enumerate(sorted(set("".join(texts))))}
        letters, sizes = _letter_counts(texts, alphabet), np.array([len(x) for x in texts])
        narrow = sizes <= 64
        masks = {c: np.zeros(len(texts), np.uint64) for c in alphabet}
        for i in np.flatnonzero(narrow):
            for j, c in enumerate(texts[i]):
                masks[c][i] |= np.uint64(1 << j)
        firsts = np.array([x[:1] for x in texts])
        forms, reach = asked["key"].tolist(), []
        for form, near in zip(forms, asked["near"]):
            fit = (sizes >= int(len(form) * 0.6)) & (sizes <= int(len(form) * longest))
            if near:
                fit &= firsts == form[:1]
            at = np.flatnonzero(fit)
            if not len(at):
                reach.append((at, np.zeros(0)))
                continue
            mine = _letter_counts([form], alphabet)[0]
            used = np.flatnonzero(mine)
            common = np.minimum(letters[np.ix_(at, used)], mine[used]).sum(1)
            if narrow[at].any():
                common = np.where(narrow[at], np.minimum(common, _in_order(masks, sizes, form)[at]), common)
            bound = 2.0 * common / (sizes[at] + len(form))
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] > 0]
            reach.append((at[order], bound[order]))
        best = {}  # of a form's place: (ratio, - place of the known title)

        def compare(pairs: list[tuple[int, int]]) -> None:
            for (f, k), ratio in zip(pairs, _ratios([forms[f] for f, _ in pairs], [texts[k] for _, k in pairs]).tolist()):
                if ratio > 0:
                    best[f] = max(best.get(f, (0.0, 0)), (ratio, -k))

        compare([(f, int(k)) for f, (at, _) in enumerate(reach) for k in at[:FIRST]])
        rest = ((f, int(k)) for f, (at, bound) in enumerate(reach) for k in at[FIRST : np.searchsorted(-bound, -(best.get(f, (0.0, 0))[0] - 1e-9), side="right")])
        while part := list(itertools.islice(rest, 8 * PAIRS)):
            compare(part)
        return pd.DataFrame([(forms[f], ids[-k], score, ords[-k]) for f, (score, k) in best.items()], columns=["key", "known_id", "score", "ord"])

    return run


def _best_of_blocks(rest: DataFrame, held: DataFrame, longest: float, few: int) -> DataFrame:
    """(key, known_id, score, ord): of each form (key, n) the best known title (known, known_id, ord, len) per block.

    Known titles of one length are dealt to blocks of about KNOWN_BLOCK, forms of one length to blocks of about
    ASKED_BLOCK, both by hash, so neither a frequent length nor a long map lands in one task.  With ``few``, only
    known titles with the form's first letter count, unless there are fewer than ``few``.
    """
    lengths = held.groupBy("len").agg(F.count("*").alias("held"))
    # neighbouring lengths share a block until it is full; a length has at most one row here
    before = F.coalesce(F.sum("held").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lengths = lengths.select("len", "held", F.floor(before / KNOWN_BLOCK).cast("long").alias("band"), F.ceil(F.col("held") / KNOWN_BLOCK).cast("int").alias("parts"))
    known = held.join(lengths.select("len", "band", "parts"), "len").select("known", "known_id", "ord", "band", F.pmod(F.xxhash64("known"), F.col("parts")).cast("int").alias("part"))
    bands = lengths.groupBy("band").agg(F.min("len").alias("low"), F.max("len").alias("high"), F.max("parts").alias("parts"))
    low, high = F.floor(F.col("n") * 0.6), F.floor(F.col("n") * longest)
    asked = rest.groupBy("n").agg(F.count("*").alias("forms"))
    # lengths and bands are few: one row for each length that occurs
    reach = asked.join(bands, (F.col("low") <= high) & (F.col("high") >= low)).select("n", "band", "parts", F.ceil(F.col("forms") / ASKED_BLOCK).cast("int").alias("deals"))
    forms = rest.withColumn("near", F.lit(False))
    if few:
        counted = held.groupBy("len", F.substring("known", 1, 1).alias("letter")).agg(F.count("*").alias("c"))
        top = held.agg(F.max("len").alias("top"))
        wanted = rest.select("n", F.substring("key", 1, 1).alias("letter")).distinct().join(F.broadcast(top)).where(low <= F.col("top")).select("n", "letter", F.explode(F.sequence(low.cast("int"), F.least(high.cast("int"), F.col("top")))).alias("len"))
        near = wanted.join(counted, ["len", "letter"]).groupBy("n", "letter").agg((F.sum("c") >= few).alias("near"))
        forms = rest.withColumn("letter", F.substring("key", 1, 1)).join(near, ["n", "letter"], "left").select("key", "n", F.coalesce("near", F.lit(False)).alias("near"))
    sent = forms.join(reach, "n").withColumn("deal", F.pmod(F.xxhash64("key"), F.col("deals")).cast("int")).select("key", "near", "band", "deal", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    deals = sent.groupBy(F.col("band").alias("b"), F.col("part").alias("p"), F.col("deal").alias("d")).agg(F.count("*").alias("_"))
    dealt = known.join(deals, (F.col("band") == F.col("b")) & (F.col("part") == F.col("p"))).select("known", "known_id", "ord", F.col("b").alias("band"), F.col("p").alias("part"), F.col("d").alias("deal"))
    # by number, since these few bytes are much work, and small partitions would be joined to one task
    by, tasks = ["band", "part", "deal"], max(4 * rest.sparkSession.sparkContext.defaultParallelism, -(-rest.count() // ASKED_BLOCK))
    sent, dealt = sent.repartition(tasks, *by), dealt.repartition(tasks, *by)
    return sent.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(_most_similar(longest), "key string, known_id string, score double, ord long")


def match_titles(titles: DataFrame, to_id: DataFrame, least: float = 0.78, longest: float = 1.6, by_first_letter: bool = False, few: int = 20) -> DataFrame:
    """(title, section_id, confidence) of each distinct title.

    Exact by normalised form (1.0); else the most similar known title of a length from .6 to ``longest`` times
    its own, the first in map order of equal ones.  Under ``least`` the id is null but the score stays.  Of a
    title's candidates the best score wins, then the first.  ``by_first_letter``: the older rule, known titles
    with the same first letter, unless there are fewer than ``few``; the title is not taken apart.

    Only distinct forms that have no exact match are compared, and only within their range of lengths: the map is
    a set of known titles in blocks, and each block of forms meets the blocks that its lengths can reach.
    """
    every = spread(titles.select("title").distinct(), "title")
    if by_first_letter:
        key = F.lower(t.numberless_title(F.col("title")))
        cands = every.select("title", F.lit(0).alias("n"), key.alias("key")).where("key != ''")
    else:
        cands = every.select("title", F.posexplode(title_candidates(F.col("title"))).alias("n", "c")).select("title", "n", "c.key")
    # tables: what several joins read is worked out once
    cands = written(cands)
    known = written(to_id.select(F.col("key").alias("known"), F.col("section_id").alias("known_id"), "ord"))
    keys = cands.select("key").distinct()
    exact = keys.join(known, F.col("key") == F.col("known")).select("key", F.col("known_id").alias("id"), F.lit(1.0).alias("score"))
    rest = keys.join(known, F.col("key") == F.col("known"), "left_anti").select("key", F.length("key").alias("n"))
    rest = written(rest)
    fuzzy_best = _best_of_blocks(rest, known.withColumn("len", F.length("known")), longest, few if by_first_letter else 0)
    best = fuzzy_best.groupBy("key").agg(F.max_by(F.struct("known_id", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    fuzzy = best.select("key", F.when(F.col("b.score") >= least, F.col("b.known_id")).alias("id"), F.col("b.score").alias("score"))
    found = cands.join(exact.union(fuzzy), "key", "left")
    top = found.groupBy("title").agg(F.max_by(F.struct("id", "score"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("n"))).alias("b"))
    return every.join(top, "title", "left").select("title", F.col("b.id").alias("section_id"), F.coalesce("b.score", F.lit(0.0)).alias("confidence"))


def route_or_match(segments: DataFrame, to_id: DataFrame, title_col: str = "section_title") -> DataFrame:
    """Add section_id and confidence: the keyword router's id with .90, else the title map's."""
    # each distinct title is routed and matched once
    titles = written(spread(segments.select(F.col(title_col).alias("title")).distinct(), "title").withColumn("_route", p.keyword_route(F.col("title"))))
    matched = match_titles(titles.where("_route is null").select("title"), to_id).select("title", F.col("section_id").alias("_id"), F.col("confidence").alias("_score"))
    answers = titles.join(matched, "title", "left").withColumnRenamed("title", "_title")
    joined = segments.join(answers, F.col(title_col).eqNullSafe(F.col("_title")), "left")
    by_route = F.col("_route").isNotNull()
    return joined.select(*segments.columns, F.coalesce("_route", "_id", F.lit("")).alias("section_id"), F.when(by_route, 0.9).otherwise(F.coalesce("_score", F.lit(0.0))).alias("confidence"))


def nest_sections(rows: DataFrame, by: str, order: list[str], fields: list[str], name: str = "sections") -> DataFrame:
    """One row per group with its rows as an array of structs in order."""
    keyed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_order"), F.struct(*fields).alias("_row"))))
    return rows.groupBy(by).agg(F.transform(keyed, lambda x: x["_row"]).alias(name))
