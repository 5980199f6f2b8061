"""Repeated runs of lines: content-defined chunks whose boundaries a rolling hash over line hashes sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivener.llm.common import discard, materialize

_LAST = (1 << 63) - 1


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later projections can't repeat inside their lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lines(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str]) -> DataFrame:
    """(doc_id, carried, doc, part, no_text, lines): (doc, part) is a row's place, null ids last, equal rows at one place."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.select("doc_id", "carried", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), part.alias("part"), F.col("text").isNull().alias("no_text"), F.split(text, "\n", -1).alias("lines"))


def _both(i: Column) -> Column:
    return F.concat_ws("\n", F.get("lines", i), F.get("lines", i + 1))


def rolling(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc, part, idx, hash) for each line but the last: a hash of its own hash and the next line's."""
    df = _once(df, "own", F.transform("lines", lambda x: digest(x))).select("doc", "part", "own")
    n = F.size("own")
    pairs = F.zip_with(F.slice("own", F.lit(1), n - 1), F.slice("own", F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
    return df.where(n > 1).select("doc", "part", F.posexplode(pairs).alias("idx", "hash"))


def _seen_before(df: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """(doc, part, gone): the places idx of a row where an earlier place of the corpus has both lines idx and idx + 1.

    Hashes and places are shuffled, no texts.  Then the lines at places that share a hash are compared: the least and
    greatest of each hash, combined before the shuffle, show whether all are equal, and a hash of different lines is
    grouped again by the lines themselves.
    """
    place, rows = F.struct("doc", "part", "idx"), rolling(df, digest)
    found = materialize(rows.groupBy("hash").agg(F.count("*").alias("times"), F.min(place).alias("keep")).where("times > 1").select("hash", "keep"))
    met = materialize(rows.join(found, "hash").select("doc", "part", "idx", "hash", (place != F.col("keep")).alias("later")))
    lists = materialize(met.groupBy("doc", "part").agg(F.collect_set(F.when(F.col("later"), F.col("idx"))).alias("gone"), F.collect_set("idx").alias("met")))
    discard(found)
    # one plan at every size: a broadcast of short lists would only hold for small corpora
    told = df.select("doc", "part", "lines").join(lists.select("doc", "part", "met").hint("merge"), ["doc", "part"]).select("lines", F.explode("met").alias("i")).select(F.get("lines", F.col("i")).alias("a"), F.get("lines", F.col("i") + 1).alias("b"))
    told = told.select(F.xxhash64(digest(F.col("a")), digest(F.col("b"))).alias("hash"), F.concat_ws("\n", "a", "b").alias("both"))
    mixed = materialize(told.groupBy("hash").agg((F.min("both") != F.max("both")).alias("mixed")).where("mixed").select("hash"))
    if mixed.isEmpty():
        discard(met, mixed)
        return lists.select("doc", "part", "gone")
    unsure = materialize(met.join(mixed, "hash").select("doc", "part", "idx"))
    again = materialize(df.select("doc", "part", "lines").join(unsure, ["doc", "part"]).select("doc", "part", "idx", _both(F.col("idx")).alias("both")))
    first = again.groupBy("both").agg(F.min(place).alias("keep"))
    later = again.join(first, "both").where(place != F.col("keep")).select("doc", "part", "idx")
    sure = met.where("later").join(mixed, "hash", "left_anti").select("doc", "part", "idx")
    out = materialize(sure.union(later).groupBy("doc", "part").agg(F.collect_set("idx").alias("gone")))
    discard(met, mixed, unsure, again, lists)
    return out


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept (the lines that stay), and the columns ``carry``.

    A hash rolls over the hashes of each two neighbouring lines.  A boundary lies between two lines whose rolling hash
    no earlier place of the corpus has; what lies between boundaries is a chunk, and chunks of two or more lines go.
    So chunks depend on the lines alone and not on where they stand, and each is a maximal run that came before; every
    run of two or more lines that an earlier place has is inside one.  Lines are compared byte by byte before
    any goes.  The first place of a run, by doc_id and line, stays; of one line many times over, one stays.

    Null text stays null with no lines; the empty text is one line.  A null doc_id comes last.  Repeated rows with equal
    doc_id and text are treated alike.  No rows give none.  Columns that are not in ``carry``, whatever their names, are
    not read; long texts take part in whole.
    """
    df = _lines(docs, id_col, text_col, carry)
    out = df.join(_seen_before(df, digest).hint("merge"), ["doc", "part"], "left")
    n = F.size("lines")
    both = F.array_union("gone", F.transform("gone", lambda i: i + 1))
    out = _once(out, "stay", F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce(both, F.array().cast("array<int>"))))
    kept = F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n")
    n_lines, n_removed = n.cast("long"), (n - F.size("stay")).cast("long")
    return out.select("doc_id", F.when(F.col("no_text"), 0).otherwise(n_lines).alias("n_lines"), F.when(F.col("no_text"), 0).otherwise(n_removed).alias("n_removed"), F.when(~F.col("no_text"), kept).alias("kept"), *[F.col(f"carried.{c}").alias(c) for c in carry])


#: Repeated runs by the lines themselves: no hash and no boundary.
ORACLE = r"""
with l as (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
p as (select *, lead(line) over (partition by doc_id order by i) as next from l),
g as (select doc_id, i, next is not null and row_number() over (partition by line, next order by doc_id, i) > 1 as later from p),
s as (select p.doc_id, p.text, p.line, p.i, g.later or coalesce(lag(g.later) over (partition by p.doc_id order by p.i), false) as gone from p join g on g.doc_id = p.doc_id and g.i = p.i)
select doc_id, case when any_value(text) is null then 0 else count(*) end as n_lines, count(*) filter (where gone) as n_removed, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from s group by doc_id"""
