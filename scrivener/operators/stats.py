"""Counts, frequencies and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as t
from scrivener.operators.tables import written


def section_counters(sections: DataFrame, id_col: str = "doc_id", title_col: str = "section", text_col: str = "text") -> DataFrame:
    """One row: documents, non-empty and empty sections, sections named FULL_TEXT."""
    empty = t.strip(t.filled(F.col(text_col))) == ""
    return sections.agg(F.countDistinct(id_col).alias("documents"), F.count_if(~empty).alias("sections"), F.count_if(empty).alias("empty_sections"), F.count_if(F.col(title_col) == "FULL_TEXT").alias("full_text"))


def count_summary(counts: DataFrame, n_col: str) -> DataFrame:
    """One row: mean, upper median, least and greatest of a count.

    The upper median of n values is the one at n div 2 in order.  Counts repeat, so their frequencies are
    accumulated instead of the values.
    """
    freq = counts.groupBy(F.col(n_col).alias("v")).agg(F.count("*").alias("c"))
    run = freq.withColumn("upto", F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.agg((F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v"))).alias("median"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def frequencies(df: DataFrame, value: Column, order: str, limit: int | None = None) -> DataFrame:
    """(value, n), most frequent first, ties by first occurrence."""
    counted = df.select(value.alias("value"), F.col(order).alias("_o")).groupBy("value").agg(F.count("*").alias("n"), F.min("_o").alias("first_seen")).orderBy(F.col("n").desc(), "first_seen")
    return counted.limit(limit) if limit else counted


def outliers(counts: DataFrame, n_col: str, few: int = 2, many: int = 40) -> DataFrame:
    return counts.where((F.col(n_col) <= few) | (F.col(n_col) >= many))


def status_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("status").agg(F.count("*").alias("n"))


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 40, units: int = 6) -> DataFrame:
    """(doc_id, repeated): whether a unit occurs twice, of at least ``units`` units with ``least`` characters.

    Units are the items of a list like ``1) ...`` if there is one, else the sentences.
    """
    body = t.strip(t.filled(F.col(text_col)))
    items = F.split(body, r"(?mU)^\s*(?=\d{1,3}\)\s+)", -1)
    sents = F.split(body, r"(?U)(?<=[.!?])\s+", -1)
    parts = F.filter(F.transform(F.when(body.rlike(r"(?mU)^\s*\d{1,3}\)\s+"), items).otherwise(sents), t.strip), lambda x: x != "")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(parts)).alias("u"))
    keys = F.transform(F.filter("u", lambda x: F.length(x) >= least), t.sentence_key)
    docs = docs.select("doc_id", F.size("u").alias("n"), F.explode(F.array(keys)).alias("k"))
    return docs.select("doc_id", ((F.col("n") >= units) & (F.size("k") >= units) & (F.size(F.array_distinct("k")) < F.size("k"))).alias("repeated"))


def safe_int(c: Column) -> Column:
    """The whole part of a number in text; 0 for anything else."""
    x = c.cast("string").try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) > 2147483647.0), 0).otherwise(x.cast("int"))


def _settled(family: pd.DataFrame) -> pd.DataFrame:
    """Names of one family of slugs, given in order of count, then title."""
    used, last, out = set(), {}, []
    for slug in family.sort_values(["count", "title"], ascending=[False, True])["slug"]:
        n = last.get(slug, 1)
        name = slug if n == 1 else f"{slug}_{n}"
        while name in used:
            n += 1
            name = f"{slug}_{n}"
        used.add(name)
        last[slug] = n
        out.append(name)
    ordered = family.sort_values(["count", "title"], ascending=[False, True])
    return pd.DataFrame({"title": ordered["title"], "count": ordered["count"], "section_id": out})


#: Rounds in which clashing names are settled together; families that need more, by far the fewest, are settled one by one.
ROUNDS = 12


def _name(slug: str, n: str) -> Column:
    return F.when(F.col(n) == 1, F.col(slug)).otherwise(F.concat_ws("_", slug, n))


def _numbered(met: DataFrame, taken: DataFrame) -> DataFrame:
    """Add n to titles (slug, nth, ...): the nth number that ``taken`` (slug, f) leaves free, and the name that it makes.

    With the r-th smallest number taken, f - r are free before it; so n is nth and as many as have f - r < nth.
    """
    gaps = taken.withColumn("gap", F.col("f") - F.row_number().over(Window.partitionBy("slug").orderBy("f"))).select("slug", "gap")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in met.schema.fields if f.name not in ("slug", "nth")]
    both = met.withColumn("of", F.lit(1)).unionByName(gaps.select("slug", F.col("gap").cast("int").alias("nth"), *empty, F.lit(2).alias("of")))
    # a gap of nth itself comes after the title, so only lesser ones count
    before = Window.partitionBy("slug").orderBy("nth", "of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("n", F.col("nth") + F.count_if(F.col("of") == 2).over(before)).where("of = 1").drop("of")
    return out.withColumn("section_id", _name("slug", "n"))


def _settled_together(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of titles (family, title, count, slug, nth) whose slugs clash, and the families left to be settled in order.

    Settling in order gives each title the first of its names that no earlier title has.  Here all titles claim
    at once: of a name that several claim the earliest title keeps it, and the slugs of the others do without its number.
    This ends in the same names if, at the end, each number that a slug does without is held by a title before those that skip it.
    """
    order = F.struct((-F.col("count")).alias("c"), F.col("title").alias("t"))
    taken = met.select("slug", F.lit(0).cast("long").alias("f")).where("false")
    for _ in range(ROUNDS):
        named = written(_numbered(met, taken).withColumn("o", order))
        first = named.groupBy("section_id").agg(F.min("o").alias("first"), F.count("*").alias("times")).where("times > 1").select("section_id", "first")
        lost = written(named.join(first, "section_id").where("o != first").select("slug", F.col("n").cast("long").alias("f"), "family").distinct())
        if lost.isEmpty():
            break
        taken = written(taken.union(lost.select("slug", "f")).distinct())
    held = named.select(F.col("section_id").alias("held"), "o")
    without = taken.join(named.select("slug", F.col("n").alias("m"), F.col("o").alias("skips"), "family"), "slug").where("m > f").groupBy("slug", "f").agg(F.min("skips").alias("skips"), F.first("family").alias("family"))
    without = without.withColumn("held_name", _name("slug", "f"))
    wrong = without.join(held, F.col("held_name") == F.col("held"), "left").where("o is null or o > skips").select("family")
    left = written(wrong.union(lost.select("family")).distinct())
    return named, left


def unique_slugs(titles: DataFrame) -> DataFrame:
    """(title, count, section_id) from (title, count): slugs, made unique by _2, _3 ... in order of count, then title.

    Names are numbered within each slug.  A name may meet one of another slug only where both are the same but for
    numbers at the end; such titles, and no others, claim their names in rounds, each slug by itself, so that thousands of
    numbered titles don't meet in one task.  Nothing goes to the driver.
    """
    ready = titles.select("title", F.col("count").cast("long").alias("count"), t.slug(t.compatible_form(F.col("title"))).alias("slug"))
    nth = F.row_number().over(Window.partitionBy("slug").orderBy(F.col("count").desc(), "title"))
    named = written(ready.withColumn("nth", nth).withColumn("section_id", _name("slug", "nth")).withColumn("family", F.regexp_replace("slug", r"(_\d+)+$", "")))
    clashing = written(named.groupBy("section_id").agg(F.count("*").alias("times"), F.first("family").alias("family")).where("times > 1").select("family").distinct())
    free = named.join(clashing, "family", "left_anti").select("title", "count", "section_id")
    if clashing.isEmpty():
        return free.orderBy(F.col("count").desc(), "title")
    met = written(named.join(clashing, "family", "left_semi").select("family", "title", "count", "slug", "nth"))
    together, left = _settled_together(met)
    done = together.join(left, "family", "left_anti").select("title", "count", "section_id")
    rest = met.join(left, "family", "left_semi").groupBy("family").applyInPandas(_settled, "title string, count long, section_id string")
    return free.union(done).union(rest).orderBy(F.col("count").desc(), "title")
