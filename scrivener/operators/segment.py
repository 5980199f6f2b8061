"""Segmentation of ordered lines or blocks into titled sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import predicates as p
from scrivener.functions import text as t


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, line) of the non-empty lines, stripped."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(t.lines(F.col(text_col))).alias("pos", "line"))


def number_segments(segments: DataFrame, by: str = "doc_id", order: str = "pos") -> DataFrame:
    """Add ``order``, counted from 1 within each document."""
    return segments.withColumn("order", F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("int"))


def split_sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, order, section, text): a document's lines under their headings, from the title PREFACE.

    A listed, addendum or capital heading that another heading with other words follows makes one title of
    both.  Capitals count as headings only while the title is PREFACE.  Sections without body go; a document
    with text but without sections is one FULL_TEXT.
    """
    each = docs.select(F.col(id_col).alias("doc_id"), t.filled(F.col(text_col)).alias("text")).select("doc_id", "text", F.explode(F.array(F.transform(t.lines(F.col("text")), t.narrow))).alias("lines"))
    # without a body all lines are headings, which few documents are: only these take their text along
    rows = each.select("doc_id", F.when(F.forall("lines", lambda y: p.heading(y, True)), t.strip(F.col("text"))).alias("bare"), F.posexplode("lines").alias("pos", "line"))
    x, by = F.col("line"), Window.partitionBy("doc_id").orderBy("pos")
    upto, before = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("doc_id", "bare", "pos", "line", (p.listed_heading(x) | p.addendum(x) | p.all_caps_heading(x)).alias("opens"), p.heading(x, True).alias("any"), p.heading(x, False).alias("plain"))
    ahead = rows.withColumn("next", F.lead("line").over(by)).withColumn("could", F.col("opens") & F.coalesce(F.lead("any").over(by), F.lit(False)) & (F.lower("line") != F.lower(F.coalesce("next", "line"))))
    # of a run of lines that could pair with the next one, every other does: the one between is taken
    paired = ahead.withColumn("pair", F.col("could") & ((F.col("pos") - F.coalesce(F.max(F.when(~F.col("could"), F.col("pos"))).over(upto), F.lit(-1))) % 2 == 1))
    paired = paired.withColumn("taken", F.coalesce(F.lag("pair").over(by), F.lit(False))).withColumn("title", F.when(F.col("pair"), F.concat("line", F.lit(" / "), "next")).otherwise(F.col("line")))
    leaves = ~F.col("taken") & (F.col("pair") | F.col("any")) & (F.col("title") != "PREFACE")
    past = F.coalesce(F.max(leaves).over(before), F.lit(False))
    headed = paired.withColumn("head", ~F.col("taken") & (F.col("pair") | F.when(past, F.col("plain")).otherwise(F.col("any"))))
    named = headed.withColumn("no", F.sum(F.col("head").cast("int")).over(upto)).withColumn("section", F.coalesce(F.last(F.when(F.col("head"), F.col("title")), ignorenulls=True).over(upto), F.lit("PREFACE")))
    named = named.withColumn("body", ~F.col("head") & ~F.col("taken"))
    whole = (F.col("pos") == 0) & (F.col("bare") != "") & ~F.max("body").over(Window.partitionBy("doc_id"))
    named = named.withColumn("whole", F.coalesce(whole, F.lit(False))).where("body or whole")
    line, section = F.when(F.col("whole"), F.col("bare")).otherwise(F.col("line")), F.when(F.col("whole"), "FULL_TEXT").otherwise(F.col("section"))
    bodies = named.select("doc_id", "no", "pos", section.alias("section"), line.alias("line")).groupBy("doc_id", "no", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda b: b["line"]), "\n").alias("text"))
    return number_segments(bodies, "doc_id", "no").select("doc_id", "order", "section", "text")


def _titled(blocks: DataFrame, is_heading: Column, title: Column, merge_same: bool) -> DataFrame:
    """Blocks with the number of their section and its title, by a running sum over the document."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    b = blocks.withColumn("_h", is_heading).withColumn("_title", F.when(F.col("_h"), title))
    key = t.fold_case(t.plain_spaces(F.col("_title")))
    before = F.last(F.when(F.col("_h"), key), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # a repeated title opens nothing, even after a body, and is no body line either
    b = b.withColumn("_opens", F.col("_h") & (~key.eqNullSafe(before) if merge_same else F.lit(True)))
    b = b.withColumn("_no", F.sum(F.col("_opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return b.withColumn("_name", F.last(F.when(F.col("_opens"), F.col("_title")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def block_sections(blocks: DataFrame, current: bool = True, dedupe: bool = True, first_title: str = "Preamble") -> DataFrame:
    """(doc_id, order, title, section_id, section_group, language, text) from blocks (doc_id, pos, line[, style]).

    ``current``: headings by style too, equal neighbouring titles merge, repeated lines and echoes of the title
    go (``dedupe``).  Else the older rule.  Sections without body go.
    """
    style = F.col("style") if current and "style" in blocks.columns else None
    line = t.plain_spaces(F.col("line")) if current else t.strip(F.col("line"))
    blocks = blocks.withColumn("line", line).where("line != ''")
    if current:
        is_heading = p.block_heading(F.col("line"), style) & ~p.noise_block(F.col("line"))
        title = t.title_key(F.col("line"), "colon")
    else:
        is_heading = p.block_heading(F.col("line"), None, 120, 2, 3, 0.85, 80, 80) & ~p.noise_block(F.col("line"))
        title = t.title_key(F.regexp_replace("line", ":+$", ""))
    named = _titled(blocks, is_heading, title, current).withColumn("_name", F.coalesce("_name", F.lit(first_title)))
    bodies = named.where("not _h").groupBy("doc_id", "_no", "_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("_lines"))
    rows = t.drop_title_echo(F.col("_name"), t.dedupe_lines(F.col("_lines"), 25)) if current and dedupe else F.col("_lines")
    made = bodies.select("doc_id", "_no", F.col("_name").alias("title"), t.strip(F.array_join(rows, "\n")).alias("text")).where("text != ''")
    routed = made.withColumn("r", p.title_route(F.col("title")))
    out = routed.select("doc_id", F.col("_no").alias("pos"), "title", "r.section_id", "r.section_group", p.language_by_ratio(F.col("text")).alias("language"), "text")
    return number_segments(out).drop("pos")


def titled_segments(blocks: DataFrame, is_heading: Callable[[Column, Column], Column] = p.paragraph_heading, noise: Callable[[Column], Column] | None = p.noise_heading) -> DataFrame:
    """(doc_id, order, section_title, text) from blocks (doc_id, pos, line[, style]).

    Lines before any heading are PREFACE; of consecutive headings the last names the section; no empty ones.
    """
    style = F.col("style") if "style" in blocks.columns else F.lit(None).cast("string")
    blocks = blocks.withColumn("line", t.strip(F.col("line"))).where("line != ''")
    found = is_heading(F.col("line"), style)
    if noise is not None:
        found = found & ~noise(F.col("line"))
    named = _titled(blocks, found, F.col("line"), False).where("not _h")
    rows = named.groupBy("doc_id", "_no").agg(F.first("_name", True).alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
    made = rows.select("doc_id", F.col("_no").alias("pos"), F.coalesce("name", F.lit("PREFACE")).alias("section_title"), F.array_join("lines", "\n").alias("text"))
    return number_segments(made).drop("pos").select("doc_id", "order", "section_title", "text")


def heal_blocks(blocks: DataFrame, longest: int = 160) -> DataFrame:
    """Blocks (doc_id, pos, line, style) with headings set: adds sub, changed, heading_set, split.

    A paragraph of several lines whose first is a heading, with a body that is not short and itself a heading,
    becomes two blocks.  A whole paragraph that is a heading of at most ``longest`` characters gets the form and
    style of one.
    """
    carried = ["doc_id", "pos", *(c for c in ("error",) if c in blocks.columns)]
    # each form of a line and each level is a column of its own, worked out once
    b = blocks.select(*carried, "line", "style", t.lines(F.col("line")).alias("_parts"), t.canonical_heading(F.col("line")).alias("_canonical"))
    b = b.withColumn("_first", F.get("_parts", F.lit(0))).withColumn("_rest", F.array_join(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), "\n"))
    several, filled = (F.size("_parts") >= 2) & F.col("line").contains("\n"), F.size("_parts") > 0
    b = b.withColumn("_upper", F.when(several, p.heading_level(F.col("_first"))))
    b = b.withColumn("_splits", F.when(F.col("_upper").isNotNull(), ~((F.length("_rest") < 20) & p.heading_level(F.col("_rest")).isNotNull())).otherwise(False))
    b = b.withColumn("_level", F.when(filled & ~F.col("_splits") & (F.length("_canonical") <= longest), p.heading_level(F.col("_canonical"))))
    canonical, level = F.col("_canonical"), F.col("_level")
    was_styled = F.coalesce(F.col("style").startswith("Heading"), F.lit(False))
    row = lambda sub, line, style, changed, set_, split: F.struct(F.lit(sub).alias("sub"), line.alias("line"), style.alias("style"), changed.alias("changed"), F.lit(set_).alias("heading_set"), F.lit(split).alias("split"))
    name = lambda n: F.concat(F.lit("Heading "), n.cast("string"))
    two = F.array(row(0, t.canonical_heading(F.col("_first")), name(F.coalesce("_upper", F.lit(1))), F.lit(True), True, True), row(1, t.unify_dashes(F.col("_rest")), F.col("style"), F.lit(False), False, False))
    whole = F.array(row(0, canonical, F.when(was_styled, F.col("style")).otherwise(name(level)), (F.col("line") != canonical) | ~was_styled, True, False))
    same = F.array(row(0, F.col("line"), F.col("style"), F.lit(False), False, False))
    return b.select(*carried, F.explode(F.when(F.col("_splits"), two).when(level.isNotNull(), whole).otherwise(same)).alias("x")).select(*carried, "x.*")


def heal_report(healed: DataFrame) -> DataFrame:
    """(doc_id, status, changed, headings_set, splits_done) of each document."""
    counted = healed.groupBy("doc_id").agg(F.max("changed").alias("changed"), F.count_if("heading_set").alias("headings_set"), F.count_if("split").alias("splits_done"))
    return counted.select("doc_id", F.when(F.col("headings_set") > 0, "ok").otherwise("no_candidates").alias("status"), "changed", "headings_set", "splits_done")
