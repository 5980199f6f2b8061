"""Whole jobs: a section's prompt from form and corpus, a corpus from documents, and the typing of titles."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import prompts, validate
from scrivener.functions import text as t
from scrivener.operators import cleaning, generate, joins, retrieval, segment, stats
from scrivener.operators.tables import written
from scrivener.sources import files, readers, writers

#: Per section: what retrieves, documents at most, length limits of the cleaner, and words of snippets.
_PLANS: dict[str, tuple] = {
    "payment_terms": (prompts.PAYMENT, retrieval.retrieve_payment_terms, 800, (120, 1800), cleaning.PAYMENT_SNIPPET, 240),
    "delivery_terms": (prompts.DELIVERY, retrieval.retrieve_delivery_terms, 1200, (120, 2200), cleaning.DELIVERY_SNIPPET, 260),
}


def check_form(spark: SparkSession, form: dict) -> list[tuple[str, str]]:
    """(path, rule) of what is wrong with a form."""
    one = spark.createDataFrame([(0, json.dumps(form))], "id int, form string")
    return sorted((r.path, r.rule) for r in validate.form_issues(one, "id", "form").collect())


def section_job(form: dict, corpus: DataFrame, section_id: str, k: int = 7) -> dict[str, DataFrame]:
    """Of one generated section: raw and clean precedents, the cleaner's report, and the prompt (one row)."""
    section, retrieve, max_docs, (least, most), words, longest = _PLANS[section_id]
    raw = retrieve(form, corpus, k, max_docs).select(F.col("rank").alias("seq"), F.col("candidate").alias("text"))
    clean, report = cleaning.clean_precedents(raw, least, most)
    snippets = cleaning.pick_snippets(clean, words, 6, 60, longest)
    listed = snippets.agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "snippet"))), lambda x: x["snippet"]).alias("s"))
    prompt = listed.select(prompts.section_prompt(F.lit(json.dumps(form, ensure_ascii=False)), F.col("s"), section).alias("prompt"))
    return {"raw": raw, "clean": clean, "report": report, "prompt": prompt}


def generate_contract(form: dict, corpus: DataFrame, chat: Callable[[str, str, float, float], str], validators: dict[str, Callable[[str], str | None]], system: str = "", retry_text: str = "") -> str:
    """The contract's text: generated sections by the caller's model and validators, stubs for the others.

    An invalid form raises; a section that stays invalid does too, with its code.
    """
    issues = check_form(corpus.sparkSession, form)
    if issues:
        raise ValueError(f"invalid form: {issues}")
    parts = []
    for name in prompts.SECTIONS:
        if name not in prompts.GENERATED:
            parts.append(prompts.stub(name))
            continue
        prompt = section_job(form, corpus, name)["prompt"].first().prompt
        text, code, attempts = validate.generate_with_retry(chat, system, prompt, validators.get(name), retry_text)
        if code:
            raise ValueError(f"{name}: {code} after {attempts} attempts")
        parts.append(text)
    return "\n\n".join(parts)


def generate_sections(forms: DataFrame, section_id: str, model: generate.Model, check: Callable[[Column], Column], retries: int = 2) -> DataFrame:
    """A section for each of many forms: (id, form, system, user, text, code, attempts).

    ``forms``: (id, form as JSON text, snippets).  System, prompt and what is said after a refusal are in the form's language;
    only forms whose text was refused go on to the next round.
    """
    section = _PLANS[section_id][0]
    english = prompts.is_english(F.col("form"))
    asked = forms.select("id", "form", prompts.system_text(section, english).alias("system"), prompts.section_prompt(F.col("form"), F.col("snippets"), section).alias("user"))
    return generate.in_rounds(asked, model, check, prompts.retry_text(section, english), retries)


def build_corpus(spark: SparkSession, source: str, nested_path: str, flat_path: str, current: bool = True) -> DataFrame:
    """From a folder of DOCX files to nested contracts and flat sections of 80 characters or more, as JSON lines."""
    blocks = readers.read_docx(spark, source).where("error is null").withColumn("doc_id", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.docx$", ""))
    sections = segment.block_sections(blocks.select("doc_id", "pos", "line", "style"), current)
    writers.write_json_lines(writers.nested_contracts(sections), nested_path)
    writers.write_json_lines(writers.flat_corpus(sections), flat_path)
    return sections


def split_folder(spark: SparkSession, source: str) -> DataFrame:
    """(path, order, section, text) of the DOCX files of a folder, by the line fold over their cleaned text."""
    texts = readers.docx_text(readers.read_docx(spark, source).where("error is null"))
    return segment.split_sections(texts.select("path", t.clean_page_text(F.col("text")).alias("text")), "path").withColumnRenamed("doc_id", "path")


def heal_folder(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """Healed blocks and a report of the DOCX files of a folder; files that can't be read are reported as errors."""
    # a table, so that files are read and healed once for the blocks, the report and the errors
    every = written(segment.heal_blocks(readers.read_docx(spark, source).select(F.col("path").alias("doc_id"), "pos", "line", "style", "error")))
    healed = every.where("error is null").drop("error")
    broken = every.where("error is not null").select("doc_id", F.concat(F.lit("error: "), "error").alias("status"), F.lit(False).alias("changed"), F.lit(0).cast("long").alias("headings_set"), F.lit(0).cast("long").alias("splits_done"))
    return healed, segment.heal_report(healed).unionByName(broken)


def write_healed(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Heal the DOCX files of a folder into those of a new one, under their own names, and give the report."""
    healed, report = heal_folder(spark, source)
    stem = F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\.docx$", "")
    files.write_files(files.docx_files(healed.withColumn("doc_id", stem)), target)
    return report


def type_titles(spark: SparkSession, source: str, title_map_path: str) -> tuple[DataFrame, DataFrame]:
    """segments (contract_id, order, section_title, section_id, text, source, confidence) and a report.

    DOCX files by headings, JSON files by their lists; titles by keyword, exact or fuzzy match.
    """
    to_id, _ = joins.title_map(readers.read_title_map(spark, title_map_path))
    stem = lambda suffix: F.regexp_replace(F.element_at(F.split("path", "/"), -1), rf"\.{suffix}$", "")
    blocks = readers.read_docx(spark, source).withColumn("doc_id", stem("docx"))
    docx = segment.titled_segments(blocks.where("error is null").select("doc_id", "pos", "line", "style")).withColumn("source", F.lit("docx"))
    contracts = readers.read_json_contracts(spark, source).withColumn("doc_id", stem("json"))
    listed = contracts.where("sections is not null").select("doc_id", F.posexplode("sections").alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("order"), F.col("s.title").alias("section_title"), F.col("s.text").alias("text"), F.lit("json").alias("source"))
    every = docx.select("doc_id", "order", "section_title", "text", "source").unionByName(listed)
    typed = joins.route_or_match(every, to_id)
    segments = typed.select(F.col("doc_id").alias("contract_id"), "order", t.bare_title(F.col("section_title")).alias("section_title"), "section_id", "text", "source", writers.confidence_text(F.col("confidence")).alias("confidence"))
    counts = every.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    seen = blocks.groupBy("doc_id").agg(F.max("error").alias("error")).select("doc_id", F.lit("docx").alias("source"), "error", F.when(F.col("error").isNotNull(), "parse_error").alias("bad")).unionByName(contracts.select("doc_id", F.lit("json").alias("source"), F.lit(None).cast("string").alias("error"), F.when(F.col("status") != "ok", F.col("status")).alias("bad")))
    joined = seen.join(counts, ["doc_id", "source"], "left")
    report = joined.select(F.col("doc_id").alias("contract_id"), "source", F.coalesce("bad", F.when(F.col("n") > 0, "ok").otherwise("zero_segments")).alias("status"), F.coalesce("n", F.lit(0)).alias("segments_count"), F.coalesce("error", F.lit("")).alias("error"))
    return segments, report


def build_title_map(segments: DataFrame) -> DataFrame:
    """(section_id, title, count) of the normalised titles of segments."""
    titles = segments.select(t.title_key(F.col("section_title"), "number").alias("title")).where("title != ''").groupBy("title").agg(F.count("*").alias("count"))
    return stats.unique_slugs(titles).select("section_id", "title", "count")
