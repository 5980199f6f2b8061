"""Registered queries, each over whole tables, and the DuckDB SQL that some are compared with.

A document's title is its first line and its body the rest; doc_id is its place in the corpus.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrivener.functions import predicates as p
from scrivener.functions import text as t
from scrivener.functions import validate
from scrivener.operators import cleaning, joins, retrieval, search, segment, stats
from scrivener.operators.tables import spread, written
from scrivener.plans import pipelines
from scrivener.plans import sql as q
from scrivener.sources import files, readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def titled(docs: DataFrame) -> DataFrame:
    """Corpus rows of the documents table."""
    title = F.substring_index("text", "\n", 1)
    body = F.when(F.instr("text", "\n") > 0, F.substring(F.col("text"), F.length(title) + 2, F.length("text"))).otherwise("")
    return docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("section_group"), F.lit("").alias("section_id"), F.col("lang").alias("language"), title.alias("title"), body.alias("text"))


TITLE = "split_part(text, chr(10), 1)"
BODY = "case when instr(text, chr(10)) > 0 then substr(text, length(split_part(text, chr(10), 1)) + 2) else '' end"
WORDS = "regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9]+')"

# ---- retrieval

#: A query with a repeated term, so that it counts twice.
ASKED = ["the", "that", "de", "und", "tion", "the", "http", "license"]


def _bm25_sql(corpus: str, terms: list[str], limit: int) -> str:
    values = ", ".join(f"('{w}')" for w in terms)
    return f"""
with corpus as ({corpus}),
w as (select doc_id, unnest({WORDS}) as term from corpus),
tf as (select doc_id, term, count(*) as tf from w group by doc_id, term),
dl as (select c.doc_id, coalesce(s.n, 0) as dl from corpus c left join (select doc_id, count(*) as n from w group by doc_id) s on s.doc_id = c.doc_id),
st as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by term),
q as (select * from (values {values}) v(term)),
sc as (select tf.doc_id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avgdl))) as score
  from q join tf on tf.term = q.term join df on df.term = q.term join dl on dl.doc_id = tf.doc_id cross join st group by tf.doc_id)
select doc_id, cast(row_number() over (order by round(score, 9) desc, doc_id) as integer) as rank, round(score, 6) as score from sc where score > 0
qualify row_number() over (order by round(score, 9) desc, doc_id) <= {limit}"""


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("seq").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("bm25_topk", _bm25_sql("select doc_id, text from documents", ASKED, 50))
def bm25_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    return _ranked(retrieval.bm25_search(docs, F.col("text"), ASKED, 50))


@query("bm25_filtered", _bm25_sql(f"select doc_id, text from documents where lang in ('en', 'bilingual') and length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 80 and (contains(lower(text), 'the')::int + contains(lower(text), 'and')::int + contains(lower(text), 'tion')::int + contains(lower(text), 'of')::int) >= 3 order by doc_id limit 3000", ASKED, 25))
def bm25_filtered(spark, sf_dir):
    """Language, length and domain filters and a prefix come before the index, and so change its statistics."""
    rows = titled(table(spark, sf_dir, "documents"))
    whole = F.concat(F.col("title"), F.lit("\n"), F.col("text"))
    fit = rows.where(p.language_matches("en", F.col("language")) & p.long_enough(whole)).where(t.count_words(F.lower(whole), ["the", "and", "tion", "of"]) >= 3)
    return _ranked(retrieval.bm25_search(retrieval.first_of(fit, 3000), whole, ASKED, 25))


@query("idf_table", f"""
with w as (select distinct doc_id, unnest({WORDS}) as term from documents), n as (select count(*) as n from documents)
select term, cast(count(*) as bigint) as df, round(ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)), 6) as idf from w cross join n group by term""")
def idf_table(spark, sf_dir):
    return retrieval.idf_table(table(spark, sf_dir, "documents"), F.col("text"), "doc_id").select("term", "df", F.round("idf", 6).alias("idf"))


@query("postings", f"""
with w as (select doc_id, unnest({WORDS}) as term from documents)
select term, cast(count(distinct doc_id) as bigint) as docs, cast(count(*) as bigint) as occurrences, cast(max(tf) as bigint) as most from (select *, count(*) over (partition by doc_id, term) as tf from w) group by term""")
def postings(spark, sf_dir):
    posted = retrieval.postings(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return posted.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"), F.max("tf").alias("most"))


@query("tfidf_topk", r"""
with a as (select doc_id, regexp_extract_all(lower(text), '[0-9_\p{L}\p{M}\p{N}]{2,}') as w from documents),
g as (select doc_id, unnest(list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda x: x[1] || ' ' || x[2]))) as term from a),
tf as (select doc_id, term, count(*) as tf from g group by doc_id, term),
n as (select count(*) as n from documents),
df as (select term, count(*) as df, any_value(n) as n from tf cross join n group by term having count(*) >= 2 and count(*) <= 0.9 * any_value(n)),
i as (select term, ln((1 + n) / (1 + df)) + 1 as idf from df),
wt as (select doc_id, tf.term, tf * idf as w, idf from tf join i on i.term = tf.term),
q as (select term, count(*) as qf from (select unnest(['license', 'the', 'worthless', 'the license', 'license the', 'the worthless']) as term) group by term),
qw as (select q.term, qf * idf as qw from q join i on i.term = q.term),
qn as (select sqrt(sum(qw * qw)) as qn from qw),
s as (select wt.doc_id, sum(w * coalesce(qw, 0)) as dot, sqrt(sum(w * w)) as norm from wt left join qw on qw.term = wt.term group by wt.doc_id),
r as (select d.doc_id, coalesce(round(dot / (norm * qn), 9), 0) as score from documents d left join s on s.doc_id = d.doc_id cross join qn)
select doc_id, round(score, 6) as score from r order by r.score desc, doc_id limit 20""")
def tfidf_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    hits = retrieval.tfidf_search(docs, F.col("text"), "License the worthless", 20)
    return hits.select(F.col("seq").alias("doc_id"), F.round("score", 6).alias("score"))


FORM = {"language_mode": "en", "currency": "USD", "payment": {"prepayment_required": True, "currency": "USD"}}


_MASKED_ONLY = q.replaced("text", ("(?i)USD", "[CURRENCY]"), (r"(?i)\b(\d{1,4})\s*(day|days)\b", r"[TERM_DAYS] \2"), (r"\b(\d{1,3})\s*%", "[PERCENT]%"), (f"\\b\\d{{1,3}}(?:[ {t.NBSP}]\\d{{3}})*(?:[.,]\\d{{1,2}})?\\b", "[AMOUNT]"))
_MASKED = q.strip(q.replaced("text", ("(?i)USD", "[CURRENCY]"), (r"(?i)\b(\d{1,4})\s*(day|days)\b", r"[TERM_DAYS] \2"), (r"\b(\d{1,3})\s*%", "[PERCENT]%"), (f"\\b\\d{{1,3}}(?:[ {t.NBSP}]\\d{{3}})*(?:[.,]\\d{{1,2}})?\\b", "[AMOUNT]"), (r"[ \t\r\f\v]+", " ")))


@query("diverse_topk", q.diverse(f"with bm as ({_bm25_sql('select doc_id, text from documents', ASKED, 80)}), hits as (select bm.rank, d.source, {_MASKED} as candidate from bm join documents d on d.doc_id = bm.doc_id)", WORDS.replace("text", "candidate")))
def diverse_topk(spark, sf_dir):
    """BM25 hits, masked, at most one of each source, none like another."""
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    hits = retrieval.bm25_search(docs, F.col("text"), ASKED, 80)
    rows = docs.join(F.broadcast(hits), "seq").select("rank", F.col("source").alias("doc_id"), retrieval.mask_form_values(F.col("text"), FORM).alias("candidate"))
    return retrieval.diverse_top_k(rows, 10).select("rank", F.col("doc_id").alias("source"), F.md5("candidate").alias("candidate_md5"))


#: What users say in the conversations, as queries.
_ASKED_SQL = "select conv_id * 1000 + turn as q, text from conversations where role = 'user'"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("q"), F.col("text").alias("query"))


def _many_sql(limit: int) -> str:
    return f"""
with w as (select doc_id, unnest({WORDS}) as term from documents),
tf as (select doc_id, term, count(*) as tf from w group by doc_id, term),
dl as (select d.doc_id, coalesce(s.n, 0) as dl from documents d left join (select doc_id, count(*) as n from w group by doc_id) s on s.doc_id = d.doc_id),
st as (select count(*) as n, avg(dl) as avgdl from dl),
df as (select term, count(*) as df from tf group by term),
a as (select q, unnest({WORDS}) as term from ({_ASKED_SQL})),
q as (select q, term, count(*) as times from a group by q, term),
sc as (select q.q, tf.doc_id, sum(q.times * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * dl.dl / st.avgdl))) as score
  from q join tf on tf.term = q.term join df on df.term = q.term join dl on dl.doc_id = tf.doc_id cross join st group by q.q, tf.doc_id)
select q, doc_id, cast(row_number() over (partition by q order by round(score, 9) desc, doc_id) as integer) as rank, round(score, 6) as score from sc where score > 0
qualify row_number() over (partition by q order by round(score, 9) desc, doc_id) <= {limit}"""


@query("bm25_many", _many_sql(10))
def bm25_many(spark, sf_dir):
    """The ten best documents for each thing a user said."""
    index = search.build_index(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return search.search(index, asked(spark, sf_dir), 10).select("q", F.col("seq").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query("diverse_many", q.diverse_each(f"with h as materialized ({_many_sql(24)}), m as materialized (select doc_id, source, {_MASKED} as candidate from documents)", WORDS.replace("text", "candidate"), 3))
def diverse_many(spark, sf_dir):
    """Of each user's hits three, masked, of different sources, none like another."""
    docs = table(spark, sf_dir, "documents")
    hits = written(search.search(search.build_index(docs, F.col("text"), "doc_id"), asked(spark, sf_dir), 24).select("q", "rank", "seq"))
    # a document is masked once, however many users it answers
    found = docs.join(hits.select(F.col("seq").alias("doc_id")).distinct(), "doc_id", "left_semi")
    masked = spread(found, "doc_id").select(F.col("doc_id").alias("seq"), F.col("source").alias("doc_id"), F.explode(F.array(retrieval.mask_form_values(F.col("text"), FORM))).alias("candidate"))
    held = written(masked.select("seq", "doc_id", F.md5("candidate").alias("candidate_md5"), retrieval.shingle_hashes(F.col("candidate")).alias("s")))
    chosen = retrieval.diverse_each(hits, held.drop("candidate_md5"), 3)
    return chosen.join(held, "seq").select("q", "rank", F.col("doc_id").alias("source"), "candidate_md5")


_UNGLUED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([,;:])([A-Za-zА-Яа-яЁё])', '\1 \2', 'g'), '([A-Za-zА-Яа-яЁё])(\d)', '\1 \2', 'g'), '(\d)([A-Za-zА-Яа-яЁё])', '\1 \2', 'g'), '([А-Яа-яЁё])([A-Za-z])', '\1 \2', 'g'), '([A-Za-z])([А-Яа-яЁё])', '\1 \2', 'g')"


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a contract's section: shorter ones begin with a clause on payment, longer ones on delivery."""
    size = F.col("n_chars")
    kind = lambda a, b, c: F.when(size < 900, a).when(size < 2500, b).otherwise(c)
    title, first = F.concat(kind("Payment of ", "Delivery to ", "Notes of "), "source"), kind(*_CLAUSES, "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("section_group"), F.when((size >= 900) & (F.col("lang") == "bilingual"), "delivery_terms").otherwise("").alias("section_id"), F.lit("en").alias("language"), title.alias("title"), F.concat(first, "text").alias("text"))


_CLAUSES = ("Payment is due by bank transfer on the invoice; prepayment, VAT and penalty interest apply. ", "Delivery and dispatch follow the schedule; packaging, marking, storage and acceptance are at the risk of the carrier. ")


def _retrieval_sql(words_for, words_against, terms: list[str], squash: str = "") -> str:
    """``squash`` names a function of the engine that squashes repeats, which SQL itself can't say; tests give one."""
    bag = lambda words: "(" + " + ".join(f"contains(low, '{w}')::int" for w in words) + ")"
    kind = lambda a, b, c: f"case when n_chars < 900 then '{a}' when n_chars < 2500 then '{b}' else '{c}' end"
    body = _UNGLUED.replace("(text,", "(regexp_replace(y, '\\[[^\\]]{1,120}\\]', '', 'g'),")
    collapse = lambda x: q.strip(f"regexp_replace({x}, '[ \\t\\r\\f\\v]+', ' ', 'g')")
    lean = collapse(f"{squash}({collapse(body)})") if squash else collapse(body)
    masked = collapse(f"{squash}({_MASKED_ONLY})") if squash else _MASKED
    return f"""c as (select doc_id, {kind('Payment of ', 'Delivery to ', 'Notes of ')} || source as title, {kind(*_CLAUSES, '')} || text as text from documents),
x as (select *, regexp_replace(regexp_replace({q.strip('text')}, '\\r\\n?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') as y from c where length({q.strip('text')}) >= 80),
v as materialized (select doc_id, title, {lean} as z from x), u as materialized (select doc_id, title, {q.smart_truncated('z', 2600)} as text from v),
k as (select *, lower(title || chr(10) || text) as low from u), d as (select * from k where {bag(words_for)} >= 4 and ({bag(words_against)} < 3 or {bag(words_for)} >= 7)),
bm as ({_bm25_sql("select doc_id, title || chr(10) || text as text from d", terms, 56)}),
hits as (select bm.rank, cast(d.doc_id as varchar) as source, {masked} as candidate from bm join d on d.doc_id = bm.doc_id)"""


def retrieval_sql(words_for, words_against, asked: str, squash: str) -> str:
    return q.diverse("with " + _retrieval_sql(words_for, words_against, retrieval._query_tokens(asked), squash), WORDS.replace("text", "candidate"), 7, "doc_id")


@query("retrieve_payment_terms")
def retrieve_payment_terms(spark, sf_dir):
    found = retrieval.retrieve_payment_terms(FORM, clauses(spark, sf_dir), 7, None)
    return found.select("rank", "doc_id", F.md5("candidate").alias("candidate_md5"))


@query("retrieve_delivery_terms")
def retrieve_delivery_terms(spark, sf_dir):
    """Sections labelled as delivery come first, which the tables may lack; then those of the domain."""
    return retrieval.retrieve_delivery_terms(FORM, clauses(spark, sf_dir), 7, None).select("rank", "doc_id", F.md5("candidate").alias("candidate_md5"))


@query("shingle_jaccard_pairs", f"""
with w as (select doc_id, {WORDS} as w from documents),
s as (select doc_id, list_distinct(list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i:i + 6], ' '))) as s from w where len(w) >= 7),
u as (select doc_id, len(s) as n, unnest(s) as g from s),
c as (select x.doc_id as a, y.doc_id as b, x.n as na, y.n as nb, count(*) as k from u x join u y on x.g = y.g and x.doc_id < y.doc_id group by x.doc_id, y.doc_id, x.n, y.n),
e as (select a, b from c where k = na and k = nb), rep as (select b, min(a) as a from e group by b)
select a, b, round(k / (na + nb - k), 6) as similarity from c where k / (na + nb - k) >= 0.55
  and ((k = na and k = nb and a not in (select b from rep)) or (not (k = na and k = nb) and a not in (select b from rep) and b not in (select b from rep)))""")
def shingle_jaccard_pairs(spark, sf_dir):
    """Similar pairs between classes of equal shingle sets; the members of a class come as pairs with its first."""
    found = retrieval.similar_pairs(table(spark, sf_dir, "documents"), F.col("text"), 7, 0.55, "doc_id")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("prioritised_union_dedup", """
with u as (select 0 as prio, doc_id as seq, text from documents where lang = 'de' union all select 1, doc_id, text from documents where n_chars < 2000),
r as (select *, row_number() over (partition by substr(text, 1, 160) order by prio, seq) as n from u)
select cast(prio as integer) as prio, seq from r where n = 1""")
def prioritised_union_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    return retrieval.prioritised_union([docs.where("lang = 'de'"), docs.where("n_chars < 2000")], [F.substring("text", 1, 160)]).select("prio", "seq")


# ---- text functions: the MD5 of the result per document

def _text_query(name: str, make: Callable[[Column], Column], sql: str | None = None):
    @query(name, f"select doc_id, md5({sql}) as result_md5 from documents" if sql else None)
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", F.md5(make(F.col("text"))).alias("result_md5"))


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\v]+|[\s\v]+$', '', 'g')"


_text_query("collapse_blanks", t.collapse_blanks, _sql_strip(r"regexp_replace(text, '[ \t\r\f\v]+', ' ', 'g')"))
_text_query("unify_newlines", t.unify_newlines, r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")
_text_query("tidy_spaces", t.tidy, _sql_strip(r"regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"))
_text_query("plain_spaces", t.plain_spaces, _sql_strip(r"regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g')"))
_text_query("narrow_spaces", t.narrow, rf"regexp_replace({_sql_strip('text')}, '[\s\v]{{2,}}', ' ', 'g')")
_PAGE = _sql_strip(r"regexp_replace(array_to_string(list_transform(regexp_split_to_array(regexp_replace(text, '(?i)Page\s+\d+\s+of\s+\d+', '', 'g'), '\r\n|[\n\r\v\f]'), lambda x: regexp_replace(regexp_replace(x, '\s{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")
_text_query("clean_page_text", t.clean_page_text, _PAGE)
_text_query("unify_dashes", t.unify_dashes, _sql_strip(r"regexp_replace(regexp_replace(regexp_replace(translate(text, '–—−' || chr(160) || chr(173), '--- '), '[ \t]+', ' ', 'g'), '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g')"))
_text_query("unglue_words", t.unglue, _UNGLUED)
_text_query("strip_placeholders", t.drop_placeholders, r"regexp_replace(text, '\[[^\]]{1,120}\]', '', 'g')")
_text_query("number_lines", t.number_lines, _sql_strip(rf"regexp_replace(regexp_replace({_sql_strip('text')}, '\n\s*\n+', chr(10), 'g'), '(?m)^\s*(\d+\.\d+)\.?\s+', '\1. ', 'g')"))
_text_query("canonical_heading", t.canonical_heading, q.canonical("text"))
_text_query("smart_truncate", lambda c: t.smart_truncate(c, 2600), q.smart_truncated("text", 2600))
_text_query("squash_repeats", lambda c: t.squash_repeats(35, 220)(c))
_text_query("truncate_at_sentence", lambda c: t.truncate_at_sentence(c, 1500), f"list_transform([{q.tidy('text')}], lambda y: list_transform([{q.sentences('y')}], lambda z: {q.truncated('y', 'z', 1500)})[1])[1]")
_text_query("dedupe_lines_window", lambda c: F.array_join(t.dedupe_lines(t.lines(c), 30), "\n"), f"array_to_string({q.deduped(q.lines('text'), 30)}, chr(10))")
_text_query("drop_heading_echo", t.drop_heading_echo, q.strip(f"array_to_string({q.without_echo(q.lines('text'))}, chr(10))"))
_text_query("mask_numbers", retrieval.mask_numbers, q.replaced("text", (r"(?i)\b(\d{1,4})\s*(day|days)\b", r"[TERM_DAYS] \2"), (r"\b(\d{1,3})\s*%", "[PERCENT]%"), (f"\\b\\d{{1,3}}(?:[ {t.NBSP}]\\d{{3}})*(?:[.,]\\d{{1,2}})?\\b", "[AMOUNT]")))
_text_query("sentence_list", lambda c: F.array_join(t.sentences(c), "\n"), rf"regexp_replace(trim(regexp_replace({_sql_strip('text')}, '[\s\v]+', ' ', 'g')), '([.!?]) ([A-ZА-ЯЁ0-9])', '\1' || chr(10) || '\2', 'g')")
_text_query("bare_title", lambda c: t.bare_title(F.substring_index(c, "\n", 1)), q.bare_title(TITLE))
_SLUG = rf"(with s as (select regexp_replace(regexp_replace(lower({_sql_strip(TITLE)}), '[^\p{{L}}\p{{M}}\p{{N}}_]+|_+', '_', 'g'), '^_+|_+$', '', 'g') as s) select case when s = '' then 'empty' when regexp_matches(s, '^\d') then 's_' || s else s end from (select regexp_replace(s, '_+', '_', 'g') as s from s))"
_text_query("slug_title", lambda c: t.slug(t.compatible_form(F.substring_index(c, "\n", 1))), _SLUG)
_text_query("first_word_after_number", lambda c: t.first_word_after_number(F.substring_index(c, "\n", 1)), rf"split_part({_sql_strip(rf'lower(regexp_replace({_sql_strip(TITLE)}, ' + chr(39) + chr(94) + r'\d+(\.\d+)*[.)]\s*' + chr(39) + ', ' + chr(39) * 2 + '))')}, ' ', 1)")


@query("token_counts", f"""
select doc_id, cast(len({WORDS}) as bigint) as tokens, cast(len(list_distinct({WORDS})) as bigint) as distinct_tokens, cast(length(regexp_replace(text, '[\\s\\v]+', '', 'g')) as bigint) as dense from documents""")
def token_counts(spark, sf_dir):
    words = t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("tokens"), F.size(F.array_distinct(words)).cast("long").alias("distinct_tokens"), t.dense_length(F.col("text")).cast("long").alias("dense"))


# ---- classifiers

@query("language_filter", "select doc_id, lang from documents where lang in ('ru', 'en', 'bilingual')")
def language_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(p.language_matches("bilingual", F.col("lang"))).select("doc_id", "lang")


_BAG = ["the", "and", "tion", "re", "re", "of"]
_AGAINST = ["!!", "http", "@", "license"]


def _bag_sql(words: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::int" for w in words)


@query("keyword_filter", f"select doc_id from documents where ({_bag_sql(_BAG)}) >= 4 and (({_bag_sql(_AGAINST)}) < 1 or ({_bag_sql(_BAG)}) >= 6)")
def keyword_filter(spark, sf_dir):
    rows = titled(table(spark, sf_dir, "documents"))
    return rows.where(p.in_domain(F.col("title"), F.col("text"), _BAG, _AGAINST, 4, 1, 6)).select(F.col("seq").alias("doc_id"))


def _counts_sql(words) -> str:
    return "cast(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in words) + " as integer)"


@query("payment_delivery_domains", f"select doc_id, {_counts_sql(p.PAYMENT_FOR)} as payment_for, {_counts_sql(p.PAYMENT_AGAINST)} as payment_against, {_counts_sql(p.DELIVERY_FOR)} as delivery_for, {_counts_sql(p.DELIVERY_AGAINST)} as delivery_against from documents")
def payment_delivery_domains(spark, sf_dir):
    rows = titled(table(spark, sf_dir, "documents"))
    low = F.lower(F.concat_ws("\n", "title", "text"))
    return rows.select(F.col("seq").alias("doc_id"), t.count_words(low, p.PAYMENT_FOR).alias("payment_for"), t.count_words(low, p.PAYMENT_AGAINST).alias("payment_against"), t.count_words(low, p.DELIVERY_FOR).alias("delivery_for"), t.count_words(low, p.DELIVERY_AGAINST).alias("delivery_against"))


@query("min_length_filter", f"select doc_id from documents where length({_sql_strip('text')}) >= 80")
def min_length_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(p.long_enough(F.col("text"))).select("doc_id")


_RATIO = "case when length(regexp_replace(lower(x), '[^a-z]', '', 'g')) > length(regexp_replace(lower(x), '[^а-яё]', '', 'g')) and length(regexp_replace(lower(x), '[^a-z]', '', 'g')) > 20 then 'en' else 'ru' end"


@query("infer_language_ratio", f"select doc_id, {_RATIO} as inferred from (select doc_id, text as x from documents)")
def infer_language_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", p.language_by_ratio(F.col("text")).alias("inferred"))


@query("infer_language_any_latin", "select page_id, case when regexp_matches(html, '[A-Za-z]') then 'en' else 'ru' end as inferred from pages")
def infer_language_any_latin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", p.language_by_any_latin(F.col("html")).alias("inferred"))


def _route_sql() -> str:
    whens = lambda k: " ".join("when " + " or ".join(f"contains(x, '{w}')" for w in r[2]) + f" then '{r[k]}'" for r in p.TITLE_ROUTES)
    return f"select doc_id, case {whens(0)} else '' end as section_id, case {whens(1)} else 'other' end as section_group from (select doc_id, lower({TITLE}) as x from documents)"


@query("section_router", _route_sql())
def section_router(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", p.title_route(F.substring_index("text", "\n", 1)).alias("r")).select("doc_id", "r.section_id", "r.section_group")


def _keyword_sql() -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"  # RE2's own word boundary knows ASCII only

    def re2(x: str) -> str:
        x = f"(^|{edge}){x[2:]}" if x.startswith(r"\b") else x
        return f"{x[:-2]}($|{edge})" if x.endswith(r"\b") else x

    whens = " ".join(f"when regexp_matches(x, '{'|'.join(re2(x) for x in patterns)}') then '{name}'" for name, patterns in p.KEYWORD_ROUTES)
    return rf"select doc_id, case {whens} end as section_id from (select doc_id, trim(regexp_replace(translate(lower({TITLE}), '–—', '--'), '[\s\v]+', ' ', 'g')) as x from documents)"


@query("keyword_router", _keyword_sql())
def keyword_router(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", p.keyword_route(F.substring_index("text", "\n", 1)).alias("section_id"))


@query("section_group", "select section_id, case " + " ".join(f"when contains(section_id, '{k}') then '{g}'" for k, g in p.ID_GROUPS) + " else 'other' end as section_group, cast(count(*) as bigint) as n from (select case when conv_id % 4 = 0 then 'payment_terms_' || role when conv_id % 4 = 1 then 'governing_law' when conv_id % 4 = 2 then 'liability_' || role else role end as section_id from conversations) group by section_id")
def section_group(spark, sf_dir):
    ids = F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("payment_terms_"), "role")).when(F.col("conv_id") % 4 == 1, "governing_law").when(F.col("conv_id") % 4 == 2, F.concat(F.lit("liability_"), "role")).otherwise(F.col("role"))
    counted = table(spark, sf_dir, "conversations").select(ids.alias("section_id")).groupBy("section_id").agg(F.count("*").alias("n"))
    return counted.select("section_id", p.id_group(F.col("section_id")).alias("section_group"), "n")


@query("heading_flags", q.HEADING_FLAGS)
def heading_flags(spark, sf_dir):
    """How many lines of each document each heading rule takes."""
    rows = segment.lines_of(table(spark, sf_dir, "documents"))
    x = F.col("line")
    flags = {"heading": p.heading(x), "all_caps": p.all_caps_heading(x), "probable_caps": p.probable_caps(x), "by_level": p.heading_level(x).isNotNull(), "block": p.block_heading(x), "older_block": p.block_heading(x, None, 120, 2, 3, 0.85, 80, 80), "text": p.heading_text(x), "noise_block": p.noise_block(x), "noise": p.noise_heading(x), "action": p.begins_with_action(x), "title_like": p.title_like(x)}
    return rows.groupBy("doc_id").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


# ---- segmentation

_LINES = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\v\f]'), lambda x: regexp_replace(regexp_replace(replace(x, chr(160), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def _heading_sql(longest: int, digits: int, deeper: int, caps: float, caps_longest: int, colon: int) -> str:
    letters = "length(regexp_replace(line, '[^A-Za-zА-Яа-яЁё]', '', 'g'))"
    capitals = "length(regexp_replace(line, '[^A-ZА-ЯЁ]', '', 'g'))"
    noise = r"(length(line) <= 2 or regexp_matches(lower(line), '^(buyer\s*/\s*seller|seller\s*/\s*buyer|buyer|seller|м\.?п\.?|swift|инн|кпп|огрн|qty)$') or (regexp_full_match(line, '[\w\-/.,:;() ]{1,25}') and length(regexp_replace(line, '\D', '', 'g')) >= 6))"
    return rf"(length(line) <= {longest} and (regexp_matches(line, '^\d{{1,{digits}}}(\.\d{{1,{digits}}}){{0,{deeper}}}\.?\s+\S+') or ({letters} > 0 and length(line) <= {caps_longest} and {capitals} / {letters} > {caps}) or (line[-1:] = ':' and length(line) <= {colon}))) and not {noise}"


_SEGMENT_SQL = """
with l as (select doc_id, unnest({lines}) as line, generate_subscripts({lines}, 1) as pos from documents),
h as (select *, {heading} as h, {title} as ttl from l),
k as (select *, case when h then lower(ttl) end as key, last_value(case when h then lower(ttl) end ignore nulls) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from h),
o as (select *, h {same} as opens from k),
n as (select *, sum(opens::int) over (partition by doc_id order by pos) as no, last_value(case when opens then ttl end ignore nulls) over (partition by doc_id order by pos) as name from o),
b as (select doc_id, no, coalesce(any_value(name), 'Preamble') as title, string_agg(line, chr(10) order by pos) as body from n where not h group by doc_id, no)
select doc_id, cast(row_number() over (partition by doc_id order by no) as integer) as "order", title, md5(body) as text_md5, {lang} as language from (select *, body as x from b)"""


@query("segment_headings", _SEGMENT_SQL.format(lines=_LINES, heading=_heading_sql(140, 3, 4, 0.88, 90, 90), title=r"regexp_replace(regexp_replace(line, ':+$', ''), '\s+$', '')", same="and key is distinct from before", lang=_RATIO))
def segment_headings(spark, sf_dir):
    """The current rule of block segmentation, without taking out repeated lines."""
    found = segment.block_sections(segment.lines_of(table(spark, sf_dir, "documents")), dedupe=False)
    return found.select("doc_id", "order", "title", F.md5("text").alias("text_md5"), "language")


@query("segment_headings_older", _SEGMENT_SQL.format(lines=_LINES.replace(r"regexp_replace(regexp_replace(replace(x, chr(160), ' '), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')", r"regexp_replace(x, '^\s+|\s+$', '', 'g')"), heading=_heading_sql(120, 2, 3, 0.85, 80, 80), title=r"regexp_replace(regexp_replace(regexp_replace(line, ':+$', ''), '\s+', ' ', 'g'), '\s+$', '')", same="", lang=_RATIO))
def segment_headings_older(spark, sf_dir):
    found = segment.block_sections(segment.lines_of(table(spark, sf_dir, "documents")), current=False)
    return found.select("doc_id", "order", "title", F.md5("text").alias("text_md5"), "language")


_BLOCKS_SQL = _SEGMENT_SQL.format(lines=_LINES, heading=_heading_sql(140, 3, 4, 0.88, 90, 90), title=r"regexp_replace(regexp_replace(line, ':+$', ''), '\s+$', '')", same="and key is distinct from before", lang=_RATIO)
_BLOCKS_SQL = _BLOCKS_SQL[: _BLOCKS_SQL.index("b as (")] + f"""b as (select doc_id, no, coalesce(any_value(name), 'Preamble') as title, list(line order by pos) as ls from n where not h group by doc_id, no),
d as (select doc_id, no, title, {q.deduped('ls', 25)} as ls from b),
e as (select *, list_position(list_transform(ls, lambda x: {q.fold_case(q.plain_spaces("regexp_replace(x, ':+$', '')"))} = {q.fold_case(q.plain_spaces('title'))}), false) as good from d),
g as (select doc_id, no, title, {q.strip("array_to_string(ls[coalesce(nullif(good, 0), len(ls) + 1):], chr(10))")} as x from e),
r as (select *, lower(title) as low from g where x <> '')
select doc_id, cast(row_number() over (partition by doc_id order by no) as integer) as "order", title, case {' '.join('when ' + ' or '.join(f"contains(low, '{w}')" for w in r[2]) + f" then '{r[0]}'" for r in p.TITLE_ROUTES)} else '' end as section_id,
case {' '.join('when ' + ' or '.join(f"contains(low, '{w}')" for w in r[2]) + f" then '{r[1]}'" for r in p.TITLE_ROUTES)} else 'other' end as section_group, {_RATIO} as language, md5(x) as text_md5 from r"""


@query("segment_blocks_deduped", _BLOCKS_SQL)
def segment_blocks_deduped(spark, sf_dir):
    found = segment.block_sections(segment.lines_of(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "order", "title", "section_id", "section_group", "language", F.md5("text").alias("text_md5"))


@query("titled_segments", q.TITLED)
def titled_segments(spark, sf_dir):
    found = segment.titled_segments(segment.lines_of(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "order", "section_title", F.md5("text").alias("text_md5"))


@query("split_sections_fold", q.split_sections(_PAGE))
def split_sections_fold(spark, sf_dir):
    cleaned = table(spark, sf_dir, "documents").select("doc_id", t.clean_page_text(F.col("text")).alias("text"))
    return segment.split_sections(cleaned).select("doc_id", "order", "section", F.md5("text").alias("text_md5"))


@query("heal_headings", q.HEALED)
def heal_headings(spark, sf_dir):
    blocks = segment.lines_of(table(spark, sf_dir, "documents")).withColumn("style", F.lit("Normal"))
    return segment.heal_report(segment.heal_blocks(blocks))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in paragraphs of two lines each, so that a heading may have its body under it in the same one."""
    lines = F.col("lines")
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 2).cast("int")), lambda i: F.array_join(F.slice(lines, i * 2 + 1, F.lit(2)), "\n"))
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.explode(F.array(t.lines(F.col("text")))).alias("lines")).where(F.size("lines") > 0)
    return rows.select("doc_id", F.posexplode(pairs).alias("pos", "line")).withColumn("style", F.lit("Normal"))


@query("heal_paragraphs", q.HEALED_PAIRS)
def heal_paragraphs(spark, sf_dir):
    healed = segment.heal_blocks(paragraphs(spark, sf_dir))
    texts = healed.groupBy("doc_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sub", "line"))), lambda x: x["line"]), "\n")).alias("healed_md5"))
    return segment.heal_report(healed).join(texts, "doc_id")


# ---- joins

_ROLE_MAP = "(values ('user', 'Question'), ('assistant', 'Answer'), ('assistant', 'Reply')) m(section_id, title)"


@query("title_map_left_join", f"select c.conv_id, c.turn, c.role as section_id, case when c.turn % 2 = 1 then 'Turn ' || c.turn else coalesce(m.title, '') end as final_title from conversations c left join {_ROLE_MAP} on m.section_id = c.role")
def title_map_left_join(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("section_id"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("Turn "), "turn")).otherwise("").alias("title"))
    titles = spark.createDataFrame([("user", "Question"), ("assistant", "Answer"), ("assistant", "Reply")], "section_id string, title string")
    return joins.fill_titles(rows, titles).select("conv_id", "turn", "section_id", "final_title")


@query("nest_sections", "select conv_id as contract_id, md5(string_agg(role || ':' || text, '|' order by turn)) as nested_md5, cast(count(*) as bigint) as n from conversations group by conv_id")
def nest_sections(spark, sf_dir):
    nested = joins.nest_sections(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], ["role", "text"])
    flat = F.array_join(F.transform("sections", lambda s: F.concat(s["role"], F.lit(":"), s["text"])), "|")
    return nested.select(F.col("conv_id").alias("contract_id"), F.md5(flat).alias("nested_md5"), F.size("sections").cast("long").alias("n"))


@query("flat_corpus_filter", "select cast(conv_id as varchar) as doc_id, role as section_id, md5(text) as text_md5 from conversations where length(text) >= 80")
def flat_corpus_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("section_id"), F.lit("").alias("section_group"), F.lit("").alias("title"), F.lit("en").alias("language"), "text")
    return writers.flat_corpus(rows, "conv_id").select("doc_id", "section_id", F.md5("text").alias("text_md5"))


@query("dedupe_keep_first", "select doc_id, md5(text) as text_md5 from documents where text <> '' qualify row_number() over (partition by replace(lower(text), 'ß', 'ss') order by doc_id) = 1")
def dedupe_keep_first(spark, sf_dir):
    return cleaning.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text"), t.fold_case(F.col("text")), ["doc_id"]).select("doc_id", F.md5("text").alias("text_md5"))


@query("fuzzy_title_match")
def fuzzy_title_match(spark, sf_dir):
    """First lines of documents against a map of the benchmark's first words."""
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.concat(F.lit("s_"), "item_id").alias("section_id"), F.substring_index(F.substring_index("text", "\n", 1), " ", 6).alias("title"))
    titles = table(spark, sf_dir, "documents").select(F.substring_index("text", "\n", 1).alias("title"))
    found = joins.match_titles(titles, joins.title_map(known)[0])
    return found.select(F.md5("title").alias("title_md5"), "section_id", F.round("confidence", 6).alias("confidence"))


@query("route_or_match")
def route_or_match(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), F.concat(F.lit("s_"), "item_id").alias("section_id"), F.substring_index(F.substring_index("text", "\n", 1), " ", 6).alias("title"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("section_title"))
    return joins.route_or_match(rows, joins.title_map(known)[0]).select("doc_id", "section_id", writers.confidence_text(F.col("confidence")).alias("confidence"))


# ---- cleaning

@query("anonymise", q.ANONYMISED)
def anonymise(spark, sf_dir):
    return cleaning.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "replacements", F.md5("text").alias("text_md5"))


@query("clean_precedents", q.CLEANED)
def clean_precedents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text")
    return cleaning.clean_precedents(rows, 120, 1800)[0].select(F.col("seq").alias("doc_id"), "replacements", F.md5("text").alias("text_md5"))


@query("clean_report", q.CLEAN_REPORT)
def clean_report(spark, sf_dir):
    return cleaning.clean_precedents(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text"), 120, 1800)[1]


@query("pick_snippets", r"""
with s as (select doc_id, unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '[\s\v]+', ' ', 'g'), '^ | $', '', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) as s, generate_subscripts(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(text, '[\s\v]+', ' ', 'g'), '^ | $', '', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), 1) as pos from documents),
f as (select *, row_number() over (partition by lower(s) order by doc_id, pos) as nth from s where not regexp_matches(s, '[\[\]]') and length(s) between 60 and 240 and (contains(lower(s), 'tion') or contains(lower(s), 'und')))
select cast(row_number() over (order by doc_id, pos) as integer) as n, s as snippet from f where nth = 1 order by doc_id, pos limit 6""")
def pick_snippets(spark, sf_dir):
    return cleaning.pick_snippets(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text"), ["tion", "und"])


# ---- statistics

_TITLED_SQL = f"select doc_id, unnest({_LINES}) as line, generate_subscripts({_LINES}, 1) as pos from documents"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.lines_of(table(spark, sf_dir, "documents"))


@query("section_counters", "select cast(count(distinct conv_id) as bigint) as documents, cast(count(*) filter (where trim(text) <> '') as bigint) as sections, cast(count(*) filter (where trim(text) = '') as bigint) as empty_sections, cast(count(*) filter (where role = 'FULL_TEXT') as bigint) as full_text from conversations")
def section_counters(spark, sf_dir):
    return stats.section_counters(table(spark, sf_dir, "conversations"), "conv_id", "role", "text")


@query("segment_stats", f"with c as (select doc_id, count(*) as n from ({_TITLED_SQL}) group by doc_id) select round(avg(n), 6) as mean, cast(list_sort(list(n))[cast(count(*) // 2 as integer) + 1] as bigint) as median, cast(min(n) as bigint) as least, cast(max(n) as bigint) as greatest from c")
def segment_stats(spark, sf_dir):
    counts = _lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    return stats.count_summary(counts, "n").withColumn("mean", F.round("mean", 6))


@query("title_freq", f"select replace(upper({TITLE}), 'ẞ', 'SS') as value, cast(count(*) as bigint) as n, cast(min(doc_id) as bigint) as first_seen from documents group by 1")
def title_freq(spark, sf_dir):
    return stats.frequencies(table(spark, sf_dir, "documents"), F.upper(F.substring_index("text", "\n", 1)), "doc_id")


@query("first_word_freq", f"select split_part(lower({TITLE}), ' ', 1) as value, cast(count(*) as bigint) as n, cast(min(doc_id) as bigint) as first_seen from documents group by 1 order by n desc, first_seen limit 30")
def first_word_freq(spark, sf_dir):
    return stats.frequencies(table(spark, sf_dir, "documents"), t.first_word_after_number(F.substring_index("text", "\n", 1)), "doc_id", 30)


@query("outlier_docs", f"select doc_id, cast(count(*) as bigint) as n from ({_TITLED_SQL}) group by doc_id having count(*) <= 2 or count(*) >= 40")
def outlier_docs(spark, sf_dir):
    return stats.outliers(_lines(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n")), "n")


@query("status_counts", "select case when n_chars = 0 then 'zero_segments' when n_chars < 200 then 'short' else 'ok' end as status, cast(count(*) as bigint) as n from documents group by 1")
def status_counts(spark, sf_dir):
    return stats.status_counts(table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") == 0, "zero_segments").when(F.col("n_chars") < 200, "short").otherwise("ok").alias("status")))


@query("source_filter_distinct", "select lang, cast(count(distinct source) as bigint) as sources from documents where source <> 'src0' group by lang")
def source_filter_distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source") != "src0").groupBy("lang").agg(F.countDistinct("source").alias("sources"))


@query("safe_int_sort", "select conv_id, turn, cast(coalesce(trunc(try_cast(regexp_extract(text, '[0-9]+') as double)), 0) as integer) as order_key from conversations where coalesce(try_cast(regexp_extract(text, '[0-9]+') as double), 0) <= 2147483647 union all select conv_id, turn, 0 from conversations where coalesce(try_cast(regexp_extract(text, '[0-9]+') as double), 0) > 2147483647")
def safe_int_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", stats.safe_int(F.regexp_extract("text", "[0-9]+", 0)).alias("order_key"))
    return rows.orderBy("conv_id", "order_key", "turn")


_REPEATED = rf"""
with u as (select doc_id, list_filter(list_transform(string_split(regexp_replace({_sql_strip('text')}, '([.!?])[\s\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_sql_strip('x')}), lambda x: x <> '') as u from documents),
k as (select doc_id, len(u) as n, list_transform(list_filter(u, lambda x: length(x) >= 40), lambda x: regexp_replace(regexp_replace(regexp_replace(lower(x), '[\s\v]+', ' ', 'g'), '[«»"()]', '', 'g'), '[,:;]+', ',', 'g')) as k from u)
select doc_id, n >= 6 and len(k) >= 6 and len(list_distinct(k)) < len(k) as repeated from k"""


@query("repetition_flag", _REPEATED)
def repetition_flag(spark, sf_dir):
    return stats.repetition(table(spark, sf_dir, "documents"))


@query("unique_section_ids", q.unique_slugs(TITLE, _SLUG.replace(TITLE, "title")))
def unique_section_ids(spark, sf_dir):
    """Slugs of whole titles, made unique in order of frequency."""
    words = table(spark, sf_dir, "documents").select(F.substring_index("text", "\n", 1).alias("title")).where("title != ''")
    return stats.unique_slugs(words.groupBy("title").agg(F.count("*").alias("count")))


# ---- validators

def _itemised(mark: Callable[[Column], Column]) -> Column:
    """A text's sentences as the lines of a numbered list."""
    return F.array_join(F.transform(t.sentences(F.col("text")), lambda x, i: F.concat(mark(i + 1), F.lit(" "), x)), "\n")


def _itemised_sql(mark: str) -> str:
    return f"array_to_string(list_transform(list_filter({q.sentences('text')}, lambda x: x <> ''), lambda x, i: {mark} || ' ' || x), chr(10))"


@query("validate_numbered_text", rf"""
with n as (select doc_id, {_itemised_sql("'1.' || i || '.'")} as text from documents),
x as (select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as t, list_filter(list_transform(string_split(text, chr(10)), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), lambda l: l <> '') as ls from n)
select doc_id, case when t = '' then 'empty_output' when length(regexp_replace(t, '[\s\v]+', '', 'g')) < 850 then 'too_short' when len(list_filter(ls, lambda l: regexp_matches(l, '^\d+\.\d+\.\s+'))) < 20 then 'too_few_list_items'
  when regexp_matches(t, '(?i)\b(swift|iban|beneficiary)\b|\baccount\s+no\b') then 'bank_details_detected' when regexp_matches(t, '(?i)\blate\s+payment\b|\bdefault\s+interest\b') then 'late_payment_penalty_detected' end as code from x""")
def validate_numbered_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _itemised(lambda i: F.concat(F.lit("1."), i.cast("string"), F.lit("."))).alias("text"))
    return docs.select("doc_id", validate.payment_terms(F.col("text"), False, False, 850).alias("code"))


@query("validate_delivery_text", rf"""
with n as (select doc_id, {_itemised_sql("'2.' || i || '.'")} as text from documents)
select doc_id, case when t = '' then 'empty_output' when length(regexp_replace(t, '[\s\v]+', '', 'g')) < 900 then 'too_short' when len(regexp_extract_all(t, '(?m)^2\.\d{{1,3}}\.\s')) < 20 then 'too_few_list_items' when len(regexp_extract_all(t, '(?i)\binvoice\b')) >= 3 then 'forbidden_topic_detected' end as code from (select doc_id, {_sql_strip('text')} as t from n)""")
def validate_delivery_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _itemised(lambda i: F.concat(F.lit("2."), i.cast("string"), F.lit("."))).alias("text"))
    return docs.select("doc_id", validate.delivery_terms(F.col("text"), 900).alias("code"))


@query("validate_older_text", q.older_validator(_REPEATED, _itemised_sql("i || ')'")))
def validate_older_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _itemised(lambda i: F.concat(i.cast("string"), F.lit(")"))).alias("text"))
    flags = stats.repetition(docs).withColumnRenamed("doc_id", "_id")
    return docs.join(flags, F.col("doc_id") == F.col("_id")).select("doc_id", validate.old_payment_terms(F.col("text"), False, False, F.col("repeated")).alias("code"))


@query("form_issues", "select conv_id, '$' as path, 'required ' || k as rule from (select distinct conv_id from conversations) cross join (values ('contract_type'), ('delivery'), ('liability'), ('payment')) v(k) union all select distinct conv_id, '$', 'additionalProperties' from conversations union all select distinct conv_id, '$.language_mode', 'enum' from conversations where conv_id % 3 = 2")
def form_issues(spark, sf_dir):
    """A form from each conversation: most fields are missing and one is unknown."""
    mode = F.when(F.col("conv_id") % 3 == 0, "ru").when(F.col("conv_id") % 3 == 1, "en").otherwise("xx")
    forms = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.to_json(F.struct(mode.alias("language_mode"), F.lit("EUR").alias("currency"), F.col("conv_id").alias("other"))).alias("form"))
    return validate.form_issues(forms, "conv_id", "form")


#: What each conversation's form breaks, said of the conversation itself; c is its id.
_DIALOGUE_SQL = r"""
with t as (select conv_id as c, role, text, turn, row_number() over (partition by conv_id order by turn) - 1 as i from conversations),
b as (select c, count(*) as n, count(distinct role) as roles, count(*) filter (where role = 'user') as users from t group by c),
f as (select * from b where c % 11 <> 10 and c % 13 <> 12),
u as (select t.* from t join f on f.c = t.c)
select c, '$' as path, 'json' as rule from b where c % 11 = 10
union all select c, '$', unnest(['type', 'not']) from b where c % 11 <> 10 and c % 13 = 12
union all select c, '$.number', 'pattern' from f where c % 5 = 0
union all select c, '$.number', 'type' from f where c % 5 = 1
union all select c, '$.days', case c % 6 when 1 then 'minimum' when 2 then 'maximum' else 'type' end from f where c % 6 in (1, 2, 3, 4)
union all select c, '$.rate', 'exclusiveMinimum' from f where c % 50 = 0
union all select c, '$.rate', 'exclusiveMaximum' from f where c % 50 >= 40
union all select c, '$.rate', 'multipleOf' from f where c % 4 = 1
union all select c, '$.mode', 'enum' from f where c % 3 = 2
union all select c, '$.kind', 'const' from f where c % 7 = 0
union all select c, '$.turns', 'minItems' from f where n < 3
union all select c, '$.turns', 'maxItems' from f where n > 6
union all select c, '$.roles', 'uniqueItems' from f where n > roles
union all select c, '$.roles', 'contains' from f where users = 0
union all select c, '$.turns[' || i || '].role', 'enum' from u where role not in ('user', 'assistant')
union all select c, '$.turns[' || i || '].text', 'minLength' from u where length(text) < 60
union all select c, '$.turns[' || i || '].text', 'maxLength' from u where length(text) > 900
union all select c, '$.turns[' || i || '].text', 'pattern' from u where not text like '%.'
union all select c, '$.turns[' || i || '].place', 'maximum' from u where turn > 5
union all select c, '$.turns[' || i || ']', 'required text' from u where false
union all select c, '$', 'required payer' from f where c % 4 = 1
union all select c, '$.payer', 'required name' from f where c % 4 = 2
union all select c, '$.payer.vat', 'anyOf' from f where c % 4 = 2
union all select c, '$.payer.other', 'type' from f where c % 4 = 3
union all select c, '$.payer.agent.name', case when c % 8 = 3 then 'minLength' else 'maxLength' end from f where c % 4 = 3
union all select c, '$', 'additionalProperties' from f where c % 9 = 4
union all select c, '$', 'not' from f where c % 9 = 5
union all select c, '$', 'minProperties' from f where c % 4 = 1 and c % 9 not in (4, 5) and c % 21 = 8"""


@query("form_schema_issues", _DIALOGUE_SQL)
def form_schema_issues(spark, sf_dir):
    """A form from each conversation, against a schema with lists, references and every kind of bound, read from its file."""
    c = F.col("c")
    pick = lambda n, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (c % n + 1).cast("int"))
    turn = F.struct("role", "text", F.col("turn").alias("place"))
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("c")).agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("i")))).alias("t"))
    turns, roles = F.to_json(F.transform("t", lambda x: x["i"])), F.to_json(F.transform("t", lambda x: x["i"]["role"]))
    number = F.when(c % 5 == 0, F.concat(F.lit('"bad '), c, F.lit('"'))).when(c % 5 == 1, c.cast("string")).otherwise(F.concat(F.lit('"C-'), c, F.lit('"')))
    rate = F.when(c % 4 == 1, F.concat((c % 50).cast("string"), F.lit(".25"))).otherwise((c % 50).cast("string"))
    party = pick(4, '{"name": "A", "vat": null}', "", '{"vat": 5}', "").alias("party")
    agent = F.when(c % 8 == 3, "").otherwise("far too long")
    payer = F.when(c % 4 == 3, F.concat(F.lit('{"name": "B", "vat": "DE1", "other": 1, "agent": {"name": "'), agent, F.lit('"}}'))).otherwise(party)
    fields = [
        F.concat(F.lit('"number": '), number), F.concat(F.lit('"days": '), pick(6, "30.0", "-1", "4000", "30.5", '"x"', "15")), F.concat(F.lit('"rate": '), rate),
        F.concat(F.lit('"mode": "'), pick(3, "ru", "en", "xx"), F.lit('"')), F.when(c % 21 != 8, F.concat(F.lit('"kind": "'), F.when(c % 7 == 0, "talk").otherwise("dialogue"), F.lit('"'))),
        F.concat(F.lit('"turns": '), turns), F.concat(F.lit('"roles": '), roles), F.when(c % 4 != 1, F.concat(F.lit('"payer": '), payer)),
        F.when(c % 9 == 4, F.lit('"surplus": {}')), F.when(c % 9 == 5, F.lit('"secret": true')),
    ]
    text = F.when(c % 11 == 10, F.lit('{"number": ')).when(c % 13 == 12, F.lit("[1]")).otherwise(F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}")))
    schema = validate.load_json(os.path.join(os.path.dirname(os.path.abspath(__file__)), "dialogue_form.schema.json"))
    return validate.form_issues(talks.select("c", text.alias("form")), "c", "form", schema)


def stand_in(system: pd.Series, user: pd.Series, temperature: pd.Series, top_p: pd.Series) -> pd.Series:
    """A model that answers a prompt with its party's name in it: enough items, too few, or with bank details."""

    def answer(prompt: str, again: bool) -> str:
        n = int(re.search(r"delivery at (\d+) ", prompt)[1])
        few = n % 3 == 1 and not (again and n % 6 == 1)
        lines = [f"1.{i}. Item {i} of place {n}: payment follows the invoice in full and on time, as the parties agreed." for i in range(1, 6 if few else 26)]
        return "\n".join(lines + (["1.26. The IBAN is given apart."] if n % 3 == 2 else []))

    return pd.Series([answer(u, x > 0.3) for u, x in zip(user, temperature)])


@query("generate_in_rounds", """
with c as (select conv_id as id, case when turn is null then '' else text end as text from conversations where turn = 0),
g as (select id, case when id % 3 = 1 and id % 6 <> 1 then 5 else 25 end as n, id % 3 = 2 as bank from c),
t as (select g.id, string_agg('1.' || i || '. Item ' || i || ' of place ' || g.id || ': payment follows the invoice in full and on time, as the parties agreed.', chr(10) order by i) || case when any_value(bank) then chr(10) || '1.26. The IBAN is given apart.' else '' end as text
  from g, (select unnest(range(1, 26)) as i) r where i <= g.n group by g.id)
select id, md5(text) as text_md5, case when id % 3 = 2 then 'bank_details_detected' when id % 6 = 4 then 'too_short' end as code, cast(case when id % 6 = 1 then 2 when id % 6 = 4 then 3 else 1 end as integer) as attempts from t""")
def generate_in_rounds(spark, sf_dir):
    """A payment section for a form of each conversation, by a stand-in for the model; refused texts are asked for again."""
    first = table(spark, sf_dir, "conversations").where("turn = 0")
    mode = F.when(F.col("conv_id") % 2 == 0, "en").otherwise("ru")
    form = F.to_json(F.struct(mode.alias("language_mode"), F.struct(F.col("conv_id").alias("payment_term_days")).alias("payment")))
    forms = first.select(F.col("conv_id").alias("id"), form.alias("form"), F.array(F.concat(F.lit("delivery at "), F.col("conv_id").cast("string"), F.lit(" "), F.substring("text", 1, 60))).alias("snippets"))
    made = pipelines.generate_sections(forms, "payment_terms", stand_in, lambda c: validate.payment_terms(c, False, False))
    return made.select("id", F.md5("text").alias("text_md5"), "code", "attempts")


# ---- files: written from a table, read back

def scratch(spark: SparkSession) -> str:
    """A folder's name that is not taken, where executors and driver both write."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{uuid.uuid4().hex}"


@query("docx_round_trip", f"""
with {q.LINES_OF}, n as (select doc_id, line, row_number() over (partition by doc_id order by pos) - 1 as i from l),
p as (select doc_id, i // 2 as k, string_agg(line, chr(10) order by i) as text from n group by doc_id, i // 2)
select doc_id, count(*) as blocks, md5(string_agg(text, '|' order by k)) as text_md5 from p group by doc_id""")
def docx_round_trip(spark, sf_dir):
    """Documents as DOCX files of paragraphs of two lines, read back."""
    folder = scratch(spark)
    files.write_files(files.docx_files(paragraphs(spark, sf_dir)), folder)
    blocks = readers.read_docx(spark, folder).withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "|")
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.md5(listed).alias("text_md5"))


@query("healed_docx", q.HEALED_PAIRS)
def healed_docx(spark, sf_dir):
    """The same files healed into others: what the report says and what the healed files hold."""
    source, target = scratch(spark), scratch(spark)
    files.write_files(files.docx_files(paragraphs(spark, sf_dir)), source)
    report = pipelines.write_healed(spark, source, target)
    number = F.regexp_extract(F.col("path"), r"(\d+)\.docx$", 1).cast("long").alias("doc_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    texts = readers.read_docx(spark, target).select(number, "pos", "line").groupBy("doc_id").agg(F.md5(listed).alias("healed_md5"))
    return report.withColumn("doc_id", F.regexp_extract("doc_id", r"(\d+)\.docx$", 1).cast("long")).join(texts, "doc_id")


@query("json_files_round_trip", "select conv_id as contract_id, md5(string_agg(role || ':' || text, '|' order by turn)) as text_md5, cast(count(*) as bigint) as sections from conversations group by conv_id")
def json_files_round_trip(spark, sf_dir):
    """Each conversation as a JSON file of its own, read back as a contract."""
    folder = scratch(spark)
    item = F.struct("turn", F.struct(F.col("role").alias("title"), "text").alias("i"))
    nested = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("contract_id")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("sections"))
    writers.write_json_files(nested, folder)
    read = readers.read_json_contracts(spark, folder).where("status = 'ok'")
    flat = F.array_join(F.transform("sections", lambda s: F.concat(s["title"], F.lit(":"), s["text"])), "|")
    return read.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("contract_id"), F.md5(flat).alias("text_md5"), F.size("sections").cast("long").alias("sections"))


@query("segmented_lines", """
select case when conv_id % 3 = 0 then 'doc_' || (2 * n - 1) else cast(conv_id as varchar) end as contract_id, turns from (select conv_id, count(*) as turns, row_number() over (partition by conv_id % 8 order by conv_id) as n from conversations group by conv_id) where conv_id % 7 <> 3""")
def segmented_lines(spark, sf_dir):
    """Conversations as JSON lines in eight files, a blank line after each, some broken, some without an id but their line's number."""
    folder, c = scratch(spark), F.col("conv_id")
    item = F.struct(F.col("role").alias("section_id"), F.lit("").alias("section_group"), F.lit("").alias("title"), F.lit("en").alias("language"), "text")
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("sections"))
    line = F.when(c % 7 == 3, F.concat(F.lit('{"contract_id": "'), c.cast("string"))).otherwise(F.to_json(F.struct(F.when(c % 3 != 0, c.cast("string")).alias("contract_id"), "sections")))
    dealt = nested.withColumn("file", c % 8).repartition(8, "file").sortWithinPartitions("file", "conv_id")
    dealt.select("file", F.explode(F.array(line, F.lit(""))).alias("value")).write.partitionBy("file").text(folder)
    return readers.read_segmented(spark, folder).select("contract_id", F.size("sections").cast("long").alias("turns"))


# ---- JSON

@query("json_structure_probe", """
with c as (select conv_id, list({'t': case when conv_id % 5 = 0 then '' else role end, 'x': text} order by turn) as s from conversations group by conv_id)
select conv_id, case when conv_id % 7 = 3 then 'parse_error' when conv_id % 7 = 4 or conv_id % 5 = 0 then 'unsupported_json_structure' else 'ok' end as status, cast(case when conv_id % 7 in (3, 4) or conv_id % 5 = 0 then 0 else len(s) end as bigint) as sections from c""")
def json_structure_probe(spark, sf_dir):
    """Conversations written as JSON contracts, some broken, some without a list, some without titles."""
    item = F.struct(F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("role")).alias("heading"), F.col("text").alias("body"))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("segments"))
    text = F.when(F.col("conv_id") % 7 == 3, "{broken").when(F.col("conv_id") % 7 == 4, '{"pages": []}').when(F.col("conv_id") % 7 == 5, F.to_json("segments")).otherwise(F.to_json(F.struct("segments")))
    coded = nested.select("conv_id", text.alias("json"))
    return coded.select("conv_id", readers.json_status(F.col("json")).alias("status"), F.coalesce(F.size(readers.json_sections(F.col("json"))), F.lit(0)).cast("long").alias("sections")).select("conv_id", "status", F.greatest("sections", F.lit(0)).alias("sections"))
