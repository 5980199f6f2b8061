import io
import json
import zipfile
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scrivener.functions import prompts, validate
from scrivener.operators import joins, segment, stats
from scrivener.plans import pipelines
from scrivener.sources import readers, writers
from scrivener.streaming import corpus


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_split_sections(spark):
    texts = ["Вступление\nУСЛОВИЯ ОПЛАТЫ\nTERMS OF PAYMENT\nПлатеж.\n2. Payment\nПо счету.\nВСЕ ЗАГЛАВНЫЕ\nхвост", "только текст", "", "ФОРС МАЖОР\n", "1. Subject\na\n2. Оплатить\nb\nAddendum 1\nПРЕАМБУЛА\nc"]
    got = {}
    for r in segment.split_sections(docs(spark, texts)).orderBy("doc_id", "order").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.text))
    assert got[0] == [("PREFACE", "Вступление"), ("УСЛОВИЯ ОПЛАТЫ / TERMS OF PAYMENT", "Платеж."), ("2. Payment", "По счету.\nВСЕ ЗАГЛАВНЫЕ\nхвост")]
    assert got[1] == [("PREFACE", "только текст")] and 2 not in got
    assert got[3] == [("FULL_TEXT", "ФОРС МАЖОР")]
    assert got[4] == [("1. Subject", "a\n2. Оплатить\nb"), ("Addendum 1 / ПРЕАМБУЛА", "c")]


def test_block_sections(spark):
    text = "начало\nОПЛАТА:\nОПЛАТА\nпервая\nпервая\nОПЛАТА:\nвторая\n3. Delivery\nтекст длиннее двадцати латинских letters abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz\nПУСТО:"
    rows = segment.block_sections(segment.lines_of(docs(spark, [text]))).orderBy("order").collect()
    assert [(r.order, r.title, r.text, r.section_id) for r in rows][:2] == [(1, "Preamble", "начало", ""), (2, "ОПЛАТА", "первая\nвторая", "payment_terms")]
    assert (rows[2].title, rows[2].section_id, rows[2].language) == ("3. Delivery", "delivery_terms", "en") and len(rows) == 3
    older = segment.block_sections(segment.lines_of(docs(spark, ["a\nITEM:\nITEM:\nb"])), current=False).collect()
    assert [(r.title, r.text) for r in older] == [("Preamble", "a"), ("ITEM", "b")]


def test_healing(spark):
    blocks = spark.createDataFrame([(0, 0, "7.THE PRICE\nThe price is set out in the annex and is final.", "Normal"), (0, 1, "plain words here", "Normal"), (0, 2, "12 - FORCE MAJEURE", "Heading 1"), (1, 0, "text", "Normal")], "doc_id long, pos int, line string, style string")
    healed = segment.heal_blocks(blocks)
    got = [(r.line, r.style) for r in healed.where("doc_id = 0").orderBy("pos", "sub").collect()]
    assert got == [("7. THE PRICE", "Heading 1"), ("The price is set out in the annex and is final.", "Normal"), ("plain words here", "Normal"), ("12. FORCE MAJEURE", "Heading 1")]
    report = {r.doc_id: (r.status, r.changed, r.headings_set, r.splits_done) for r in segment.heal_report(healed).collect()}
    assert report == {0: ("ok", True, 2, 1), 1: ("no_candidates", False, 0, 0)}


def test_fuzzy_match_against_difflib(spark):
    known = ["payment terms", "delivery terms", "условия оплаты", "условия поставки", "liability", "force majeure", "payment term"]
    titles = ["Payment Term", "PAYMENT TERMS", "1. Условия оплата", "Delivery term / Условия поставк", "zzz", "Liabilities", "", None]
    to_id, _ = joins.title_map(spark.createDataFrame([(i, f"s{i}", k) for i, k in enumerate(known)], "seq long, section_id string, title string"))
    got = {r.title: (r.section_id, round(r.confidence, 9)) for r in joins.match_titles(spark.createDataFrame([(x,) for x in titles], "title string"), to_id).collect()}

    def one(x):
        if x in known:
            return f"s{known.index(x)}", 1.0
        best, score = None, 0.0
        for i, k in enumerate(known):
            s = SequenceMatcher(None, x, k).ratio()
            if int(len(x) * 0.6) <= len(k) <= int(len(x) * 1.6) and s > score:
                best, score = f"s{i}", s
        return (best if score >= 0.78 else None), round(score, 9)

    assert got["Payment Term"] == ("s6", 1.0) and got["PAYMENT TERMS"] == ("s0", 1.0) and got["zzz"] == one("zzz") and got[""] == (None, 0.0) and got[None] == (None, 0.0)
    assert got["1. Условия оплата"] == one("условия оплата") and got["Liabilities"] == one("liabilities")
    assert got["Delivery term / Условия поставк"] == max((one("delivery term / условия поставк"), one("delivery term"), one("условия поставк")), key=lambda x: x[1])


def test_statistics(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1, 2, 3, 4])], "doc_id int, n long")
    assert tuple(stats.count_summary(counts, "n").first()) == (2.5, 3, 1, 4)
    units = " ".join(f"Это достаточно длинное предложение номер {i}, чтобы считаться." for i in (1, 2, 3, 4, 5, 6))
    got = {r.doc_id: r.repeated for r in stats.repetition(docs(spark, [units, units + " " + units, "коротко. " * 9])).collect()}
    assert got == {0: False, 1: True, 2: False}
    values = spark.createDataFrame([("3.7",), ("x",), ("nan",), ("inf",), ("",), (None,), ("-2",)], "v string")
    assert [r.n for r in values.select(stats.safe_int(F.col("v")).alias("n")).collect()] == [3, 0, 0, 0, 0, 0, -2]
    slugs = stats.unique_slugs(spark.createDataFrame([("A", 3), ("a!", 2), ("a_2", 1), ("ａ", 1)], "title string, count long")).collect()
    assert [r.section_id for r in slugs] == ["a", "a_2", "a_2_2", "a_3"]


def codes(spark, f, texts):
    return [r.c for r in docs(spark, texts).select("doc_id", f(F.col("text")).alias("c")).orderBy("doc_id").collect()]


def test_validators(spark):
    item = "Покупатель оплачивает поставленный товар в порядке, согласованном сторонами."
    good = "\n".join(f"1.{i}. {item}" for i in range(1, 23))
    pay = lambda c: validate.payment_terms(c, False, False)
    assert codes(spark, pay, [good, "", "short", good.replace("1.", "1) "), good + "\nSWIFT код", good + "\nпеня 1", "\n".join(f"{i}. {item}" for i in range(30)) + "\n" + good]) == [None, "empty_output", "too_short", "too_few_list_items", "bank_details_detected", "late_payment_penalty_detected", "wrong_numbering_format"]
    goods = "\n".join(f"2.{i}. Поставщик передает товар перевозчику в согласованном месте." for i in range(1, 23))
    assert codes(spark, validate.delivery_terms, [goods, goods + " штраф суд счет", goods + " штраф суд"]) == [None, "forbidden_topic_detected", None]
    old = lambda c: validate.old_payment_terms(c, False, False, F.lit(False))
    listed = "\n".join(f"{i}) {item}" for i in range(1, 25))
    assert codes(spark, old, [listed, listed + "\n[AMOUNT]", listed + " поставщик исполнитель", listed + " форс-мажор", listed + " санкции", listed + " 123456789012", listed + " дата списания дата зачисления"]) == [None, "contains_placeholders", "mixed_party_terms", "contains_out_of_scope_topics", "contains_penalty", "contains_bank_details", "conflicting_payment_date_definition"]
    assert codes(spark, validate.custom(lambda s: "long" if len(s) > 3 else None), ["ab", "abcd", None]) == [None, "long", None]


FORM = {
    "contract_type": "supply", "language_mode": "ru", "currency": "RUB",
    "payment": {"payment_trigger": "invoice_date", "payment_term_days": 15, "prepayment_required": False, "bank_details_included": False, "withholding_allowed": False, "suspension_right": True, "bank_charges": "payee", "vat_mode": "inclusive", "late_payment_penalty_enabled": False},
    "delivery": {"delivery_trigger": "from_payment", "delivery_term_days": 5, "delivery_place": "Москва", "partial_deliveries_allowed": False, "acceptance_required": True, "acceptance_period_days": 5, "acceptance_docs": "act", "acceptance_rules": "mixed"},
    "liability": {"liability_cap_enabled": True, "liability_cap_type": "other", "cap_scope": "", "indirect_damages_excluded": True, "exceptions_to_cap": ["fraud"], "delay_in_delivery_penalty_enabled": False, "claim_notice_days": 30},
}


def test_form(spark):
    assert pipelines.check_form(spark, FORM) == []
    bad = json.loads(json.dumps(FORM))
    bad["payment"].update(payment_term_days=9999, bank_charges="me", extra=1)
    bad["liability"].update(exceptions_to_cap=["fraud", "fraud", "x"], claim_notice_days="soon")
    del bad["delivery"]["delivery_place"], bad["currency"]
    assert pipelines.check_form(spark, bad) == sorted([("$", "required currency"), ("$.delivery", "required delivery_place"), ("$.liability.claim_notice_days", "type"), ("$.liability.exceptions_to_cap", "uniqueItems"), ("$.liability.exceptions_to_cap[2]", "enum"), ("$.payment", "additionalProperties"), ("$.payment.bank_charges", "enum"), ("$.payment.payment_term_days", "maximum")])
    assert [r.rule for r in validate.form_issues(spark.createDataFrame([(1, "{"), (2, "[]")], "i int, f string"), "i", "f").collect()] == ["json", "type"]


def test_retries():
    said = iter(["a", "bb", "ccc"])
    seen = []
    chat = lambda system, user, temperature, top_p: (seen.append((user, temperature)), next(said))[1]
    assert validate.generate_with_retry(chat, "s", "u", lambda x: None if len(x) > 2 else "too_short", "again") == ("ccc", None, 3)
    assert seen == [("u", 0.3), ("u\n\nagain\n", 0.35), ("u\n\nagain\n", 0.35)]
    assert validate.generate_with_retry(lambda *a: "x", "s", "u", lambda x: "too_short") == ("x", "too_short", 3)
    assert validate.generate_with_retry(lambda *a: "x", "s", "u", lambda x: "other") == ("x", "other", 1)


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda x: f'<w:p><w:pPr><w:pStyle w:val="{x[1]}"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>{x[0]}</w:t></w:r></w:p>' if isinstance(x, tuple) else f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>"
    body = "".join("<w:tbl><w:tr>" + "".join(f"<w:tc>{''.join(map(p, c)) if isinstance(c, list) else p(c)}</w:tc>" for c in x["row"]) + "</w:tr></w:tbl>" if isinstance(x, dict) else p(x) for x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="H1"><w:name w:val="Heading 1"/></w:style></w:styles>')
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.docx").write_bytes(docx([("Условия оплаты", "H1"), "Покупатель оплачивает товар в течение пятнадцати дней после получения счета от поставщика и подписания акта.", {"row": ["ячейка", "вторая"]}, ("ПОСТАВКА", "H1"), "срок"]))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "c.json").write_text(json.dumps({"clauses": [{"heading": "Арбитраж", "body": "Споры"}, {"heading": "", "body": "x"}]}, ensure_ascii=False))
    (tmp_path / "d.json").write_text("{")
    (tmp_path / "e.json").write_text('{"sections": []}')
    (tmp_path / "map.csv").write_text('﻿section_id,title,count\npayment_terms,"Порядок\nрасчетов",3\n,none,1\n', encoding="utf-8")
    return str(tmp_path)


def test_documents_to_corpus_and_titles(spark, folder):
    blocks = readers.read_docx(spark, folder)
    assert {(r.path.rsplit("/", 1)[1], r.error is None) for r in blocks.collect()} == {("a.docx", True), ("b.docx", False)}
    assert [(r.kind, r.style, r.bold_ratio) for r in blocks.where("error is null").orderBy("pos").collect()][:3] == [("p", "Heading 1", 1.0), ("p", "", 0.0), ("t", "", 0.0)]
    assert readers.docx_text(blocks.where("error is null")).first().text.endswith("срок\nячейка\nвторая")
    sections = pipelines.build_corpus(spark, folder, f"{folder}/nested", f"{folder}/flat")
    assert [(r.title, r.section_id) for r in sections.orderBy("order").collect()] == [("Условия оплаты", "payment_terms"), ("ПОСТАВКА", "delivery_terms")]
    assert spark.read.json(f"{folder}/nested").select(F.size("sections")).first()[0] == 2
    assert [r.title for r in readers.read_corpus(spark, f"{folder}/flat").collect()] == ["Условия оплаты"]
    segments, report = pipelines.type_titles(spark, folder, f"{folder}/map.csv")
    assert {(r.contract_id, r.source, r.status, r.segments_count) for r in report.collect()} == {("a", "docx", "ok", 2), ("b", "docx", "parse_error", 0), ("c", "json", "ok", 1), ("d", "json", "parse_error", 0), ("e", "json", "unsupported_json_structure", 0)}
    assert {(r.section_title, r.section_id, r.confidence) for r in segments.collect()} == {("Условия оплаты", "payment_terms", "0.900"), ("ПОСТАВКА", "delivery_terms", "0.900"), ("Арбитраж", "dispute_resolution", "0.900")}
    writers.write_report(report, f"{folder}/report")
    assert readers.read_csv(spark, f"{folder}/report", ";").count() == 5
    assert {r.title for r in readers.read_title_map(spark, f"{folder}/map.csv").collect()} == {"Порядок\nрасчетов"}
    with pytest.raises(ValueError):
        readers.read_csv(spark, f"{folder}/map.csv", required=["nothing"])
    assert pipelines.build_title_map(segments).count() == 3
    healed, heal = pipelines.heal_folder(spark, folder)
    assert {r.status.split(":")[0] for r in heal.collect()} == {"ok", "error"} and pipelines.split_folder(spark, folder).count() >= 1


def test_tolerant_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"contract_id": "k", "sections": [{"section_id": "s", "text": "t"}]}\n\nnot json\n{"sections": []}\n{"sections": 5}\n')
    assert [(r.contract_id, len(r.sections)) for r in readers.read_segmented(spark, str(tmp_path / "x.jsonl")).orderBy("contract_id").collect()] == [("doc_4", 0), ("k", 1)]


def rows_of_corpus(spark):
    text = "Payment terms: the invoice is due by bank transfer within {} days, interest and penalty apply; prepayment is payable in advance. Clause {} covers VAT and set-off for lot {}."
    data = [(i, f"d{i % 9}", "", "", "en", "Payment", text.format(i, "x" * (i % 13), i * 7) + " extra words here " * (i % 5)) for i in range(30)]
    return spark.createDataFrame(data, "seq long, doc_id string, section_group string, section_id string, language string, title string, text string")


def test_section_job(spark):
    form = FORM | {"language_mode": "en", "currency": "USD"}
    job = pipelines.section_job(form, rows_of_corpus(spark), "payment_terms", 3)
    raw = job["raw"].collect()
    assert 1 <= len(raw) <= 3 and all("[TERM_DAYS]" in r.text for r in raw)
    prompt = job["prompt"].first().prompt
    assert 'section "Payment Terms"' in prompt and "- bank_charges: paid by the recipient" in prompt and "- payment_term_days: 15" in prompt
    ru = spark.createDataFrame([(json.dumps(FORM, ensure_ascii=False),)], "f string").select(prompts.section_prompt(F.col("f"), F.array(F.lit("образец")), prompts.DELIVERY).alias("p")).first().p
    assert "Условия поставки" in ru and "- delivery_place: Москва" in ru and "- partial_deliveries_allowed: нет" in ru and "- образец" in ru
    with pytest.raises(ValueError):
        pipelines.generate_contract({}, rows_of_corpus(spark), lambda *a: "", {})
    text = pipelines.generate_contract(form, rows_of_corpus(spark), lambda s, u, a, b: "generated", {})
    assert text.split("\n\n") == ["generated", "generated", "[liability_penalties]", "[disputes_governing_law]"]


def test_stream(spark, tmp_path):
    rows_of_corpus(spark).drop("seq").withColumn("contract_id", F.lit("c")).coalesce(1).write.json(str(tmp_path / "in"))
    stream = corpus.cleaned_stream(corpus.read_corpus_stream(spark, str(tmp_path / "in")), "en").withColumn("at", F.current_timestamp())
    corpus.write_stream(corpus.first_seen(stream, "at"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= 30
