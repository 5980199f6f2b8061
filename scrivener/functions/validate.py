"""Validators of generated texts and of the input form, as Columns that hold the first rule broken or null."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivener.functions import schema as json_schema
from scrivener.functions import text as t

#: Marks of bank details, of late-payment penalties, and of topics foreign to delivery.
BANK = r"(?iU)\bр/с\b|\bк/с\b|\bбик\b|\bинн\b|\bкпп\b|\bогрн\b|\bswift\b|\biban\b|\baccount\s+no\b|\bbeneficiary\b|\bрасч[её]тн(ый|ого)\s+сч[её]т\b\s*[:№]?\s*\d{10,}|\bкорр(еспондентский)?\s+сч[её]т\b\s*[:№]?\s*\d{10,}"
PENALTY = r"(?iU)\bпен(я|и)\b|\bнеусто(йка|ек)\b|\bштраф\b|\bпроцен(т|ты)\s+за\s+просроч|\blate\s+payment\b|\bdefault\s+interest\b"
FOREIGN = r"(?iU)\bоплат|\bплатеж|\bплатёж|\bсчет\b|\bсч[её]т\b|\binvoice\b|\bпен(я|и)\b|\bнеусто(йка|ек)\b|\bштраф\b|\bсуд\b|\bарбитраж\b|\bпретензи"
BOILERPLATE = (
    r"\bв\s+соответствии\s+с\s+действующ\w*\s+законодательств\w*\b", r"\bсторон[аы]\s+обяз(уется|уются)\b.*\bсоблюдат\w*\b", r"\bвправе\s+требоват\w*\b", r"\bвозможн(ые|ых)\s+последств(ия|ий)\b",
    r"\bв\s+случае\s+неисполнени\w*\b.*\bубытк\w*\b", r"\bвозмещени\w*\s+убытк\w*\b", r"\bв\s+случае\s+возникновени\w*\s+спор\w*\b", r"\bвести\s+переговор\w*\b",
)
OUT_OF_SCOPE = (
    r"\bприменим(ое|ого)\s+прав(о|а)\b", r"\bподсудност[ьи]\b", r"\bюрисдикц(ия|ии)\b", r"\bарбитражн(ый|ого)\s+суд\b", r"\bтретейск(ий|ого)\s+суд\b", r"\bсудебн(ый|ого)\s+поряд(ок|ке)\b",
    r"\bмест[оа]\s+рассмотрени[яе]\s+спор(ов|а)\b", r"\bфорс[- ]?мажор\b", r"\bнепреодолим(ая|ой)\s+сил(а|ы)\b", r"\bконфиденциал(ьн|)\w*\b", r"\bкоммерческ(ая|ой)\s+тайн(а|ы)\b",
    r"\bрасторжен(ие|ия)\b", r"\bсрок\s+действия\b", r"\bпрекращен(ие|ия)\b", r"\bраздел\s+уведомлени(я|й)\b", r"\bнастоящ(ие|ий)\s+уведомлени(я|е)\s+направля(ется|ются)\s+по\s+адрес(у|ам)\b",
)
OLD_PENALTY = ("пеня", "неустойк", "штраф", "санкц")
OLD_BANK = ("банковские реквизиты", "р/с", "к/с", "корр", "корр.счет", "корреспондентск", "бик", "iban", "swift", "bic", "account no", "account number", "bank code", "routing number", "банковских реквизит")
DEBIT, CREDIT = ("дата списан", "днем списан", "днём списан", "момент списан"), ("дата зачисл", "днем зачисл", "днём зачисл", "момент зачисл")


def first_broken(*rules: tuple[Column, str]) -> Column:
    """The code of the first rule that holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for c, code in rules])


def _count_lines(rows: Column, pattern: str) -> Column:
    return F.size(F.filter(rows, lambda x: x.rlike(pattern)))


def payment_terms(c: Column, bank_details: bool, penalty: bool, least: int = 850, items: int = 20, repeated: Column | None = None) -> Column:
    """empty_output, too_short, too_few_list_items, wrong_numbering_format, bank_details_detected, late_payment_penalty_detected.

    ``repeated`` may add the rule repetition_detected, which is off by default.
    """
    good, plain = r"(?U)^\d+\.\d+\.\s+", r"(?U)^\d+\.\s+"

    def count(x: Column) -> Column:
        return F.struct(x["body"].alias("body"), _count_lines(x["rows"], good).alias("good"), _count_lines(x["rows"], plain).alias("plain"))

    def judge(x: Column) -> Column:
        return first_broken(
            (x["body"] == "", "empty_output"),
            (t.dense_length(x["body"]) < least, "too_short"),
            (x["good"] < items, "too_few_list_items"),
            ((x["good"] > 0) & (x["plain"] >= F.greatest(F.lit(2), F.floor(x["good"] / 2))), "wrong_numbering_format"),
            (F.lit(not bank_details) & x["body"].rlike(BANK), "bank_details_detected"),
            (F.lit(not penalty) & x["body"].rlike(PENALTY), "late_payment_penalty_detected"),
            (F.lit(False) if repeated is None else repeated, "repetition_detected"),
        )

    return t.bind(t.bind(F.struct(t.strip(t.filled(c)).alias("body"), t.lines(c).alias("rows")), count), judge)


def delivery_terms(c: Column, least: int = 900, items: int = 20, prefix: str = "2") -> Column:
    """empty_output, too_short, too_few_list_items, forbidden_topic_detected (three hits or more)."""
    body, rows = t.strip(t.filled(c)), t.lines(c)
    numbered = _count_lines(rows, rf"(?U)^\s*\Q{prefix}\E\.(\d{{1,3}})\s*(?:[.)\-–])?\s+")
    return first_broken((body == "", "empty_output"), (t.dense_length(body) < least, "too_short"), (numbered < items, "too_few_list_items"), (F.regexp_count(body, F.lit(FOREIGN)) >= 3, "forbidden_topic_detected"))


def old_payment_terms(c: Column, bank_details: bool, penalty: bool, repeated: Column, placeholder: str = r"\[[A-Z_]{2,}\]", least: int = 750) -> Column:
    """The older rules, for items like ``1)``: also placeholders, mixed parties, repetition, boilerplate, foreign topics."""
    body = t.filled(c)
    low = F.lower(body)
    has = lambda *words: t.count_words(low, words) > 0
    any_of = lambda patterns: low.rlike("(?U)" + "|".join(f"(?:{x})" for x in patterns))
    mixed = (has("покупател") & has("заказчик")) | (has("поставщик") & has("исполнител")) | (has("покупател") & has("продавец"))
    return first_broken(
        (t.dense_length(body) < least, "too_short"),
        (F.regexp_count(body, F.lit(r"(?mU)^\s*\d{1,3}\)\s+")) < 20, "too_few_list_items"),
        (body.rlike(placeholder), "contains_placeholders"),
        (mixed, "mixed_party_terms"),
        (repeated, "repetition_detected"),
        (any_of(BOILERPLATE), "contains_boilerplate"),
        (any_of(OUT_OF_SCOPE), "contains_out_of_scope_topics"),
        (F.lit(not penalty) & has(*OLD_PENALTY), "contains_penalty"),
        (F.lit(not bank_details) & (has(*OLD_BANK) | low.rlike(r"\d{12,}")), "contains_bank_details"),
        (has(*DEBIT) & has(*CREDIT), "conflicting_payment_date_definition"),
    )


def custom(check: Callable[[str], str | None]):
    """A caller's own validator as a function of a text column, batch by batch."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: check(x or ""))

    return run


# ---- the input form

#: The form's fields: kind, and what it may be.  A list of choices, (least, most) or a least length.
FORM: dict[str, dict[str, tuple]] = {
    "": {"contract_type": ("string", ["supply"]), "language_mode": ("string", ["ru", "en", "bilingual"]), "currency": ("string", 1)},
    "payment": {
        "payment_trigger": ("string", 1), "payment_term_days": ("integer", (0, 3650)), "prepayment_required": ("boolean",), "bank_details_included": ("boolean",), "withholding_allowed": ("boolean",),
        "suspension_right": ("boolean",), "bank_charges": ("string", ["payer", "payee", "shared", ""]), "vat_mode": ("string", ["exclusive_if_any", "inclusive", "not_applicable", ""]), "late_payment_penalty_enabled": ("boolean",),
    },
    "delivery": {
        "delivery_trigger": ("string", 1), "delivery_term_days": ("integer", (1, 3650)), "delivery_place": ("string", 1), "partial_deliveries_allowed": ("boolean",), "acceptance_required": ("boolean",),
        "acceptance_period_days": ("integer", (0, 365)), "acceptance_docs": ("string", 0), "acceptance_rules": ("string", ["buyer_only", "supplier_only", "mixed", ""]),
    },
    "liability": {
        "liability_cap_enabled": ("boolean",), "liability_cap_type": ("string", ["contract_price", "fixed_amount", "other", ""]), "cap_scope": ("string", ["aggregate", "per_claim", "other", ""]),
        "indirect_damages_excluded": ("boolean",), "exceptions_to_cap": ("array", ["fraud", "wilful_misconduct", "gross_negligence", "ip_infringement", "other"]),
        "delay_in_delivery_penalty_enabled": ("boolean",), "claim_notice_days": ("integer", (0, 3650)),
    },
}


def form_schema() -> dict:
    """The JSON Schema of ``FORM``: all groups and fields are required, and no others may be there."""

    def field(kind: str, limit=None) -> dict:
        if kind == "array":
            return {"type": kind, "items": {"enum": limit}, "uniqueItems": True}
        if isinstance(limit, list):
            return {"type": kind, "enum": limit}
        if isinstance(limit, tuple):
            return {"type": kind, "minimum": limit[0], "maximum": limit[1]}
        return {"type": kind} if limit is None else {"type": kind, "minLength": limit}

    made = {group: {"type": "object", "additionalProperties": False, "required": list(fields), "properties": {k: field(*f) for k, f in fields.items()}} for group, fields in FORM.items()}
    root = made.pop("")
    return root | {"required": [*root["required"], *made], "properties": root["properties"] | made}


def form_issues(forms: DataFrame, id_col: str, json_col: str, schema: dict | bool | None = None) -> DataFrame:
    """(id, path, rule) of each rule of ``schema`` (that of ``FORM`` by default) that a JSON form breaks.

    Paths and rules are those of ``schema.issues``.  Each form is judged in its own row, so many are checked like one.
    """
    found = json_schema.issues(form_schema() if schema is None else schema, F.col("v"))
    v = forms.select(F.col(id_col), F.try_parse_json(F.col(json_col)).alias("v"))
    return v.select(id_col, F.explode(found).alias("x")).select(id_col, "x.path", "x.rule")


# ---- generation with retries

def generate_with_retry(chat: Callable[[str, str, float, float], str], system: str, user: str, validator: Callable[[str], str | None] | None = None, retry_text: str = "", retries: int = 2, settings: tuple[float, float] = (0.3, 0.92), retry_settings: tuple[float, float] = (0.35, 0.92), retryable: Sequence[str] = ("too_short", "repetition_detected")) -> tuple[str, str | None, int]:
    """(text, code of the last broken rule or None, attempts) of a caller's ``chat(system, user, temperature, top_p)``.

    Only codes in ``retryable`` are tried again; when attempts run out the last code is returned.
    """
    text, code = "", None
    for attempt in range(retries + 1):
        prompt = f"{user}\n\n{retry_text.strip()}\n" if attempt and retry_text else user
        text = chat(system, prompt, *(retry_settings if attempt else settings))
        code = validator(text) if validator else None
        if code is None or code not in retryable:
            return text, code, attempt + 1
    return text, code, retries + 1


def load_json(path: str) -> dict:
    """A JSON file of settings; missing or broken files raise a RuntimeError that names the path."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise RuntimeError(f"cannot read {path}: {e}") from e
