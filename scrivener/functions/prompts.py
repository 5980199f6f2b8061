"""Prompts for a contract section: parameters of the form, phrases for them, and blocks of text.

The wording is this project's own; only field names, choices and defaults follow the form.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivener.functions import text as t

SECTIONS = ("payment_terms", "delivery_terms", "liability_penalties", "disputes_governing_law")
GENERATED = SECTIONS[:2]


@dataclass(frozen=True)
class Section:
    """How a section is asked for: defaults of its parameters, phrases by value, and fixed blocks by language."""

    number: int
    form_key: str
    defaults: Mapping[str, str]
    phrases: Mapping[str, Mapping[str, tuple[str, str]]]  # parameter -> value -> (en, ru); "" is any other value
    titles: tuple[str, str]
    aliases: Mapping[str, str] = field(default_factory=dict)
    forbidden: tuple[str, str] = ("", "")
    items: int = 20


_YES_NO = {"true": ("yes", "да"), "": ("no", "нет")}
PAYMENT = Section(
    1, "payment",
    {"payment_trigger": "invoice_date", "payment_term_days": "30", "prepayment_required": "false", "bank_details_included": "false", "withholding_allowed": "false", "suspension_right": "false", "bank_charges": "payer", "vat_mode": "exclusive_if_any", "late_payment_penalty_enabled": "false"},
    {
        "payment_trigger": {"invoice_date": ("after the invoice date", "после даты счета"), "receipt_of_invoice": ("after receipt of the invoice", "после получения счета"), "acceptance_date": ("after acceptance", "после приемки"), "delivery_date": ("after delivery", "после поставки"), "signing_date": ("after signing", "после подписания"), "": ("after the agreed event", "после согласованного события")},
        "bank_charges": {"payer": ("paid by the payer", "платит плательщик"), "beneficiary": ("paid by the recipient", "платит получатель"), "shared": ("shared", "делятся"), "": ("as agreed", "по соглашению")},
        "vat_mode": {"exclusive_if_any": ("on top of the price", "сверх цены"), "inclusive": ("within the price", "в цене"), "not_applicable": ("none", "нет"), "": ("as the law says", "по закону")},
        **{k: _YES_NO for k in ("prepayment_required", "bank_details_included", "withholding_allowed", "suspension_right", "late_payment_penalty_enabled")},
    },
    ("Payment Terms", "Порядок расчетов"), {"payee": "beneficiary"}, ("disputes, notices, liability", "споры, уведомления, ответственность"),
)
DELIVERY = Section(
    2, "delivery",
    {"delivery_trigger": "within_days_from_effective", "delivery_term_days": "30", "delivery_place": "", "partial_deliveries_allowed": "true", "incoterms": "", "risk_transfer": "upon_delivery", "acceptance_docs": "", "packaging_required": "true"},
    {
        "delivery_trigger": {"within_days_from_effective": ("after the effective date", "после вступления в силу"), "within_days_from_signing": ("after signing", "после подписания"), "from_order_ack": ("after the order is confirmed", "после подтверждения заказа"), "from_payment": ("after payment", "после оплаты"), "": ("after the agreed event", "после согласованного события")},
        "risk_transfer": {"upon_delivery": ("on delivery", "при поставке"), "upon_handover_to_carrier": ("on handover to the carrier", "при передаче перевозчику"), "upon_loading": ("after loading", "после погрузки"), "": ("as agreed", "по соглашению")},
        "acceptance_docs": {"act": ("acceptance act", "акт приемки"), "acceptance_act": ("acceptance act", "акт приемки"), "invoice": ("invoice", "счет"), "delivery_note": ("delivery note", "накладная"), "waybill": ("delivery note", "накладная"), "": ("usual documents", "обычные документы")},
        **{k: _YES_NO for k in ("partial_deliveries_allowed", "packaging_required")},
    },
    ("Delivery Terms", "Условия поставки"), {}, ("payment, disputes, liability, notices", "оплата, споры, ответственность, уведомления"),
)


def parameter(form: Column, section: Section, name: str) -> Column:
    """A form's value of a parameter as text, or its default; ``form`` is a VARIANT."""
    found = F.coalesce(F.try_variant_get(form, f"$.{section.form_key}.{name}", "string"), F.lit(section.defaults[name]))
    for old, new in section.aliases.items():
        found = F.when(found == old, new).otherwise(found)
    return found


def phrase(value: Column, choices: Mapping[str, tuple[str, str]], english: Column) -> Column:
    """The phrase of a value in the form's language, or that of any other value."""
    key = F.lower(t.strip(value))
    pick = lambda n: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in choices.items() if k for x in (k, v[n])]), key), F.lit(choices[""][n]))
    return F.when(english, pick(0)).otherwise(pick(1))


def section_prompt(form_json: Column, snippets: Column, section: Section) -> Column:
    """The prompt of each row: its form as JSON text and its snippets as an array.

    English for language_mode en, Russian for anything else.  Blocks: task, structure, parameters, parties,
    topics that don't belong here, style samples, limits, output.
    """
    form = F.try_parse_json(form_json)
    english = F.lower(t.strip(F.coalesce(F.try_variant_get(form, "$.language_mode", "string"), F.lit("ru")))) == "en"
    say = lambda en, ru: F.when(english, F.lit(en)).otherwise(F.lit(ru))
    lines = []
    for name in section.defaults:
        value = parameter(form, section, name)
        shown = phrase(value, section.phrases[name], english) if name in section.phrases else value
        lines.append(F.concat(F.lit(f"- {name}: "), F.coalesce(F.nullif(shown, F.lit("")), F.lit("-"))))
    n = section.number
    blocks: Sequence[Column] = [
        say(f'Write the contract section "{section.titles[0]}".', f'Напиши раздел договора "{section.titles[1]}".'),
        say(f"At least {section.items} items, one sentence each, numbered {n}.1., {n}.2., ... on lines of their own.", f"Не менее {section.items} пунктов, по одному предложению, с номерами {n}.1., {n}.2., ... на отдельных строках."),
        F.concat(say("Parameters:\n", "Параметры:\n"), F.concat_ws("\n", *lines)),
        say("Call the parties Buyer and Supplier throughout.", "Называй стороны Покупатель и Поставщик."),
        say(f"Leave out: {section.forbidden[0]}.", f"Не упоминай: {section.forbidden[1]}."),
        F.concat(say("Style samples, not facts:\n", "Образцы стиля, не факты:\n"), F.when(F.size(snippets) > 0, F.array_join(F.transform(snippets, lambda s: F.concat(F.lit("- "), s)), "\n")).otherwise(F.lit("-"))),
        say("No placeholders, no repetition, no facts from the samples.", "Без заглушек, повторов и фактов из образцов."),
        say("Answer with the section's text only, in English.", "Ответь только текстом раздела, по-русски."),
    ]
    return t.tidy(F.concat_ws("\n\n", *blocks))


#: What the model is told to be, per language, and what a section's samples must not lend to it.
_ROLE = ("You draft contracts with care. Keep to the parameters given, write formally and make up nothing.", "Ты внимательно составляешь договоры. Держись заданных параметров, пиши официально и ничего не придумывай.")
_FROM_SAMPLES = {
    "payment": ("Take no sums, currencies, rates, countries, company names, item numbers or bank details from the samples.", "Не бери из образцов суммы, валюты, ставки, страны, названия компаний, номера пунктов и банковские реквизиты."),
    "delivery": ("Take no addresses, dates, delivery codes, company names or item numbers from the samples.", "Не бери из образцов адреса, даты, базисы поставки, названия компаний и номера пунктов."),
}
_ONLY = {
    "payment": ("Bank details stay out unless the form allows them.", "Без банковских реквизитов, если форма их не допускает."),
    "delivery": ("Payment, penalties and disputes stay out.", "Без оплаты, штрафов и споров."),
}


def _in(english: Column, pair: tuple[str, str]) -> Column:
    return F.when(english, F.lit(pair[0])).otherwise(F.lit(pair[1]))


def is_english(form_json: Column) -> Column:
    """Whether a form, as JSON text, asks for English; any other language, and none, is Russian."""
    return F.lower(t.strip(F.coalesce(F.try_variant_get(F.try_parse_json(form_json), "$.language_mode", "string"), F.lit("ru")))) == "en"


def system_text(section: Section, english: Column) -> Column:
    """What comes before a section's prompt."""
    return F.concat_ws(" ", _in(english, _ROLE), _in(english, _FROM_SAMPLES[section.form_key]))


def retry_text(section: Section, english: Column, items: int | None = None) -> Column:
    """What comes after a section's prompt once an attempt was refused."""
    least, n = section.items if items is None else items, section.number
    ask = (
        f"The last draft was refused by a check. Give at least {least} items numbered {n}.1., {n}.2., ..., each on a line of its own, leave those written as they are, and let each new one add a point of its own, worded differently.",
        f"Прошлый вариант не прошел проверку. Нужно не менее {least} пунктов с номерами {n}.1., {n}.2., ..., каждый на своей строке; написанные оставь как есть, а каждый новый пусть добавит свою мысль другими словами.",
    )
    return F.concat_ws(" ", _in(english, ask), _in(english, _ONLY[section.form_key]))


def stub(section_id: str) -> str:
    """A stand-in for sections that nothing generates."""
    return f"[{section_id}]"
