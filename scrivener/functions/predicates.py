"""Classifiers of lines, titles and texts: functions from Columns to a Column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrivener.functions import text as t

# ---- languages

def language_matches(wanted: str, language: Column) -> Column:
    """ru and en take themselves and bilingual; bilingual takes all three; anything else takes all. Null is ru."""
    have, wanted = F.lower(F.coalesce(F.nullif(language, F.lit("")), F.lit("ru"))), (wanted or "ru").lower()
    if wanted in ("ru", "en"):
        return have.isin(wanted, "bilingual")
    return have.isin("ru", "en", "bilingual") if wanted == "bilingual" else F.lit(True)


def language_by_ratio(c: Column) -> Column:
    """en if there are more Latin than Cyrillic letters and over 20 of them, else ru."""
    def decide(n: Column) -> Column:
        return F.when((n["latin"] > n["cyrillic"]) & (n["latin"] > 20), "en").otherwise("ru")

    size = lambda low, other: F.length(F.regexp_replace(low, other, ""))
    return t.bind(F.lower(t.filled(c)), lambda low: t.bind(F.struct(size(low, "[^a-z]").alias("latin"), size(low, "[^а-яё]").alias("cyrillic")), decide))


def language_by_any_latin(c: Column) -> Column:
    return F.when(t.filled(c).rlike("[A-Za-z]"), "en").otherwise("ru")


# ---- domains.  Fixed values: stems that speak for and against a section's domain; each list is a bag.

PAYMENT_FOR = (
    "оплата", "платеж", "платёж", "счет", "счёт", "инвойс", "предоплата", "аванс", "отсрочка", "расчет", "расчёт", "расчеты", "расчёты",
    "срок", "банков", "ндс", "комис", "неустойк", "пеня", "процент", "просроч",
    "payment", "invoice", "due", "payable", "prepayment", "advance", "bank", "transfer", "vat", "interest", "penalty", "setoff", "set-off",
)
PAYMENT_AGAINST = (
    "поставщик обязуется", "передать в собственность", "номенклатур", "ассортимент", "техническ", "спецификац", "предмет договора",
    "поставка товара осуществляется", "продукци", "оборудовани", "товар", "работ", "услуг", "комплект", "acceptance", "приемк", "приёмк", "качество", "количество",
)
DELIVERY_FOR = (
    "поставка", "доставка", "отгруз", "срок постав", "срок достав", "место постав", "место достав", "переход риск", "риск случайной",
    "инкотерм", "incoterms", "склад", "перевоз", "транспорт", "упаков", "маркир", "приемк", "приёмк", "акт прием", "накладн", "товаротранспорт",
    "частичн", "партиями", "график", "задержк", "просрочк", "хранен", "демерредж", "простой",
    "delivery", "dispatch", "shipment", "shipping", "lead time", "delivery date", "delivery point", "incoterms", "risk", "title", "packing", "packaging",
    "marking", "carrier", "transport", "acceptance", "take delivery", "demurrage", "storage", "partial delivery", "instalments", "schedule",
)
DELIVERY_AGAINST = (
    "оплата", "платеж", "счет", "инвойс", "проценты", "пеня", "неустойк", "штраф", "payment", "invoice", "interest", "penalty", "late payment",
    "арбитраж", "суд", "претенз", "спор", "jurisdiction", "governing law", "liability", "damages", "убытк", "ответственност",
)


def in_domain(title: Column, body: Column, words_for: Sequence[str], words_against: Sequence[str], least: int = 4, most_against: int = 3, sure: int = 7) -> Column:
    """At least ``least`` words for; with ``most_against`` words against or more, at least ``sure`` for."""
    def decide(low: Column) -> Column:
        counts = F.struct(t.count_words(low, words_for).alias("pro"), t.count_words(low, words_against).alias("con"))
        return t.bind(counts, lambda n: (n["pro"] >= least) & ((n["con"] < most_against) | (n["pro"] >= sure)))

    return t.bind(F.lower(F.concat(t.filled(title), F.lit("\n"), t.filled(body))), decide)


def long_enough(c: Column, least: int = 80) -> Column:
    return F.length(t.strip(t.filled(c))) >= least


# ---- headings by list, number and capitals.  Fixed values.

PLAIN_HEADINGS = (
    "ПРЕАМБУЛА", "Преамбула", "ПРЕДМЕТ КОНТРАКТА", "Предмет Контракта", "ОСНОВНЫЕ УСЛОВИЯ", "Основные условия", "УСЛОВИЯ ОПЛАТЫ", "Условия оплаты",
    "ОТГРУЗКА ТОВАРА", "Отгрузка Товара", "ОТВЕТСТВЕННОСТЬ СТОРОН", "Ответственность Сторон", "АРБИТРАЖ", "Арбитраж", "ПРОЧИЕ УСЛОВИЯ", "Прочие условия",
    "РЕКВИЗИТЫ", "Реквизиты", "ПОДПИСИ", "Подписи", "ПРИЛОЖЕНИЯ", "Приложения", "Приложения:",
    "PREAMBLE", "Preamble", "SUBJECT OF THE CONTRACT", "Subject of the Contract", "PRINCIPAL PROVISIONS", "Principal provisions",
    "TERMS AND PROCEDURES OF PAYMENT", "Terms and procedures of payment", "SHIPMENT OF THE GOODS", "Shipment of the Goods",
    "LIABILITY OF THE PARTIES", "Liability of the Parties", "ARBITRATION", "Arbitration", "OTHER CONDITIONS", "Other conditions",
    "SIGNATURES", "Signatures", "APPENDICES", "Appendices", "Appendices:",
)
TITLE_WORDS = (
    "замечания", "качество", "количество", "ассортимент", "комплектн", "предмет", "оплата", "поставка", "отгрузка", "ответственность", "арбитраж",
    "конфиденциал", "форс", "обстоятельств", "subject", "payment", "delivery", "shipment", "liability", "arbitration", "quantity", "quality",
    "selection", "completeness", "force majeure", "governing law", "confidential", "terms and conditions", "general terms",
)
ACTION_VERBS = (
    "принять", "предоставить", "оплатить", "возместить", "осуществить", "направить", "произвести", "передать", "просим", "требуем", "заменить",
    "accept", "provide", "pay", "return", "compensate", "perform", "send", "deliver", "please", "replace",
)
COVER_CAPS = ("BUYER", "SELLER", "ПОКУПАТЕЛЬ", "ПОСТАВЩИК", "ПРОДАВЕЦ", "CONTRACT", "КОНТРАКТ", "EXAMPLE")
MAX_LEVEL = 2


def number_level(line: Column) -> Column:
    """Parts of a leading number like 4.1. or 4.1), 0 without one."""
    number = F.regexp_extract(t.strip(line), r"(?U)^(\d+(?:\.\d+)*)[.)]\s+", 1)
    return t.bind(number, lambda n: F.when(n == "", 0).otherwise(F.size(F.split(n, r"\."))))


def begins_with_action(line: Column) -> Column:
    rest = t.strip(F.lower(F.regexp_replace(t.strip(t.filled(line)), r"(?U)^\d+(\.\d+)*[.)]\s+", "")))
    return F.substring_index(rest, " ", 1).isin(*ACTION_VERBS)


def title_like(line: Column) -> Column:
    def decide(s: Column) -> Column:
        return (s != "") & (s.endswith(":") | (t.count_words(F.lower(s), TITLE_WORDS) > 0))

    return t.bind(t.strip(t.filled(line)), decide)


def all_caps_heading(line: Column) -> Column:
    """Six letters or more, all capitals, at most 90 characters; no cover-page label, nothing in parentheses."""
    def decide(s: Column) -> Column:
        letters = F.regexp_replace(s, f"[^{t.LETTERS}]", "")
        cover = F.lit(False)
        for x in COVER_CAPS:
            cover = cover | s.startswith(x)
        return ~cover & ~(s.startswith("(") & s.endswith(")")) & (F.length(s) <= 90) & (F.length(letters) >= 6) & (letters == F.upper(letters))

    return t.bind(t.narrow(line), decide)


def addendum(line: Column) -> Column:
    return line.rlike(r"(?iU)^(Приложение|Addendum)\s*№?\s*\d+.*$")


def listed_heading(line: Column) -> Column:
    return line.isin(*PLAIN_HEADINGS)


def heading(line: Column, caps: bool = True) -> Column:
    """Listed, ARTICLE n, addendum, numbered (up to level 2, no action, like a title) or, if ``caps``, capitals."""
    def decide(s: Column) -> Column:
        numbered = s.rlike(r"(?U)^\d+(\.\d+)*[.)]\s+.+$")
        by_number = (number_level(s) > 0) & (number_level(s) <= MAX_LEVEL) & ~begins_with_action(s) & title_like(s)
        article = s.rlike(r"(?iU)^(ARTICLE|CLAUSE|SECTION)\s+\d+(\.\d+)*[.)]?(\s+.+)?$")
        found = F.when(listed_heading(s) | article | addendum(s), True).when(numbered, by_number)
        return (s != "") & found.otherwise(all_caps_heading(s) if caps else F.lit(False))

    return t.bind(t.narrow(line), decide)


# ---- headings by level, for healing

def probable_caps(line: Column) -> Column:
    def decide(s: Column) -> Column:
        letters, capitals = F.length(F.regexp_replace(s, r"(?U)[^\p{IsAlphabetic}]", "")), F.length(F.regexp_replace(s, r"(?U)[^\p{Lu}]", ""))
        marks = F.length(F.regexp_replace(s, "[^.!?;]", ""))
        fit = (s != "") & (F.length(s) <= 90) & ~s.rlike(r"(?U)^\s*[-•]\s+.+$") & (letters >= 4) & (marks < 2)
        return fit & ((capitals / F.greatest(letters, F.lit(1)) >= 0.75) | s.contains("/"))

    return t.bind(t.unify_dashes(line), decide)


def heading_level(line: Column) -> Column:
    """1, 2 or 3 for a heading, else null.  A number needs a final dot or parenthesis for each of its parts."""
    def decide(s: Column) -> Column:
        number = r"(?U)^\s*(\d{1,3})(?:\.(\d{1,3}))?(?:\.(\d{1,3}))?\s*[.)]\s*(.+)$"
        by_number = F.when(F.regexp_extract(s, number, 3) != "", 3).when(F.regexp_extract(s, number, 2) != "", 2).otherwise(1)
        dash = t.unify_dashes(line).rlike(r"(?U)^\s*(\d{1,3})\s*-\s*(.+)$")
        return F.when(s.rlike(r"(?iU)^\s*СТАТЬЯ\s+(\d+)\.?\s*(.*)$"), 1).when(s.rlike(number), by_number).when(dash | probable_caps(s), 1)

    return t.bind(t.canonical_heading(line), decide)


# ---- headings of corpus blocks

def block_heading(line: Column, style: Column | None = None, longest: int = 140, digits: int = 3, deeper: int = 4, caps: float = 0.88, caps_longest: int = 90, colon_longest: int = 90) -> Column:
    """By style name, number, share of capitals or closing colon.  The older rule: 120, 2, 3, .85, 80, 80."""
    def decide(s: Column) -> Column:
        number = s.rlike(rf"(?U)^\d{{1,{digits}}}(\.\d{{1,{digits}}}){{0,{deeper}}}\.?\s+\S+")
        capitals = (F.length(s) <= caps_longest) & (F.coalesce(t.caps_ratio(s), F.lit(0.0)) > caps)
        colon = s.endswith(":") & (F.length(s) <= colon_longest)
        styled = F.lit(False) if style is None else F.lower(t.strip(t.filled(style))).rlike("^(heading|заголовок|header)")
        return (s != "") & (F.length(s) <= longest) & (styled | number | capitals | colon)

    return t.bind(t.plain_spaces(line), decide)


#: Short lines that are no headings.
NOISE = (r"^buyer\s*/\s*seller$", r"^seller\s*/\s*buyer$", r"^buyer$", r"^seller$", r"^м\.?п\.?$", r"^swift$", r"^инн$", r"^кпп$", r"^огрн$", r"^qty$")


def noise_block(line: Column) -> Column:
    def decide(s: Column) -> Column:
        x = F.lower(s)
        coded = s.rlike(r"(?U)^[\w\-/.,:;() ]{1,25}$") & (F.length(F.regexp_replace(s, r"(?U)\D", "")) >= 6)
        return (F.length(x) <= 2) | x.rlike("(?U)" + "|".join(NOISE)) | coded

    return t.bind(t.plain_spaces(line), decide)


def heading_text(line: Column) -> Column:
    """A short title with a heading's word, or in capitals up to 80 characters."""
    def decide(s: Column) -> Column:
        words = r"(?iU)\b(предмет|оплата|поставка|ответственност|арбитраж|споры|право|гаранти|форс|реквизит|definitions|subject|payment|delivery|liability|arbitration|governing law|warranty|force majeure|signatures)\b"
        upper = (s == F.upper(s)) & (s != F.lower(s)) & (F.length(s) <= 80)
        return (s != "") & (F.length(s) <= 120) & s.rlike("[A-Za-zА-Яа-я]") & (s.rlike(words) | upper)

    return t.bind(t.bare_title(line), decide)


def paragraph_heading(line: Column, style: Column) -> Column:
    """By style name, else by the text; bold type never decides by itself."""
    return F.coalesce(style.rlike("Heading|Заголовок"), F.lit(False)) | ((t.strip(t.filled(line)) != "") & heading_text(line))


def noise_heading(line: Column) -> Column:
    """Stamps, table labels, forms to fill in, contract numbers, delivery-clause notes, short parentheses."""
    def decide(raw: Column) -> Column:
        low = F.lower(raw)
        bracketed = raw.startswith("(") & raw.endswith(")")
        terms = low.rlike("cip|cif|fca|dap|ddp|exw|cpt|cfr|fob")
        return (
            (raw == "") | low.isin("м.п.", "м.п. м.п.", "m.p.", "mp", "swift", "swft", "инн", "inn", "qty")
            | low.rlike(r"(?U)^(buyer|seller|покупатель|продавец|поставщик|заказчик)(\s*/\s*.*)?$") | raw.rlike("_{3,}")
            | (low.rlike(r"(?U)\bcontract\b") & (raw.contains("№") | low.contains("n"))) | low.startswith("ontract")
            | ((low.contains("инкотермс") | low.contains("incoterms")) & bracketed) | (low.rlike(r"(?U)\b(usd|eur|rub|uzs|cny)\b") & terms) | (bracketed & (F.length(raw) <= 40))
        )

    return t.bind(F.regexp_replace(t.strip(t.filled(line)), r"(?U)\s+", " "), decide)


# ---- routers.  Fixed values: ordered; the first that matches decides.

TITLE_ROUTES = (
    ("payment_terms", "commercial", ("payment", "оплат", "расчет", "расчёт", "settlement", "invoic", "price", "цена", "стоимост")),
    ("delivery_terms", "commercial", ("delivery", "поставк", "отгруз", "shipment", "accept", "приемк", "приёмк", "performance", "срок")),
    ("liability_penalties", "liability", ("liabil", "responsib", "ответствен", "неустойк", "штраф", "пен", "penalt")),
    ("disputes_governing_law", "disputes", ("dispute", "спор", "арбит", "jurisdiction", "подсуд", "governing law", "применим", "право")),
)
ID_GROUPS = (
    ("payment_terms", "commercial"), ("price", "commercial"), ("prices", "commercial"), ("settlement", "commercial"), ("delivery_terms", "commercial"), ("delivery", "commercial"),
    ("liability", "liability"), ("penalties", "liability"), ("disputes", "disputes"), ("governing_law", "disputes"),
)
KEYWORD_ROUTES = (
    ("anti_corruption", (r"антикоррупц", r"anti-corruption", r"\banticorruption\b")),
    ("export_compliance", (r"export compliance", r"экспорт", r"санкцион", r"\bcompliance\b")),
    ("price", (r"\bcontract price\b", r"\bprice\b", r"цена", r"стоимост", r"общая стоимость")),
    ("payment_terms", (r"\bpayment\b", r"оплат", r"расчет", r"payment terms", r"terms of payment")),
    ("delivery_terms", (r"условия поставки", r"\bterms of supply\b", r"\bdelivery\b", r"\bshipment\b", r"поставка")),
    ("packing_marking", (r"упаковк", r"маркировк", r"\bpacking\b", r"\bmarking\b")),
    ("acceptance", (r"приемк", r"\bacceptance\b", r"\binspection\b", r"приемка товара")),
    ("claims", (r"претенз", r"рекламац", r"\bclaims?\b", r"\bcomplaints?\b")),
    ("dispute_resolution", (r"разрешение споров", r"\bdispute", r"arbitration", r"арбитраж", r"спор")),
    ("rights_obligations", (r"права и обязанност", r"rights and obligations", r"responsibilities", r"обязанност")),
    ("liability", (r"ответствен", r"\bliabilit", r"\bresponsibilit\b")),
    ("penalties", (r"штраф", r"санкц", r"неустойк", r"\bpenalt", r"\bfines?\b")),
    ("confidentiality", (r"конфиденц", r"\bconfidential", r"защита данных", r"\bdata protection\b")),
    ("term", (r"срок действия", r"\bterm\b", r"\bvalidity\b")),
    ("final_provisions", (r"заключительные положения", r"\bmiscellaneous\b", r"\bgeneral provisions\b", r"прочие условия", r"общие положения")),
    ("specification", (r"спецификац", r"\bspecification\b", r"\bannex\b", r"\bappendix\b", r"\bschedule\b")),
    ("bank_details", (r"реквизит", r"bank details", r"account details", r"реквизиты счета")),
    ("addresses", (r"адрес", r"addresses?", r"местонахожд", r"место нахожд")),
    ("signatures", (r"подписи сторон", r"\bsignatures?\b", r"in witness", r"signature")),
)


def title_route(title: Column, routes: Sequence[tuple[str, str, Sequence[str]]] = TITLE_ROUTES) -> Column:
    """Struct of section_id and section_group by words in the title; ("", "other") if none is there."""
    low, out = F.lower(t.filled(title)), None
    for section, group, words in routes:
        hit, value = t.count_words(low, words) > 0, F.struct(F.lit(section).alias("section_id"), F.lit(group).alias("section_group"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.struct(F.lit("").alias("section_id"), F.lit("other").alias("section_group")))


def keyword_route(title: Column, routes: Sequence[tuple[str, Sequence[str]]] = KEYWORD_ROUTES) -> Column:
    """Section id by patterns in the title, null if none matches."""
    low, out = t.strip(F.regexp_replace(F.translate(F.lower(t.filled(title)), "–—", "--"), r"(?U)\s+", " ")), None
    for section, patterns in routes:
        hit = low.rlike("(?U)" + "|".join(patterns))
        out = F.when(hit, F.lit(section)) if out is None else out.when(hit, F.lit(section))
    return out


def id_group(section_id: Column, groups: Sequence[tuple[str, str]] = ID_GROUPS) -> Column:
    low, out = F.lower(t.filled(section_id)), None
    for key, group in groups:
        out = F.when(low.contains(key), group) if out is None else out.when(low.contains(key), group)
    return out.otherwise("other")
