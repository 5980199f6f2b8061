"""Cleaning and anonymising of retrieved texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.functions import text as t
from scrivener.operators.tables import spread, written

#: Number words, and what each rule puts in place of what, in order.
NUMBER_WORDS = "одного|один|двух|два|трех|трёх|три|четырех|четырёх|четыре|пяти|пять|шести|шесть|семи|семь|восьми|восемь|девяти|девять|десяти|десять|тридцати|тридцать|сорока|сорок"
RULES: tuple[tuple[str, str, str], ...] = (
    ("number word in parentheses", rf"(?iU)\s*\(\s*(?:{NUMBER_WORDS})\s*\)\s*", " "),
    ("rate of VAT", r"(?iU)(?:(?:ндс|vat)\s*(?:в\s*размере\s*)?)\s*(\d{1,2}(?:[.,]\d{1,2})?)\s*%", "[VAT_RATE]"),
    ("VAT", r"(?iU)\b(vat)\b|ндс", "[VAT]"),
    ("currency code", r"(?iU)\b(USD|EUR|RUB|GBP|CNY|CHF|AED|KZT|UAH|PLN|TRY|JPY)\b", "[CURRENCY]"),
    ("currency word", r"(?iU)\b(доллар(?:а|ов)?|usd|евро|eur|руб(?:ль|ля|лей)|rub|фунт(?:а|ов)?\s+стерлинг(?:ов)?|gbp|злот(?:ый|ых|ого|ым|ыми)|pln|юан(?:ь|я|ей)|cny|тенге|kzt|дирхам(?:а|ов)?|aed)\b", "[CURRENCY]"),
    ("country of a currency", r"(?iU)\bпольск\w*\s+\[CURRENCY\](?=[\s,.;:)\]]|$)", "[CURRENCY]"),
    ("percentage", r"(?U)(?<!\w)(\d{1,2}(?:[.,]\d{1,2})?)\s*%", "[PERCENT]"),
    ("days in digits", r"(?iU)\b(\d{1,3})\s*(?:day|days|banking\s+days|business\s+days|дн\.?|дней|дня|сут\.?|банковских\s+дней|рабочих\s+дней)\b", "[TERM_DAYS]"),
    ("days in words", rf"(?iU)\b({NUMBER_WORDS})\b\s*(?:банковских\s+дней|рабочих\s+дней|дней|суток)?\b", "[TERM_DAYS]"),
    ("amount", "(?U)(?<!\\w)(?:\\d{1,3}(?:[ ,. ]\\d{3})+(?:[.,]\\d{1,2})?|\\d{4,}(?:[.,]\\d{1,2})?)(?!\\w)", "[AMOUNT]"),
    ("amount that is a clause", r"(?iU)\b(пункт[аеуы]?|п\.|раздел[аеуы]?|стать[еяи])\s+\[AMOUNT\]\b", "$1 [CLAUSE_REF]"),
    ("amount of working days", r"(?iU)\[AMOUNT\](\s+(?:банковских\s+дней|рабочих\s+дней|business\s+days|banking\s+days))", "[TERM_DAYS]$1"),
    ("amount of days", r"""(?iU)[«"']?\[AMOUNT\][»"']?(\s+(?:календарн(?:ых|ые)\s+)?(?:дней|дня|суток))""", "[TERM_DAYS]$1"),
    ("reference to a clause", r"(?iU)(?:,?\s*)?(?:указанн\w*|предусмотренн\w*)\s+(?:в\s+)?(пункте|п\.|разделе|статье)\s+(?:\[[A-Z_]+\]|\d+(?:\.\d+)*)\s+(?:настоящего|данного)\s+контракт\w*", ""),
)


#: What a rule can't match without: one of these in the text in lower case.  A digit is "0", a Cyrillic letter "я".
NEEDS: dict[str, tuple[str, ...]] = {
    "number word in parentheses": ("(",), "rate of VAT": ("%",), "VAT": ("vat", "ндс"), "currency code": ("usd", "eur", "rub", "gbp", "cny", "chf", "aed", "kzt", "uah", "pln", "try", "jpy"),
    "currency word": ("я", "usd", "eur", "rub", "gbp", "pln", "cny", "kzt", "aed"), "country of a currency": ("я",), "percentage": ("%",), "days in digits": ("day", "я"), "days in words": ("я",),
    "amount": ("0",), "amount that is a clause": ("я",), "reference to a clause": ("я",),
}


def anonymise(df: DataFrame, col: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Replace column ``col`` by its anonymised form and add ``replacements``, the number of substitutions.

    A rule's pattern runs only on texts that hold what it can't match without.
    """
    out = df.withColumn(col, t.filled(F.col(col))).withColumn("_low", F.lower(F.col(col)))
    out = out.withColumn("_cyrillic", F.col("_low").rlike("[а-яё]")).withColumn("_digit", F.col("_low").rlike(r"(?U)\d")).withColumn("replacements", F.lit(0).cast("long"))
    for name, pattern, new in rules:
        may = F.lit(name not in NEEDS)
        for need in NEEDS.get(name, ()):
            may = may | (F.col("_digit") if need == "0" else F.col("_cyrillic") if need == "я" else F.contains(F.col("_low"), F.lit(need)))
        # each rule reads the text that the rule before it made
        more = F.when(may, F.regexp_count(F.col(col), F.lit(pattern))).otherwise(0)
        out = out.select(*[c for c in out.columns if c not in (col, "replacements")], (F.col("replacements") + more).alias("replacements"), F.when(may, F.regexp_replace(col, pattern, new)).otherwise(F.col(col)).alias(col))
    # through a generator no filter on the result is pushed, which would repeat all rules inside it
    return out.select(*df.drop(col).columns, "replacements", F.explode(F.array(t.tidy(F.col(col)))).alias(col))


def keep_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Of rows with equal key the first; rows with an empty key go.  A key is grouped by its 128-bit hash, so texts go once a row."""
    keyed = df.withColumn("_key", F.when(key != "", F.unhex(F.md5(key)))).where("_key is not null")
    return keyed.groupBy("_key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")).select("_row.*")


def clean_precedents(texts: DataFrame, min_chars: int = 120, max_chars: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Of (seq, text): the cleaned texts (seq, text, replacements), and a report of one row.

    Spaces, echoes of headings and repeated lines go; short texts are dropped; facts become placeholders; texts
    are cut at sentences; repeated texts go, the first stays.
    """
    lean = t.strip(F.array_join(t.dedupe_lines(t.lines(t.drop_heading_echo(t.tidy(F.col("text")))), 30), "\n"))
    # through a generator the filter on length isn't pushed, which would work all of this out twice
    normal = spread(texts, "seq").select("seq", F.explode(F.array(lean)).alias("text"))
    long = normal.where(F.length("text") >= min_chars)
    # a table: texts are cleaned once for the result and all counts of the report
    cut = written(anonymise(long, "text").withColumn("text", t.truncate_at_sentence(F.col("text"), max_chars)))
    filled = cut.where(t.strip(F.col("text")) != "")
    unique = keep_first(filled, t.fold_case(F.col("text")), ["seq"]).select("seq", "text", "replacements")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    report = count(texts, "input_count").crossJoin(count(unique, "output_count")).crossJoin(cut.agg(F.count("*").alias("long"), F.coalesce(F.sum("replacements"), F.lit(0)).alias("total_replacements")))
    return unique, report.select("input_count", "output_count", (F.col("input_count") - F.col("long")).alias("dropped_empty"), (F.col("long") - F.col("output_count")).alias("dropped_duplicates"), "total_replacements")


#: Words of which a snippet must hold one.
PAYMENT_SNIPPET = (
    "оплат", "платеж", "платёж", "счет", "счёт", "инвойс", "invoice", "дата оплаты", "датой оплаты", "банковск", "комисси", "ндс", "vat", "предоплат", "аванс",
    "удержан", "withholding", "приостанов", "suspension", "пен", "неустойк", "штраф", "процент", "просроч",
    "payment", "invoice", "due", "payable", "bank", "transfer", "vat", "interest", "penalty", "setoff", "set-off", "withholding",
)
DELIVERY_SNIPPET = (
    "поставк", "отгруз", "доставк", "срок", "график", "парт", "частичн", "упаков", "маркир", "перевоз", "транспорт", "погруз", "разгруз", "рис",
    "право собственности", "приемк", "акт", "накладн", "склад", "место поставки", "передач",
    "delivery", "dispatch", "shipment", "shipping", "lead time", "schedule", "partial", "packaging", "marking", "transport", "carrier", "loading", "unloading",
    "risk", "title", "acceptance", "delivery note", "warehouse", "delivery point",
)


def pick_snippets(texts: DataFrame, words: Sequence[str], limit: int = 6, least: int = 60, most: int = 240) -> DataFrame:
    """(n, snippet): the first ``limit`` different sentences of (seq, text) of a fit length without brackets and with one of the words."""
    parts = texts.select("seq", F.posexplode(F.transform(F.split(t.strip(t.filled(F.col("text"))), r"(?U)(?<=[.!?])\s+", -1), lambda x: t.strip(F.regexp_replace(x, r"(?U)\s+", " ")))).alias("pos", "snippet"))
    fit = parts.where(~F.col("snippet").rlike(r"[\[\]]") & F.length("snippet").between(least, most) & (t.count_words(F.lower("snippet"), words) > 0))
    first = keep_first(fit, F.lower("snippet"), ["seq", "pos"]).orderBy("seq", "pos").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("seq", "pos")).alias("n"), "snippet")
