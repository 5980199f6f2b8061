import random
import re

import pytest
from pyspark.sql import functions as F

from scrivener.functions import predicates as p
from scrivener.functions import text as t
from scrivener.operators import cleaning, retrieval


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f,given,wanted",
    [
        (t.collapse_blanks, " a \t b\n c\r ", "a b\n c"),
        (t.unify_newlines, "a\r\nb\rc\n\n\n\nd", "a\nb\nc\n\nd"),
        (t.tidy, " a  b\n\n\n\nc\t", "a b\n\nc"),
        (t.narrow, "  a   b\tc ", "a b\tc"),
        (t.clean_page_text, "Line  one \npage 3 OF 12\n\n\n\n two", "Line one\n\ntwo"),
        (t.unify_dashes, "a — b – c −d­ e \n  f", "a - b - c -d e\nf"),
        (t.canonical_heading, "12 – ФОРС-МАЖОР", "12. ФОРС-МАЖОР"),
        (t.canonical_heading, "7.THE ABC", "7. THE ABC"),
        (t.unglue, "оплата,счет:5дней ABCпример x7", "оплата, счет:5 дней ABC пример x 7"),
        (t.drop_placeholders, "a [AMOUNT] b []", "a  b []"),
        (t.squash_repeats(30, 220), "это предложение повторяется дважды подряд " * 3 + "конец", None),
        (t.drop_heading_echo, "УСЛОВИЯ ОПЛАТЫ\nPAYMENT\nПокупатель платит.\nИТОГО", "Покупатель платит.\nИТОГО"),
        (t.slug, "  Условия оплаты / Payment!", "условия_оплаты_payment"),
        (t.slug, "1. Abc", "s_1_abc"),
        (t.slug, "...", "empty"),
        (t.bare_title, "ARTICLE IV. Liability :", "Liability"),
        (t.bare_title, "1.2. «Предмет»  договора (далее - Договор)", '"Предмет" договора'),
        (lambda c: t.bare_title(c, True), "Liability", "ability"),
        (t.numberless_title, "Раздел 3. Оплата", "Оплата"),
        (lambda c: t.title_key(c, "colon"), " Title  one:: ", "Title one"),
        (lambda c: t.title_key(c, "number"), "Приложение №  5", "Приложение № 5"),
        (t.first_word_after_number, "3.1. Оплата товара", "оплата"),
        (t.sentence_key, " Счёт; «оплачен» (да) ", "счет, оплачен да"),
        (t.number_lines, "1.1 текст\n\n1.2.  ещё", "1.1. текст\n1.2. ещё"),
        (t.dense_length, " a b \n", 2),
        (t.tokens, "Payment-2: Ёлка naïve", ["payment", "2", "ёлка", "na", "ve"]),
        (t.collapse_blanks, None, ""),
        (t.sentences, "Первое. Второе! third? Да. 5 дней", ["Первое.", "Второе! third?", "Да.", "5 дней"]),
        (p.language_by_ratio, "abcdefghijklmnopqrstu привет", "en"),
        (p.language_by_ratio, "short", "ru"),
        (p.heading_level, "СТАТЬЯ 5. Оплата", 1),
        (p.heading_level, "1.1 Text", 1),
        (p.heading_level, "1.1. Text", 2),
        (p.heading_level, "1.2.3) Text", 3),
        (p.heading_level, "обычный текст без признаков", None),
        (p.heading, "2. Оплатить товар", False),
        (p.heading, "2. Payment", True),
        (p.heading, "2.1.1. Payment", False),
        (p.heading, "ПОКУПАТЕЛЬ ОБЯЗАН", False),
        (p.heading, "ФОРС МАЖОР", True),
        (p.heading, "Приложение № 2 к договору", True),
        (p.block_heading, "3.2. Payment", True),
        (p.block_heading, "Итого:", True),
        (p.noise_block, "40702810900000012345", True),
        (p.noise_block, "ИНН", True),
        (p.noise_heading, "CONTRACT № 5", True),
        (p.noise_heading, "(EQUIPMENT SUPPLY)", True),
        (p.noise_heading, "Порядок расчетов", False),
        (p.heading_text, "Предмет договора поставки", True),
        (p.heading_text, "просто строка", False),
        (p.keyword_route, "Разрешение споров и арбитраж", "dispute_resolution"),
        (p.keyword_route, "Contract price and payment", "price"),
        (p.keyword_route, "nothing", None),
        (p.id_group, "liability_penalties", "liability"),
        (retrieval.mask_numbers, "в течение 15 дней 20 % от 1 500,50", "в течение [TERM_DAYS] дней [PERCENT]% от [AMOUNT]"),
    ],
)
def test_one(spark, f, given, wanted):
    got = apply(spark, f, [given])[0]
    if wanted is None and isinstance(got, str):
        wanted = "это предложение повторяется дважды подряд конец"
    assert got == wanted


def test_truncations_against_plain_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cd. E! F? G\n;:я") for _ in range(rng.randrange(150))) for _ in range(200)] + ["x" * 90, ""]

    def smart(s, most):
        s = s.strip()
        if len(s) <= most:
            return s
        low = int(most * 0.65)
        marks = [i for i in range(low, most) if s[i] in ".!?;:\n"]
        out = s[: marks[-1] + 1 if marks else most].rstrip()
        return out if not out or out[-1] in ".!?…" else out + "…"

    assert apply(spark, lambda c: t.smart_truncate(c, 60), texts) == [smart(s, 60) for s in texts]

    def by_sentence(s, most):
        s = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", s)).strip()
        if len(s) <= most:
            return s
        parts = [x for x in re.split(r"(?<=[.!?])\s+(?=[A-ZА-ЯЁ0-9])", re.sub(r"\s+", " ", s)) if x]
        out = ""
        for x in parts:
            longer = f"{out} {x}" if out else x
            if len(longer) > most:
                break
            out = longer
        return out or parts[0][:most].rsplit(" ", 1)[0].strip()

    assert apply(spark, lambda c: t.truncate_at_sentence(c, 40), texts) == [by_sentence(s, 40) for s in texts]


def test_line_windows_against_plain_python(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", "B", "b", "Straße", "STRASSE", "", "c c", "d"]) for _ in range(rng.randrange(25))) for _ in range(60)]

    def plain(s, window):
        kept = []
        for x in (" ".join(line.split()) for line in s.split("\n")):
            if x and x.casefold() not in [y.casefold() for y in kept[-window:]]:
                kept.append(x)
        return kept

    for window in (1, 3, 30):
        assert apply(spark, lambda c: t.dedupe_lines(t.lines(c), window), texts) == [plain(s, window) for s in texts]


def test_squash_against_the_pattern_alone(spark):
    rng = random.Random(3)
    atoms = ["abc", " ", "\n", "x" * 9, "word one two three four ", "слово "]
    texts = ["".join(rng.choice(atoms) * rng.randrange(1, 4) for _ in range(rng.randrange(1, 30))) for _ in range(150)]

    def plain(s):
        if len(s) < 20:
            return s
        while (new := re.sub(r"(.{10,40})(?:[\s]*\1)+", r"\1", s, flags=re.DOTALL)) != s:
            s = new
            if len(s) < 20:
                break
        return s

    assert apply(spark, t.squash_repeats(10, 40), texts) == [plain(s) for s in texts]


def test_anonymise(spark):
    rows = [
        "НДС в размере 20% и VAT 5 %, сумма 1 500 000,00 руб или 100 USD",
        "в течение 10 (десяти) банковских дней, семь дней, 15 days",
        "указанных в пункте 5.1 настоящего Контракта",
        "50 польских злотых",
    ]
    df = cleaning.anonymise(spark.createDataFrame(list(enumerate(rows)), "i int, text string"), "text").orderBy("i").collect()
    assert df[0].text == "[VAT_RATE] и [VAT_RATE], сумма [AMOUNT] руб или 100 [CURRENCY]" and df[0].replacements == 4
    assert df[1].text == "в течение [TERM_DAYS], [TERM_DAYS], [TERM_DAYS]"
    assert df[2].text == "" and df[3].text == "50 [CURRENCY]"


def test_diverse_top_k_against_a_plain_loop(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghij") * 3 for _ in range(30)] for _ in range(4)]
    hits = []
    for i in range(25):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            words[rng.randrange(30)] = "zzz"
        hits.append((i + 1, rng.choice(["", "d1", "d2", "d3", f"e{i}"]), " ".join(words)))

    def shingles(s):
        w = s.split()
        return {tuple(w[i : i + 7]) for i in range(len(w) - 6)}

    chosen = []
    for rank, doc, s in hits:
        if len(chosen) < 5 and not any((doc and d == doc) or len(shingles(s) & shingles(o)) / len(shingles(s) | shingles(o)) >= 0.55 for _, d, o in chosen):
            chosen.append((rank, doc, s))
    df = spark.createDataFrame(hits, "rank int, doc_id string, candidate string")
    assert sorted((r.rank, r.doc_id, r.candidate) for r in retrieval.diverse_top_k(df, 5).collect()) == chosen


def test_squash_takes_time_in_proportion(spark):
    """A million characters each: nearly periodic, of one character, without repeats, and with a very long gap."""
    import random
    import time

    rng = random.Random(7)
    period = "".join(rng.choice("abcdefgh ") for _ in range(150))
    near = "".join(period[:149] + chr(0x4E00 + i) for i in range(6_700))
    own = "".join(rng.choice("abcdefghijklmnop ") for _ in range(1_000_000))
    head = "".join(rng.choice("abcdef") for _ in range(60))
    texts = [near, "a" * 1_000_000, own, head + " " * 900_000 + head]
    began = time.time()
    got = apply(spark, t.squash_repeats(35, 220), texts)
    assert got[0] == near and len(got[1]) < 100 and got[2] == own and got[3] == head
    assert time.time() - began < 240
