"""DuckDB SQL of text rules, as expressions over an expression, and of the longer queries.

RE2 has no look-around and knows ASCII only in its word boundaries: EDGE stands for what is no word character, and
a rule that consumes it on either side is applied twice, since neighbours share it.
"""

from __future__ import annotations

from scrivener.functions import predicates as p
from scrivener.functions import text as t
from scrivener.operators import cleaning

EDGE = r"[^\p{L}\p{M}\p{N}_]"
SPLIT = r"'\r\n|[\n\r\v\f]'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\v]+|[\s\v]+$', '', 'g')"


def replaced(x: str, *rules: tuple[str, str]) -> str:
    for pattern, new in rules:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


def lines(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, {SPLIT}), lambda x: {strip('x')}), lambda x: x <> '')"


def plain_spaces(x: str) -> str:
    return strip(replaced(f"replace({x}, chr(160), ' ')", (r"[ \t]+", " ")))


def tidy(x: str) -> str:
    return strip(f"regexp_replace({replaced(f'replace({x}, chr(160), chr(32))', (r'[ \t]+', ' '))}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def unify_dashes(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace(regexp_replace(translate({x}, '–—−' || chr(160) || chr(173), '--- '), '[ \t]+', ' ', 'g'), '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g')")


def canonical(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({unify_dashes(x)}, '^(\d{{1,3}})([.)])([A-Za-zА-Яа-я])', '\1\2 \3'), '(?s)^\s*(\d{{1,3}})\s*-\s*(\S.*?)\s*$', '\1. \2')")


def fold_case(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def letters(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-Za-zА-Яа-яЁё]', '', 'g'))"


def capitals(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-ZА-ЯЁ]', '', 'g'))"


def without_echo(x: str) -> str:
    """An array of lines from the first that does not look like a heading in capitals."""
    caps = f"({letters('x')} >= 4 and length(x) <= 90 and {capitals('x')} / greatest({letters('x')}, 1) > 0.88)"
    return f"({x})[coalesce(nullif(list_position(list_transform({x}, lambda x: {caps}), false), 0), len({x}) + 1):]"


def deduped(x: str, window: int) -> str:
    """A fold over an array of lines that carries those kept; empty ones go."""
    clean = f"list_filter(list_transform({x}, lambda x: {plain_spaces('x')}), lambda x: x <> '')"
    items = f"list_transform({clean}, lambda x: {{'line': [x], 'key': [{fold_case('x')}]}})"
    fold = f"list_reduce({items}, lambda a, b: case when list_contains(a.key[-{window}:], b.key[1]) then a else {{'line': a.line || b.line, 'key': a.key || b.key}} end)"
    return f"case when len({clean}) = 0 then []::varchar[] else ({fold}).line end"


def sentences(x: str) -> str:
    flat = rf"trim(regexp_replace({x}, '[\s\v]+', ' ', 'g'))"
    return rf"string_split(regexp_replace({flat}, '([.!?]) ([A-ZА-ЯЁ0-9])', '\1' || chr(10) || '\2', 'g'), chr(10))"


def truncated(tidied: str, sents: str, most: int) -> str:
    """From a tidied text and its array of sentences, whole sentences up to ``most`` characters."""
    n = f"len(list_filter(range(1, least(len({sents}), {most}) + 1), lambda k: list_sum(list_transform({sents}[1:k], lambda s: length(s))) + k - 1 <= {most}))"
    hard = strip(f"regexp_replace(substr({sents}[1], 1, {most}), '(?s) [^ ]*$', '')")
    return f"case when length({tidied}) <= {most} then {tidied} when {n} = 0 then {hard} else array_to_string({sents}[1:{n}], ' ') end"


def bare_title(x: str) -> str:
    """Roman numerals count only where no letter or digit follows."""
    flat = strip(rf"regexp_replace(translate({strip(x)}, chr(160) || '–—«»', ' --' || chr(34) || chr(34)), '[\s\v]+', ' ', 'g')")
    labels = "|".join(t.TITLE_LABELS)

    def cut(y: str, lead: str, deep: str) -> str:
        rest = rf"(?:\.\d+){deep}\s*[).\-:]?\s*"
        roman = rf"regexp_matches({y}, '(?i)^{lead}[IVXLC]+([^\p{{L}}\p{{M}}\p{{N}}]|$)')"
        return rf"(case when {roman} then regexp_replace({y}, '(?i)^{lead}[IVXLC]+{rest}', '') else regexp_replace({y}, '(?i)^{lead}\d+{rest}', '') end)"

    one = f"list_transform([{flat}], lambda f: {cut('f', rf'(?:\(?\s*(?:{labels})\s*)', '*')})"
    two = rf"list_transform({one}, lambda f: {cut('f', r'\s*', '{0,3}')})"
    end = strip(rf"regexp_replace(regexp_replace({strip(r'regexp_replace(f, ' + chr(39) + r'\s*[:;\-–]\s*$' + chr(39) + ', ' + chr(39) * 2 + ')')}, '(?i)\((?:hereinafter|далее)[^)]*\)', '', 'g'), '[\s\v]+', ' ', 'g')")
    return f"list_transform({two}, lambda f: {end})[1]"


def smart_truncated(x: str, most: int) -> str:
    low = int(most * 0.65)
    return rf"case when length({strip(x)}) <= {most} then {strip(x)} else (with c as (select substr({strip(x)}, 1, {most}) as a), d as (select regexp_replace(case when regexp_matches(substr(a, {low + 1}), '[.!?;:\n]') then substr(a, 1, {low}) || regexp_extract(substr(a, {low + 1}), '(?s)^.*[.!?;:\n]') else a end, '\s+$', '') as b from c) select case when regexp_matches(b, '[.!?…]$') then b else b || '…' end from d) end"


# ---- headings: expressions over a column ``line``

NARROW = r"regexp_replace(line, '[\s\v]{2,}', ' ', 'g')"


def one_of(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def contains_any(x: str, words) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


ACTION = rf"split_part(lower({strip(r'regexp_replace(line, ' + chr(39) + r'^\d+(\.\d+)*[.)]\s+' + chr(39) + ', ' + chr(39) * 2 + ')')}), ' ', 1) in ({one_of(p.ACTION_VERBS)})"
TITLE_LIKE = f"(line <> '' and (line[-1:] = ':' or {contains_any('lower(line)', p.TITLE_WORDS)}))"
ALL_CAPS = f"(not ({' or '.join(f'starts_with(s, {one_of([w])})' for w in p.COVER_CAPS)}) and not (s[1:1] = '(' and s[-1:] = ')') and length(s) <= 90 and {letters('s')} >= 6 and {letters('s')} = length(regexp_replace(s, '[^A-ZА-ЯЁ]', '', 'g')))"
ADDENDUM = r"regexp_matches(s, '(?i)^(Приложение|Addendum)\s*№?\s*\d+.*$')"
LISTED = f"s in ({one_of(p.PLAIN_HEADINGS)})"


def heading(caps: bool) -> str:
    """Over columns s (the narrowed line), action and title_like of it."""
    number = r"regexp_extract(s, '^(\d+(?:\.\d+)*)[.)]\s+', 1)"
    level = f"(case when {number} = '' then 0 else len(string_split({number}, '.')) end)"
    return rf"(s <> '' and case when {LISTED} or regexp_matches(s, '(?i)^(ARTICLE|CLAUSE|SECTION)\s+\d+(\.\d+)*[.)]?(\s+.+)?$') or {ADDENDUM} then true when regexp_matches(s, '^\d+(\.\d+)*[.)]\s+.+$') then {level} between 1 and {p.MAX_LEVEL} and not action and title_like else {ALL_CAPS if caps else 'false'} end)"


def probable_caps(dashed: str) -> str:
    alpha, upper = rf"length(regexp_replace({dashed}, '[^\p{{L}}]', '', 'g'))", rf"length(regexp_replace({dashed}, '[^\p{{Lu}}]', '', 'g'))"
    return rf"({dashed} <> '' and length({dashed}) <= 90 and not regexp_matches({dashed}, '^\s*[-•]\s+.+$') and {alpha} >= 4 and length(regexp_replace({dashed}, '[^.!?;]', '', 'g')) < 2 and ({upper} / greatest({alpha}, 1) >= 0.75 or contains({dashed}, '/')))"


def has_level(line: str, canon: str, dashed_canon: str) -> str:
    """Over a line with its unified dashes (``line``), its canonical form, and that with unified dashes."""
    return rf"(regexp_matches({canon}, '(?i)^\s*СТАТЬЯ\s+(\d+)\.?\s*(.*)$') or regexp_matches({canon}, '^\s*(\d{{1,3}})(?:\.(\d{{1,3}}))?(?:\.(\d{{1,3}}))?\s*[.)]\s*(.+)$') or regexp_matches({line}, '^\s*(\d{{1,3}})\s*-\s*(.+)$') or {probable_caps(dashed_canon)})"


def block_heading(x: str, longest: int, digits: int, deeper: int, caps: float, caps_longest: int, colon: int) -> str:
    return rf"({x} <> '' and length({x}) <= {longest} and (regexp_matches({x}, '^\d{{1,{digits}}}(\.\d{{1,{digits}}}){{0,{deeper}}}\.?\s+\S+') or ({letters(x)} > 0 and length({x}) <= {caps_longest} and {capitals(x)} / {letters(x)} > {caps}) or ({x}[-1:] = ':' and length({x}) <= {colon})))"


def noise_block(x: str) -> str:
    return rf"(length({x}) <= 2 or regexp_matches(lower({x}), '^(buyer\s*/\s*seller|seller\s*/\s*buyer|buyer|seller|м\.?п\.?|swift|инн|кпп|огрн|qty)$') or (regexp_full_match({x}, '[\p{{L}}\p{{M}}\p{{N}}_\-/.,:;() ]{{1,25}}') and length(regexp_replace({x}, '[^\p{{Nd}}]', '', 'g')) >= 6))"


def heading_text(bare: str) -> str:
    words = "предмет|оплата|поставка|ответственност|арбитраж|споры|право|гаранти|форс|реквизит|definitions|subject|payment|delivery|liability|arbitration|governing law|warranty|force majeure|signatures"
    upper = f"replace(upper({bare}), 'ẞ', 'SS')"
    return f"({bare} <> '' and length({bare}) <= 120 and regexp_matches({bare}, '[A-Za-zА-Яа-я]') and (regexp_matches({bare}, '(?i)(^|{EDGE})({words})($|{EDGE})') or ({bare} = {upper} and {bare} <> lower({bare}) and length({bare}) <= 80)))"


def noise_heading(raw: str) -> str:
    """Over a line with each run of white space as one blank."""
    low, bracketed = f"lower({raw})", f"({raw}[1:1] = '(' and {raw}[-1:] = ')')"
    return rf"""({raw} = '' or {low} in ('м.п.', 'м.п. м.п.', 'm.p.', 'mp', 'swift', 'swft', 'инн', 'inn', 'qty') or regexp_matches({low}, '^(buyer|seller|покупатель|продавец|поставщик|заказчик)(\s*/\s*.*)?$') or regexp_matches({raw}, '_{{3,}}')
  or (regexp_matches({low}, '(^|{EDGE})contract($|{EDGE})') and (contains({raw}, '№') or contains({low}, 'n'))) or starts_with({low}, 'ontract') or ((contains({low}, 'инкотермс') or contains({low}, 'incoterms')) and {bracketed})
  or (regexp_matches({low}, '(^|{EDGE})(usd|eur|rub|uzs|cny)($|{EDGE})') and regexp_matches({low}, 'cip|cif|fca|dap|ddp|exw|cpt|cfr|fob')) or ({bracketed} and length({raw}) <= 40))"""


LINES_OF = f"l as (select doc_id, unnest({lines('text')}) as line, generate_subscripts({lines('text')}, 1) as pos from documents)"
COLLAPSED = r"trim(regexp_replace(line, '[\s\v]+', ' ', 'g'))"

#: Lines with the forms that the heading rules read.
FORMS = f"""with {LINES_OF},
f as (select *, {NARROW} as s, {plain_spaces('line')} as plain, {unify_dashes('line')} as dashed, {canonical('line')} as canon, {bare_title('line')} as bare, {COLLAPSED} as raw from l),
g as (select *, {unify_dashes('canon')} as dashed_canon, {canonical('canon')} as canon2 from f),
h as (select *, {ACTION.replace('(line,', '(s,')} as action, {TITLE_LIKE.replace('line', 's')} as title_like from g)"""

_FLAGS = {
    "heading": heading(True), "all_caps": ALL_CAPS, "probable_caps": probable_caps("dashed"), "by_level": has_level("dashed", "canon", "dashed_canon"), "block": block_heading("plain", 140, 3, 4, 0.88, 90, 90),
    "older_block": block_heading("plain", 120, 2, 3, 0.85, 80, 80), "text": heading_text("bare"), "noise_block": noise_block("plain"), "noise": noise_heading("raw"), "action": ACTION, "title_like": TITLE_LIKE,
}
HEADING_FLAGS = f"{FORMS} select doc_id, " + ", ".join(f'cast(count(*) filter (where {x}) as bigint) as "{n}"' for n, x in _FLAGS.items()) + " from h group by doc_id"

HEALED = f"""{FORMS}, k as (select doc_id, {has_level('dashed_canon', 'canon2', unify_dashes('canon2'))} and length(canon) <= 160 as headed from h)
select doc_id, case when count(*) filter (where headed) > 0 then 'ok' else 'no_candidates' end as status, bool_or(headed) as changed, cast(count(*) filter (where headed) as bigint) as headings_set, cast(0 as bigint) as splits_done from k group by doc_id"""



def _level(x: str) -> str:
    return has_level(unify_dashes(x), canonical(x), unify_dashes(canonical(x)))


#: Paragraphs of two lines: a heading with a body under it is split, unless the body is a short heading, too.
HEALED_PAIRS = f"""with {LINES_OF}, n as (select doc_id, line, row_number() over (partition by doc_id order by pos) - 1 as i from l),
p as (select doc_id, i // 2 as k, max(line) filter (where i % 2 = 0) as a, max(line) filter (where i % 2 = 1) as b from n group by doc_id, i // 2),
w as (select *, a || coalesce(chr(10) || b, '') as pair from p), c as (select *, {canonical('pair')} as canon from w),
k as (select *, b is not null and {_level('a')} and not (length(b) < 20 and {_level('b')}) as split, {_level('canon')} and length(canon) <= 160 as headed from c),
o as (select doc_id, unnest(case when split then [[k * 2, 0], [k * 2, 1]] else [[k * 2, 0]] end) as spot, case when split then [{canonical('a')}, {unify_dashes('b')}] when headed then [canon] else [pair] end as made, split, headed from k)
select doc_id, case when bool_or(split or headed) then 'ok' else 'no_candidates' end as status, bool_or(split or headed) as changed, count(*) filter (where (split or headed) and spot[2] = 0) as headings_set,
  count(*) filter (where split and spot[2] = 0) as splits_done, md5(string_agg(made[spot[2] + 1], chr(10) order by spot)) as healed_md5 from o group by doc_id"""

TITLED = f"""{FORMS}, k as (select doc_id, pos, line, {heading_text('bare')} and not {noise_heading('raw')} as head from h),
n as (select *, sum(head::int) over w as no, last_value(case when head then line end ignore nulls) over w as name from k window w as (partition by doc_id order by pos rows between unbounded preceding and current row)),
b as (select doc_id, no, coalesce(any_value(name), 'PREFACE') as section_title, string_agg(line, chr(10) order by pos) as body from n where not head group by doc_id, no)
select doc_id, cast(row_number() over (partition by doc_id order by no) as integer) as "order", section_title, md5(body) as text_md5 from b"""


def split_sections(clean: str) -> str:
    """A fold over each document's lines that carries the title, the body and the sections so far."""
    item = "{'line': line, 'after': coalesce(after, ''), 'any': any_head, 'plain': plain_head, 'could': could, 'title': '', 'body': '', 'skip': false, 'out': []::struct(section varchar, txt varchar)[]}"
    first = "{'line': '', 'after': '', 'any': false, 'plain': false, 'could': false, 'title': 'PREFACE', 'body': '', 'skip': false, 'out': []::struct(section varchar, txt varchar)[]}"
    state = lambda title, body, skip, out: f"{{'line': '', 'after': '', 'any': false, 'plain': false, 'could': false, 'title': {title}, 'body': {body}, 'skip': {skip}, 'out': {out}}}"
    flushed = "case when a.body = '' then a.out else list_append(a.out, {'section': a.title, 'txt': a.body}) end"
    step = f"""case when a.skip then {state('a.title', 'a.body', 'false', 'a.out')}
  when b.could or case when a.title = 'PREFACE' then b.any else b.plain end then {state("case when b.could then b.line || ' / ' || b.after else b.line end", "''", 'b.could', flushed)}
  else {state('a.title', "case when a.body = '' then b.line else a.body || chr(10) || b.line end", 'false', 'a.out')} end"""
    return f"""with c as (select doc_id, {clean} as text from documents),
l as (select doc_id, unnest({lines('text')}) as s0, generate_subscripts({lines('text')}, 1) as pos from c),
s as (select doc_id, pos, {NARROW.replace('line', 's0')} as s from l),
h as (select *, {ACTION.replace('(line,', '(s,')} as action, {TITLE_LIKE.replace('line', 's')} as title_like from s),
k as (select doc_id, pos, s as line, ({LISTED} or {ADDENDUM} or {ALL_CAPS}) as opens, {heading(True)} as any_head, {heading(False)} as plain_head from h),
n as (select *, lead(line) over w as after, coalesce(opens and lead(any_head) over w and lower(line) <> lower(lead(line) over w), false) as could from k window w as (partition by doc_id order by pos)),
g as (select doc_id, list_prepend({first}, list({item} order by pos)) as items from n group by doc_id),
d as (select doc_id, list_reduce(items, lambda a, b: {step}) as a from g),
o as (select doc_id, {flushed} as out from d),
u as (select doc_id, unnest(out) as x, generate_subscripts(out, 1) as i from o)
select doc_id, cast(i as integer) as "order", x.section as section, md5(x.txt) as text_md5 from u
union all select c.doc_id, 1, 'FULL_TEXT', md5({strip('c.text')}) from c join o on o.doc_id = c.doc_id where len(o.out) = 0 and {strip('c.text')} <> ''"""


# ---- anonymising: rules in Cyrillic alone are left out, for the tables hold none

def _bounded(x: str, pattern: str, new: str, before: bool = True, after: bool = True) -> str:
    """Twice, since neighbours share an edge."""
    full, put = f"{f'(^|{EDGE})' if before else '()'}(?:{pattern}){f'($|{EDGE})' if after else '()'}", rf"\1{new}\2"
    return replaced(x, (full, put), (full, put))


def anonymised(source: str) -> list[str]:
    """CTEs a0 ... from ``source`` (id, text): text and n, the number of substitutions."""
    amount = next(r[1] for r in cleaning.RULES if r[0] == "amount").removeprefix(r"(?U)(?<!\w)").removesuffix(r"(?!\w)").removeprefix("(?:").removesuffix(")")
    rules = [
        ("[VAT_RATE]", lambda x: replaced(x, (r"(?i)(?:(?:ндс|vat)\s*(?:в\s*размере\s*)?)\s*\d{1,2}(?:[.,]\d{1,2})?\s*%", "[VAT_RATE]"))),
        ("[VAT]", lambda x: _bounded(x, "(?i:vat)", "[VAT]")),
        ("[CURRENCY]", lambda x: _bounded(x, "(?i:USD|EUR|RUB|GBP|CNY|CHF|AED|KZT|UAH|PLN|TRY|JPY)", "[CURRENCY]")),
        ("[PERCENT]", lambda x: _bounded(x, r"\d{1,2}(?:[.,]\d{1,2})?\s*%", "[PERCENT]", True, False)),
        ("[TERM_DAYS]", lambda x: _bounded(x, r"\d{1,3}\s*(?i:day|days|banking\s+days|business\s+days)", "[TERM_DAYS]")),
        ("[AMOUNT]", lambda x: _bounded(x, amount, "[AMOUNT]")),
    ]
    ctes, before = [], source
    for i, (mark, make) in enumerate(rules):
        count = lambda x: f"(length({x}) - length(replace({x}, '{mark}', ''))) // {len(mark)}"
        ctes.append(f"a{i} as (select id, new as text, n + {count('new')} - {count('text')} as n from (select *, {make('text')} as new from {before}))")
        before = f"a{i}"
    working = rf"(?i)\[AMOUNT\](\s+(?:business\s+days|banking\s+days))"
    ctes.append(f"z as (select id, {tidy(f'regexp_replace(text, {chr(39)}{working}{chr(39)}, {chr(39)}[TERM_DAYS]' + chr(92) + f'1{chr(39)}, {chr(39)}g{chr(39)})')} as text, n + len(regexp_extract_all(text, '{working}')) as n from {before})")
    return ctes


ANONYMISED = "with s as (select doc_id as id, text, 0 as n from documents), " + ",\n".join(anonymised("s")) + " select id as doc_id, cast(n as bigint) as replacements, md5(text) as text_md5 from z"

_LEAN = f"""with r1 as (select doc_id as id, {lines(tidy('text'))} as ls from documents),
r2 as (select id, {lines(f"array_to_string({without_echo('ls')}, chr(10))")} as ls from r1),
r3 as (select id, {strip(f"array_to_string({deduped('ls', 30)}, chr(10))")} as text from r2),
s as (select id, text, 0 as n from r3 where length(text) >= 120),
{", ".join(anonymised("s"))},
y as (select id, n, {tidy('text')} as td from z), x as (select *, {sentences('td')} as ss from y),
q as (select id, n, {truncated('td', 'ss', 1800)} as text from x),
u as (select *, row_number() over (partition by {fold_case('text')} order by id) as nth from q where text <> '')"""
CLEANED = _LEAN + " select id as doc_id, cast(n as bigint) as replacements, md5(text) as text_md5 from u where nth = 1"
CLEAN_REPORT = _LEAN + """ select cast((select count(*) from documents) as bigint) as input_count, cast((select count(*) from u where nth = 1) as bigint) as output_count, cast((select count(*) from documents) - (select count(*) from s) as bigint) as dropped_empty,
cast((select count(*) from s) - (select count(*) from u where nth = 1) as bigint) as dropped_duplicates, cast(coalesce((select sum(n) from q), 0) as bigint) as total_replacements"""


def unique_slugs(title: str, slug: str) -> str:
    """A fold over titles in order that carries the names in use."""
    free = "list_filter(list_transform(range(1, len(a.used) + 2), lambda k: case when k = 1 then b.slug else b.slug || '_' || k end), lambda x: not list_contains(a.used, x))[1]"
    return f"""with c as (select {title} as title, count(*) as n from documents group by 1 having {title} <> ''), g as (select title, n, {slug} as slug from c),
f as (select list(title order by n desc, title) as titles, list(n order by n desc, title) as ns, list_reduce(list_prepend({{'slug': '', 'used': []::varchar[]}}, list({{'slug': slug, 'used': []::varchar[]}} order by n desc, title)), lambda a, b: {{'slug': '', 'used': list_append(a.used, {free})}}).used as ids from g)
select unnest(titles) as title, cast(unnest(ns) as bigint) as count, unnest(ids) as section_id from f"""


def older_validator(repeated: str, itemised: str) -> str:
    """Over sentences as items.  Cyrillic patterns are left out, for the tables hold none."""
    # items of a list are told apart by their numbers, so the units are the lines
    units = repeated.replace("from documents", "from n").replace("string_split(regexp_replace(" + strip("text") + r", '([.!?])[\s\v]+', '\1' || chr(1), 'g'), chr(1))", "string_split(text, chr(10))")
    return rf"""with n as (select doc_id, {itemised} as text from documents), r as ({units}) select d.doc_id, case when length(regexp_replace(text, '[\s\v]+', '', 'g')) < 750 then 'too_short' when len(regexp_extract_all(text, '(?m)^\s*\d{{1,3}}\)\s+')) < 20 then 'too_few_list_items' when regexp_matches(text, '\[[A-Z_]{{2,}}\]') then 'contains_placeholders'
when r.repeated then 'repetition_detected' when {contains_any('lower(text)', ('iban', 'swift', 'bic', 'account no', 'account number', 'bank code', 'routing number'))} or regexp_matches(text, '\d{{12,}}') then 'contains_bank_details' end as code from n d join r on r.doc_id = d.doc_id"""


_SEVEN = "case when len(w) >= 7 then list_distinct(list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i:i + 6], ' '))) else []::varchar[] end"


_RESEMBLES = "len(list_intersect(o.s, b.s)) > 0 and len(list_intersect(o.s, b.s)) / len(list_distinct(o.s || b.s)) >= 0.55"


def diverse(hits: str, words: str, k: int = 10, name: str = "source") -> str:
    """``hits``: rank, source, candidate.  A fold in rank order that carries what is chosen."""
    kind = "struct(rank integer, source varchar, candidate varchar, s varchar[])"
    return f"""{hits}, w as (select *, {words} as w from hits),
e as (select rank, source, candidate, {_SEVEN} as s from w),
f as (select list_reduce(list_prepend([]::{kind}[], list([struct_pack(rank := rank, source := source, candidate := candidate, s := s)]::{kind}[] order by rank)), lambda a, c: list_transform([c[1]], lambda b: case when len(a) >= {k} or len(list_filter(a, lambda o: (b.source <> '' and o.source = b.source) or ({_RESEMBLES}))) > 0 then a else a || [b] end)[1]) as chosen from e)
select x.rank as rank, x.source as {name}, md5(x.candidate) as candidate_md5 from (select unnest(chosen) as x from f)"""


def diverse_each(hits: str, words: str, k: int = 3) -> str:
    """``hits``: a table h (q, rank, doc_id) and one m (doc_id, source, candidate).  k times the first of each q that is left,
    and what it leaves of the others."""
    parts = [f"""{hits}, w as materialized (select *, {words} as w from m), g as materialized (select doc_id, source, md5(candidate) as candidate_md5, {_SEVEN} as s from w),
e as materialized (select h.q, h.rank, g.* from h join g on g.doc_id = h.doc_id)"""]
    left = "e"
    for i in range(k):
        parts.append(f"c{i} as materialized (select * from {left} qualify row_number() over (partition by q order by rank) = 1)")
        parts.append(f"l{i} as materialized (select b.* from {left} b join c{i} o on o.q = b.q where b.rank > o.rank and not ((b.source <> '' and o.source = b.source) or ({_RESEMBLES})))")
        left = f"l{i}"
    return ",\n".join(parts) + "\n" + " union all ".join(f"select q, rank, source, candidate_md5 from c{i}" for i in range(k))
