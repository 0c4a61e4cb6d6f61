"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import licenses, quality


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_sql() -> str:
    """Base counts, then Jensen-Shannon distances of class and common-word counts from the sums of the other documents."""
    # as many characters of each class as a pattern removes
    patterns = ["[a-z]", "[A-Z]", "[0-9]", r"[ \t\x0B\x0C\r]", r"\n", "[.,;:!?]", "['\"()\\[\\]\\-_/]", r"[#*$%&<>=+@`{}]", r"[|\\^~]", r"[\x00-\x08\x0E-\x1F\x7F]", r"[\x{80}-\x{23F}]", r"[\x{240}-\x{7FF}]", r"[\x{800}-\x{FFFF}]", r"[\x{10000}-\x{10FFFF}]"]
    counts = ", ".join(f"length(t) - length(regexp_replace(t, {quoted(p)}, '', 'g'))" for p in patterns)
    known = ", ".join(f"({quoted(lang)}, {quoted(w)})" for lang, words in quality.COMMON_WORDS.items() for w in words.split())
    listed = ", ".join(quoted(x) for x in quality.COMMON_WORDS)

    def distance(name: str, source: str, cells: int, least: int, pooled: bool) -> str:
        everything = f" union all select {quoted(quality.ALL)}, k, sum(n)::double from {source} group by k" if pooled else ""
        fallback = f"when coalesce(e.total, 0) - s.total >= {least} then {quoted(quality.ALL)}" if pooled else ""
        return f"""{name}_ref as (select lang, k, sum(n)::double as n from {source} group by all{everything}),
{name}_all as (select lang, sum(n) as total from {name}_ref group by 1), {name}_sum as (select doc_id, any_value(lang) as lang, sum(n)::double as total from {source} group by 1),
{name}_key as (select doc_id, s.total, case when coalesce(a.total, 0) - s.total >= {least} then s.lang {fallback} end as ref
  from {name}_sum s left join {name}_all a using (lang) left join {name}_all e on e.lang = {quoted(quality.ALL)}),
{name}_p as (select x.doc_id, x.total, coalesce(h.n, 0) / greatest(x.total, 1) as p, (r.n - coalesce(h.n, 0)) / (a.total - x.total) as q from {name}_key x join {name}_ref r on r.lang = x.ref
  join {name}_all a on a.lang = x.ref left join {source} h on h.doc_id = x.doc_id and h.k = r.k),
{name}_d as (select doc_id, any_value(total) as total, sqrt(greatest(sum(case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2
  - {cells - 1} / (8 * ln(2) * greatest(any_value(total), 1)), 0)) as {name} from {name}_p group by 1)"""

    return f"""
with c as (select doc_id, coalesce(text, '') as t, regexp_extract(coalesce(lang, ''), '^([a-z]{{2,3}})(?s:[-_].*)?$', 1) as code from documents),
d as (select doc_id, t, case when code = '' then {quoted(quality.OTHER)} else code end as lang from c),
w as (select doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as words from d),
x as (select doc_id, unnest(range(1, len(words) - 6)) as i, words from w where len(words) >= 8),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as s from x),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, s) > 1),
hit as (select doc_id, count(distinct i + j) as n_repeat_words from rep, range(8) r(j) group by 1),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from d),
dups as (select doc_id, sum(n - 1) as n_dup_lines from (select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by all) group by 1),
chars as (select doc_id, lang, unnest(range({len(patterns)})) as k, unnest([{counts}]) as n from d),
known(lang, word) as (values {known}),
plain as (select doc_id, lang, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) as word from d where lang in ({listed})),
common as (select p.doc_id, p.lang, coalesce(k.word, '*') as k, count(*) as n from plain p left join known k on k.lang = p.lang and k.word = p.word group by all),
{distance("dc", "chars", len(patterns), quality.MIN_REFERENCE_CHARS, True)},
{distance("dw", "common", quality.N_COMMON, quality.MIN_REFERENCE_WORDS, False)},
base as (select d.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, length(t) as n_chars
  from d join w using (doc_id) left join hit using (doc_id) left join dups using (doc_id)),
judged as (select *, n_words < {quality.MIN_BASE_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from base),
measured as (select b.*, case when n_chars >= {quality.MIN_CHARS} then dc end as char_distance, case when n_chars >= {quality.MIN_CHARS} and w.total >= {quality.MIN_WORDS} then dw end as word_distance
  from judged b left join dc_d using (doc_id) left join dw_d w using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(char_distance >= {quality.MAX_CHAR_DISTANCE}, false) and not coalesce(word_distance >= {quality.MAX_WORD_DISTANCE}, false) as kept,
  round(char_distance, 4) as char_distance, round(word_distance, 4) as word_distance from measured"""


def license_sql() -> str:
    bigrams = {name: licenses._bigrams(text) for name, text in sorted(licenses.TEMPLATES.items())}

    def strings(values: list[str]) -> str:
        return f"[{', '.join(map(quoted, values))}]::varchar[]"

    rows = ", ".join(f"({quoted(name)}, {strings(b)}, {strings(licenses.kin(b)[0])}, {strings(licenses.kin(b)[1])})" for name, b in bigrams.items())
    familiar = ", ".join(f"({quoted(b)})" for b in licenses.long_bigrams(bigrams))
    t = licenses.THRESHOLD
    return f"""
with known(name, grams, needs, bars) as (values {rows}), familiar(gram) as (values {familiar}),
lines as (select doc_id, n, string_split(trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), ' ') as words, parts from
  (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as n, len(string_split(coalesce(text, ''), chr(10))) as parts from documents)),
grammed as (select *, case when len(words) > 1 then list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) else [] end as g from lines),
ours as (select doc_id, n, count(f.gram) as k from (select doc_id, n, unnest(g) as gram from grammed where parts > 1) x left join familiar f using (gram) group by all),
marked as (select l.doc_id, l.n, l.words, coalesce(2 * k >= len(g), false) as flagged from grammed l left join ours using (doc_id, n) where parts > 1 and words <> ['']),
numbered as (select *, sum(case when flagged then 0 else 1 end) over (partition by doc_id order by n) as run from marked),
runs as (select doc_id, run, flatten(list(words order by n)) as words from numbered where flagged group by all),
texts as (select doc_id, list_filter(flatten(list(words order by n)), lambda w: w <> '') as words from lines group by doc_id having any_value(parts) > 1),
units as (select doc_id, 'line' as kind, n, words, parts from lines union all by name select doc_id, 'text' as kind, 0 as n, words, 2 as parts from texts union all by name select doc_id, 'run' as kind, run as n, words, 2 as parts from runs),
grams as (select doc_id, kind, n, parts, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as g from units where len(words) > 1),
hits as (select doc_id, kind, n, parts, name, 2.0::double * len(list_intersect(g, k.grams)) / (len(g) + len(k.grams)) as dice, g, needs, bars from grams, known k
  where len(g) between len(k.grams) * {t / (2 - t)} - 1e-6 and len(k.grams) * {(2 - t) / t} + 1e-6 and len(g) > 0),
found as (select * from hits where dice >= {t} and list_has_all(g, needs) and not list_has_any(g, bars)),
best as (select doc_id, arg_max(name, (dice, name)) as license, round(max(dice), 4) as dice, count(distinct n) filter (kind = 'line') as n_lines, count(distinct n) filter (kind = 'run') as n_runs,
  bool_or(kind = 'text' or (kind = 'line' and parts = 1)) as whole_text, string_agg(distinct name, ',' order by name) as licenses from found group by 1)
select d.doc_id, license, dice, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_runs, 0)::bigint as n_runs, coalesce(whole_text, false) as whole_text, coalesce(licenses, '') as licenses
from documents d left join best using (doc_id)"""


def contamination_sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
with d as (select doc_id, {words} as words from documents), b as (select item_id, {words} as words from benchmark),
lengths as (select distinct least(len(words), 10) as n from b where len(words) > 0),
theirs as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') as s from
  (select item_id, words, least(len(words), 10) as n, unnest(range(1, len(words) - least(len(words), 10) + 2)) as i from b where len(words) > 0)),
ours as (select doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') as s from (select doc_id, words, n, unnest(range(1, len(words) - n + 2)) as i from d, lengths where len(words) >= n)),
hits as (select doc_id, i, o.n, item_id from ours o join theirs t on t.n = o.n and t.s = o.s),
words as (select doc_id, count(distinct i + j) as n_hit from (select distinct doc_id, i, n from hits), range(10) r(j) where j < n group by 1),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


def warc_sql() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # five hexadecimal digits are four of base 32
    part = "('0x' || substr(h, 5 * k + 1, 5))::int"
    digits = " || ".join(f"substr('{alphabet}', (({part} >> {shift}) & 31) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
t as (select h, max(page_id) as top from p group by 1),
b as (select h, string_agg({digits}, '' order by k) as digest from (select distinct h from p), range(8) r(k) group by 1)
select page_id, strlen(html)::bigint as payload_bytes, digest as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id = top then null else top end as refers_to from p join t using (h) join b using (h)"""


SQL = {
    "op1_quality_rules": quality_sql(),
    "op2_license_scans": license_sql(),
    "op4_benchmark_decontamination": contamination_sql(),
    "op5_warc": warc_sql(),
}
