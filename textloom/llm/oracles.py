"""DuckDB SQL for those operators whose results SQL can state."""

from __future__ import annotations

from . import quality_rules as q
from . import sharding as s

_RATES = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words", "word_length": "word_chars"}
_BIN = "case when v < 64 then v else 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) end"
_LOW = "case when {b} < 64 then {b} else (({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1)) end"


def quality_rules() -> str:
    rate = lambda c: f"(case when n_words > 0 then 1000 * {c} // n_words else 0 end)"
    stacked = " union all ".join(f"select lang, source, '{k}' as feature, {rate(c)} as v from passed" for k, c in _RATES.items())
    stacked += " union all select lang, source, 'n_words' as feature, n_words as v from passed"
    at = lambda d, k: f"max(case when feature = '{k}' then d{d} end)"
    event = lambda k: f"1000 * {q.EVENT[k]} // {at(5, 'n_words')}"
    wide = ", ".join(f"{at(9, k)} + {q.FENCE} * greatest({at(9, k)} - {at(5, k)}, {event(k)}) as hi_{k}" for k in _RATES)
    low = f"{at(1, 'word_length')} - {q.FENCE} * greatest({at(5, 'word_length')} - {at(1, 'word_length')}, {event('word_length')})"
    ratio = f"least(cast({at(1, 'n_words')} as double) / {at(5, 'n_words')}, 0.96875)"
    low_words = f"{at(1, 'n_words')} * {' * '.join([ratio] * q.FENCE)}"
    inside = "coalesce(n_words >= lo_n_words, true) and " + " and ".join(f"coalesce({rate(c)} <= hi_{k}, true)" for k, c in _RATES.items())
    return rf"""with d as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
lines as (select r, unnest(string_split(text, chr(10))) as line from d),
dups as (select r, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
windows as (select r, i, array_to_string(words[i:i + {q.WINDOW - 1}], ' ') as k from (select r, words, unnest(range(1, len(words) - {q.WINDOW - 2})) as i from w)),
again as (select r, i from (select r, i, count(*) over (partition by r, k) as n from windows) where n > 1),
covered as (select r, count(distinct i + j) as n from again, range({q.WINDOW}) t(j) group by 1),
f as (select r, doc_id, lang, source, cast(len(words) as bigint) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols, cast(coalesce(dups.n, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from w left join dups using (r) left join covered using (r)),
b as (select *, n_words < {q.MIN_WORDS} or 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words as base_failed from f),
passed as (select * from b where not base_failed),
cells as (select lang, source, feature, {_BIN} as bin, count(*) as n from ({stacked}) group by all),
sizes as (select lang, source, sum(n) as docs from cells where feature = 'n_words' group by all),
levels as (select *, case when docs >= {q.MIN_GROUP} then 2 when sum(docs) over (partition by lang) >= {q.MIN_GROUP} then 1 else 0 end as level from sizes),
keyed as (select lang, source, level, case when level >= 1 then lang else '' end as gl, case when level = 2 then source else '' end as gs from levels),
merged as (select level, case when level >= 1 then lang else '' end as gl, case when level = 2 then source else '' end as gs, feature, bin, sum(n) as n
  from cells, range(3) t(level) group by all),
ranked as (select *, sum(n) over (partition by level, gl, gs, feature order by bin) as upto, sum(n) over (partition by level, gl, gs, feature) as total from merged),
deciles as (select level, gl, gs, feature, min(case when 10 * upto >= total then bin end) as b1, min(case when 2 * upto >= total then bin end) as b5, min(case when 10 * upto >= 9 * total then bin end) as b9
  from ranked group by all),
bounds as (select *, {_LOW.format(b='b1')} as d1, {_LOW.format(b='b5')} as d5, {_LOW.format(b='b9')} as d9 from deciles),
wide as (select level, gl, gs, {wide}, {low} as lo_word_length, {low_words} as lo_n_words from bounds group by level, gl, gs),
fences as (select lang, source, wide.* exclude (level, gl, gs) from keyed join wide using (level, gl, gs))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
not base_failed and {inside} and coalesce({rate('word_chars')} >= lo_word_length, true) as kept from b left join fences using (lang, source)"""


def warc() -> str:
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = " || ".join(f"substr('{alphabet}', cast((v >> {shift}) & 31 as integer) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""with p as (select page_id, coalesce(html, '') as html from pages),
h as (select *, sha1(html) as hex, max(page_id) over (partition by html) as largest from p),
g as (select *, array_to_string(list_transform(list_transform(range(8), lambda k: cast('0x' || substr(hex, 5 * k + 1, 5) as bigint)), lambda v: {digits}), '') as digest from h)
select page_id, cast(strlen(html) as bigint) as payload_bytes, digest as payload_digest, case when page_id is null or page_id = largest then 'response' else 'revisit' end as record_type,
case when page_id < largest then largest end as refers_to from g"""


def sharding() -> str:
    table = []
    for k in range(256):  # the table of CRC-32, from its polynomial
        for _ in range(8):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    step = f"xor(([{', '.join(map(str, table))}])[(xor(a, b) & 255) + 1], a >> 8)"
    return f"""with d as (select doc_id, coalesce(text, '') as text from documents),
c as (select doc_id, strlen(text) + {s.ROW_BYTES} as size, cast(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x as bigint))),
  lambda a, b: {step}), 4294967295) as bigint) as text_crc32 from d),
p as (select *, row_number() over o as r, sum(size) over (order by text_crc32, doc_id nulls first, size rows unbounded preceding) as upto, sum(size) over () as total from c
  window o as (order by text_crc32, doc_id nulls first, size)),
q as (select *, cast(least((2 * upto - size) * {s.SHARDS} // (2 * total), {s.SHARDS - 1}) as integer) as shard from p)
select doc_id, cast(size as bigint) as size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by r) - 1 as slot, cast(null as integer) as grown_shard from q"""


ORACLES = {"op4_sharding": sharding(), "op5_quality_rules": quality_rules(), "op3_warc": warc()}
