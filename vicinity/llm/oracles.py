"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_chat_formatting"] = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns as (
  select *, regexp_replace(text, '([<\[])(\\*)(\|(?:start|sep|end|im_start|im_end|endoftext)\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g') as escaped from rows)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (where role = 'assistant'), '')) as loss_sha256,
  (sum(length('<|start|>' || role || '<|sep|>' || escaped || '<|end|>')) + count(*) - 1)::bigint as formatted_chars
from turns group by conv_id
"""

ORACLES["op9_source_mixing"] = r"""
with base as (
  select *, length(bin(size)) as digits from (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents)),
s0 as (select source, sum(size)::bigint as source_size, sum(size * digits)::bigint as size_digits, min(digits) as low, max(digits) as high from base group by source),
s1 as (select *, [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, 2.0::double * source_size as cap from s0),
s2 as (select *, cap / weight as fill from s1),
s3 as (select *,
  coalesce(sum(cap) over (order by fill, source nulls last rows between unbounded preceding and 1 preceding), 0) as before,
  sum(weight) over (order by fill, source nulls last rows between current row and unbounded following) as open_weight,
  1.5::double * sum(source_size) over () as total from s2),
s4 as (select *, (total - before) / open_weight as level from s3),
s5 as (select *, (select level from s4 where level <= fill order by fill, source nulls last limit 1) as lam from s4),
s6 as (select source, source_size, size_digits, low, high, case when lam is null then cap else least(cap, lam * weight) end as target from s5),
s7 as (select *, case when source_size > 0 then target / source_size else 0 end as times from s6),
s8 as (select *, floor(times + 1e-12)::bigint as whole from s7),
s9 as (select *, greatest(0, times - whole) as p, target - whole * source_size as lacks, case when source_size > 0 then size_digits / source_size else 0 end as mean from s8),
s10 as (select *, greatest(high - mean, mean - low) as reach from s9),
s11 as (select *, case when reach > 0 then 0.5::double * least(p, 1 - p) / reach else 0 end as tilt from s10),
r0 as (select b.doc_id, b.size, s.source, s.source_size, s.target, s.whole, s.p, s.lacks, s.p + s.tilt * (b.digits - s.mean) as pi,
  (('0x' || substr(md5('mix-1:' || coalesce(b.doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u
  from base b join s11 s on b.source is not distinct from s.source),
r1 as (select *, case when p > 0 then (u / (1 - u)) / (pi / (1 - pi)) end as odds from r0),
r2 as (select *, coalesce(sum(size) over (partition by source order by odds / (1 + odds), doc_id nulls first rows between unbounded preceding and 1 preceding), 0) as before from r1)
select doc_id, size, source_size, target,
  (size * (whole + case when p > 0 and before + size / 2.0 <= lacks then 1 else 0 end))::bigint as taken,
  (whole + case when p > 0 and before + size / 2.0 <= lacks then 1 else 0 end)::bigint as copies
from r2
"""

ORACLES["op10_line_dedup"] = r"""
with lines as (
  select doc_id, i, ls[i] as line, translate(trim(ls[i], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
repeated as (select key, max(doc_id) as owner from lines where length(key) >= 20 group by key having count(distinct doc_id) >= 3)
select doc_id, count(*)::bigint as n_lines,
  count(*) filter (where owner is not null and owner <> doc_id)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where owner is null or owner = doc_id), '')) as kept_sha256
from lines left join repeated using (key) group by doc_id
"""

ORACLES["op7_minhash_near_dedup"] = r"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as ws from documents),
sets as (
  select doc_id, case when len(ws) < 2 then ws else list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) end as sh from words),
entries as (select doc_id, len(sh) as n, unnest(sh) as s from sets),
pairs as (
  select a.doc_id as x, b.doc_id as y from entries a join entries b on a.s = b.s and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select x, y from pairs union select y, x from pairs),
reach as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
least as (select x, min(y) as y from reach group by x)
select doc_id, len(sh)::bigint as n_shingles, least(doc_id, coalesce(y, doc_id)) as component_id, doc_id <= coalesce(y, doc_id) as kept
from sets left join least on doc_id = x
"""

ORACLES["op5_decontamination"] = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ws from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as ws from benchmark),
ds as (select doc_id, len(ws) as words, [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] as sh from d where len(ws) >= 5),
bs as (select item_id, len(ws) as n, [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] as sh from b where len(ws) >= 5),
pair as (select distinct doc_id, item_id from (select doc_id, unnest(sh) as s from ds) join (select item_id, unnest(sh) as s from bs) using (s)),
win as (select doc_id, item_id, n, len(bs.sh) as b_size, ds.sh as sh, unnest(range(0, greatest(0, words - n) + 1)) as start from pair join ds using (doc_id) join bs using (item_id)),
wsh as (select doc_id, item_id, n, b_size, start, unnest(sh[start + 1:start + n - 4]) as s from win),
wc as (select doc_id, item_id, n, b_size, start, s, count(*) as c from wsh group by all),
ic as (select item_id, s, count(*) as c from (select item_id, unnest(sh) as s from bs) group by all),
sim as (select wc.doc_id, wc.item_id, n, b_size, start, sum(wc.c) as a_size, sum(least(wc.c, coalesce(ic.c, 0))) as common
  from wc left join ic on wc.item_id = ic.item_id and wc.s = ic.s group by all),
good as (select *, common::double / (a_size + b_size - common) as similarity from sim where common::double / (a_size + b_size - common) >= 0.8 - 1e-12)
select doc_id, item_id, start::bigint as start_word, n::bigint as n_words, round(similarity, 6) as similarity from good
qualify row_number() over (partition by doc_id, item_id order by similarity desc, start) = 1
"""
