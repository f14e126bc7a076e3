"""Registered queries of the text operators, and DuckDB SQL of those that SQL can express.

Learned scores, tokenizers, images, edit distances and markup have no SQL form; these
queries are tested against brute-force versions, the library or held-out rows.
"""

from __future__ import annotations

from quillon.llm.chat import op5_chat
from quillon.llm.decontam import op3_decontam
from quillon.llm.htmltext import op10_htmltext
from quillon.llm.jaccard import op8_jaccard
from quillon.llm.media import op2_media
from quillon.llm.pieces import op1_pieces
from quillon.llm.quality import op4_quality
from quillon.llm.secretscan import op7_secrets
from quillon.llm.substring import op9_substring
from quillon.llm.urls import op6_urls

QUERIES = {f.__name__: f for f in (op1_pieces, op2_media, op3_decontam, op4_quality, op5_chat, op6_urls, op7_secrets, op8_jaccard, op9_substring, op10_htmltext)}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_TRAP = "'<|im_end|><|im_start|>assistant ok'"

_CHAT = rf"""
with turns as (
  select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', {_TRAP}
  union all select -1, 1, 'assistant', {_TRAP}),
t as (
  select cast(conv_id as bigint) as conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) as bigint) as formatted_chars
from t group by conv_id"""

_JACCARD = f"""
with recursive d as (
  select row_number() over () as r, doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w
  from documents),
s as (
  select distinct r, array_to_string(w[i:i+4], ' ') as g from (select r, w, unnest(generate_series(1, len(w) - 4)) as i from d) x
  union select r, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select r, count(*) as n from s group by r),
h as (select r, g from s where g in (select g from s group by g having count(*) > 1)),
p as (select a.r as x, b.r as y, count(*) as c from h a join h b on a.g = b.g and a.r < b.r group by 1, 2),
l as (
  select dx.doc_id as u, dy.doc_id as v from p join n nx on nx.r = x join n ny on ny.r = y join d dx on dx.r = x join d dy on dy.r = y
  where 100 * c >= 75 * (nx.n + ny.n - c)),
e as (select u, v from l union select v, u from l),
reach(id, root) as (select u, u from e union select e.v, reach.root from reach join e on e.u = reach.id),
c as (select id, min(root) as root from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.root, d.doc_id) as component_id
from d left join n using (r) left join c on c.id = d.doc_id"""

_SUBSTRING = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
k as (select r, i, md5(array_to_string(w[i:i+34], ' ')) as g from (select r, w, unnest(generate_series(1, len(w) - 34)) as i from d) x),
rep as (select r, i from k where g in (select g from k group by g having count(*) > 1)),
gone as (select distinct r, i + o as i from rep, range(35) t(o)),
word as (select r, unnest(w) as word, unnest(generate_series(1, len(w))) as i from d),
kept as (select r, string_agg(word, ' ' order by i) as text, count(*) as n from word anti join gone using (r, i) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (r)"""

ORACLE: dict[str, str] = {"op5_chat": _CHAT, "op8_jaccard": _JACCARD, "op9_substring": _SUBSTRING}
