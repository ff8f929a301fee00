"""DuckDB SQL for the operators that SQL can express."""

MIXING = """
with counts as (select source as src, count(*) as n_docs from documents group by source),
weighed as (select src, n_docs, pow(n_docs::double, 0.7::double) as weight from counts),
total as (select sum(weight) as w_all, sum(n_docs) as n_all from weighed),
rates as (select src, n_all::double * (weight / w_all) / n_docs as lam from weighed, total),
steps as (select src, lam, unnest(range(0, ceil(lam + 12 * sqrt(lam) + 30)::bigint + 1)) as k from rates),
cdf as (select src, k, sum(exp(-lam + k * ln(lam) - lgamma((k + 1)::double))) over (partition by src order by k) as c from steps),
hashed as (select *, coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, '')) as name from documents),
u as (select *, ('0x' || substr(md5('17|' || name), 1, 13))::bigint / 4503599627370496.0::double as u from hashed),
n as (select u.doc_id, u.source, any_value(u.text) as text, any_value(u.lang) as lang, any_value(u.n_chars) as n_chars,
             u.name, count(cdf.k) as copies
      from u left join cdf on u.source is not distinct from cdf.src and cdf.c <= u.u group by u.doc_id, u.source, u.name),
copies as (select *, unnest(range(1, copies + 1))::int as copy from n)
select doc_id, text, lang, source, n_chars, copy,
       md5('order17|' || name || '|' || copy::varchar) as mix_key
from copies
"""

# The span arithmetic of chat.chat_windows, stated again over window functions.
CHAT = r"""
with raw as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
seg as (
  select *, '<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g') || chr(10)
     || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10) as segment from raw),
tok as (select *, ceil(length(segment) / 4.0::double)::bigint as tokens from seg),
ord as (
  select *, row_number() over o as pos, (sum(tokens) over (o rows unbounded preceding))::bigint as ends,
     sum(case when role = 'system' then 1 else 0 end) over (o rows unbounded preceding) as sys_seen
  from tok window o as (partition by conv_id order by turn nulls first, role, text)),
sys as (select *, role = 'system' and sys_seen = 1 as is_system from ord),
half as (
  select *, greatest(1, floor((2048 - 256 - coalesce(max(case when is_system then tokens end) over (partition by conv_id), 0)) / 2.0))::bigint as half from sys),
keyed as (select *, tokens > half as long, (ends - 1) // half as slot from half),
opened as (
  select *, coalesce(slot <> lag(slot) over o or long or lag(long) over o, false) as opens from keyed
  window o as (partition by conv_id order by pos)),
win as (select *, sum(opens::int) over (partition by conv_id order by pos rows unbounded preceding) as win from opened),
lasts as (select *, max(ends) over (partition by conv_id, win) as window_ends, max(win) over (partition by conv_id) as last_window from win),
sized as (
  select *, length(segment) * (1 + case when is_system then last_window - win
     when win < last_window and window_ends - ends + tokens <= 256 then 1 else 0 end) as out_chars from lasts)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum(out_chars)::bigint as formatted_chars, (max(last_window) + 1)::bigint as n_windows
from sized group by conv_id
"""
