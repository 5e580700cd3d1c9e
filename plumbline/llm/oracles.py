"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

MIX = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text,''), {_BLANK})) as size, md5(coalesce(cast(doc_id as varchar),'null')||':0') as key from documents),
s as (select source, cast(sum(size) as bigint) as source_size, cast(([5,2,1])[(row_number() over (order by source nulls last)-1)%3+1] as double) as w from d group by source),
c as (select *, cast(3*source_size as double) as cap, row_number() over (order by 3*source_size/w, source) as k from s),
l as (select *, ((select cast(sum(source_size) as double) from s) - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0)) / sum(w) over (order by k rows between current row and unbounded following) as level from c),
t as (select source, source_size, least(w*(select level from l where level*w <= cap order by k limit 1), cap) as target from c),
p as (select doc_id, size, source_size, target, cast(floor(target+0.5) as bigint) as budget, cast(coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as before from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size>0 then budget//source_size else 0 end as epochs from p)
select doc_id, cast(size as bigint) as size, source_size, target, cast(epochs*size + least(greatest(budget-epochs*source_size-before, 0), size) as bigint) as taken from e"""

NEAR = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, {_BLANK}) as w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w)-4, 1)+1), lambda i: array_to_string(list_slice(w, i, i+4), ' '))) as k from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b using (k) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100*c >= 85*(nx.n+ny.n-c)),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.y from r join e on r.b = e.x),
m as (select a, min(b) as component_id from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id, d.doc_id = m.component_id as kept from d join m on d.doc_id = m.a left join n on d.doc_id = n.doc_id"""

LEAKS = f"""
with b as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark),
bw as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w)-9, 1)+1), lambda i: array_to_string(list_slice(w, i, i+9), ' '))) as k from b where len(w) > 0),
d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
dw as (select doc_id, n, unnest(range(1, len(w)-n+2)) as i, w from d, (select distinct n from bw)),
h as (select doc_id, i, bw.n, item_id from (select doc_id, i, n, array_to_string(list_slice(w, i, i+n-1), ' ') as k from dw) x join bw on x.k = bw.k and x.n = bw.n),
hw as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i+n)) as p from h) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, cast(item_id as varchar) as item from h) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from d left join hw on d.doc_id = hw.doc_id left join it on d.doc_id = it.doc_id"""

REPEATS = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text,''), {_BLANK}) as w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i+19), ' ') as k from (select doc_id, w, unnest(range(1, len(w)-18)) as i from d)),
rep as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from win) where r > 1),
g as (select doc_id, list(p) as ps, count(*) as n from (select distinct doc_id, unnest(range(i, i+20)) as p from rep) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(array_to_string(case when ps is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end, ' ')) as kept_sha256 from d left join g on d.doc_id = g.doc_id"""

_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda c, x: list_reduce([xor(c,x),0::bigint,0,0,0,0,0,0,0], lambda a, b: xor(a>>1, 3988292384*(a&1)))), 4294967295::bigint)"
_SPACE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(state: str, cost: str, letter: str, line: str) -> str:
    """A state's cheapest edits so far, and one more: cost and audit as sortable text, and the repaired lines."""
    return f"{{'k': lpad(((left({state}.k,12)::bigint)+{cost})::varchar,12,'0')||substr({state}.k,13)||'{letter}', 't': {state}.t||{line}}}"


_NL = "case when t.{0}.t='' then '' else chr(10) end"


def _keep(state: str, letter: str) -> str:
    return _way("t." + state, f"case when r='{letter}' and not gone then late else 100000 end", "K", f"{_NL.format(state)}||role||':'||text")


def _rerole(state: str, role: str) -> str:
    return _way("t." + state, "case when gone then 100000 else late+1 end", "R", f"{_NL.format(state)}||'{role}:'||text")


#: Inserts are left out: deleting the row that an insert stands beside never costs more than inserting (2 against 5), and it ends the same way.
REPAIR = f"""
with recursive k as (select *, coalesce(conv_id::varchar,' ')||':'||coalesce(turn::varchar,' ') as k from conversations),
c as (select conv_id, turn, coalesce(role,' ') as role, coalesce(text,' ') as text, {_CRC} % 20 as f from k),
d as (select conv_id, turn, case when f=4 then 'user' else role end as role, case when f=1 then '' when f=2 then translate(text,'.!?','') else text end as text, unnest(range(case when f=3 then 2 else 1 end)) as copy from c where f<>0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i, rtrim(text, {_SPACE}) as bare from d),
s as (select *, row_number() over (partition by conv_id, role, text order by i) as seen from o),
g as (select *, left(role,1) as r, case when bare='' then 1 when seen>1 then 2 when right(bare,1) not in ('.','!','?') then 3 else 0 end as fault from s),
h as (select *, fault in (1,2) as gone, case when fault=3 then 5 else 0 end as late, lag(r) over (partition by conv_id order by i) as p from g),
t(conv_id, i, q0, q1, q2, q3) as (
 select conv_id, 0::bigint, {{'k': '000000000000', 't': ''}}, {{'k': '000000100000', 't': ''}}, {{'k': '000000100000', 't': ''}}, {{'k': '000000100000', 't': ''}} from (select distinct conv_id from h)
 union all
 select t.conv_id, h.i, {_way("t.q0", "2", "D", "''")},
  {_least(_way("t.q1", "2", "D", "''"), _keep("q0", "s"))},
  {_least(_way("t.q2", "2", "D", "''"), _keep("q0", "u"), _keep("q1", "u"), _keep("q3", "u"), _rerole("q0", "user"), _rerole("q1", "user"), _rerole("q3", "user"))},
  {_least(_way("t.q3", "2", "D", "''"), _keep("q2", "a"), _rerole("q2", "assistant"))}
 from t join h on h.conv_id is not distinct from t.conv_id and h.i = t.i + 1),
e as (select t.conv_id, {_least("q0", "q3")} as w from t join (select conv_id, max(i) as i from h group by conv_id) m on t.conv_id is not distinct from m.conv_id and t.i = m.i),
n as (select conv_id, coalesce(max(turn)-min(turn)+1-count(distinct turn), 0) as gaps, sum((fault=1)::int) as blank, sum((fault=2)::int) as duplicate, sum((fault=3)::int) as truncated, sum((p is not null and p||r not in ('su','ua','au'))::int) as illegal from h group by conv_id)
select a.conv_id, coalesce(gaps,0)::bigint as gaps, coalesce(blank,0)::bigint as blank, coalesce(duplicate,0)::bigint as duplicate, coalesce(truncated,0)::bigint as truncated, coalesce(illegal,0)::bigint as illegal, coalesce(left(w.k,12)::bigint,0) as cost, coalesce(substr(w.k,13),'') as audit, sha256(coalesce(w.t,'')) as repaired_sha256
from (select distinct conv_id from conversations) a left join n on a.conv_id is not distinct from n.conv_id left join e on a.conv_id is not distinct from e.conv_id"""

#: All pairs, so what the passes may miss would show.
NEAR_VECTORS = """
with recursive f as (select vec_id, cast(embedding as double[]) as v from embeddings),
u as (select vec_id, list_transform(v, lambda x: x/sqrt(list_dot_product(v, v))) as v from f where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
e as (select a.vec_id as x, b.vec_id as y from u a join u b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) >= 0.9),
r(a, b) as (select vec_id, vec_id from embeddings union select r.a, e.y from r join e on r.b = e.x),
m as (select a, min(b) as component_id from r group by a)
select d.vec_id, (select count(*) from e where e.x = d.vec_id) as n_links, component_id, d.vec_id = component_id as kept from embeddings d join m on d.vec_id = m.a"""

PHRASES = rf"""
with d as (select coalesce(lang,'und') as lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) as p from documents),
w as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from d),
s as (select lang, w, unnest(range(1, len(w)+1)) as i from w),
g as (select lang, list_slice(w, i, i+n-1) as g, count(*) as a from s, (select unnest(range(1,6)) as n) where i+n-1 <= len(w) group by 1, 2),
f as (select * from g where a >= 100),
t as (select lang, sum(len(w))::hugeint as n from w group by 1),
c as (select f.*, n, unnest(range(1, len(g))) as k from f join t using (lang) where len(g) > 1),
j as (select c.lang, c.g, c.a, c.n, k, l.a as l, r.a as r, (1000*c.a::hugeint*c.n) // (l.a::hugeint*r.a) as score from c join f l on l.lang = c.lang and l.g = list_slice(c.g, 1, k) join f r on r.lang = c.lang and r.g = list_slice(c.g, k+1, len(c.g))),
b as (select *, row_number() over (partition by lang, g order by score, k) as z from j),
x as (select distinct lang, h as g, a from (select lang, a, unnest([list_slice(g, 1, len(g)-1), list_slice(g, 2, len(g))]) as h from f where len(g) > 2)),
o as (select b.* from b where z = 1 and not exists (select 1 from x where x.lang = b.lang and x.g = b.g and x.a >= b.a)),
q as (select *, array_to_string(g, ' ') as phrase from o),
v as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from q)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from v where rank <= 2000"""
