"""DuckDB statements of the operators that SQL can express at an acceptable cost."""

#: crc32 in SQL: its table of 256 steps by eight shifts each, and the checksum of bytes in hexadecimal digits ``{0}``.
_STEPS = """bits as (select range::bigint as i, range::bigint as c, 0 as k from range(256) union all select i, xor(c>>1, 3988292384*(c&1)), k+1 from bits where k<8),
 steps as materialized (select list(c order by i) as steps from bits where k=8)"""
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, len({0})//2+1), lambda i: ('0x'||substr({0}, 2*i-1, 2))::bigint)), lambda c, b: xor(c>>8, steps[(xor(c,b)&255)+1])), 4294967295)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """with p as (select page_id, coalesce(html, '') as h from pages), k as (select *, strlen(h) as n, max(page_id) over (partition by h) as keeper from p)
select page_id, n as payload_bytes, sha1(h) as payload_digest, case when n >= 1000 and page_id <> keeper then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id <> keeper then keeper end as refers_to from k"""

_WORDS = f"regexp_extract_all({_LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATION = f"""with it as (select item_id, {_WORDS} as w from benchmark where text is not null),
 win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[s:s+least(10, len(w))-1], ' ') as k from (select item_id, w, unnest(range(1, len(w)-least(10, len(w))+2)) as s from it where len(w)>0)),
 dw as materialized (select doc_id, coalesce({_WORDS}, []) as w from documents),
 hit as materialized (select doc_id, s, n, k from (select doc_id, n, s, array_to_string(w[s:s+n-1], ' ') as k from (select doc_id, n, w, unnest(range(1, len(w)-n+2)) as s from dw, (select distinct n from win) where len(w)>=n)) where k in (select k from win)),
 cover as (select doc_id, count(distinct p) as h from (select doc_id, unnest(range(s, s+n)) as p from hit) group by doc_id),
 items as (select doc_id, count(*) as m, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from hit join win using (k)) group by doc_id)
select doc_id, len(w) as n_words, coalesce(h, 0) as n_hit, coalesce(m, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(h, 0)>0 as contaminated
from dw left join cover using (doc_id) left join items using (doc_id)"""

#: Candidates of the dynamic program from behind a row: struct (cost, edits) of state ``{0}``; what a row of initial u, a or s leads to.
_TO = {0: "case ini when 's' then v1 when 'u' then v2 end", 1: "case ini when 'u' then v2 end", 2: "case ini when 'a' then v3 end", 3: "case ini when 'u' then v2 end"}
_NEXT = {0: "v2", 1: "v2", 2: "v3", 3: "v2"}
_edit = lambda letter, cost, v: f"{{'c': ({v}).c+{cost}, 'a': '{letter}'||({v}).a}}"
_BASE = ", ".join(f"list_min(list_filter([{_edit('D', 3, f'v{s}')}, case when not gone and ({_TO[s]}) is not null then {_edit('K', 'cut', _TO[s])} end, case when not gone then {_edit('R', '2+cut', _NEXT[s])} end], lambda x: x is not null)) as b{s}" for s in range(4))
_AHEAD = f"""list_min([b0, {_edit('I', 2, 'b2')}, {_edit('II', 4, 'b3')}]), list_min([b1, {_edit('I', 2, 'b2')}, {_edit('II', 4, 'b3')}]), list_min([b2, {_edit('I', 2, 'b3')}]), list_min([b3, {_edit('I', 2, 'b2')}])"""
CONVERSATIONS = f"""with recursive {_STEPS},
 src as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("hex(encode(coalesce(conv_id::varchar, ' ')||':'||coalesce(turn::varchar, ' ')))")}%20 as f from conversations, steps),
 dmg as (select conv_id, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then translate(text, '.!?', '') else text end as text, unnest(range(case f when 0 then 0 when 3 then 2 else 1 end)) as copy from src),
 num as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from dmg),
 flt as (select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by conv_id, role, text order by i)>1 as again, lead(left(role, 1)) over (partition by conv_id order by i) as nxt from num),
 r as materialized (select *, left(role, 1) as ini, blank or again as gone, (not blank and not again and not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$'))::int as cut from flt),
 dp as (select conv_id, count(*)+1 as i, {{'c': 0::bigint, 'a': ''}} as v0, {{'c': 4::bigint, 'a': 'II'}} as v1, {{'c': 2::bigint, 'a': 'I'}} as v2, {{'c': 0::bigint, 'a': ''}} as v3 from r group by conv_id union all
  select conv_id, i, {_AHEAD} from (select r.conv_id, r.i, {_BASE} from dp join r on r.conv_id is not distinct from dp.conv_id and r.i=dp.i-1)),
 aud as materialized (select conv_id, v0.c as cost, v0.a as audit from dp where i=1),
 walk as (select conv_id, audit, 1 as j, 1::bigint as i, 0 as s, []::varchar[] as made from aud union all
  select k.conv_id, audit, j+1, k.i+(e<>'I')::int, z, case when e='D' then made else list_append(made, case when e='K' then r.role when z=2 then 'user' else 'assistant' end||':'||case when e='I' then '' else r.text end) end
  from (select *, case e when 'D' then s when 'K' then case when ini='s' then 1 when ini='u' then 2 else 3 end else case when s=2 then 3 else 2 end end as z
   from (select walk.*, substr(audit, j, 1) as e, r.ini from walk left join r on r.conv_id is not distinct from walk.conv_id and r.i=walk.i where j<=len(audit))) k left join r on r.conv_id is not distinct from k.conv_id and r.i=k.i),
 fin as (select conv_id, sha256(array_to_string(made, chr(10))) as repaired_sha256 from walk where j=len(audit)+1),
 stat as (select conv_id, coalesce(max(turn)-min(turn)+1-count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank, count(*) filter (where again and not blank) as duplicate, sum(cut)::bigint as truncated, count(*) filter (where nxt is not null and ini||nxt not in ('su', 'ua', 'au')) as illegal from r group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0) as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) o left join stat on stat.conv_id is not distinct from o.conv_id left join aud on aud.conv_id is not distinct from o.conv_id left join fin on fin.conv_id is not distinct from o.conv_id"""

SPELLING = f"""with recursive {_STEPS},
 runs as (select doc_id, w, count(*) as n from (select doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) as w from documents) where length(w)>=7 group by all),
 sums as (select w, n, {_CRC.format("hex(encode(coalesce(doc_id::varchar, '')||':'||w))")} as h from runs, steps),
 voc as materialized (select word, sum(n)::bigint as n from (select case when h%31=0 then left(w, (h%length(w))::int)||substr(w, (h%length(w))::int+2) else w end as word, n from sums) where length(word)>=7 group by word having sum(n)>=2),
 masks as (select word, unnest(list_concat(list_transform(range(0, length(word)), lambda i: left(word, i::int)||'_'||substr(word, i::int+2)), list_transform(range(0, length(word)+1), lambda i: left(word, i::int)||'_'||substr(word, i::int+1)))) as m from voc),
 near as (select distinct a.word, b.word as other from masks a join masks b using (m) where a.word<>b.word),
 best as (select near.word, count(*) as n_near, min({{'n': -v.n, 'w': other}}) as b from near join voc v on v.word=other group by near.word),
 formed as materialized (select voc.word, voc.n, coalesce(n_near, 0) as n_near, case when -b.n>=10*voc.n then b.w end as form, case when -b.n>=10*voc.n then -b.n end as form_n from voc left join best using (word)),
 chain as (select word, word as here, 0 as k from formed union all select chain.word, f.form, k+1 from chain join formed f on f.word=chain.here where f.form is not null),
 roots as (select word, arg_max(here, k) as root from chain group by word)
select word, form, root, n, n_near, form_n from formed join roots using (word)"""
