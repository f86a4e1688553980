"""DuckDB SQL for those operators' queries that SQL can express, straight from their contracts."""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
with items as (select item_id::varchar as item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') as ws from benchmark where item_id is not null),
iw as (select distinct item_id, least(len(ws), 13) as n, array_to_string(ws[i : i + least(len(ws), 13) - 1], ' ') as k
       from (select *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from items where len(ws) > 0)),
d as (select doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') as ws from documents),
dw as (select doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') as k
       from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, (select distinct n from iw) where len(ws) >= n)),
met as (select doc_id, dw.n, i, item_id from dw join iw on dw.n = iw.n and dw.k = iw.k),
hit as (select doc_id, count(distinct j) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as j from met) group by 1),
names as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as h from (select distinct doc_id, item_id from met) group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(h, sha256('')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from d left join hit using (doc_id) left join names using (doc_id)
"""

NEAR_DEDUP = f"""
with recursive w as (select doc_id, regexp_extract_all({_FOLD}, '{_WORD}') as ws from documents),
s as (select distinct doc_id, hash(x) as x from (
        select doc_id, ws[i] || ' ' || ws[i + 1] as x from (select doc_id, ws, unnest(range(1, len(ws))) as i from w)
        union all select doc_id, ws[1] from w where len(ws) = 1)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 80 * (na.n + nb.n - i)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on e.a = r.b),
m as (select a as doc_id, min(b) as component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from w left join n using (doc_id) left join m using (doc_id)
"""

RECOMPRESSION = f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
win as (select doc_id, i, sha256(array_to_string(ws[i : i + 34], ' ')) as k from (select doc_id, ws, unnest(range(1, len(ws) - 33)) as i from w where len(ws) > 34)),
twice as (select k from win group by 1 having count(*) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as j from win semi join twice using (k)),
own as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as j from w),
kept as (select doc_id, string_agg(word, ' ' order by j) as t, count(*) as n from own anti join gone using (doc_id, j) group by 1)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (doc_id)
"""

#: Words w of rows j, with the repeated tails; runs are maximal stretches of words equal to the word p later.
HARMONIC_RUNS = f"""
with recursive crc(k, v, step) as (
    select k, k::bigint, 0 from range(256) as t(k)
    union all select k, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, step + 1 from crc where step < 8),
look as (select list(v order by k) as l from crc where step = 8),
d as (select row_number() over () as j, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
hashed as (select d.*, xor(list_reduce([x::bigint for x in list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c))],
                lambda v, c: xor(v >> 8, l[(xor(v, c) & 255) + 1]), 4294967295::bigint), 4294967295) as h from d, look),
tail as (select *, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from hashed),
per as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from tail),
w as (select j, i, case when i < a or a is null then ws[i + 1] else ws[a + (i - a) % p + 1] end as word from (select *, unnest(range(n)) as i from per)),
eq as (select x.j, x.i, y.i - x.i as p from w x join w y on x.j = y.j and x.word = y.word and y.i > x.i join tail t on t.j = x.j where 4 * (y.i - x.i) <= t.n),
isle as (select j, p, i, i - row_number() over (partition by j, p order by i) as g from eq),
stretch as (select j, p, min(i) as s, count(*) + p as l from isle group by j, p, g having count(*) + p >= greatest(6, 4 * p)),
runs as (select j, s, l, min(p) as p from stretch group by 1, 2, 3),
listed as (select j, count(*) as n_runs, string_agg(s || ',' || l || ',' || p || chr(10), '' order by s, p) as t, first(struct_pack(s := s, l := l, p := p) order by l desc, s, p) as b from runs group by 1),
gone as (select distinct j, unnest(range(s + p, s + l)) as i from runs),
kept as (select j, string_agg(word, ' ' order by i) as t from w anti join gone using (j, i) group by 1)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, b.l::bigint as length, b.p::bigint as period, (b.l * 1000 // b.p)::bigint as exponent_milli,
       sha256(coalesce(listed.t, '')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256, n::bigint as n_words
from tail left join listed using (j) left join kept using (j)
"""

HARD_NEGATIVES = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(x::double * 256)) as v
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, b.label = a.label as same, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
pos as (select anchor_id, vec_id as positive_id, score as ps from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
neg as (select pos.*, vec_id as negative_id, score as ns, row_number() over (partition by pos.anchor_id, positive_id order by score desc, vec_id) as rank
        from pos join s on s.anchor_id = pos.anchor_id and not same and 30 * ps <= 100 * score and 100 * score <= 90 * ps)
select anchor_id, positive_id, rank::integer as rank, negative_id, ps as positive_score, ns as negative_score from neg where rank <= 10
"""
