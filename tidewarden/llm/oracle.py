"""The operators' results as SQL over whole tables, where SQL can say them."""

from __future__ import annotations

from .chat import CONTROLS, END, START

#: A run of characters that aren't white space, as the operators take words.
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = """with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, 200)) as w from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as i from docs where length(h) >= 200)),
ranked as (select doc_id, i, (doc_id, i) > min((doc_id, i)) over (partition by w) as late from win),
spans as (select doc_id, i, i + 100 as e, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as reach from ranked where late),
runs as (select doc_id, i, e, sum(case when reach is null or i > reach then 1 else 0 end) over (partition by doc_id order by i) as run from spans),
gone as (select doc_id, run, min(i) as a, max(e) as z from runs group by doc_id, run),
edges as (select doc_id, z as a, lead(a) over (partition by doc_id order by a) as z from gone union all select doc_id, 0, min(a) from gone group by doc_id),
kept as (select e.doc_id, string_agg(substr(d.h, 2 * e.a + 1, 2 * (coalesce(e.z, length(d.h) // 2) - e.a)), '' order by e.a) as h from edges e join docs d on d.doc_id = e.doc_id group by e.doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(g.n, 0) as bigint) as n_removed, cast(coalesce(g.spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(k.h, d.h))) as kept_sha256
from docs d left join (select doc_id, sum(z - a) as n, count(*) as spans from gone group by doc_id) g on g.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id"""

OP3 = rf"""with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents),
sh as (select distinct doc_id, md5(array_to_string(w[i + 1 : i + 5], ' ')) as s from (select doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) as i from docs where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
both_ as (select a.doc_id as u, b.doc_id as v, count(*) as x from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from both_ join n p on p.doc_id = u join n q on q.doc_id = v where 100 * x >= 75 * (p.n + q.n - x)),
reach as (select u, v from links union select r.u, l.v from reach r join links l on r.v = l.u),
least_ as (select u, least(u, min(v)) as c from reach group by u)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(l.c, d.doc_id) as component_id, coalesce(l.c, d.doc_id) = d.doc_id as kept
from docs d left join n on n.doc_id = d.doc_id left join least_ l on l.u = d.doc_id"""


def _escaped(x: str) -> str:
    """As ``chat.escape``: a control string may begin inside another, so it is done twice."""
    special = str.maketrans({c: "\\" + c for c in "|[]/<>()"})
    pattern = "|".join(c[1:].translate(special) for c in sorted(CONTROLS, key=len, reverse=True))
    once = lambda t: rf"regexp_replace({t}, '([<\[])({pattern})', '\1\\\2', 'g')"
    return once(once(rf"replace({x}, '\', '\\')"))


_ROLE = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
_SAID = "</s>[INST] ok [/INST]"

OP4 = rf"""with rows_ as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '{_SAID}' union all select -7, 1, 'assistant', '{_SAID}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum({len(START)} + length({_escaped(_ROLE)}) + 1 + length({_escaped('text')}) + {len(END)} + 1) as bigint) as formatted_chars from rows_ group by conv_id"""

OP7 = rf"""with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) as s from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from docs where len(w) >= 50)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as first_ from win) where doc_id > first_),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as i from late),
kept as (select d.doc_id, string_agg(d.x, ' ' order by d.i) as t, count(*) as n from (select doc_id, unnest(w) as x, unnest(range(0, len(w))) as i from docs) d anti join gone g on g.doc_id = d.doc_id and g.i = d.i group by d.doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(len(d.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from docs d left join kept k on k.doc_id = d.doc_id"""

ORACLE = {"op1_suffix_array_dedup": OP1, "op3_minhash_near_dedup": OP3, "op4_chat_formatting": OP4, "op7_substring_dedup": OP7}
