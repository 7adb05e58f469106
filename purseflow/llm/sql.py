"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import corpus_pipeline

OP1 = r"""
with docs as materialized (
  select row_number() over () as k, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents
),
windows as materialized (
  select k, unnest(range(1, len(words) - 33)) as i from docs where len(words) >= 35
),
hashed as materialized (
  select w.k, w.i, array_to_string(list_slice(d.words, w.i, w.i + 34), ' ') as body
  from windows w join docs d on d.k = w.k
),
repeated as (select body from hashed group by body having count(*) > 1),
covered as (
  select distinct h.k, unnest(range(h.i, h.i + 35)) as i
  from hashed h join repeated r on r.body = h.body
),
gone as (select k, count(*) as n from covered group by k),
flags as (
  select d.doc_id, d.words, coalesce(g.n, 0) as n,
         d.k
  from docs d left join gone g on g.k = d.k
),
words as (
  select d.k, unnest(range(1, len(d.words) + 1)) as i, unnest(d.words) as word from docs d
),
kept as (
  select w.k, string_agg(w.word, ' ' order by w.i) as body
  from words w left join covered c on c.k = w.k and c.i = w.i
  where c.i is null group by w.k
)
select f.doc_id, cast(len(f.words) as bigint) as n_words, cast(f.n as bigint) as n_removed,
       sha256(coalesce(kept.body, '')) as kept_sha256
from flags f left join kept on kept.k = f.k
"""

OP6 = """
select doc_id,
       max(doc_id) over same as keep_id,
       count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

OP8 = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null
),
usable as (
  select * from v
  where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0
),
links as materialized (
  select a.vec_id as a, b.vec_id as b
  from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.93
),
reach(a, b) as (
  select vec_id, vec_id from embeddings
  union
  select r.a, l.b from reach r join links l on l.a = r.b
),
least as (select a, min(b) as component_id from reach group by a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id) as n_links,
       least.component_id, e.vec_id = least.component_id as kept
from embeddings e join least on least.a = e.vec_id
"""


# crc32 of a conversation's decimal id: each character is followed by eight shifts.
OP12 = r"""
with recursive turns as (
  select conv_id, turn, octet_length(encode(coalesce(text, ''))) as bytes,
         sha256(octet_length(encode(coalesce(role, '')))::varchar || ':' || coalesce(role, '')
                || coalesce(text, '')) as body
  from conversations where conv_id is not null
),
own as (
  select conv_id, list({'body': body, 'bytes': bytes} order by turn nulls first, body) as steps
  from turns group by conv_id
),
heads as (
  select conv_id, steps,
    list_reduce(
      flatten([[unicode(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]
               for c in string_split(conv_id::varchar, '')]),
      lambda s, x: case when x >= 0 then xor(s, x)
                        when s % 2 = 1 then xor(s // 2, 3988292384) else s // 2 end,
      4294967295::bigint) as state
  from own
),
rebuilt as (
  select o.conv_id,
         list_concat(coalesce(list_slice(b.steps, 1, xor(o.state, 4294967295) % 9), []),
                     list_slice(o.steps, xor(o.state, 4294967295) % 9 + 1, len(o.steps))) as steps
  from heads o left join own b on b.conv_id = o.conv_id - o.conv_id % 5
),
levels as (
  select conv_id, steps, unnest(range(0, len(steps) + 1)) as depth from rebuilt
),
members as materialized (
  select conv_id, depth, len(steps) = depth as ends,
         case when depth > 0 then steps[depth].bytes else 0 end as bytes,
         array_to_string([s.body for s in list_slice(steps, 1, depth)], '') as path
  from levels
),
nodes as materialized (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), ''))
           as ends_sha256
  from members group by depth, path
),
children as (
  select depth - 1 as depth, left(path, greatest(length(path) - 64, 0)) as path, count(*) as n
  from nodes where depth > 0 group by all
),
sized as materialized (
  select n.*, coalesce(c.n, 0) as n_children from nodes n left join children c using (depth, path)
),
below as (
  select a.depth, a.path, sum((d.n_convs - 1) * d.bytes) as saved,
         count(*) filter (d.n_children = 0) as leaves
  from sized d, unnest(range(0, d.depth + 1)) as up(k)
  join nodes a on a.depth = up.k and a.path = left(d.path, 64 * up.k)
  group by all
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children,
       b.leaves as n_leaves, cast(b.saved as bigint) as saved_tokens, n.ends_sha256
from sized n
join below b using (depth, path)
left join nodes p on p.depth = n.depth - 1 and p.path = left(n.path, greatest(length(n.path) - 64, 0))
"""


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_substring_dedup": OP1,
        "op6_exact_dedup": OP6,
        "op8_embedding_dedup": OP8,
        "op12_conversation_trie": OP12,
    }
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
