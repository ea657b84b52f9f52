"""SQL of the queries on centroids, prefix tries and licenses."""

from __future__ import annotations

from lograin.llm.licenses import NOTICES

_ASSIGNED = """
a{i} as (
  select r, vec_id, e, n, d from (
    select v.r, v.vec_id, v.e, c.n,
      list_dot_product(v.e, v.e) - 2 * list_dot_product(v.e, c.e) + list_dot_product(c.e, c.e) as d
    from v, c{i} c
  )
  qualify row_number() over (partition by r order by d, n) = 1
)"""

_MOVED = """
m{i} as (
  select n, list(floor(s / k) order by dim) as e from (
    select n, dim, sum(x) as s, count(*) as k
    from (select n, unnest(e) as x, unnest(range(64)) as dim from a{i}) group by n, dim
  ) group by n
),
c{j} as (select c.n, coalesce(m.e, c.e) as e from c{i} c left join m{i} m using (n))"""


def centroids_sql(rounds: int = 3) -> str:
    steps = [step for i in range(rounds) for step in (_ASSIGNED.format(i=i), _MOVED.format(i=i, j=i + 1))]
    return f"""
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e
  from embeddings
  where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
),
c0 as (
  select row_number() over (order by sha256('1:' || vec_id) nulls last, e) - 1 as n, e from v qualify n < 16
),{",".join([*steps, _ASSIGNED.format(i=rounds)])}
select vec_id, cast(n as integer) as cluster, cast(d as bigint) as distance,
  cast(sum(d) over (partition by n) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
  sha256(array_to_string(list_transform(c.e, lambda x: cast(cast(x as bigint) as varchar)), ',')) as centroid_sha256
from a{rounds} join c{rounds} c using (n)
"""


PREFIX_TRIE_SQL = r"""
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as txt,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
),
convs as (
  select c, xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint)),
    lambda a, b: list_reduce(
      [xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))
    ))) % 4 as h
  from (select distinct c from t)
),
parts as (
  select c, 1 as own, pos, role, txt from t join convs using (c) where pos >= h
  union all
  select convs.c, 0, pos, role, txt from convs join t on t.c = convs.c - convs.c % 20 and pos < h
),
turns as (
  select c, row_number() over (partition by c order by own, pos) as d, role, txt from parts
),
keys as (
  select c, d, sha256(string_agg(concat(length(role), ':', role, length(txt), ':', txt), '' order by d) over (partition by c order by d)) as k,
    len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+')) as words
  from turns
  union all select c, 0, '', 0 from convs
),
members as (
  select *, lag(k) over (partition by c order by d) as pk, d = max(d) over (partition by c) as last from keys
),
nodes as (
  select k, d, any_value(pk) as pk, min(c) as conv_id, count(*) as n_convs, any_value(words) as words,
    sha256(coalesce(string_agg(c, ',' order by c) filter (last), '')) as ends_sha256
  from members group by k, d
),
kids as (select pk as k, count(*) as n_children from nodes where pk is not null group by pk),
shaped as (
  select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids on nodes.k = kids.k
),
totals as (
  select m.k, m.d, count(*) filter (x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.words) as saved_tokens
  from shaped x join keys m on m.c = x.conv_id and m.d <= x.d group by m.k, m.d
)
select s.conv_id, cast(s.d as bigint) as depth, p.conv_id as parent_conv_id, s.n_convs, s.n_children, n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, s.ends_sha256
from shaped s join totals on totals.k = s.k and totals.d = s.d left join nodes p on p.k = s.pk
"""

_TEMPLATES = ", ".join(f"('{text}', '{label}', false)" for text, label in NOTICES.items())

LICENSES_SQL = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
templates as (
  select row_number() over () as t, string_split(text, ' ') as tw, label, exact from (values
    ('under the mit license', 'mit', true), ('apache license version 2', 'apache-2', true), ('cc by nc', 'cc-by-nc', true), {_TEMPLATES}
  ) as given(text, label, exact)
),
runs as (select t, i as tpos, tw[i] as a, tw[i + 1] as b, tw[i + 2] as c from templates, unnest(range(1, len(tw) - 1)) as u(i)),
words as (select r, i as pos, w[i] as a, w[i + 1] as b, w[i + 2] as c from docs, unnest(range(1, len(w) - 1)) as u(i)),
hits as (select r, t, pos - 1 as pos, tpos, pos - tpos as diagonal from words join runs using (a, b, c)),
diagonals as (
  select r, t, diagonal, case when exact then 1 else cast(coalesce(diagonal - lag(diagonal) over (partition by r, t order by diagonal) > 3, true) as integer) end as apart
  from (select distinct r, t, diagonal from hits) join templates using (t)
),
merged as (select r, t, diagonal, sum(apart) over (partition by r, t order by diagonal) as span from diagonals),
spans as (
  select r, t, span, any_value(label) as label, any_value(exact) as exact, min(pos) as start, count(distinct tpos) / any_value(len(tw) - 2) as share
  from hits join merged using (r, t, diagonal) join templates using (t) group by r, t, span
),
judged as (
  select r, count(*) filter (exact and share = 1) as n_base, min(start) filter (exact and share = 1) as first_word,
    max(start) filter (exact and share = 1) as last_word, max(share) as score,
    string_agg(distinct label, ',' order by label) filter (exact and share = 1) as base_labels,
    string_agg(distinct label, ',' order by label) filter ((exact and share = 1) or (not exact and share >= 0.6)) as labels
  from spans group by r
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
  coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from docs left join judged using (r)
"""
