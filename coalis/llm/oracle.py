"""DuckDB SQL for the pN_ queries that SQL can express on whole tables."""

from coalis.plans.hot import ISSUE as _ISSUE

# Stated here on its own, so that the SQL does not follow the operator's default.
_WORDS = """
'na', 'nan', 'nil', 'none', 'null', 'nul', 'void', 'missing', 'absent', 'empty', 'blank', 'unknown', 'unspecified', 'undefined', 'undetermined', 'unavailable', 'unset',
'untitled', 'untitled finding', 'untitled issue', 'no title', 'no version', 'no name', 'no value', 'no data', 'title missing', 'version missing', 'missing title', 'missing version',
'unknown version', 'unknown title', 'version unknown', 'title unknown', 'not available', 'not applicable', 'not specified', 'not set', 'not known', 'not given', 'not provided',
'not defined', 'not found', 'n a', 't b d', 'tbd', 'tba', 'tbc', 'todo', 'fixme', 'to be filled in', 'to be determined', 'to be defined', 'to be done', 'to be announced',
'placeholder', 'dummy', 'default', 'title', 'version', 'x y z'
"""


def _usable(c: str) -> str:
    words = f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return (
        f"({c} is not null and {words} <> '' and {words} not in ({_WORDS}) and not regexp_matches({words}, '^x{{2,}}$')"
        f" and not regexp_matches(lower({c}), '^\\s*(\\$?\\{{+[^{{}}]*\\}}+|%+\\w+%+|<+[^<>]*>+|\\[+\\s*(title|version|name|value|text)\\s*\\]+)\\s*$'))"
    )


_SOURCE = "trim(regexp_replace(lower({}), '[\\s\\x{{0085}}\\p{{Z}}_-]+', ' ', 'g'))"

P1 = f"""
with r as (select {_SOURCE.format('source')} as src, min(trust_rank) as rnk from scan_sources group by 1),
c as (
  select lower(occurrence_key) as k, cand_id, seen_at, coalesce(r.rnk, 4611686018427387904) as rnk, title, affected_version
  from candidates left join r on {_SOURCE.format('origin.source')} = r.src),
m as (select cluster_id, list_distinct(list_transform(members, lambda x: lower(x))) as ms from clusters),
g as (select cluster_id, unnest(ms) as k from m where len(ms) > 1),
f as (
  select cluster_id, 'title' as field_name, cand_id, rnk, seen_at from g join c using (k) where {_usable('title')}
  union all select cluster_id, 'affected_version', cand_id, rnk, seen_at from g join c using (k) where {_usable('affected_version')}
  union all select cluster_id, 'source', cand_id, rnk, seen_at from g join c using (k))
select cluster_id, field_name, cand_id from (
  select *, row_number() over (partition by cluster_id, field_name order by rnk, seen_at desc nulls last, cand_id) as n from f) where n = 1
"""

_PARTS = "string_split(regexp_replace(x, '#.*$', ''), '?')"
_HEAD = f"replace({_PARTS}[1], '/@', '/%40')"
_QUERY = f"""coalesce('?' || array_to_string(list_sort(list_transform(string_split({_PARTS}[2], '&'),
  lambda q: lower(string_split(q, '=')[1]) || '=' || string_split(q, '=')[2])), '&'), '')"""
_CANONICAL = f"""case
  when x like 'cpe:2.3:%' then lower(x)
  when x like 'cpe:/%' then 'cpe:2.3:' || lower(substr(x, 6)) || repeat(':*', (11 - len(string_split(substr(x, 6), ':')))::int)
  when lower(x) like 'pkg:pypi/%' then replace(lower(regexp_replace({_HEAD}, '@[^/]*$', '')), '_', '-') || regexp_extract({_HEAD}, '@[^/]*$') || {_QUERY}
  when regexp_matches(lower(x), '^pkg:(npm|github|deb)/') then lower(regexp_replace({_HEAD}, '@[^/]*$', '')) || regexp_extract({_HEAD}, '@[^/]*$') || {_QUERY}
  else lower(regexp_extract(x, '^pkg:[^/]*')) || regexp_replace({_HEAD}, '^pkg:[^/]*', '') || {_QUERY} end"""


def _pairs(name: str, batch: str, subject: str = _CANONICAL) -> str:
    return f"""select cand_id, {batch} as b, partition, kind, {_ISSUE} as issue, {subject} as subject
  from (select cand_id, {batch}, partition, kind, i, unnest(subject_ids) as x from (select *, unnest(issue_ids) as i from {name}))
  where partition is not null and kind.tag is not null and {_ISSUE} <> '' and x is not null"""


def _repeats(subject: str, out: str) -> str:
    return f"""
with a as ({_pairs('candidates', '0', subject)} union all {_pairs('incoming_candidates', 'batch_no', subject)})
select n.cand_id, min(o.cand_id) as {out} from a n join a o
on n.partition = o.partition and n.kind is not distinct from o.kind and n.issue = o.issue and n.subject = o.subject and o.b < n.b
group by 1"""


P5 = _repeats(_CANONICAL, "accepted_id")

_PICKS = ", ".join(
    f"max(case when f.field_name = '{f}' then {v} end) as {f}, max(case when f.field_name = '{f}' then f.cand_id end) as {f}_from"
    for f, v in (("title", "c.title"), ("affected_version", "c.affected_version"), ("source", "trim(c.origin.source, ' ')"))
)
P1_GOLDEN = f"with f as ({P1}) select f.cluster_id, {_PICKS} from f join candidates c using (cand_id) group by f.cluster_id"

P2 = """
with recursive
p as (select least(lower(left_key), lower(right_key)) as a, greatest(lower(left_key), lower(right_key)) as b,
  arg_max(coalesce(lower(trim(decision)) = 'duplicate', false), row(compared_at, comparison_id)) as d from comparisons where lower(left_key) <> lower(right_key) group by 1, 2),
m as (select list_sort(list_distinct(list_transform(members, lambda x: lower(x)))) as ms from clusters),
l as (select a, b from p where d union select ms[1], unnest(ms[2:]) from m where len(ms) > 1),
e as materialized (select a, b from l union select b, a from l),
cc(k, g) using key (k) as (
  select a, min(least(a, b)) from e group by a
  union
  select e.a, min(cc.g) from cc join e on e.b = cc.k join recurring.cc as old on old.k = e.a where cc.g < old.g group by e.a)
select k as occurrence_key, g as group_key from cc"""

# Every pair with a common bigram is counted here, which only small tables allow.
P3 = r"""
with w as (select cand_id, partition, kind, trim(regexp_replace(regexp_replace(lower(concat_ws(' ', title, array_to_string(subject_names, ' '), location)), '\p{Cf}+', '', 'g'),
  '[^\p{L}\p{N}\p{M}]+', ' ', 'g')) as t from candidates where partition is not null and kind.tag is not null),
x as (select cand_id, partition, kind, unnest(string_split(t, ' ')) as word from w where t <> ''),
g as (select cand_id, partition, kind, word, unnest(range(1, length(word) + 2)) as i from x),
f as (select cand_id, partition, kind, gram, row_number() over (partition by cand_id, gram) as n from (select *, substr(' ' || word || ' ', i::int, 2) as gram from g)),
s as (select cand_id, count(*) as size from f group by 1),
b as (select a.cand_id as x, c.cand_id as y, count(*) as common from f a join f c on a.partition = c.partition and a.kind is not distinct from c.kind and a.gram = c.gram and a.n = c.n and a.cand_id < c.cand_id
  group by 1, 2)
select x as cand_id_a, y as cand_id_b from b join s sx on sx.cand_id = x join s sy on sy.cand_id = y where common::double / (sx.size + sy.size - common) > 0.8"""

P3_CLASSES = P3.replace("select x as cand_id_a, y as cand_id_b from", """, j as materialized (select x, y from""") + r"""),
k as (select cand_id, partition, kind, list_sort(string_split(t, ' ')) as t from w where t <> ''),
c as (select cand_id, min(cand_id) over (partition by partition, kind, t) as class_id, count(*) over (partition by partition, kind, t) as class_size from k),
o as (select z, count(*) as links from (select unnest([x, y]) as z from j where x in (select class_id from c) and y in (select class_id from c)) group by 1)
select cand_id, class_id, class_size, coalesce(links, 0) as links from c left join o on z = class_id"""

# What any right packing or mix has in common, whatever its random numbers.
P6_CHECKED = """select container_kind, (select count(*) from documents where text is not null) as n_documents, 0::bigint as wrongly_cut, 0::bigint as gaps, 0::bigint as overfull
from pack_sizes where capacity_tokens > 0 group by container_kind"""
P7_CHECKED = "select source, target_share, true as reached, false as overused, 0::bigint as repeated_uses, 0::bigint as foreign from mix_targets where source in (select source from documents)"

SQL = {"p6_checked": P6_CHECKED, "p7_checked": P7_CHECKED, "p1_found": P1, "p1_golden": P1_GOLDEN, "p2_found": P2, "p3_found": P3, "p3_classes": P3_CLASSES, "p5_found": P5}
