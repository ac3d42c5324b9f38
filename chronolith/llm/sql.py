"""DuckDB SQL with the same results as the registered queries, where SQL can express them."""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_chunk_recipes"] = r"""
with d as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare from documents),
w as (select doc_id, bare, first_value(doc_id) over (partition by bare order by n desc, doc_id) as keep_id, count(*) over (partition by bare) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(bare) as text_sha256 from w
"""

_HOST, _REST = _LOWER.format("regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)"), "regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"

ORACLE_SQL["op3_redirect_urls"] = rf"""
with recursive p as (
  select page_id, html, coalesce({_HOST.format(u="url")}, '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    nullif(coalesce({_HOST.format(u="url")}, ''), '') || {_REST.format(u="url")} as node from pages),
rules(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (select distinct host, path, h || q as rule, v from (select distinct host, path from p), rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, q)),
best as (select host, path, first(rule order by length(rule) desc, v) as rule, first(v order by length(rule) desc, v) as v from fit group by host, path),
tag as (select host, path, node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) as t from p where node is not null),
link as (
  select host, path, node, replace(regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1), '&amp;', '&') as l from tag where regexp_matches(t, '(?is)^<link\b') and regexp_matches(t, '(?is)\brel\s*=\s*("[^"]*\bcanonical\b|''[^'']*\bcanonical\b|canonical\b)')
  union all
  select host, path, node, replace(regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1), '&amp;', '&') from tag where regexp_matches(t, '(?is)^<meta\b') and regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')),
target as (select node, case when contains(l, '://') then l when starts_with(l, '//') then 'x:' || l when starts_with(l, '/') then 'x://' || host || l when starts_with(l, '?') then 'x://' || host || path || l
    else 'x://' || host || case when path = '' then '/' else regexp_replace(path, '[^/]*$', '') end || l end as u from link where l <> '' and not starts_with(l, '#')),
edge as (select node as src, nullif({_HOST.format(u="u")}, '') || {_REST.format(u="u")} as dst from target),
both_ways as (select src, dst from edge where src <> dst union select dst, src from edge where src <> dst),
reach(node, seen) as (select src, src from both_ways union select r.node, b.dst from reach r join both_ways b on r.seen = b.src),
class as (select node, min(seen) as component from reach group by node),
named as (select p.page_id, p.host, p.path, b.rule, b.v, c.component from p left join best b on p.host = b.host and p.path = b.path left join class c on c.node = p.node),
vote as (select component, bool_or(v = 'allow') as a, bool_or(v = 'block') as b from named where component is not null and v is not null group by component)
select n.page_id, n.host, n.path, n.rule, coalesce(n.v, case when o.a then 'allow' when o.b then 'block' else 'allow' end) as verdict
from named n left join vote o on n.component = o.component
"""

ORACLE_SQL["op9_suffix_decontamination"] = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
sizes as (select distinct n from win),
place as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as t from (select d.doc_id, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) as i from d, sizes s where len(d.w) >= s.n)),
hit as (select p.doc_id, p.i, p.n, win.item_id from place p join win on p.n = win.n and p.t = win.t),
word as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by doc_id),
item as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(word.n_hit, 0) as n_hit, coalesce(item.n_items, 0) as n_items, sha256(coalesce(item.ids, '')) as items_sha256, coalesce(word.n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join item using (doc_id)
"""

# crc32 of a decimal number's text: each byte enters on the first of its eight shifts
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({x}::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"


def _hashed(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"coalesce(octet_length(encode({v}::varchar))::varchar || ':' || {v}::varchar, '-')" for v in values) + "))"


ORACLE_SQL["op13_merkle_manifest"] = rf"""
with recursive d as (
  select *, row_number() over () as k, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from (
    select doc_id, source, {_hashed("doc_id", "source", "lang", "n_chars", "text")} as leaf,
      case when {_CRC.format(x="doc_id")} % 2 = 0 then {_hashed("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")} end as tampered from documents)),
up(source, lvl, pos, h) as (
  select source, 0, pos, leaf from d
  union all
  select source, lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over (partition by source) as n from up) where n > 1 group by source, lvl, pos // 3),
sub as (select source, max(lvl) as height, arg_max(h, lvl) as subroot from up group by source),
ranked as (select *, row_number() over (order by source nulls first) - 1 as place from sub),
top(lvl, pos, h) as (
  select 0, place, subroot from ranked
  union all
  select lvl + 1, pos // 3, sha256(string_agg(h, '' order by pos)) from (select *, count(*) over () as n from top) where n > 1 group by lvl, pos // 3),
root as (select max(lvl) as height, arg_max(h, lvl) as root from top),
power as (select k as lvl, (3 ** k)::bigint as p from range(0, 30) t(k)),
step as (
  select d.k, w.lvl, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos < d.pos // w.p), '') as l, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos > d.pos // w.p), '') as r
    from d join ranked s on d.source is not distinct from s.source join power w on w.lvl < s.height join up u on u.source is not distinct from d.source and u.lvl = w.lvl and u.pos // 3 = d.pos // (3 * w.p) group by d.k, w.lvl
  union all
  select d.k, 100 + w.lvl, coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos < s.place // w.p), ''), coalesce(string_agg(u.h, '' order by u.pos) filter (u.pos > s.place // w.p), '')
    from d join ranked s on d.source is not distinct from s.source, root join power w on w.lvl < root.height join top u on u.lvl = w.lvl and u.pos // 3 = s.place // (3 * w.p) group by d.k, w.lvl),
path as (select k, sha256(string_agg(l || r, '' order by lvl)) as proof, list({{'l': l, 'r': r, 'h': ''}} order by lvl) as steps from step group by k),
folded as (
  select d.doc_id, d.leaf, s.subroot, root.root, coalesce(p.proof, sha256('')) as proof_sha256,
    list_reduce(list_prepend({{'l': '', 'r': '', 'h': coalesce(d.tampered, d.leaf)}}, coalesce(p.steps, [])), lambda a, s: {{'l': '', 'r': '', 'h': sha256(s.l || a.h || s.r)}}).h as folded_root
  from d join ranked s on d.source is not distinct from s.source, root left join path p on p.k = d.k)
select *, folded_root = root as verified from folded
"""

ORACLE_SQL["op12_prefix_trie"] = rf"""
with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from conversations where conv_id is not null),
c as (select conv_id, {_CRC.format(x="conv_id")} % 6 as h, list({{'role': role, 'text': text}} order by pos) as own from o group by conv_id),
r as (select c.conv_id, list_concat(coalesce(m.own[1 : c.h], []), c.own[c.h + 1 :]) as t from c left join c m on m.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, len(t) as n, d as depth, t[1 : d] as seq from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from r)),
node as (select depth, seq, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth) as ends,
  (count(*) - 1) * case when depth = 0 then 0 else length(seq[depth].text) end as saved from p group by depth, seq),
kids as (select seq[1 : depth - 1] as seq, count(*) as n from node where depth > 0 group by 1),
whole as (select node.*, coalesce(kids.n, 0) as n_children from node left join kids on kids.seq = node.seq),
under as (select v.depth, v.seq, sum(w.saved) as saved, count(*) filter (w.n_children = 0) as leaves from whole w, unnest(range(0, w.depth + 1)) t(d) join whole v on v.depth = t.d and v.seq = w.seq[1 : t.d] group by v.depth, v.seq)
select w.conv_id, w.depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, u.leaves as n_leaves, u.saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from whole w join under u on u.depth = w.depth and u.seq = w.seq left join node q on w.depth > 0 and q.depth = w.depth - 1 and q.seq = w.seq[1 : w.depth - 1]
"""

ORACLE_SQL["op11_sign_hash_vectors"] = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select *, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach(x, y) as (select x, y from link union select r.x, l.y from reach r join link l on l.x = r.y),
class as (select x, min(y) as least from reach group by x),
n as (select x, count(*) as n from link group by x)
select v.vec_id, coalesce(n.n, 0) as n_links, least(v.vec_id, class.least) as component_id, v.vec_id = least(v.vec_id, class.least) as kept
from v left join n on n.x = v.vec_id left join class on class.x = v.vec_id
"""
