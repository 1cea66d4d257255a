"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quadrille.llm.decontaminate import op10_decontaminate
from quadrille.llm.embedding_dedup import op5_embedding_links
from quadrille.llm.fill_in_middle import op13_fill_in_middle
from quadrille.llm.jaccard import op3_jaccard_join
from quadrille.llm.language_id import op1_language
from quadrille.llm.language_model import op2_score
from quadrille.llm.line_dedup import op12_line_dedup
from quadrille.llm.mixing import op9_mix
from quadrille.llm.resampling import op11_resample
from quadrille.llm.sharding import op6_shard
from quadrille.llm.token_counts import op4_token_counts
from quadrille.llm.token_files import op7_token_files
from quadrille.llm.warc import op8_warc

QUERIES = {
    "op1_language": op1_language,
    "op2_score": op2_score,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_counts": op4_token_counts,
    "op5_embedding_links": op5_embedding_links,
    "op6_shard": op6_shard,
    "op7_token_files": op7_token_files,
    "op8_warc": op8_warc,
    "op9_mix": op9_mix,
    "op10_decontaminate": op10_decontaminate,
    "op11_resample": op11_resample,
    "op12_line_dedup": op12_line_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE_SQL = {
    "op3_jaccard_join": f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, {_WORDS}), []) as w from documents),
s as (
  select distinct doc_id, array_to_string(g, ' ') as g from (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) when len(w) > 0 then [w] else [] end) as g from d)
), n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
reach(node, root) as (select doc_id, doc_id from documents union select l.b, r.root from reach r join l on l.a = r.node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(root) from reach r where r.node = d.doc_id) as component_id
from d left join n on n.doc_id = d.doc_id
""",
    "op5_embedding_links": """
with recursive e as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), p as (select vec_id, label, v, list_max(list_transform(v, lambda x: abs(x))) as largest from e),
s as (select vec_id, label, list_transform(v, lambda x: x / largest) as v from p where largest > 0),
u as (select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from s),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach(node, root) as (select vec_id, vec_id from embeddings union select l.b, r.root from reach r join l on l.a = r.node),
least as (select node, min(root) as component_id from reach group by node),
n as (select a, count(*) as n_links from l group by a)
select x.vec_id, coalesce(n_links, 0) as n_links, component_id, x.vec_id = component_id as kept
from embeddings x left join n on n.a = x.vec_id left join least on least.node = x.vec_id
""",
    "op8_warc": """
with p as (select page_id, coalesce(html, '') as html from pages), q as (select page_id, cast(strlen(html) as bigint) as n, sha1(html) as d from p),
k as (select d, max(page_id) as kept from q where n >= 1000 group by d)
select q.page_id, q.n as payload_bytes, q.d as payload_digest,
  case when k.kept is null or q.page_id = k.kept then 'response' else 'revisit' end as record_type,
  case when q.page_id <> k.kept then k.kept end as refers_to
from q left join k on q.n >= 1000 and q.d = k.d
""",
    "op10_decontaminate": f"""
with recursive bench as (
  select cast(item_id as varchar) as item, regexp_extract_all({_LOWER.format("text")}, {_ALNUM}) as w from benchmark where text is not null and item_id is not null
), grams as (
  select distinct item, len(win) as k, array_to_string(win, ' ') as gram from (
    select item, unnest(case when len(w) >= 10 then list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) when len(w) > 0 then [w] else [] end) as win from bench)
), doc as (
  select doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, {_ALNUM}), []) as w from documents
), sizes as (select distinct k from grams),
places as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as gram from (
    select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from doc, sizes where len(w) >= k)
), hits as (select p.doc_id, p.k, p.i, g.item from places p join grams g on p.k = g.k and p.gram = g.gram),
marked as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from (select distinct doc_id, k, i from hits)) group by doc_id),
listed as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc d left join marked m on m.doc_id = d.doc_id left join listed l on l.doc_id = d.doc_id
""",
    "op12_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos from d),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as name from l),
bad as (select name from k where length(name) >= 1 group by name having count(distinct doc_id) >= 10),
j as (select k.*, bad.name is not null as gone from k left join bad on bad.name = k.name)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
""",
    "op13_fill_in_middle": """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
h as (select doc_id, t, cast(length(t) as bigint) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h
), o as (
  select *, case form when 'plain' then t
    when 'psm' then '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    else '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) end as output from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(output) as output_sha256, sha256(t) as restored_sha256
from o
""",
}
