"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import divergence, interactions, language_model, licenses, media, mixing, nearcopies, neighbours, pieces, quality, suffixes, topk, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_mixing": mixing.op2_mixing,
    "op3_language_model": language_model.op3_language_model,
    "op4_pieces": pieces.op4_pieces,
    "op5_near_copies": nearcopies.op5_near_copies,
    "op6_media": media.op6_media,
    "op7_quality": quality.op7_quality,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_suffixes": suffixes.op9_suffixes,
    "op10_neighbours": neighbours.op10_neighbours,
    "op11_interactions": interactions.op11_interactions,
    "op12_divergence": divergence.op12_divergence,
    "op13_top_k": topk.op13_top_k,
}

ORACLE_SQL: dict[str, str] = {
    "op5_near_copies": r"""with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
),
s as (select doc_id, unnest(case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a as u, b as v from l union all select b, a from l),
r(u, v) as (select doc_id, doc_id from documents union select r.u, e.v from r join e on e.u = r.v)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.v) as component_id, d.doc_id = min(r.v) as kept
from (select distinct doc_id from documents) d join r on r.u = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id""",
    "op11_interactions": interactions.SQL,
    "op12_divergence": divergence.SQL,
    "op13_top_k": topk.SQL,
}
