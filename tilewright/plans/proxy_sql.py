"""SQL twins of the stand-in tables, written independently of the DataFrame code."""

from __future__ import annotations

CTE: dict[str, str] = {}

CTE["tiles"] = """
select l_suppkey as slide_id,
       (l_orderkey*8 + l_linenumber)*1000000 + l_partkey as tile_id,
       (l_orderkey % 40)*400 as x_min, (l_partkey % 40)*400 as y_min,
       (l_orderkey % 40)*400 + 400 as x_max, (l_partkey % 40)*400 + 400 as y_max,
       (1::double - cast((l_orderkey*48271 + l_linenumber*7919 + l_partkey*69621) % 1000003 as double) / 1000003.0::double)
         * (1::double - 0.004::double * cast(l_suppkey % 5 as double)) as score
from lineitem"""

CTE["slides"] = """
select s_suppkey as slide_id,
       lpad(cast(s_suppkey as varchar), 5, '0') || ' P ' || cast(s_nationkey as varchar) || '.ndpi' as slide_name,
       cast(s_nationkey as bigint) as nation
from supplier"""

CTE["levels"] = """
select s_suppkey as slide_id, l as level,
       cast(floor((16000 + (s_suppkey % 7)*64) / pow(4, l)) as bigint) as w,
       cast(floor((12000 + (s_suppkey % 5)*64) / pow(4, l)) as bigint) as h,
       pow(4, l)::double as downsample
from supplier, range(4) t(l)
where l = 0 or s_suppkey % 10 <> 9"""

CTE["cont"] = """
select s_suppkey as slide_id, c.cont_idx, c.k, (s_suppkey % 100)*16 + c.x as x, (s_suppkey % 100)*16 + c.y as y
from supplier, (values
  (0,0,1000,1000),(0,1,3000,1000),(0,2,3000,2400),(0,3,1000,2400),
  (1,0,4000,1000),(1,1,7000,1000),(1,2,7000,2000),(1,3,5000,2000),(1,4,5000,4000),(1,5,4000,4000),
  (2,0,1000,5000),(2,1,4001,5000),(2,2,2500,8000)) c(cont_idx,k,x,y)"""

CTE["hole"] = """
select s_suppkey as slide_id, c.cont_idx, c.hole_idx, p.k,
       (s_suppkey % 100)*16 + c.x + p.a*c.w as x, (s_suppkey % 100)*16 + c.y + p.b*c.h as y
from supplier, (values (0,0,1500,1200,600,500),(1,0,4200,1100,300,200),(1,1,5200,1200,500,400),(1,2,4200,3000,50,40))
       c(cont_idx,hole_idx,x,y,w,h), (values (0,0,0),(1,1,0),(2,1,1),(3,0,1)) p(k,a,b)"""

CTE["edges"] = """
select slide_id, cont_idx, k, x as x1, y as y1,
       coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
from cont window w as (partition by slide_id, cont_idx order by k rows between unbounded preceding and unbounded following)"""

CTE["hole_edges"] = """
select slide_id, cont_idx, hole_idx, k, x as x1, y as y1,
       coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2
from hole window w as (partition by slide_id, cont_idx, hole_idx order by k rows between unbounded preceding and unbounded following)"""

CTE["truth"] = """
select s_suppkey as slide_id,
  case when s_suppkey % 11 = 3 then 'EQV' when s_suppkey % 13 = 5 then 'WT'
       when (s_suppkey % 5 in (0,1)) <> (s_suppkey % 7 = 0) then 'Y' else 'N' end as code
from supplier"""

CTE["labelled"] = """
select slide_id, case code when 'N' then 0 when 'EQV' then 0 when 'WT' then 1 when 'Y' then 1 end as label from truth"""

CTE["grid"] = """
select i as t_idx, case when i < 99 then 0.01::double * i else 0.99::double + 0.001::double * (i-99) end as threshold
from range(109) r(i)"""

CTE["swept"] = """
select s.slide_id, g.t_idx, g.threshold, count(*) filter (where t.score >= g.threshold) as positive_tiles
from (select distinct slide_id from tiles) s cross join grid g join tiles t on t.slide_id = s.slide_id
group by all"""

CTE["conf"] = """
select t_idx, threshold,
  count(*) filter (where positive_tiles >= 1 and label = 1) as tp, count(*) filter (where positive_tiles >= 1 and label = 0) as fp,
  count(*) filter (where positive_tiles = 0 and label = 1) as fn, count(*) filter (where positive_tiles = 0 and label = 0) as tn
from swept join labelled using (slide_id) group by all"""

CTE["rated"] = """
select *, case when tp+fn = 0 then 0 else tp::double/(tp+fn) end as sensitivity,
  case when tn+fp = 0 then 0 else tn::double/(tn+fp) end as specificity from conf"""

CTE["bin_scores"] = """
select doc_id, cast(n_chars as double) as score, quality as label from documents join labels using (doc_id)"""

CTE["train_log"] = """
select case when event_id % 4 = 0 then 'val' else 'train' end as split, cast(extract(day from ts) as bigint) as epoch,
  event_id as batch, value/100.0::double as loss, cast(event_id % 100 as double)/50.0::double as instance_loss,
  user_id % 3 as y, (user_id + case when event_id % 5 = 0 then 1 else 0 end) % 3 as y_hat
from events"""

CTE["logits"] = """
select vec_id, label, k,
  (select sum(cast(embedding[j+1] as double) * (((k*7 + j*3) % 11 - 5) / 10.0::double)) from range(64) r(j)) as z
from embeddings, range(10) c(k)"""

CTE["probs"] = """
select vec_id, label, k, exp(z - max_z) / sum(exp(z - max_z)) over v as p
from (select *, max(z) over (partition by vec_id) as max_z from logits)
window v as (partition by vec_id)"""

_SMALL = "s_suppkey % 10 = 9"
CTE["px_base"] = f"""
select s_suppkey as slide_id, r as row, c as col, (r*7919 + c*104729 + s_suppkey*48271) % 97 as h,
  (r-8)*(r-8) + (c-8-s_suppkey%5)*(c-8-s_suppkey%5) as d1, (r-15)*(r-15) + (c-20-s_suppkey%4)*(c-20-s_suppkey%4) as d2,
  s_suppkey % 10 = 9 as small
from supplier, range(24) a(r), range(32) b(c)"""

CTE["pixels"] = """
select slide_id, row, col,
  case when pen then [20,30,30,200][cast(slide_id % 4 + 1 as integer)] when tissue then 150 - h % 20 else 240 - h % 6 end::bigint as r,
  case when pen then [20,40,140,30][cast(slide_id % 4 + 1 as integer)] when tissue then 80 + h % 15 else 238 - h % 4 end::bigint as g,
  case when pen then [25,180,60,40][cast(slide_id % 4 + 1 as integer)] when tissue then 140 - h % 10 else 242 - h % 5 end::bigint as b
from (select *, col between 28 and 30 and row between 4 and 18 and slide_id % 3 = 0 as pen,
        (d1 <= (case when small then 2 else 25 end) and not d1 <= (case when small then -1 else 2 end))
        or d2 <= (case when small then 1 else 16 end) or h < 2 as tissue from px_base)"""

NEEDS = {
    "edges": ["cont"], "hole_edges": ["hole"], "labelled": ["truth"], "swept": ["tiles", "grid"],
    "conf": ["swept", "labelled"], "rated": ["conf"], "probs": ["logits"], "pixels": ["px_base"],
}


def sql(body: str, *ctes: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``body`` with the named stand-ins (and what they need) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        add(name)
    parts = [f"{name} as ({CTE[name].strip()})" for name in ordered]
    parts += [f"{name} as ({text.strip()})" for name, text in (extra or {}).items()]
    head = "with recursive " if recursive else "with "
    return (head + ",\n".join(parts) + "\n" if parts else "") + body.strip()
