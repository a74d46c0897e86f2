"""Staves and bars to numbered measures: every step of the flagship chain."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..operators import corrections as cor
from ..operators import islands, joins, numbering
from ..plans import score
from ..session import materialize
from ..sources import documents
from . import register

PG = "score_id,page_index"
ON = "a.score_id=b.score_id AND a.page_index=b.page_index"

# DuckDB re-statement of the chain with plain joins and a recursive greedy pass.
LAY = {
    "o_pos": f"SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY y1,staff_index)-1 pos FROM {{f_staff}}",
    "o_bar": f"SELECT {PG},x1,y1,x2,y2,count(*) n FROM {{f_barline}} GROUP BY ALL",
    "o_sb": f"""SELECT * FROM (SELECT a.score_id,a.page_index,b.pos,a.x1,a.y1,a.x2,a.y2,a.n,
      least(a.y2,b.y2)-greatest(a.y1,b.y1) ov, b.y2-b.y1 sh, b.unit_size u
      FROM {{o_bar}} a JOIN {{o_pos}} b ON {ON}) WHERE ov>0 AND (ov>sh*0.2 OR ov>u*0.4)""",
    "o_pair": f"""SELECT a.score_id,a.page_index,a.pos,CAST(sum(a.n*b.n) AS BIGINT) n_pairs FROM {{o_sb}} a JOIN {{o_sb}} b
      ON {ON} AND b.pos=a.pos-1 AND abs((a.x1+a.x2)/2e0-(b.x1+b.x2)/2e0)<=4 GROUP BY ALL""",
    "o_feat": f"""SELECT s.*, coalesce(p.n_pairs,0) np, c.present,
      coalesce(nb.n,0)=0 free, avg(y2-y1) OVER (PARTITION BY s.score_id,s.page_index) ah,
      s.y1-lag(s.y2) OVER (PARTITION BY s.score_id,s.page_index ORDER BY s.pos) gap,
      lag(coalesce(nb.n,0)=0) OVER (PARTITION BY s.score_id,s.page_index ORDER BY s.pos) pfree
      FROM {{o_pos}} s LEFT JOIN {{o_pair}} p USING (score_id,page_index,pos)
      LEFT JOIN (SELECT {PG},pos,sum(n) n FROM {{o_sb}} GROUP BY ALL) nb USING (score_id,page_index,pos)
      LEFT JOIN (SELECT {PG},staff_index pos,present FROM {{f_connector}}) c USING (score_id,page_index,pos)""",
    "o_link": """SELECT *, CASE WHEN gap IS NULL THEN 'none'
      WHEN NOT (gap<=ah*1.5 OR (coalesce(present,false) AND gap<=ah*1.56)) THEN 'none'
      WHEN present IS NOT NULL AND NOT present THEN 'none'
      WHEN gap<=ah*1.5 AND coalesce(present,false) AND (free OR pfree) THEN 'deferred'
      WHEN (gap<=ah*1.5 AND np>=2) OR (coalesce(present,false) AND gap<=ah*1.56 AND np>=3) THEN 'hard'
      ELSE 'none' END link FROM {o_feat}""",
    "o_chain": f"""SELECT *, count(*) OVER (PARTITION BY {PG},chain) chain_size FROM (
      SELECT *, sum(CASE WHEN link='none' THEN 1 ELSE 0 END) OVER (PARTITION BY {PG} ORDER BY pos) chain FROM {{o_link}})""",
    "o_sys": f"""SELECT *, CAST(sum(CASE WHEN link='hard' OR (link='deferred' AND chain_size>=3) THEN 0 ELSE 1 END)
      OVER (PARTITION BY {PG} ORDER BY pos)-1 AS INT) sr FROM {{o_chain}}""",
    "o_systab": f"""SELECT {PG},sr,count(*) ns,quantile_cont(unit_size,0.5) u,min(x1) sx1,min(y1) sy1,max(y2) sy2,
      avg(y2-y1) ah FROM {{o_sys}} GROUP BY ALL""",
    "o_sysbar": f"""SELECT a.score_id,a.page_index,b.sr,a.pos,a.x1,a.y1,a.x2,a.y2,a.ov>=a.u*4 fs
      FROM {{o_sb}} a JOIN {{o_sys}} b ON {ON} AND a.pos=b.pos""",
    "o_dbar": f"""SELECT {PG},sr,x1,y1,x2,y2,bool_or(fs) fs FROM {{o_sysbar}} GROUP BY ALL""",
    "o_supp": f"""SELECT a.*, t.ns, t.u, t.ns<3 OR a.fs OR (SELECT count(DISTINCT b.pos) FROM {{o_sysbar}} b WHERE {ON} AND a.sr=b.sr
        AND abs((a.x1+a.x2)/2e0-(b.x1+b.x2)/2e0)<t.u*1.2)>=2 ok
      FROM {{o_dbar}} a JOIN {{o_systab}} t USING (score_id,page_index,sr)""",
    "o_rank": f"""SELECT {PG},sr,x1,x2,y1,y2,u,row_number() OVER (PARTITION BY {PG},sr ORDER BY x1,x1-x2,y1,y2,x2) rn
      FROM {{o_supp}} WHERE ok""",
    "o_next": f"""SELECT a.score_id,a.page_index,a.sr,a.rn,min(b.rn) nx FROM {{o_rank}} a LEFT JOIN {{o_rank}} b
      ON {ON} AND a.sr=b.sr AND b.x1>=a.x1+a.u*1.2 GROUP BY ALL""",
    "o_walk": f"""SELECT {PG},sr,rn,nx FROM {{o_next}} WHERE rn=1 UNION ALL
      SELECT b.score_id,b.page_index,b.sr,b.rn,b.nx FROM o_walk a JOIN {{o_next}} b ON {ON} AND a.sr=b.sr AND a.nx=b.rn""",
    "o_kept": f"""SELECT k.* FROM {{o_rank}} k JOIN {{o_walk}} USING (score_id,page_index,sr,rn)""",
    "o_bars": f"""SELECT {PG},sr,x1,x2,y1,y2,false gh FROM {{o_kept}} UNION ALL
      SELECT t.score_id,t.page_index,t.sr,t.sx1,t.sx1+1,t.sy1,t.sy2,true FROM {{o_systab}} t JOIN
       (SELECT {PG},sr,min(x1) fx FROM {{o_kept}} GROUP BY ALL) f USING (score_id,page_index,sr) WHERE f.fx-t.sx1>4*t.u""",
    "o_iv0": f"""SELECT * FROM (SELECT {PG},sr,gh,row_number() OVER w -1 i, x2 a, lead(x1) OVER w b,
       first_value(gh) OVER w g0 FROM {{o_bars}} WINDOW w AS (PARTITION BY {PG},sr ORDER BY x1,NOT gh)) WHERE b IS NOT NULL""",
    "o_iv1": f"""SELECT v.*, t.sy1, t.sy2, t.ah, row_number() OVER (PARTITION BY {PG},v.sr ORDER BY i) wn
      FROM {{o_iv0}} v JOIN {{o_systab}} t USING (score_id,page_index,sr) WHERE b-a>=t.u""",
    "o_iv": f"""SELECT *, i=0 AND g0 AND coalesce(b-a<0.5*md AND b-a<1.2*ah,false) narrow FROM (
      SELECT *, quantile_cont(CASE WHEN NOT g0 OR wn>1 THEN CAST(b-a AS DOUBLE) END,0.5) OVER (PARTITION BY {PG},sr) md FROM {{o_iv1}})""",
    "o_cidx": f"""SELECT {PG},sr,CAST(dense_rank() OVER (PARTITION BY {PG} ORDER BY sr)-1 AS INT) system FROM
      (SELECT DISTINCT {PG},sr FROM {{o_iv}} WHERE NOT narrow)""",
    "o_int": f"""SELECT v.score_id,v.page_index,v.sr,c.system,CAST(v.i AS INT) AS interval_,v.a x1,v.sy1 y1,v.b x2,v.sy2 y2,v.narrow
      FROM {{o_iv}} v JOIN {{o_cidx}} c USING (score_id,page_index,sr)""",
    "o_base": f"""SELECT *, CAST(row_number() OVER (PARTITION BY {PG},system ORDER BY interval_)-1 AS INT) measure
      FROM {{o_int}} WHERE NOT narrow""",
    # corrections log → one override per key
    "o_ovlog": f"""SELECT {PG},system,measure,ord,op,set_number,force_measure,
      CASE kind WHEN 'auto' THEN 0 WHEN 'measure_construction' THEN 1 ELSE 2 END stage,
      CASE WHEN op='set_measure_span' THEN skip-1 WHEN op='suppress' THEN NULL ELSE skip END skip
      FROM {{f_override}} WHERE NOT (op='set_measure_span' AND skip<1)""",
    "o_ov": f"""SELECT {PG},system,measure,skip,set_number,force_measure,stage FROM (SELECT *, row_number() OVER (
      PARTITION BY {PG},system,measure ORDER BY stage DESC,ord DESC) rn FROM {{o_ovlog}}) WHERE rn=1 AND op<>'suppress'""",
    "o_forced": f"""SELECT i.*, coalesce(f.force_measure,false) forced, f.skip fs, f.set_number fn FROM {{o_int}} i
      LEFT JOIN (SELECT * FROM {{o_ov}} WHERE force_measure) f ON i.score_id=f.score_id AND i.page_index=f.page_index
       AND i.system=f.system AND i.interval_=f.measure""",
    "o_vis": f"""SELECT *, CAST(row_number() OVER (PARTITION BY {PG},system ORDER BY interval_)-1 AS INT) measure
      FROM {{o_forced}} WHERE NOT narrow OR forced""",
    "o_mo": """SELECT v.*, CAST(coalesce(CASE WHEN v.forced THEN v.fs ELSE o.skip END,0) AS INT) skip,
       CASE WHEN v.forced THEN v.fn ELSE o.set_number END set_number
      FROM {o_vis} v LEFT JOIN {o_ov} o ON v.score_id=o.score_id AND v.page_index=o.page_index
       AND v.system=o.system AND v.measure=o.measure""",
    "o_anch": """SELECT m.*, coalesce(m.set_number, CASE WHEN m.measure=0 THEN b.reset_number END) anchor
      FROM {o_mo} m LEFT JOIN {f_boundary} b USING (score_id,page_index,system)""",
    "o_seg": """SELECT *, count(anchor) OVER (PARTITION BY score_id ORDER BY page_index,system,measure) seg FROM {o_anch}""",
    "o_num": """SELECT *, CAST(coalesce(max(anchor) FILTER (WHERE anchor IS NOT NULL) OVER (PARTITION BY score_id,seg),1)
       + coalesce(sum(1+skip) OVER (PARTITION BY score_id,seg ORDER BY page_index,system,measure
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) number FROM {o_seg}""",
}


def _pairs(c):
    pos = joins.staff_positions(c["f_staff"])
    return pos, joins.assign_bars(pos, joins.distinct_bars(c["f_barline"]))


def _extents(pairs):
    return materialize(joins.reduce_pairs(pairs), "extents")


def _connector(c):
    return c["f_connector"].withColumnRenamed("staff_index", "pos")


def _layout(c, stage=True, **kw):
    return score.layout(c["f_staff"], c["f_barline"], c["f_connector"], stage=stage, **kw)


def override_logs(c):
    o = c["f_override"]
    spans = cor.measure_span_ops(
        o.where("kind = 'mmr_measure_span'").withColumnRenamed("skip", "measure_span"))
    return (o.where("kind = 'auto'"), cor.force_measures(o.where("kind = 'measure_construction'")), spans)


def merged_overrides(c):
    return cor.merge(*override_logs(c))


@register("bar_staff_pairs", duck(f"SELECT {PG},pos::INT AS pos,x1,y1,x2,y2,n FROM {{o_sb}}", LAY))
def _(c):
    return _pairs(c)[1].select(*KEYS, "pos", "x1", "y1", "x2", "y2", "n")


@register("aligned_bar_pairs", duck(f"SELECT {PG},pos::INT AS pos,n_pairs FROM {{o_pair}}", LAY))
def _(c):
    pos, pairs = _pairs(c)
    return joins.aligned_pairs(pos, _extents(pairs)).where("n_pairs > 0").select(
        *KEYS, "pos", "n_pairs")


@register("systems_connector_aware", duck(f"""
SELECT {PG},pos::INT AS pos,link,chain_size,sr AS system_raw FROM {{o_sys}}""", LAY))
def _(c):
    pos, pairs = _pairs(c)
    return islands.build_systems(pos, _extents(pairs), _connector(c)).select(
        *KEYS, "pos", "link", "chain_size", "system_raw")


@register("systems_by_geometry", duck(f"""
SELECT {PG},pos::INT AS pos,CAST(sum(CASE WHEN gap IS NOT NULL AND ((gap<=ah*1.5 AND np>=2)
  OR (coalesce(present,false) AND gap<=ah*1.56 AND np>=3)) THEN 0 ELSE 1 END)
  OVER (PARTITION BY {PG} ORDER BY pos)-1 AS INT) AS system_raw FROM {{o_feat}}""", LAY))
def _(c):
    pos, pairs = _pairs(c)
    return islands.build_systems(pos, _extents(pairs), _connector(c),
                                 connector_aware=False).select(*KEYS, "pos", "system_raw")


_IDX = """SELECT *, CASE WHEN score_id%3=0 THEN NULL WHEN staff_index%4=3 THEN -1 ELSE CAST(floor((7-staff_index)/2) AS INT)%3 END system_index FROM {f_staff}"""


@register("systems_by_explicit_index", duck(f"""
SELECT * FROM (WITH g AS (SELECT {PG},pos,CAST(sum(CASE WHEN gap IS NOT NULL AND gap<=ah*1.5 AND np>=2 THEN 0 ELSE 1 END) OVER (PARTITION BY {PG} ORDER BY pos)-1 AS INT) sg FROM {{o_feat}}),
 i AS (SELECT *, max(CASE WHEN system_index>=0 THEN 1 ELSE 0 END) OVER (PARTITION BY {PG}) has_any, coalesce(CASE WHEN system_index>=0 THEN system_index END,-1-pos) grp FROM (
  SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY y1,staff_index)-1 pos FROM {{idx_}})),
 f AS (SELECT *, min(pos) OVER (PARTITION BY {PG},grp) fp FROM i)
SELECT {PG},CAST(f.pos AS INT) AS pos,CASE WHEN has_any=1 THEN CAST(dense_rank() OVER (PARTITION BY {PG} ORDER BY fp)-1 AS INT) ELSE sg END AS system_raw
FROM f JOIN g USING (score_id,page_index,pos))""", {**LAY, "idx_": _IDX}))
def _(c):
    """Pages without any index fall back to geometry (here without connector evidence)."""
    pos = joins.staff_positions(c.sql(_IDX))
    pairs = joins.assign_bars(pos, joins.distinct_bars(c["f_barline"]))
    return islands.build_systems(pos, _extents(pairs), explicit=True).select(
        *KEYS, "pos", "system_raw")


@register("connector_chain_sizes", duck(f"""
SELECT {PG},CAST(min(pos) AS INT) AS first_pos,count(*) AS chain_size FROM {{o_chain}} GROUP BY {PG},chain
HAVING count(*)>1""", LAY))
def _(c):
    pos, pairs = _pairs(c)
    s = islands.build_systems(pos, _extents(pairs), _connector(c))
    return s.where("link <> 'none' OR chain_size > 1").groupBy(
        *KEYS, "chain_size", (F.col("pos") - F.lit(0)).alias("pos")).agg(F.first("link").alias("link")).where(
        "link = 'none' AND chain_size > 1").select(*KEYS, F.col("pos").alias("first_pos"), "chain_size")


@register("multistaff_bar_support", duck(f"""
SELECT {PG},sr AS system_raw,x1,x2,bool_or(ok) AS ok FROM {{o_supp}} WHERE ns>=3 GROUP BY ALL""", LAY))
def _(c):
    lay = _layout(c)
    b = numbering.supported_bars(lay.staff, lay.extents).where("n_staves >= 3")
    return b.select(*KEYS, "system_raw", F.explode("bars").alias("b")).select(
        *KEYS, "system_raw", "b.x1", "b.x2", "b.ok").groupBy(*KEYS, "system_raw", "x1", "x2").agg(
        F.bool_or("ok").alias("ok"))


@register("kept_system_bars", duck(f"SELECT {PG},sr AS system_raw,x1,x2,y1,y2 FROM {{o_kept}}", LAY))
def _(c):
    lay = _layout(c)
    k = numbering.kept_bars(numbering.supported_bars(lay.staff, lay.extents))
    return k.select(*KEYS, "system_raw", F.explode("bars").alias("b")).select(
        *KEYS, "system_raw", "b.x1", "b.x2", "b.y1", "b.y2")


@register("implicit_system_starts", duck(f"""
SELECT {PG},sr AS system_raw,x1,x2,y1,y2 FROM {{o_bars}} WHERE gh""", LAY))
def _(c):
    return _layout(c).systems.where(F.coalesce(F.get("bars", 0)["is_ghost"], F.lit(False))).select(
        *KEYS, "system_raw", F.get("bars", 0).alias("b")).select(
        *KEYS, "system_raw", "b.x1", "b.x2", "b.y1", "b.y2")


@register("measure_intervals", duck(f"""
SELECT {PG},sr AS system_raw,system,interval_ AS interval,x1,y1,x2,y2,narrow FROM {{o_int}}""", LAY))
def _(c):
    return _layout(c).intervals


@register("base_measures", duck(f"""
SELECT {PG},system,measure,x1,y1,x2,y2 FROM {{o_base}}""", LAY))
def _(c):
    return numbering.base_measures(_layout(c).intervals).select(
        *KEYS, "system", "measure", "x1", "y1", "x2", "y2")


@register("forced_measures", duck(f"""
SELECT {PG},system,measure,interval_ AS interval,forced,skip,set_number FROM {{o_mo}}""", LAY))
def _(c):
    return numbering.apply_overrides(_layout(c).intervals, merged_overrides(c)).select(
        *KEYS, "system", "measure", "interval", "forced", "skip", "set_number")


def numbered(c, overrides=True, boundaries=True):
    return score.number_corpus(
        c["f_staff"], c["f_barline"], c["f_connector"],
        merged_overrides(c) if overrides else None, c["f_boundary"] if boundaries else None)


@register("measure_numbering", duck(f"""
SELECT {PG},system,measure,x1,y1,x2,y2,skip,number FROM {{o_num}}""", LAY))
def _(c):
    """Flagship: layout, corrections and boundaries to numbered measures."""
    return numbered(c).select(*KEYS, "system", "measure", "x1", "y1", "x2", "y2", "skip", "number")


_BASE = {**LAY, "o_mo": "SELECT *, 0 skip, CAST(NULL AS INT) set_number FROM {o_base}"}


@register("measure_numbers_with_resets", duck(f"""
SELECT {PG},system,measure,number FROM {{o_num}}""", _BASE))
def _(c):
    return numbered(c, overrides=False).select(*KEYS, "system", "measure", "number")


@register("page_carry_over", duck(f"""
SELECT {PG}, CAST(coalesce(lag(nx IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY page_index),1) AS BIGINT) AS start_number,
 CAST(coalesce(last_value(nx IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY page_index),1) AS BIGINT) AS next_number
FROM (SELECT p.score_id,p.page_index,n.nx FROM {{f_page}} p LEFT JOIN
 (SELECT {PG},arg_max(number+1+skip,system*10000+measure) nx FROM {{o_num}} GROUP BY ALL) n USING (score_id,page_index))""",
    {**LAY, "o_int": LAY["o_int"] + " WHERE NOT EXISTS (SELECT 1 FROM {f_evidence} e WHERE e.state='no_boundary' AND e.score_id=v.score_id AND e.page_index=v.page_index)"}))
def _(c):
    """Pages on the exclusion list carry the running number over."""
    excluded = c["f_evidence"].where("state = 'no_boundary'")
    iv = joins.exclude_pages(_layout(c).intervals, excluded)
    m = materialize(numbering.apply_overrides(iv, merged_overrides(c)), "measures")
    return numbering.page_numbers(m, c["f_page"], c["f_boundary"], block=4)


@register("unknown_boundaries", duck(f"""
SELECT {PG},system FROM {{f_review}} b WHERE NOT EXISTS (SELECT 1 FROM {{o_cidx}} a WHERE {ON} AND a.system=b.system)""", LAY))
def _(c):
    return numbering.unknown_boundaries(c["f_review"], _layout(c).intervals)


@register("row_labels", duck(f"""
WITH rows_ AS (SELECT {PG},system,arg_min(number,measure) number,min(x1) mx1,min(y1) my1,max(x2) mx2,max(y2) my2 FROM {{o_num}} GROUP BY ALL),
st AS (SELECT s.score_id,s.page_index,c.system,min(x1) a1,min(y1) a2,max(x2) a3,max(y2) a4,arg_min(y2-y1,pos) th
 FROM {{o_sys}} s JOIN {{o_cidx}} c USING (score_id,page_index,sr) GROUP BY ALL),
j AS (SELECT r.score_id,r.page_index,r.system,r.number,least(mx1,a1) x1,least(my1,a2) y1,greatest(mx2,a3) x2,greatest(my2,a4) y2,a2 ty,greatest(1,th) th FROM rows_ r JOIN st USING (score_id,page_index,system)),
f AS (SELECT *, greatest(18,least(96,CAST(round_even(quantile_cont(CAST(th AS DOUBLE),0.5) OVER (PARTITION BY {PG})*0.28,0) AS INT))) font FROM j),
g AS (SELECT *, greatest(6,CAST(floor(font/6) AS INT),CAST(trunc((y2-y1)*0.035) AS INT)) gap, length(CAST(number AS VARCHAR))*CAST(floor(font/2) AS INT) tw FROM f)
SELECT {PG},system,number,font AS font_size,CAST(greatest(2,least(1300-tw-2,x1-gap-tw)) AS INT) AS x,
 CAST(CASE WHEN ty-font-gap<=2 THEN greatest(2,ty+gap) ELSE ty-font-gap END AS INT) AS y,
 CASE WHEN ty-font-gap<=2 THEN 'inside_left_fallback' ELSE 'primary_left_gutter' END AS placement FROM g""".replace("WITH rows_", "SELECT * FROM (WITH rows_", 1) + ")", LAY))
def _(c):
    lay = _layout(c)
    m = numbering.number_measures(
        materialize(numbering.apply_overrides(lay.intervals, merged_overrides(c)), "measures"),
        c["f_boundary"])
    return documents.row_labels(m, lay.staff, lay.systems, page_width=1300)


_BBOX = """concat('"bbox":[',CAST(x1 AS INT),',',CAST(y1 AS INT),',',CAST(x2 AS INT),',',CAST(y2 AS INT),']}')"""


@register("numbering_documents", duck(f"""
SELECT * FROM (WITH st AS (SELECT {PG},sr,string_agg(concat('{{',{_BBOX}),',' ORDER BY pos) s FROM {{o_sys}} GROUP BY ALL),
 ms AS (SELECT {PG},sr,string_agg(concat('{{"number":',number,',',{_BBOX}),',' ORDER BY measure) m FROM {{o_num}} GROUP BY ALL),
 one AS (SELECT st.score_id,st.page_index,st.sr,m IS NULL e,CASE WHEN m IS NULL THEN concat('{{"staves":[',s,'],"reason":"no_measures"}}') ELSE concat('{{"staves":[',s,'],"measures":[',m,']}}') END d
  FROM st LEFT JOIN ms USING (score_id,page_index,sr)),
 n AS (SELECT {PG},string_agg(d,',' ORDER BY sr) FILTER (WHERE NOT e) f,string_agg(d,',' ORDER BY sr) FILTER (WHERE e) e FROM one GROUP BY ALL)
SELECT p.score_id,p.page_index,concat('{{"pages":[{{"page_number":',p.page_index+1,',"width":',width,',"height":',height,',"systems":[',coalesce(f,''),'],"empty_systems":[',coalesce(e,''),']}}]}}') AS document
FROM {{f_page}} p LEFT JOIN n USING (score_id,page_index))""", LAY))
def _(c):
    """Nested numbering document per page, as JSON text."""
    lay = _layout(c)
    m = numbering.number_measures(
        materialize(numbering.apply_overrides(lay.intervals, merged_overrides(c)), "measures"),
        c["f_boundary"])
    return documents.page_documents(m, lay.staff, lay.systems, c["f_page"])


@register("numbering_document_shape", duck(f"""
SELECT p.score_id,p.page_index,CAST(coalesce(n.ns,0) AS INT) AS n_systems,CAST(coalesce(n.nm,0) AS INT) AS n_measures,
 CAST(coalesce(e.ne,0) AS INT) AS n_empty, n.first_number FROM {{f_page}} p
LEFT JOIN (SELECT {PG},count(DISTINCT system) ns,count(*) nm,arg_min(number,system*10000+measure) first_number FROM {{o_num}} GROUP BY ALL) n USING (score_id,page_index)
LEFT JOIN (SELECT {PG},count(*) ne FROM (SELECT {PG},sr FROM {{o_systab}} EXCEPT SELECT {PG},sr FROM {{o_cidx}}) GROUP BY ALL) e USING (score_id,page_index)""", LAY))
def _(c):
    """Written documents read back and unnested."""
    lay = _layout(c)
    m = numbering.number_measures(
        materialize(numbering.apply_overrides(lay.intervals, merged_overrides(c)), "measures"),
        c["f_boundary"])
    docs = documents.page_documents(m, lay.staff, lay.systems, c["f_page"])
    return documents.document_shape(docs)


@register("score_next_numbers", duck("""
SELECT score_id, count(*) AS n_pages, arg_max(next_number,page_index) AS next_number FROM (
SELECT p.score_id,p.page_index,CAST(coalesce(last_value(nx IGNORE NULLS) OVER (PARTITION BY p.score_id ORDER BY p.page_index),1) AS BIGINT) next_number
FROM {f_page} p LEFT JOIN (SELECT score_id,page_index,arg_max(number+1+skip,system*10000+measure) nx FROM {o_num} GROUP BY ALL) n USING (score_id,page_index))
GROUP BY score_id""", LAY))
def _(c):
    lay = _layout(c)
    m = materialize(numbering.apply_overrides(lay.intervals, merged_overrides(c)), "measures")
    return documents.score_summary(numbering.page_numbers(m, c["f_page"], c["f_boundary"]))
