"""Consensus, nearest, band and overlap joins between detector tables."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..functions import geometry as g
from ..operators import joins, numbering
from . import register
from .layout import LAY, ON, PG, _layout
from .sqltext import expand_cols, iou

EXP = {
    "d_exp": f"SELECT *, {expand_cols('e_')} FROM {{f_detection}}",
    # bands of a page: the staves themselves
    "d_band": f"SELECT {PG},CAST(staff_index AS INT) band_idx,y1 b1,y2 b2 FROM {{f_staff}}",
    # candidate columns per band
    "d_col": f"SELECT {PG},band_idx,rec_id,col,CAST(100+band_idx*80+CAST(floor((band_idx+1)/3) AS INT)*100 AS INT) b1,CAST(140+band_idx*80+CAST(floor((band_idx+1)/3) AS INT)*100 AS INT) b2 FROM {{f_scan_record}}",
}


def bands(c):
    return c["f_staff"].select(*KEYS, F.col("staff_index").alias("band_idx"),
                               F.col("y1").alias("b1"), F.col("y2").alias("b2"))


def columns(c):
    return c.sql(EXP["d_col"])


def detections(c, source):
    return c["f_detection"].where(F.col("source") == source)


@register("detector_consensus", duck(f"""
SELECT a.score_id,a.page_index,a.det_id,a.x1,a.y1,a.x2,a.y2 FROM (SELECT *, {expand_cols('e_')} FROM {{f_barline}}) a
WHERE EXISTS (SELECT 1 FROM {{d_exp}} b WHERE {ON} AND b.source<>'baseline' AND {iou('a.e_', 'b.e_')}>0.5)""", EXP))
def _(c):
    return joins.consensus(detections(c, "baseline"), detections(c, "sr"), detections(c, "omr")).select(
        *KEYS, "det_id", *g.BOX)


@register("nearest_existing_bar", duck(f"""
SELECT * FROM (WITH e AS (SELECT b.score_id,b.page_index,n.band_idx,(b.x1+b.x2)/2e0 ex,b.det_id,b.y1,b.y2 FROM {{f_barline}} b JOIN {{d_band}} n
  ON b.score_id=n.score_id AND b.page_index=n.page_index AND (b.y1+b.y2)/2e0 BETWEEN n.b1 AND n.b2),
 q AS (SELECT DISTINCT {PG},band_idx,CAST(col AS DOUBLE) col FROM {{d_col}})
SELECT score_id,page_index,band_idx,col,abs(ex-col) AS dx,y1 AS pred_y1,y2 AS pred_y2 FROM (
 SELECT q.*,e.ex,e.y1,e.y2,row_number() OVER (PARTITION BY q.score_id,q.page_index,q.band_idx,q.col ORDER BY abs(e.ex-q.col),e.det_id) rn
 FROM q JOIN e ON q.score_id=e.score_id AND q.page_index=e.page_index AND q.band_idx=e.band_idx) WHERE rn=1)""", EXP))
def _(c):
    return joins.nearest_existing(columns(c), c["f_barline"].withColumnRenamed("det_id", "ord"), bands(c))


@register("suppressed_by_existing", duck(f"""
SELECT score_id,page_index,band_idx,rec_id,col FROM {{d_col}} a WHERE NOT EXISTS (SELECT 1 FROM {{f_barline}} b WHERE {ON}
 AND (b.y1+b.y2)/2e0 BETWEEN a.b1 AND a.b2 AND abs((b.x1+b.x2)/2e0-a.col)<=6
 AND greatest(0e0,least(a.b2,b.y2)-greatest(a.b1,b.y1))/greatest(1e0,greatest(1e0,a.b2-a.b1)+greatest(1e0,b.y2-b.y1)-greatest(0e0,least(a.b2,b.y2)-greatest(a.b1,b.y1)))>=0.4)""", EXP))
def _(c):
    return joins.suppress_existing(columns(c), c["f_barline"], x_tol=6, min_v_iou=0.4).select(
        *KEYS, "band_idx", "rec_id", "col")


_DBL = f"""SELECT {PG},det_id,x1,y1,x2,y2 FROM {{f_barline}} UNION ALL
 SELECT {PG},det_id,x2+CAST(det_id%5 AS INT)*2,y1+CAST(det_id%9 AS INT)*2,x2+CAST(det_id%5 AS INT)*2+3,y2 FROM {{f_barline}}"""
@register("double_bars", duck(f"""
SELECT * FROM (WITH dd AS (SELECT DISTINCT {PG},x1,y1,x2,y2 FROM {{dbl_}} WHERE x2-x1<=6 AND y2-y1>=18),
 p AS (SELECT a.score_id,a.page_index,a.x1 ax1,a.y1 ay1,a.x2 ax2,a.y2 ay2,b.x1 bx1,b.y1 by1,b.x2 bx2,b.y2 by2 FROM dd a JOIN dd b
 ON {ON} AND b.x1>a.x2 AND b.x1<=a.x2+6 AND least(a.y2,b.y2)>greatest(a.y1,b.y1)
 AND (least(a.y2,b.y2)-greatest(a.y1,b.y1))/CAST(greatest(a.y2-a.y1,b.y2-b.y1) AS DOUBLE)>=0.75)
SELECT {PG},ax1 AS x1,ay1 AS y1,ax2 AS x2,ay2 AS y2 FROM p UNION SELECT {PG},bx1,by1,bx2,by2 FROM p)""", {"dbl_": _DBL}))
def _(c):
    return joins.double_bars(c.sql(_DBL))


@register("runs_not_near_existing", duck(f"""
SELECT * FROM (WITH dd AS (SELECT DISTINCT {PG},x1,y1,x2,y2 FROM {{dbl_}} WHERE x2-x1<=6 AND y2-y1>=18),
 p AS (SELECT a.score_id,a.page_index,a.x1 ax1,a.y1 ay1,a.x2 ax2,a.y2 ay2,b.x1 bx1,b.y1 by1,b.x2 bx2,b.y2 by2 FROM dd a JOIN dd b
 ON {ON} AND b.x1>a.x2 AND b.x1<=a.x2+6 AND least(a.y2,b.y2)>greatest(a.y1,b.y1)
 AND (least(a.y2,b.y2)-greatest(a.y1,b.y1))/CAST(greatest(a.y2-a.y1,b.y2-b.y1) AS DOUBLE)>=0.75),
 dbl AS (SELECT {PG},ax1 x1,ay1 y1,ax2 x2,ay2 y2 FROM p UNION SELECT {PG},bx1,by1,bx2,by2 FROM p)
SELECT a.score_id,a.page_index,a.det_id,a.x1,a.y1,a.x2,a.y2 FROM {{dbl_}} a WHERE
 EXISTS (SELECT 1 FROM dbl b WHERE {ON} AND a.x1=b.x1 AND a.y1=b.y1 AND a.x2=b.x2 AND a.y2=b.y2)
 OR NOT EXISTS (SELECT 1 FROM {{d_exp}} b WHERE {ON} AND b.source='omr' AND abs((a.x1+a.x2)/2e0-(b.x1+b.x2)/2e0)<=4 AND abs((a.y1+a.y2)/2e0-(b.y1+b.y2)/2e0)<=8))""",
    {**EXP, "dbl_": _DBL}))
def _(c):
    runs = c.sql(_DBL)
    return joins.skip_near(runs, detections(c, "omr"), joins.double_bars(runs))


# staves of the page as it is now: each twice, some moved too far to be taken for the same
_SUP = f"""SELECT {PG},x1+2 x1,y1+CASE WHEN (score_id+staff_index)%4=0 THEN 24 ELSE 6 END y1,x2-1 x2,y2+CASE WHEN (score_id+staff_index)%4=0 THEN 27 ELSE 9 END y2 FROM {{f_staff}} 
 UNION ALL SELECT {PG},x1-1,y1-CASE WHEN (score_id+staff_index)%3=0 THEN 8 ELSE 26 END,x2,y2-CASE WHEN (score_id+staff_index)%3=0 THEN 12 ELSE 30 END FROM {{f_staff}}"""


@register("mapped_staves", duck(f"""
SELECT * FROM (WITH b AS (SELECT s.score_id,s.page_index,c.system,s.staff_index,s.x1,s.y1,s.x2,s.y2 FROM {{o_sys}} s JOIN {{o_cidx}} c USING (score_id,page_index,sr)),
 h AS (SELECT b.*,a.x1 mx1,a.y1 my1,a.x2 mx2,a.y2 my2 FROM b LEFT JOIN {{sup_}} a ON {ON} AND least(a.y2,b.y2)>greatest(a.y1,b.y1)
  AND abs((a.y1+a.y2)/2e0-(b.y1+b.y2)/2e0)/greatest(1,a.y2-a.y1,b.y2-b.y1)<=0.5)
SELECT {PG},system,staff_index,x1,y1,x2,y2,coalesce(min(mx1),x1) AS m_x1,coalesce(min(my1),y1) AS m_y1,coalesce(max(mx2),x2) AS m_x2,coalesce(max(my2),y2) AS m_y2,
 count(mx1) AS candidate_count, CASE count(mx1) WHEN 0 THEN 'phase_a_fallback' WHEN 1 THEN 'single_current_staff' ELSE 'union_current_staff' END AS mode
FROM h GROUP BY {PG},system,staff_index,x1,y1,x2,y2)""", {**LAY, "sup_": _SUP}))
def _(c):
    lay = _layout(c)
    idx = lay.systems.where("system IS NOT NULL").select(*KEYS, "system_raw", "system")
    base = lay.staff.join(idx, [*KEYS, "system_raw"]).select(*KEYS, "system", "staff_index", *g.BOX)
    return joins.map_staves(base, c.sql(_SUP))


# an older numbering: the same measures with some right edges moved
_OLD = f"""SELECT {PG},system,measure,CASE WHEN (measure+system)%7=3 THEN x1-60 ELSE x1 END x1,y1,
 CASE WHEN (measure+page_index)%6=2 THEN x2+45 ELSE x2 END x2,y2 FROM {{m}} WHERE (score_id+system+measure)%23<>5"""


def base_measures(c):
    return numbering.base_measures(_layout(c).intervals).select(*KEYS, "system", "measure", *g.BOX)


def old_measures(c, new):
    from ..session import materialize

    m = materialize(new, "measures")
    return m, c.spark.sql(_OLD, m=m)


@register("remapped_measures", duck(f"""
SELECT * FROM (WITH o AS ({_OLD.replace('{m}', '{o_base}')}),
 q AS (SELECT DISTINCT {PG},system,measure FROM {{f_override}}),
 sc AS (SELECT q.score_id,q.page_index,q.system,q.measure,n.measure nm,
  greatest(0,least(o.x2,n.x2)-greatest(o.x1,n.x1))*greatest(0,least(o.y2,n.y2)-greatest(o.y1,n.y1))
  /CAST(least(greatest(1,(o.x2-o.x1)*(o.y2-o.y1)),greatest(1,(n.x2-n.x1)*(n.y2-n.y1))) AS DOUBLE) s
  FROM q JOIN o USING (score_id,page_index,system,measure) JOIN {{o_base}} n ON q.score_id=n.score_id AND q.page_index=n.page_index AND q.system=n.system),
 r AS (SELECT *, row_number() OVER (PARTITION BY {PG},system,measure ORDER BY s DESC,nm DESC) rn, lead(s) OVER (PARTITION BY {PG},system,measure ORDER BY s DESC,nm DESC) s2 FROM sc WHERE s>0)
SELECT q.score_id,q.page_index,q.system,q.measure, CASE WHEN NOT coalesce(r.s2>=0.8 AND r.s2>=r.s*0.95,false) THEN r.nm END AS remapped,
 CASE WHEN o.x1 IS NULL THEN 'source_measure_missing' WHEN NOT EXISTS (SELECT 1 FROM {{o_base}} n WHERE q.score_id=n.score_id AND q.page_index=n.page_index AND q.system=n.system) THEN 'system_missing'
  WHEN r.nm IS NULL THEN 'no_overlap' WHEN coalesce(r.s2>=0.8 AND r.s2>=r.s*0.95,false) THEN 'ambiguous' END AS reason
FROM q LEFT JOIN o USING (score_id,page_index,system,measure) LEFT JOIN (SELECT * FROM r WHERE rn=1) r USING (score_id,page_index,system,measure))""", LAY))
def _(c):
    new, old = old_measures(c, base_measures(c))
    return joins.remap_measures(c["f_override"], old, new)


@register("bar_neighborhood", duck(f"""
SELECT * FROM (WITH p AS (SELECT b.score_id,b.page_index,b.ord,m.system,m.measure,
 CASE WHEN (b.x1+b.x2)/2e0 BETWEEN m.x1 AND m.x2 THEN 0e0 ELSE least(abs((b.x1+b.x2)/2e0-m.x1),abs((b.x1+b.x2)/2e0-m.x2)) END d
 FROM {{f_bar_override}} b JOIN {{o_base}} m ON b.score_id=m.score_id AND b.page_index=m.page_index AND least(b.y2,m.y2)>greatest(b.y1,m.y1)),
 n AS (SELECT *, min(d) OVER (PARTITION BY {PG},ord,system) md FROM p),
 z AS (SELECT {PG},system,max(measure) last FROM {{o_base}} GROUP BY ALL)
SELECT DISTINCT n.score_id,n.page_index,n.system,CAST(unnest(range(greatest(0,n.measure-1),least(z.last,n.measure+1)+1)) AS INT) AS measure
FROM n JOIN z USING (score_id,page_index,system) WHERE abs(d-md)<1e-6)""", LAY))
def _(c):
    return joins.bar_neighborhood(base_measures(c), c["f_bar_override"], radius=1)


@register("last_override_per_measure", duck(f"""
SELECT {PG},system,measure,max(ord) AS ord,arg_max(skip,ord) AS skip,arg_max(kind,ord) AS kind FROM {{f_override}} GROUP BY ALL"""))
def _(c):
    return joins.last_wins(
        c["f_override"].select(*KEYS, "system", "measure", "ord", "skip", "kind"),
        [*KEYS, "system", "measure"])


@register("bars_assigned_to_bands", duck(f"""
SELECT det_id,band_idx FROM (SELECT a.det_id,b.band_idx,row_number() OVER (PARTITION BY a.rid ORDER BY
 CASE WHEN (a.y1+a.y2)/2e0+a.det_id%90-45 BETWEEN b.b1 AND b.b2 THEN 0 ELSE 1 END,
 CASE WHEN (a.y1+a.y2)/2e0+a.det_id%90-45 BETWEEN b.b1 AND b.b2 THEN 0e0 ELSE least(abs((a.y1+a.y2)/2e0+a.det_id%90-45-b.b1),abs((a.y1+a.y2)/2e0+a.det_id%90-45-b.b2)) END, b.band_idx) rn
 FROM (SELECT *, row_number() OVER () rid FROM {{f_barline}}) a JOIN {{d_band}} b ON {ON}) WHERE rn=1""", EXP))
def _(c):
    shift = (F.col("det_id") % 90 - 45).cast("int")
    b = c["f_barline"].withColumns({"y1": F.col("y1") + shift, "y2": F.col("y2") + shift})
    return joins.assign_to_bands(b, bands(c)).select("det_id", "band_idx")


@register("pages_not_excluded", duck(f"""
SELECT a.score_id,a.page_index,a.n_staves FROM {{f_page}} a WHERE NOT EXISTS (SELECT 1 FROM {{f_evidence}} b WHERE {ON} AND b.state='no_boundary')"""))
def _(c):
    return joins.exclude_pages(c["f_page"], c["f_evidence"].where("state = 'no_boundary'")).select(
        *KEYS, "n_staves")


# one page of each score is expected to go
_XP = "SELECT score_id,CAST(greatest(1,max(page_index)) AS BIGINT) expected FROM {f_page} GROUP BY 1"


@register("page_count_violations", duck(f"""
SELECT x.score_id,x.expected,coalesce(n,0) AS found FROM {{xp_}} x LEFT JOIN (SELECT score_id,count(*) n FROM {{f_page}} a
 WHERE NOT EXISTS (SELECT 1 FROM {{f_evidence}} b WHERE {ON} AND b.state='no_boundary') GROUP BY 1) USING (score_id) WHERE coalesce(n,0)<>expected""", {"xp_": _XP}))
def _(c):
    return joins.page_count_violations(c["f_page"], c["f_evidence"].where("state = 'no_boundary'"), c.sql(_XP))


_TALL = f"""SELECT {PG},det_id,x1,y1-CASE WHEN det_id%4=0 THEN 85 ELSE 5 END y1,x2,y2+CASE WHEN det_id%8=1 THEN 190 ELSE 3 END y2 FROM {{f_barline}}"""


@register("staff_strokes", duck(f"""
SELECT * FROM (WITH h AS (SELECT a.det_id,a.score_id,a.page_index,a.x1,a.x2,a.y1,a.y2,b.pos,b.y1 s1,b.y2 s2 FROM {{tall_}} a JOIN {{o_pos}} b ON {ON}
 AND least(a.y2,b.y2)-greatest(a.y1,b.y1)>=20), n AS (SELECT det_id,count(*) n FROM h GROUP BY 1)
SELECT h.det_id,CAST(h.pos AS INT) AS staff,h.x1,greatest(h.y1,h.s1) AS y1,h.x2,least(h.y2,h.s2) AS y2 FROM h JOIN n USING (det_id) WHERE n>=2
UNION ALL SELECT a.det_id,-1,a.x1,a.y1,a.x2,a.y2 FROM {{tall_}} a LEFT JOIN n USING (det_id) WHERE coalesce(n,0)<2)""", {**LAY, "tall_": _TALL}))
def _(c):
    return joins.staff_strokes(c.sql(_TALL), joins.staff_positions(c["f_staff"]), box_id="det_id").select(
        "det_id", "staff", *g.BOX)


@register("staff_overlap_filter", duck(f"""
SELECT a.det_id FROM {{tall_}} a WHERE NOT EXISTS (SELECT 1 FROM {{d_band}} b WHERE {ON}) OR
 (SELECT max(greatest(0,least(a.y2,b.b2)-greatest(a.y1,b.b1))/CAST(greatest(1,a.y2-a.y1) AS DOUBLE)) FROM {{d_band}} b WHERE {ON})>=0.5""",
    {**EXP, "tall_": _TALL}))
def _(c):
    return joins.staff_overlap_filter(c.sql(_TALL), bands(c)).select("det_id")


@register("aligned_measure_views", duck(f"""
SELECT {PG},system,measure,CASE WHEN (score_id+measure)%19<>3 THEN x1+4 END AS x1_primary,CASE WHEN (score_id+system)%17<>2 THEN x1 END AS x1_alternate,x1 AS x1_fallback,
 CASE WHEN (score_id+measure)%19=3 OR (score_id+system)%17=2 THEN 'topology_mismatch' END AS violation FROM {{o_base}}""", LAY))
def _(c):
    from ..session import materialize

    m = materialize(base_measures(c), "measures")
    return joins.zip_views({
        "primary": m.where("(score_id + measure) % 19 <> 3").withColumn("x1", F.col("x1") + 4),
        "alternate": m.where("(score_id + system) % 17 <> 2"), "fallback": m})


@register("divisi_links", duck(f"""
SELECT * FROM (WITH b AS (SELECT *, avg(b2-b1+1) OVER (PARTITION BY {PG}) ah, lead(b1) OVER (PARTITION BY {PG} ORDER BY band_idx) nb,
  lead(band_idx) OVER (PARTITION BY {PG} ORDER BY band_idx) ni FROM {{d_band}}),
 x AS (SELECT {PG},CAST(staff_index AS INT) band_idx,(x1+x2)/2e0 x FROM {{f_barline}} JOIN (SELECT {PG},staff_index,y1 sy FROM {{f_staff}}) USING (score_id,page_index) WHERE y1 BETWEEN sy AND sy+2),
 m AS (SELECT b.score_id,b.page_index,b.band_idx up,b.ni low FROM b JOIN x a ON {ON} AND a.band_idx=b.band_idx WHERE b.nb-b.b2<b.ah*1.2
  AND EXISTS (SELECT 1 FROM x z WHERE z.score_id=a.score_id AND z.page_index=a.page_index AND z.band_idx=b.ni AND abs(z.x-a.x)<=4) GROUP BY ALL HAVING count(*)>=2)
SELECT d.score_id,d.page_index,d.band_idx,EXISTS (SELECT 1 FROM m WHERE m.score_id=d.score_id AND m.page_index=d.page_index AND m.low=d.band_idx) AS has_top,
 EXISTS (SELECT 1 FROM m WHERE m.score_id=d.score_id AND m.page_index=d.page_index AND m.up=d.band_idx) AS has_bottom FROM {{d_band}} d)""", EXP))
def _(c):
    s = c["f_staff"].select(*KEYS, "staff_index", F.col("y1").alias("sy"))
    x = c["f_barline"].join(s, list(KEYS)).where("y1 BETWEEN sy AND sy + 2").select(
        *KEYS, F.col("staff_index").alias("band_idx"), g.center_x(g.box()).alias("x"))
    return joins.divisi_links(bands(c), x)


@register("connector_evidence_last", duck(f"""
SELECT {PG},staff_index,arg_max(present,seq) AS present FROM {{dup_}} GROUP BY ALL""", {"dup_": (
    f"SELECT {PG},staff_index,present,0 seq FROM {{f_connector}} UNION ALL SELECT {PG},staff_index,NOT present,1 FROM {{f_connector}} WHERE (score_id+staff_index)%5=0")}))
def _(c):
    """Duplicate evidence for one staff pair: the last record counts."""
    e = c.sql(f"SELECT {PG},staff_index,present,0 seq FROM {{f_connector}} UNION ALL "
              f"SELECT {PG},staff_index,NOT present,1 FROM {{f_connector}} WHERE (score_id+staff_index)%5=0")
    return joins.last_wins(e, [*KEYS, "staff_index"], "seq").select(*KEYS, "staff_index", "present")
