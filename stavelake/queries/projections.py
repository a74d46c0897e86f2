"""Band geometry, profiles, candidate measurements and the whole probe scan."""

from pyspark.sql import functions as F

from ..fixtures import duck
from ..functions import geometry as g
from ..operators import projections as pr, raster
from ..session import materialize
from . import register
from .raster import DARK, IMG_H, IMG_W, R, R6, boxes, raster_bands

P = pr.DEFAULTS | dict(
    scan_pad_ratio=0.25, height_mode="median_box", height_scale=0.4, height_min=4, extend_scale=1.8, ink_threshold=DARK,
    min_distance=3, refine=2, scan_width=16, line_ratio=0.35, min_lines=2, fallback_pred=True, xpeak=True, window=6, xpeak_min=1.2,
    segment_height=3, ignore_peak=True, ignore_radius=0, x_tol=1, min_v_iou=0.2, divisi=True, divisi_tol=1, divisi_count=4, divisi_ratio=0.4,
    rightmost=True, right_tol=6, right_rows=2, right_ratio=0.8, gap=True, gap_threshold=1.2, gap_min=0.32, gap_margin=0.1)
LADDER = dict(
    min_ratio=0.36, use_peak_relative=True, peak_ratio_min=1.05, rel_rescue=True, rel_rescue_min=0.9, rel_rescue_xpeak_min=1.2,
    rel_rescue_overhang=0.42, ext_max=0.42, top_max=0.36, bottom_max=0.36, xpeak_rescue=True, xpeak_min=1.3, xpeak_overhang=0.6,
    segment_height=3, segment_pass=0.5)

AT = "page_id,band_idx,rank"
_XOK = "(coalesce(xpeak>=1.3,false) AND (scan_top IS NULL OR scan_top<=0.6) AND (scan_bottom IS NULL OR scan_bottom<=0.6) AND (seg_pass IS NULL OR seg_pass>=0.5))"
_VI = "greatest(0e0,least(A2,e.y2)-greatest(A1,e.y1))/greatest(1e0,greatest(1e0,A2-A1)+greatest(1e0,e.y2-e.y1)-greatest(0e0,least(A2,e.y2)-greatest(A1,e.y1)))"


def _there(alias: str, a: str, z: str) -> str:
    """Whether an existing box stands at the column of ``alias`` in its lines a to z."""
    vi = _VI.replace("A1", f"{alias}.{a}").replace("A2", f"{alias}.{z}")
    return (f"EXISTS (SELECT 1 FROM {{p_ex}} e WHERE e.page_id={alias}.page_id AND (e.y1+e.y2)/2e0 BETWEEN {alias}.{a} AND {alias}.{z} "
            f"AND abs((e.x1+e.x2)/2e0-{alias}.x)<=1 AND {vi}>=0.2)")


def _peaks(table: str, least: float, top: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, coalesce(lag(ratio) OVER w,last_value(ratio) OVER v) l,coalesce(lead(ratio) OVER w,first_value(ratio) OVER v) r FROM {{{table}}}
 WINDOW w AS (PARTITION BY page_id,band_idx ORDER BY x), v AS (PARTITION BY page_id,band_idx ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE ratio>={least} AND ratio>=l AND ratio>=r{top}"""


def _ratios(regions: str) -> str:
    """Stripe ratios of regions (page_id,band_idx,role,ya,yb), column by column."""
    return f"""SELECT page_id,band_idx,role,x,sum(k) OVER (PARTITION BY page_id,band_idx,role ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)/CAST(greatest(1,yb-ya+1)*4 AS DOUBLE) ratio
 FROM (SELECT r.page_id,r.band_idx,r.role,r.ya,r.yb,i.x,sum(i.k) k FROM {{{regions}}} r JOIN {{p_ink}} i ON i.page_id=r.page_id AND i.y BETWEEN r.ya AND r.yb GROUP BY ALL)"""


Q = {
    **R,
    "p_pg": "SELECT page_id,max(y)+1 h,max(len(px)) w FROM {f_raster} GROUP BY 1",
    "p_ex": f"SELECT *, CAST(((y1*64+x1)*64+x2)*64+y2 AS BIGINT) ord FROM {{rd_}} WHERE abs(y2-y1)>=CAST(trunc({IMG_H}*0.52) AS INT) AND abs(x2-x1)>=CAST(trunc({IMG_W}*0.08) AS INT)",
    "p_ink": f"SELECT page_id,y,x,CASE WHEN p<{DARK} THEN 1 ELSE 0 END k FROM {{r_long}}",
    "p_geo": """SELECT page_id,band_idx,y1,y2,s1,s2,b1,b2,CAST(greatest(0,round_even(mid-eh/2e0,0)) AS INT) e1,CAST(least(h-1,round_even(mid+eh/2e0,0)) AS INT) e2,h,w FROM (
 SELECT *, greatest(greatest(1,b2-b1+1),CAST(round_even(greatest(1,b2-b1+1)*1.8,0) AS INT)) eh FROM (
 SELECT page_id,band_idx,y1,y2,h,w,mid,CAST(greatest(0,y1-pad) AS INT) s1,CAST(least(h-1,y2+pad) AS INT) s2,CAST(greatest(0,mid-t//2) AS INT) b1,CAST(least(h-1,mid+t//2) AS INT) b2 FROM (
 SELECT *, CASE WHEN md<>0 THEN greatest(4,CAST(round_even(md*0.4,0) AS INT)) ELSE y2-y1+1 END t FROM (
 SELECT b.page_id,b.band_idx,b.b1 y1,b.b2 y2,g.h,g.w,CAST(round_even((b.b1+b.b2)/2e0,0) AS INT) mid,CAST(round_even((b.b2-b.b1+1)*0.25,0) AS INT) pad,
  CAST(trunc(coalesce((SELECT median(abs(e.y2-e.y1)) FROM {p_ex} e WHERE e.page_id=b.page_id AND (e.y1+e.y2)/2e0 BETWEEN b.b1 AND b.b2),
   (SELECT median(abs(e.y2-e.y1)) FROM {p_ex} e WHERE e.page_id=b.page_id),0)) AS INT) md
 FROM {r_band} b JOIN {p_pg} g USING (page_id)))))""",
    "p_reg": """SELECT page_id,band_idx,'band' role,b1 ya,b2 yb FROM {p_geo} UNION ALL SELECT page_id,band_idx,'ext',e1,e2 FROM {p_geo} UNION ALL
 SELECT page_id,band_idx,'top',e1,b1-1 FROM {p_geo} WHERE b1>e1 UNION ALL SELECT page_id,band_idx,'bottom',b2+1,e2 FROM {p_geo} WHERE e2>b2""",
    "p_rat": _ratios("p_reg"),
    "p_bsig": "SELECT * FROM {p_rat} WHERE role='band'",
    "p_pk": "SELECT *, row_number() OVER (PARTITION BY page_id,band_idx ORDER BY ratio DESC,x) rn FROM (" + _peaks("p_bsig", 0.32) + ")",
    "p_fold": """SELECT * FROM (WITH RECURSIVE f AS (SELECT page_id,band_idx,1::BIGINT rn,[x] kept FROM {p_pk} WHERE rn=1 UNION ALL
 SELECT f.page_id,f.band_idx,p.rn,CASE WHEN len(kept)>=8 OR len(list_filter(kept,lambda q: abs(q-p.x)<3))>0 THEN kept ELSE list_append(kept,p.x) END FROM f JOIN {p_pk} p ON p.page_id=f.page_id AND p.band_idx=f.band_idx AND p.rn=f.rn+1)
 SELECT page_id,band_idx,CAST(unnest(range(len(kept))) AS INT) rank,unnest(kept) seed_x FROM (SELECT *, row_number() OVER (PARTITION BY page_id,band_idx ORDER BY rn DESC) z FROM f) WHERE z=1)""",
    "p_cand": """SELECT page_id,band_idx,rank,seed_x,x,ratio FROM (SELECT f.page_id,f.band_idx,f.rank,f.seed_x,s.x,s.ratio,row_number() OVER (PARTITION BY f.page_id,f.band_idx,f.rank ORDER BY s.ratio DESC,s.x) z
 FROM {p_fold} f JOIN {p_bsig} s ON s.page_id=f.page_id AND s.band_idx=f.band_idx AND s.x BETWEEN f.seed_x-2 AND f.seed_x+2) WHERE z=1""",
    "p_row": """SELECT page_id,band_idx,sum(k)/CAST(count(*)*max(w) AS DOUBLE) row_mean,max(k)/CAST(max(w) AS DOUBLE) row_max,CAST(sum(CASE WHEN k/CAST(w AS DOUBLE)>=0.35 THEN 1 ELSE 0 END) AS BIGINT) row_lines,
 min_by(y,(-k)*100000+y) peak_row FROM (SELECT g.page_id,g.band_idx,g.w,i.y,sum(i.k) k FROM {p_geo} g JOIN {p_ink} i ON i.page_id=g.page_id AND i.y BETWEEN g.s1 AND g.s2 WHERE g.s2>g.s1 GROUP BY ALL) GROUP BY 1,2""",
    "p_strip": """SELECT c.page_id,c.band_idx,c.x,i.y,sum(i.k)/CAST(max(c.z-c.a+1) AS DOUBLE) ratio FROM (SELECT DISTINCT c.page_id,c.band_idx,c.x,g.s1,g.s2,greatest(0,c.x-8) a,least(g.w-1,c.x+8) z FROM {p_cand} c JOIN {p_geo} g USING (page_id,band_idx)) c
 JOIN {p_ink} i ON i.page_id=c.page_id AND i.y BETWEEN c.s1 AND c.s2 AND i.x BETWEEN c.a AND c.z GROUP BY ALL""",
    "p_tight": """SELECT * FROM (WITH h AS (SELECT *, sum(CASE WHEN d>1 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id,band_idx,x ORDER BY y) grp FROM (SELECT *, y-lag(y) OVER (PARTITION BY page_id,band_idx,x ORDER BY y) d FROM {p_strip} WHERE ratio>=0.35)),
 gr AS (SELECT page_id,band_idx,x,grp,min(y) a,max(y) z FROM h GROUP BY ALL), q AS (SELECT *, lead(z,1) OVER (PARTITION BY page_id,band_idx,x ORDER BY grp) last FROM gr),
 m AS (SELECT q.page_id,q.band_idx,q.x,q.grp,q.a,q.last,round(avg(r.ratio),9) mean FROM q JOIN {p_strip} r ON r.page_id=q.page_id AND r.band_idx=q.band_idx AND r.x=q.x AND r.y BETWEEN q.a AND q.last WHERE q.last IS NOT NULL GROUP BY ALL)
 SELECT page_id,band_idx,x,a AS top,last AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY page_id,band_idx,x ORDER BY last-a,mean DESC,grp) rn FROM m) WHERE rn=1)""",
    "p_pred": """SELECT page_id,band_idx,x,py1,py2 FROM (SELECT c.page_id,c.band_idx,c.x,e.y1 py1,e.y2 py2,row_number() OVER (PARTITION BY c.page_id,c.band_idx,c.x ORDER BY abs((e.x1+e.x2)/2e0-c.x),e.ord) z
 FROM (SELECT DISTINCT c.page_id,c.band_idx,c.x,g.y1,g.y2 FROM {p_cand} c JOIN {p_geo} g USING (page_id,band_idx)) c JOIN {p_ex} e ON e.page_id=c.page_id AND (e.y1+e.y2)/2e0 BETWEEN c.y1 AND c.y2) WHERE z=1""",
    "p_place": """SELECT *, CAST(greatest(0,round_even(mid2-xh/2e0,0)) AS INT) x_e1,CAST(least(h-1,round_even(mid2+xh/2e0,0)) AS INT) x_e2 FROM (
 SELECT *, CAST(least(h-1,peak_row+scan_h-1) AS INT) peak_y2,greatest(scan_h,CAST(round_even(scan_h*1.8,0) AS INT)) xh,round_even((scan_y1+scan_y2)/2e0,0) mid2 FROM (
 SELECT *, greatest(1,scan_y2-scan_y1+1) scan_h FROM (
 SELECT c.*,g.y1,g.y2,g.s1,g.s2,g.b1,g.b2,g.h,g.w,r.peak_row,coalesce(t.top,p.py1,g.b1) scan_y1,coalesce(t.bottom,p.py2,g.b2) scan_y2,
  CAST(greatest(0,round_even(c.x-2e0,0)) AS INT) sx1,CAST(least(g.w-1,round_even(c.x+2e0,0)) AS INT) sx2
 FROM {p_cand} c JOIN {p_geo} g USING (page_id,band_idx) LEFT JOIN {p_row} r USING (page_id,band_idx) LEFT JOIN {p_tight} t USING (page_id,band_idx,x) LEFT JOIN {p_pred} p USING (page_id,band_idx,x))))""",
    "p_st": """SELECT c.page_id,c.band_idx,c.rank,(i.y-c.scan_y1)//3 seg,o.d,sum(CASE WHEN i.y<>c.peak_row THEN i.k ELSE 0 END) k FROM {p_place} c, (SELECT unnest(range(-6,7)) d) o, {p_ink} i
 WHERE c.x+o.d BETWEEN 0 AND c.w-1 AND i.page_id=c.page_id AND i.y BETWEEN c.scan_y1 AND c.scan_y2 AND i.x BETWEEN c.x+o.d-2 AND c.x+o.d+1 GROUP BY ALL""",
    "p_seg": f"""SELECT {AT},seg,CASE WHEN md>0 THEN own/md END contrast FROM (SELECT {AT},seg,max(k) FILTER (d=0) own,median(k) FILTER (d<>0) md FROM {{p_st}} GROUP BY ALL)""",
    "p_xp": f"""SELECT {AT},CASE WHEN md>0 THEN own/md END xpeak FROM (SELECT {AT},max(k) FILTER (d=0) own,median(k) FILTER (d<>0) md FROM (SELECT {AT},d,sum(k) k FROM {{p_st}} GROUP BY ALL) GROUP BY ALL)""",
    "p_mea": f"""SELECT m.*,x.xpeak,s.seg_min,s.seg_pass FROM (SELECT {','.join('c.' + n for n in AT.split(','))},
  sum(k) FILTER (y BETWEEN scan_y1 AND scan_y2)/CAST(max(scan_h*(sx2-sx1+1)) AS DOUBLE) scan_ratio,
  CASE WHEN max(peak_row)<=max(peak_y2) THEN coalesce(sum(k) FILTER (y BETWEEN peak_row AND peak_y2),0)/CAST(max((peak_y2-peak_row+1)*(sx2-sx1+1)) AS DOUBLE) END scan_peak,
  sum(k) FILTER (y BETWEEN x_e1 AND x_e2)/CAST(max(greatest(1,x_e2-x_e1+1)*(sx2-sx1+1)) AS DOUBLE) scan_ext,
  CASE WHEN max(scan_y1-x_e1)>0 THEN sum(k) FILTER (y BETWEEN x_e1 AND scan_y1-1)/CAST(max((scan_y1-x_e1)*(sx2-sx1+1)) AS DOUBLE) END scan_top,
  CASE WHEN max(x_e2-scan_y2)>0 THEN sum(k) FILTER (y BETWEEN scan_y2+1 AND x_e2)/CAST(max((x_e2-scan_y2)*(sx2-sx1+1)) AS DOUBLE) END scan_bottom
 FROM {{p_place}} c JOIN {{p_ink}} i ON i.page_id=c.page_id AND i.x BETWEEN c.sx1 AND c.sx2 GROUP BY ALL) m
 LEFT JOIN {{p_xp}} x USING ({AT}) LEFT JOIN (SELECT {AT},min(contrast) seg_min,avg(CASE WHEN contrast>=1.2 THEN 1e0 WHEN contrast IS NOT NULL THEN 0e0 END) seg_pass FROM {{p_seg}} GROUP BY ALL) s USING ({AT})""",
    "p_dreg": "SELECT page_id,band_idx,'divisi' role,greatest(0,mid-4) ya,least(h-1,mid+4) yb FROM (SELECT *, CAST(round_even((y1+y2)/2e0,0) AS INT) mid FROM {p_geo})",
    "p_drat": _ratios("p_dreg"),
    "p_dpos": """SELECT page_id,band_idx,x,'box' kind FROM (SELECT e.page_id,g.band_idx,(e.x1+e.x2)/2e0 x,row_number() OVER (PARTITION BY e.page_id,e.ord ORDER BY NOT ((e.y1+e.y2)/2e0 BETWEEN g.y1 AND g.y2),
  CASE WHEN (e.y1+e.y2)/2e0 BETWEEN g.y1 AND g.y2 THEN 0e0 ELSE least(abs((e.y1+e.y2)/2e0-g.y1),abs((e.y1+e.y2)/2e0-g.y2)) END,g.band_idx) z FROM {p_ex} e JOIN {p_geo} g USING (page_id)) WHERE z=1
 UNION ALL SELECT page_id,band_idx,CAST(x AS DOUBLE),'ink' FROM (""" + _peaks("p_drat", 0.4) + ")",
    "p_dlink": """SELECT page_id,up FROM (SELECT b.page_id,b.band_idx up,count(*) m FROM (SELECT *, lead(y1) OVER (PARTITION BY page_id ORDER BY band_idx) n1,lead(band_idx) OVER (PARTITION BY page_id ORDER BY band_idx) low,avg(y2-y1+1) OVER (PARTITION BY page_id) ah FROM {p_geo}) b
  JOIN {p_dpos} a ON a.page_id=b.page_id AND a.band_idx=b.band_idx WHERE n1-y2<ah*1.2 AND EXISTS (SELECT 1 FROM {p_dpos} o WHERE o.page_id=b.page_id AND o.band_idx=b.low AND abs(o.x-a.x)<=1) GROUP BY ALL) WHERE m>=4""",
    "p_jud": f"""SELECT *, CASE WHEN coalesce(scan_ratio,ratio)<0.36 THEN 'scan_ratio_low'
 WHEN rel_ratio<1.05 AND rel_ratio>=0.9 AND xpeak>=1.2 AND (scan_top IS NULL OR scan_top<=0.42) AND (scan_bottom IS NULL OR scan_bottom<=0.42) THEN 'scan_ratio_rel_low_rescued_limited'
 WHEN rel_ratio<1.05 THEN 'scan_ratio_rel_low' WHEN scan_ext>=0.42 THEN 'extended_ratio_scan'
 WHEN scan_top>=0.36 AND NOT divisi_top AND NOT {_XOK} THEN 'extended_top_ratio_scan' WHEN scan_bottom>=0.36 AND NOT divisi_bottom AND NOT {_XOK} THEN 'extended_bottom_ratio_scan'
 WHEN ext>=0.42 THEN 'extended_ratio' WHEN ext_top>=0.36 THEN 'extended_top_ratio' WHEN ext_bottom>=0.36 THEN 'extended_bottom_ratio' WHEN existing THEN 'existing'
 WHEN scan_bottom>=0.36 THEN CASE WHEN divisi_bottom THEN 'accepted_bot_divisi' ELSE 'accepted_bot_xpeak' END
 WHEN scan_top>=0.36 THEN CASE WHEN divisi_top THEN 'accepted_top_divisi' ELSE 'accepted_top_xpeak' END ELSE 'accepted' END status FROM (
 SELECT c.*,m.scan_ratio,m.scan_peak,m.scan_ext,m.scan_top,m.scan_bottom,m.xpeak,m.seg_min,m.seg_pass,CASE WHEN m.scan_peak>0 THEN m.scan_ratio/greatest(m.scan_peak,1e-6) END rel_ratio,
  xe.ratio ext,xt.ratio ext_top,xb.ratio ext_bottom,EXISTS (SELECT 1 FROM {{p_dlink}} l WHERE l.page_id=c.page_id AND l.up=c.band_idx-1) divisi_top,EXISTS (SELECT 1 FROM {{p_dlink}} l WHERE l.page_id=c.page_id AND l.up=c.band_idx) divisi_bottom,
  {_there('c', 'y1', 'y2')} existing,{_there('c', 'b1', 'b2')} again
 FROM {{p_place}} c JOIN {{p_mea}} m USING ({AT}) LEFT JOIN {{p_rat}} xe ON xe.page_id=c.page_id AND xe.band_idx=c.band_idx AND xe.x=c.x AND xe.role='ext'
 LEFT JOIN {{p_rat}} xt ON xt.page_id=c.page_id AND xt.band_idx=c.band_idx AND xt.x=c.x AND xt.role='top' LEFT JOIN {{p_rat}} xb ON xb.page_id=c.page_id AND xb.band_idx=c.band_idx AND xb.x=c.x AND xb.role='bottom')""",
    "p_rec": "SELECT *, status LIKE 'accepted%' OR status='scan_ratio_rel_low_rescued_limited' acc,CAST(band_idx*1048576+rank AS BIGINT) rec FROM {p_jud}",
    "p_bad": "SELECT * FROM {p_rec} WHERE NOT acc AND status<>'existing'",
    "p_right": """SELECT * FROM (WITH ok AS (SELECT page_id,band_idx,x FROM {p_rec} WHERE status='accepted' UNION ALL SELECT page_id,band_idx,x FROM {p_rec} r WHERE acc AND NOT EXISTS (SELECT 1 FROM {p_rec} s WHERE s.page_id=r.page_id AND s.status='accepted')),
 e AS (SELECT page_id,band_idx,CAST(max(x) AS DOUBLE) x FROM ok GROUP BY ALL), t AS (SELECT page_id,median(x) target FROM (SELECT *, max(x) OVER (PARTITION BY page_id) mx FROM e) WHERE x>=mx*0.8 GROUP BY 1),
 nr AS (SELECT b.*,t.target FROM {p_bad} b JOIN t USING (page_id) WHERE abs(b.x-target)<=6),
 s AS (SELECT page_id,band_idx,CAST(x AS DOUBLE) nx FROM (SELECT *, row_number() OVER (PARTITION BY page_id,band_idx ORDER BY abs(x-target),rec) z FROM nr) WHERE z=1),
 q AS (SELECT page_id FROM e LEFT JOIN s USING (page_id,band_idx) JOIN t USING (page_id) WHERE abs(coalesce(nx,x)-target)<=6 GROUP BY 1 HAVING count(*)>=2)
 SELECT page_id,rec FROM (SELECT *, row_number() OVER (PARTITION BY page_id,x ORDER BY rec) z FROM nr JOIN q USING (page_id)
  WHERE NOT again AND status IN ('scan_ratio_low','scan_ratio_rel_low','extended_ratio_scan','extended_top_ratio_scan','extended_bottom_ratio_scan')) WHERE z=1)""",
    "p_gap": """SELECT * FROM (WITH x AS (SELECT page_id,band_idx,CAST(x AS DOUBLE) x FROM {p_rec} WHERE acc UNION SELECT page_id,band_idx,x FROM (SELECT e.page_id,min(g.band_idx) band_idx,(max(e.x1)+max(e.x2))/2e0 x FROM {p_ex} e JOIN {p_geo} g ON g.page_id=e.page_id AND (e.y1+e.y2)/2e0 BETWEEN g.y1 AND g.y2 GROUP BY e.page_id,e.ord)),
 gp AS (SELECT *, nx-x gap FROM (SELECT *, lead(x) OVER (PARTITION BY page_id,band_idx ORDER BY x) nx FROM x) WHERE nx IS NOT NULL), m AS (SELECT page_id,median(gap) md FROM gp GROUP BY 1),
 c AS (SELECT gp.page_id,gp.band_idx,gp.x gx,b.x col,b.rec,b.again,row_number() OVER (PARTITION BY gp.page_id,gp.band_idx,gp.x ORDER BY coalesce(b.scan_ratio,b.ratio) DESC,b.rec) z FROM gp JOIN m USING (page_id) JOIN {p_bad} b ON b.page_id=gp.page_id AND b.band_idx=gp.band_idx
  WHERE gap>=md*1.2 AND b.status IN ('scan_ratio_low','scan_ratio_rel_low') AND coalesce(b.scan_ratio,b.ratio)>=0.32 AND b.x>gp.x+gap*0.1 AND b.x<gp.nx-gap*0.1)
 SELECT page_id,rec FROM (SELECT *, row_number() OVER (PARTITION BY page_id,band_idx,col ORDER BY gx) z2 FROM c WHERE z=1 AND NOT again) WHERE z2=1)""",
}


class Scan:
    """The inputs of a scan, shared by the queries."""

    def __init__(self, c):
        F_ = F.col
        self.rows = c.raster()
        self.bands = raster_bands(c).select("page_id", "band_idx", F_("b1").alias("y1"), F_("b2").alias("y2"))
        box = boxes(c).select("page_id", *g.BOX).distinct()
        big = raster.minimum_size(box, F.lit(IMG_W), F.lit(IMG_H), h_ratio=0.52, w_ratio=0.08)
        self.existing = big.withColumn("ord", (((F_("y1") * 64 + F_("x1")) * 64 + F_("x2")) * 64 + F_("y2")).cast("bigint"))
        self.pages = pr.page_sizes(self.rows)
        self.geometry = pr.band_geometry(self.bands, self.existing, self.pages, P)
        self.dark = pr.integral_rows(self.rows, threshold=DARK, sums="d")
        self.domains = self.geometry.select("page_id", "band_idx", F.lit(0).alias("d1"), (F_("w") - 1).alias("d2"))

    def placed(self):
        prof = materialize(pr.band_profiles(self.geometry, self.domains, self.rows, P), "profiles")
        cands = pr.selected_columns(prof.where("role = 'band'"), P, min_ratio=0.32)
        return prof, materialize(pr.placed_candidates(cands, self.geometry, self.existing, self.dark, P), "candidates")


@register("band_projections", duck("""
SELECT page_id,band_idx,y1,y2,s1,s2,b1,b2,e1,e2,row_mean,row_max,row_lines,peak_row,best_x,round(best,6) AS best FROM {p_geo} JOIN {p_row} USING (page_id,band_idx)
JOIN (SELECT page_id,band_idx,min_by(x,CAST(-ratio*100000 AS BIGINT)*1000+x) best_x,max(ratio) best FROM {p_bsig} GROUP BY 1,2) USING (page_id,band_idx)""", Q))
def _(c):
    s = Scan(c)
    prof = pr.band_profiles(s.geometry, s.domains, s.rows, P).where("role = 'band'")
    best = prof.select("page_id", "band_idx", F.array_max("ratios").alias("best"), (F.array_position("ratios", F.array_max("ratios")) - 1).cast("int").alias("best_x"))
    return s.geometry.drop("h", "w").join(pr.row_profile(s.geometry, s.dark, P), ["page_id", "band_idx"]).join(
        best.withColumn("best", R6(F.col("best"))), ["page_id", "band_idx"])


@register("band_profiles", duck("SELECT page_id,band_idx,role,x,ratio FROM {p_rat}", Q))
def _(c):
    s = Scan(c)
    return pr.band_profiles(s.geometry, s.domains, s.rows, P).select("page_id", "band_idx", "role", F.posexplode("ratios").alias("x", "ratio"))


@register("candidate_measurements", duck(f"""
SELECT {AT},seed_x,x,ratio,scan_y1,scan_y2,x_e1,x_e2,sx1,sx2,peak_row,scan_ratio,scan_peak,scan_ext,scan_top,scan_bottom,xpeak,seg_min,seg_pass FROM {{p_place}} JOIN {{p_mea}} USING ({AT})""", Q))
def _(c):
    s = Scan(c)
    _, placed = s.placed()
    at = AT.split(",")
    return placed.select(*at, "seed_x", "x", "ratio", "scan_y1", "scan_y2", "x_e1", "x_e2", "sx1", "sx2", "peak_row").join(
        pr.measure(placed, s.dark, P), at)


@register("x_peak_segments", duck(f"SELECT {AT},CAST(seg AS INT) AS segment,contrast FROM {{p_seg}}", Q))
def _(c):
    s = Scan(c)
    _, placed = s.placed()
    return pr.segment_contrast(pr.scan_segments(placed, s.dark, P), P).select(*AT.split(","), "segment", "contrast")


@register("divisi_positions", duck("SELECT page_id,band_idx,x,kind FROM {p_dpos}", Q))
def _(c):
    s = Scan(c)
    return pr.divisi_positions(s.bands, s.existing, s.pages, s.domains, s.rows, P)


@register("scan_acceptance", duck(f"SELECT {AT},x,rel_ratio,ext,ext_top,ext_bottom,divisi_top,divisi_bottom,existing,status FROM {{p_jud}}", Q))
def _(c):
    s = Scan(c)
    prof, placed = s.placed()
    d = pr.judged(placed.select(*AT.split(","), "x", "ratio", "y1", "y2"), s.existing, s.bands, s.pages, s.domains, s.rows, prof,
                  pr.measure(placed, s.dark, P), P, LADDER)
    return d.select(*AT.split(","), "x", "rel_ratio", "ext", "ext_top", "ext_bottom", "divisi_top", "divisi_bottom", "existing", "status")


@register("probe_scan", duck(f"""
SELECT {AT},seed_x,x,ratio,scan_ratio,status,concat_ws(',',CASE WHEN g.rec IS NOT NULL THEN 'gap' END,CASE WHEN t.rec IS NOT NULL THEN 'rightmost' END) AS rescue,
 acc OR g.rec IS NOT NULL OR t.rec IS NOT NULL AS found,sx1 AS x1,b1 AS y1,sx2 AS x2,b2 AS y2 FROM {{p_rec}} r LEFT JOIN {{p_gap}} g USING (page_id,rec) LEFT JOIN {{p_right}} t USING (page_id,rec)""", Q))
def _(c):
    s = Scan(c)
    return pr.probe_scan(s.bands, s.existing, s.rows, P, LADDER)
