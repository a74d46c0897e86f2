"""Raster statistics, probe scans, candidate filters and rescues."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..functions import geometry as g
from ..operators import raster
from . import register
from .joins import EXP, bands
from .layout import PG

R6 = lambda c: F.round(c, 6)
DARK = 118
IMG_W, IMG_H = 64, 50

# small boxes on the raster pages
_RB = """SELECT CAST(l_suppkey%(SELECT greatest(1,CAST(floor(count(*)/50) AS BIGINT)) FROM {embeddings}) AS INT) page_id,CAST(l_partkey%58 AS INT) x1,CAST(l_orderkey%25 AS INT) y1,
 CAST(l_partkey%58+1+l_linenumber%5 AS INT) x2,CAST(l_orderkey%25+15+CAST(floor(l_quantity) AS INT)%12 AS INT) y2 FROM {lineitem}"""
BX = "page_id,x1,y1,x2,y2"
R = {
    "rb_": _RB,
    "rd_": f"SELECT DISTINCT {BX} FROM {{rb_}}",
    "rh_": f"SELECT b.page_id,b.x1,b.y1,b.x2,b.y2,r.y,r.px[b.x1+1:b.x2] v FROM {{rd_}} b JOIN {{f_raster}} r ON r.page_id=b.page_id AND r.y>=b.y1 AND r.y<b.y2",
    # staff-like mask: bright pixels on every fifth scan line
    "r_mask": "SELECT page_id,y,list_transform(px,lambda p: CASE WHEN y%5=0 AND p>110 THEN 255 ELSE 0 END) px FROM {f_raster}",
    # note-head-like mask: very bright pixels
    "r_head": "SELECT page_id,y,list_transform(px,lambda p: CASE WHEN p>160 THEN 1 ELSE 0 END) px FROM {f_raster}",
    # long form for column statistics
    "r_long": "SELECT page_id,y,CAST(unnest(range(64)) AS INT) x,unnest(px) p FROM {f_raster}",
    "r_band": "SELECT page_id,CAST(b AS INT) band_idx,CAST(b*10 AS INT) b1,CAST(b*10+7 AS INT) b2 FROM (SELECT DISTINCT page_id,unnest(range(5)) b FROM {f_raster})",
    "r_ink": f"SELECT b.page_id,b.band_idx,b.b1,b.b2,l.x,CAST(sum(CASE WHEN l.p<{DARK} THEN 1 ELSE 0 END) AS BIGINT) ink FROM {{r_band}} b JOIN {{r_long}} l ON l.page_id=b.page_id AND l.y BETWEEN b.b1 AND b.b2 GROUP BY ALL",
    "r_sig": "SELECT *, sum(ink) OVER (PARTITION BY page_id,band_idx ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)/32e0 ratio FROM {r_ink}",
}


def boxes(c):
    return c.sql(_RB)


def staff_mask(c):
    return c.raster().withColumn("px", F.transform("px", lambda p: F.when(
        (F.col("y") % 5 == 0) & (p > 110), 255).otherwise(0)))


def head_mask(c):
    return c.raster().withColumn("px", F.transform("px", lambda p: F.when(p > 160, 1).otherwise(0)))


def raster_bands(c):
    return c.raster().select("page_id").distinct().select(
        "page_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("band_idx")).select(
        "page_id", "band_idx", (F.col("band_idx") * 10).alias("b1"), (F.col("band_idx") * 10 + 7).alias("b2"))


def signal(c):
    return raster.stripe_ratio(raster.column_ink(raster_bands(c), c.raster(), threshold=DARK))


@register("rectangle_statistics", duck(f"""
SELECT {BX},CAST(sum(len(v)) AS BIGINT) AS n_px,CAST(sum(list_sum(v)) AS BIGINT) AS px_sum,CAST(sum(len(list_filter(v,lambda p: p<{DARK}))) AS BIGINT) AS n_dark,
 CAST(sum(len(list_filter(v,lambda p: p>0))) AS BIGINT) AS n_nonzero,round(sum(list_sum(v))/CAST(sum(len(v)) AS DOUBLE),6) AS mean,
 round(sqrt(greatest(0,(sum(len(v))*sum(list_sum(list_transform(v,lambda p: p*p)))-sum(list_sum(v))*sum(list_sum(v)))/CAST(sum(len(v))*sum(len(v)) AS DOUBLE))),6) AS std,
 round(sum(len(list_filter(v,lambda p: p<{DARK})))/CAST(sum(len(v)) AS DOUBLE),6) AS dark_ratio,round(sum(len(list_filter(v,lambda p: p>0)))/CAST(sum(len(v)) AS DOUBLE),6) AS nonzero_ratio
FROM {{rh_}} GROUP BY ALL""".replace("GROUP BY ALL", f"GROUP BY {BX}"), R))
def _(c):
    s = raster.rect_stats(boxes(c), c.raster(), threshold=DARK)
    return s.select("page_id", *g.BOX, "n_px", "px_sum", "n_dark", "n_nonzero",
                    *(R6(F.col(n)).alias(n) for n in ("mean", "std", "dark_ratio", "nonzero_ratio")))


@register("page_ink_statistics", duck(f"""
SELECT page_id,round(avg(CASE WHEN p<{DARK} THEN 1e0 ELSE 0e0 END),6) AS ink_ratio,round(stddev_pop(p),4) AS stddev,
 avg(CASE WHEN p<{DARK} THEN 1e0 ELSE 0e0 END)<=0.29 AND stddev_pop(p)<=17 AS blank FROM {{r_long}} GROUP BY 1""", R))
def _(c):
    s = raster.page_ink(c.raster(), threshold=DARK, max_ink=0.29, max_std=17)
    return s.select("page_id", R6(F.col("ink_ratio")).alias("ink_ratio"),
                    F.round("stddev", 4).alias("stddev"), "blank")


_PL = "SELECT DISTINCT CAST(p_size AS INT) page_id FROM {part}"


@register("staff_detection_failed", duck("""
SELECT p.page_id,round(n,6) AS nonzero_ratio,n<0.12 AS failed,CASE WHEN n IS NULL THEN 'missing' END AS reason FROM {pl_} p LEFT JOIN
 (SELECT page_id,sum(len(list_filter(px,lambda v: v>0)))/CAST(sum(len(px)) AS DOUBLE) n FROM {r_mask} GROUP BY 1) USING (page_id)""", {**R, "pl_": _PL}))
def _(c):
    return raster.staff_failed(c.sql(_PL), staff_mask(c), min_ratio=0.12).withColumn(
        "nonzero_ratio", R6(F.col("nonzero_ratio")))


_STAT = f"""SELECT {PG},n_staves,CASE WHEN page_index%4=0 THEN page_index%3=0 END blank_manual,CASE WHEN page_index%3<>1 THEN n_staves<8 END blank_auto,
 CASE WHEN score_id%9=0 THEN true END staff_manual,CASE WHEN page_index%7<>2 THEN n_staves<5 END staff_auto FROM {{f_page}}"""


@register("page_statuses", duck(f"""
SELECT {PG},page_index+1 IN (2,5) AS excluded_by_user,coalesce(CAST(blank_manual AS VARCHAR),CAST(blank_auto AS VARCHAR),'unknown') AS blank_page,
 coalesce(CAST(staff_manual AS VARCHAR),CAST(staff_auto AS VARCHAR),'unknown') AS staff_detect_failed FROM {{stat_}}""", {"stat_": _STAT}))
def _(c):
    return raster.page_status(c.sql(_STAT), excluded=(F.col("page_index") + 1).isin(2, 5)).select(
        *KEYS, "excluded_by_user", "blank_page", "staff_detect_failed")


@register("minimum_size_boxes", duck("""SELECT det_id FROM {f_barline} WHERE abs(y2-y1)>=CAST(trunc(1111*0.034) AS INT) AND abs(x2-x1)>=CAST(trunc(1300*0.005) AS INT)"""))
def _(c):
    return raster.minimum_size(c["f_barline"], F.lit(1300), F.lit(1111), h_ratio=0.034, w_ratio=0.005).select("det_id")


_CD = """SELECT det_id,x1-CAST(det_id%5 AS INT)*20 x1,y1,x2-CAST(det_id%5 AS INT)*20+CASE WHEN det_id%31=0 THEN 60 ELSE 0 END x2,y2-CASE WHEN det_id%11=0 THEN 25 ELSE 0 END y2,1300 img_w,1100 img_h,
 CAST(40 AS DOUBLE) median_h,10 p_x1,90 p_y1,1050 p_x2,900 p_y2,CASE WHEN det_id%2=0 THEN CAST(det_id%7 AS DOUBLE)/CAST(100 AS DOUBLE) END clef_ratio,
 CAST(det_id%100 AS DOUBLE)/CAST(99 AS DOUBLE) paper_ratio,CASE WHEN det_id%3<>0 THEN CAST(det_id%50 AS DOUBLE)/CAST(1000 AS DOUBLE) END staff_ratio,
 CAST(det_id%20 AS DOUBLE)/CAST(40 AS DOUBLE) ink_ratio FROM {f_barline}"""
_RS = """concat_ws(',',CASE WHEN abs(x2-x1)>CAST(trunc(1300*0.04) AS INT) THEN 'too_wide' END,CASE WHEN greatest(x1,x2)<=156 THEN 'left_margin_zone' END,
 CASE WHEN greatest(x1,x2)<=325 AND clef_ratio>0.01 THEN 'clef_mask_overlap' END,CASE WHEN abs(y2-y1)<24 THEN 'too_short_vs_existing_median' END,
 CASE WHEN NOT (CAST(round_even((x1+x2)/2e0,0) AS INT) BETWEEN p_x1 AND p_x2 AND CAST(round_even((y1+y2)/2e0,0) AS INT) BETWEEN p_y1 AND p_y2) THEN 'outside_page_region' END,
 PAPER CASE WHEN staff_ratio<0.01 THEN 'no_staff_overlap' END,CASE WHEN ink_ratio<0.18 THEN 'low_ink_ratio' END)"""
_RS1 = _RS.replace("PAPER", "CASE WHEN paper_ratio<0.6 THEN 'low_paper_overlap' END,")
_RS2 = _RS.replace("PAPER", "").replace("CASE WHEN abs(x2-x1)>CAST(trunc(1300*0.04) AS INT) THEN 'too_wide' END,", "")


@register("candidate_drop_reasons", duck(f"SELECT det_id,{_RS1} AS reasons,{_RS1}='' AS keep FROM {{cd_}}", {"cd_": _CD}))
def _(c):
    d = raster.candidate_drops(c.sql(_CD), max_width=0.04)
    return d.select("det_id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("keep"))


@register("candidate_drop_reasons_without_paper", duck(f"SELECT det_id,{_RS2} AS reasons FROM {{cd_}}", {"cd_": _CD}))
def _(c):
    d = raster.candidate_drops(c.sql(_CD), paper_rule=False)
    return d.select("det_id", F.array_join("reasons", ",").alias("reasons"))


_MEXT = f"abs(y2-y1)>=CAST(trunc({IMG_H}*0.4) AS INT) AND abs(x2-x1)>=CAST(trunc({IMG_W}*0.03) AS INT)"
_MC = {
    **R,
    "mc_px": f"""SELECT b.*,coalesce(ink,0)/n ink_ratio,paper/n paper_ratio,staff/n staff_ratio,clef/n clef_ratio FROM (SELECT {BX.replace('page_id', 'b.page_id')},CAST(count(*) AS DOUBLE) n,
 sum(CASE WHEN p<{DARK} THEN 1 ELSE 0 END) ink,sum(CASE WHEN p>100 THEN 1 ELSE 0 END) paper,sum(CASE WHEN y%5=0 AND p>110 THEN 1 ELSE 0 END) staff,sum(CASE WHEN p>160 THEN 1 ELSE 0 END) clef
 FROM {{rd_}} b JOIN {{r_long}} l ON l.page_id=b.page_id AND l.y>=b.y1 AND l.y<b.y2 AND l.x>=b.x1 AND l.x<b.x2 GROUP BY ALL) b""",
    "mc_page": "SELECT page_id,64 img_w,max(y)+1 img_h,min(x) FILTER (p>100) p_x1,min(y) FILTER (p>100) p_y1,max(x) FILTER (p>100) p_x2,max(y) FILTER (p>100) p_y2 FROM {r_long} GROUP BY 1",
    "mc_tall": f"SELECT page_id,median(abs(y2-y1)) median_h FROM {{rd_}} WHERE {_MEXT} GROUP BY 1",
    "mc_": "SELECT * EXCLUDE (n,ink,paper,staff,clef,median_h),coalesce(median_h,0) median_h FROM {mc_px} JOIN {mc_page} USING (page_id) LEFT JOIN {mc_tall} USING (page_id)",
}
_MRS = f"""concat_ws(',',CASE WHEN abs(x2-x1)>CAST(trunc(64*0.07) AS INT) THEN 'too_wide' END,CASE WHEN x2<=CAST(trunc(64*0.12) AS INT) THEN 'left_margin_zone' END,
 CASE WHEN x2<=CAST(trunc(64*0.25) AS INT) AND clef_ratio>0.01 THEN 'clef_mask_overlap' END,
 CASE WHEN CAST(trunc(median_h*0.8) AS INT)>0 AND abs(y2-y1)<CAST(trunc(median_h*0.8) AS INT) THEN 'too_short_vs_existing_median' END,
 CASE WHEN NOT (CAST(round_even((x1+x2)/2e0,0) AS INT) BETWEEN p_x1 AND p_x2 AND CAST(round_even((y1+y2)/2e0,0) AS INT) BETWEEN p_y1 AND p_y2) THEN 'outside_page_region' END,
 CASE WHEN paper_ratio<0.92 THEN 'low_paper_overlap' END,CASE WHEN staff_ratio<0.1 THEN 'no_staff_overlap' END,CASE WHEN ink_ratio<0.18 THEN 'low_ink_ratio' END)"""


def measured(c, apart=True):
    paper = c.raster().withColumn("px", F.transform("px", lambda p: F.when(p > 100, 255).otherwise(0)))
    existing = raster.minimum_size(boxes(c), F.lit(IMG_W), F.lit(IMG_H), h_ratio=0.4, w_ratio=0.03)
    return raster.measure_candidates(boxes(c), c.raster(), existing, paper, staff=staff_mask(c), clef=head_mask(c), ink_threshold=DARK, apart=apart)


@register("measured_candidates", duck(f"SELECT {BX},ink_ratio,paper_ratio,staff_ratio,clef_ratio,img_w,CAST(img_h AS INT) AS img_h,p_x1,p_y1,p_x2,p_y2,CAST(median_h AS DOUBLE) AS median_h FROM {{mc_}}", _MC))
def _(c):
    return measured(c)


@register("measured_candidate_drops", duck(f"SELECT {BX},{_MRS} AS reasons FROM {{mc_}}", _MC))
def _(c):
    d = raster.candidate_drops(measured(c), max_width=0.07, min_height_ratio=0.8, min_paper=0.92, min_staff=0.1)
    return d.select("page_id", *g.BOX, F.array_join("reasons", ",").alias("reasons"))


@register("measured_edge_and_staff_filter", duck(f"""
SELECT {BX} FROM {{mc_}} WHERE x1>=4 AND x2<=60 AND y1>=3 AND y2<=47 AND staff_ratio>=0.1 AND y2-y1>=18 AND x2-x1<=4""", _MC))
def _(c):
    d = raster.edge_and_staff_filter(measured(c, apart=False), margin_x=4, margin_y=3, min_overlap=0.1, min_h=F.lit(18), max_w=F.lit(4))
    return d.select("page_id", *g.BOX)


@register("edge_and_staff_filter", duck("""
SELECT det_id FROM {cd_} WHERE x1>=60 AND x2<=1240 AND y1>=120 AND y2<=1000 AND staff_ratio>=0.02 AND y2-y1>=30 AND x2-x1<=8""", {"cd_": _CD}))
def _(c):
    return raster.edge_and_staff_filter(c.sql(_CD), margin_x=60, margin_y=120, min_overlap=0.02,
                                        min_h=F.lit(30), max_w=F.lit(8)).select("det_id")


@register("staff_crossings", duck(f"""
SELECT * FROM (WITH m AS (SELECT page_id,y,CAST(unnest(range(64)) AS INT) x,unnest(px) p FROM {{r_mask}}),
 h AS (SELECT b.*,m.y,m.p>0 s,lag(m.p>0) OVER (PARTITION BY b.page_id,b.x1,b.y1,b.x2,b.y2 ORDER BY m.y) ps FROM {{rd_}} b JOIN m ON m.page_id=b.page_id AND m.y>=b.y1 AND m.y<b.y2 AND m.x=CAST(floor((b.x1+b.x2)/2e0) AS INT))
SELECT {BX},CAST(sum(CASE WHEN s AND NOT coalesce(ps,false) THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM h GROUP BY {BX})""", R))
def _(c):
    return raster.staff_crossings(boxes(c), staff_mask(c))


@register("stem_rejections", duck(f"""
SELECT * FROM (WITH hd AS (SELECT page_id,y,CAST(unnest(range(64)) AS INT) x,unnest(px) p FROM {{r_head}}),
 hp AS (SELECT page_id,y,x FROM hd WHERE p>0), st AS (SELECT page_id,y,CAST(unnest(range(64)) AS INT) x,unnest(px) p FROM {{r_mask}}),
 nr AS (SELECT b.page_id,b.x1,b.y1,b.x2,b.y2,count(*) nn,sum(CASE WHEN hp.x>=b.x1 AND hp.x<b.x2 THEN 1 ELSE 0 END) ov FROM {{rd_}} b JOIN hp ON hp.page_id=b.page_id AND hp.y>=b.y1 AND hp.y<b.y2 AND hp.x>=b.x1-5 AND hp.x<b.x2+5 GROUP BY ALL),
 cr AS (SELECT {BX},sum(CASE WHEN s AND NOT coalesce(ps,false) THEN 1 ELSE 0 END) n FROM (SELECT b.*,st.p>0 s,lag(st.p>0) OVER (PARTITION BY b.page_id,b.x1,b.y1,b.x2,b.y2 ORDER BY st.y) ps FROM {{rd_}} b JOIN st ON st.page_id=b.page_id AND st.y>=b.y1 AND st.y<b.y2 AND st.x=CAST(floor((b.x1+b.x2)/2e0) AS INT)) GROUP BY {BX})
SELECT b.page_id,b.x1,b.y1,b.x2,b.y2,coalesce(nn>0,false) AND ((b.y2-b.y1<24 AND b.x2-b.x1<4 AND coalesce(ov,0)>=2) OR (coalesce(ov,0)<2 AND cr.n<4)) AS rejected
FROM {{rd_}} b LEFT JOIN nr USING (page_id,x1,y1,x2,y2) LEFT JOIN cr USING (page_id,x1,y1,x2,y2))""", R))
def _(c):
    return raster.stem_rejects(boxes(c), head_mask(c), staff=staff_mask(c), min_overlap=2, min_crossings=4)


_TS = "unnest([{'n':'roi','a':b.x1,'z':b.x2},{'n':'left','a':greatest(0,b.x1-3),'z':b.x1},{'n':'right','a':b.x2,'z':least(64,b.x2+3)},{'n':'rleft','a':greatest(0,b.x1-6),'z':greatest(0,b.x1-3)},{'n':'rright','a':least(64,b.x2+3),'z':least(64,b.x2+6)}])"
_TP = ",".join(f"max(CASE WHEN s.n='{n}' THEN {c} END) {n}_{c}" for n in ("roi", "left", "right", "rleft", "rright") for c in ("mn", "sd", "dr"))


@register("thin_run_acceptance", duck(f"""
SELECT * FROM (WITH d AS (SELECT * FROM {{rd_}} WHERE NOT (x2-x1<2 AND y2-y1<18) AND x1>0 AND x2<64 AND (x1+x2)/2e0>8),
 e AS (SELECT b.*, {_TS} s FROM d b),
 q AS (SELECT e.page_id,e.x1,e.y1,e.x2,e.y2,e.s,count(*) n,avg(l.p) mn,sqrt(greatest(0,(count(*)*sum(l.p*l.p)-sum(l.p)*sum(l.p))/CAST(count(*)*count(*) AS DOUBLE))) sd,avg(CASE WHEN l.p<{DARK} THEN 1e0 ELSE 0e0 END) dr FROM e JOIN {{r_long}} l ON l.page_id=e.page_id AND l.y>=e.y1 AND l.y<e.y2 AND l.x>=e.s.a AND l.x<e.s.z GROUP BY ALL),
 p AS (SELECT {BX},{_TP} FROM q GROUP BY {BX}),
 k AS (SELECT *, left_mn>=127 OR coalesce(rleft_mn>=127 AND rleft_dr<=0.28,false) lo, right_mn>=127 OR coalesce(rright_mn>=127 AND rright_dr<=0.28,false) ro FROM p),
 o AS (SELECT *, lo AND ro bo, NOT (lo AND ro) AND lo<>ro AND (CASE WHEN lo THEN right_dr ELSE left_dr END)<=0.3 ov FROM k)
SELECT {BX} FROM o WHERE (bo OR ov) AND NOT (ov AND x2-x1=1 AND y2-y1<20) AND roi_mn<129 AND (roi_sd<=15 OR (x2-x1<=4 AND roi_sd<=17))
 AND NOT ((CASE WHEN ov THEN left_dr>0.31 AND right_dr>0.31 ELSE left_dr>0.31 OR right_dr>0.31 END) AND roi_sd>=14))""", R))
def _(c):
    return raster.thin_run_accept(
        boxes(c), c.raster(), img_w=IMG_W, pixel=129, dark=DARK, adjacent_min=127, relaxed_dark=0.28,
        max_std=15, max_std_relaxed=17, head_dark=0.31, head_std=14, single_dark=0.3, left_margin=8)


_XC = f"SELECT {PG},det_id,CAST(floor(x1/3) AS INT)*3 x1,y1,CAST(floor(x1/3) AS INT)*3+3 x2,y2-CAST(det_id%25 AS INT) y2 FROM {{f_barline}}"
_XE = f"SELECT {PG},x1,y1,x2,y2 FROM {{f_extra_bar}}"


@register("x_cluster_filter", duck(f"""
SELECT * FROM (WITH d AS (SELECT *, CAST(round_even((x1+x2)/4e0,0) AS INT)*2 bx FROM {{xc_}}),
 s AS (SELECT {PG},bx FROM d GROUP BY ALL HAVING count(*)>=3 AND max(y2)-min(y1)>=120),
 k AS (SELECT s.*, EXISTS (SELECT 1 FROM {{xe_}} e WHERE e.score_id=s.score_id AND e.page_index=s.page_index AND abs(s.bx-(e.x1+e.x2)/2e0)<8) near FROM s)
SELECT d.det_id FROM d LEFT JOIN k USING (score_id,page_index,bx) WHERE near IS NULL OR (near AND y2-y1>=20))""", {"xc_": _XC, "xe_": _XE}))
def _(c):
    return raster.x_cluster_filter(c.sql(_XC), c.sql(_XE), reject_count=3, keys=KEYS).select("det_id")


@register("trimmed_boxes", duck(f"""
SELECT * FROM (WITH a AS (SELECT {BX},min(y) a,max(y)+1 z FROM {{rh_}} WHERE len(list_filter(v,lambda p: p<105))/CAST(greatest(1,len(v)) AS DOUBLE)>=0.3 GROUP BY {BX})
SELECT {BX},coalesce(a,y1) AS t_y1,coalesce(z,y2) AS t_y2 FROM {{rd_}} LEFT JOIN a USING ({BX}))""", R))
def _(c):
    return raster.trim_boxes(boxes(c), c.raster(), threshold=105, min_ratio=0.3)


@register("split_boxes", duck(f"""
SELECT * FROM (WITH r AS (SELECT {BX},y,y-row_number() OVER (PARTITION BY {BX} ORDER BY y) k FROM {{rh_}} WHERE y2-y1>18 AND len(list_filter(v,lambda p: p<112))>0),
 s AS (SELECT {BX},k,min(y) a,max(y)+1 z FROM r GROUP BY ALL HAVING max(y)+1-min(y)>=3),
 t AS (SELECT *, sum(b) OVER (PARTITION BY {BX} ORDER BY a) g FROM (SELECT *, CASE WHEN a-lag(z) OVER (PARTITION BY {BX} ORDER BY a)>=3 THEN 1 ELSE 0 END b FROM s)),
 u AS (SELECT {BX},g,min(a) s_y1,max(z) s_y2 FROM t GROUP BY ALL)
SELECT {BX},coalesce(s_y1,y1) AS s_y1,coalesce(s_y2,y2) AS s_y2 FROM {{rd_}} LEFT JOIN u USING ({BX}))""", R))
def _(c):
    return raster.split_boxes(boxes(c), c.raster(), threshold=112, min_gap=3, min_segment=3, min_height=F.lit(18))


@register("stripe_signal", duck("SELECT page_id,band_idx,x,ink,round(ratio,6) AS ratio FROM {r_sig}", R))
def _(c):
    return signal(c).select("page_id", "band_idx", "x", "ink", R6(F.col("ratio")).alias("ratio"))


@register("refined_peaks", duck("""
SELECT * FROM (WITH s AS (SELECT page_id,band_idx,x FROM (SELECT *, lag(ratio) OVER w l, lead(ratio) OVER w r FROM {r_sig} WINDOW w AS (PARTITION BY page_id,band_idx ORDER BY x)) WHERE ratio>=l AND ratio>=r)
SELECT page_id,band_idx,seed_x,x,round(ratio,6) AS ratio FROM (SELECT s.page_id,s.band_idx,s.x seed_x,g.x,g.ratio,row_number() OVER (PARTITION BY s.page_id,s.band_idx,s.x ORDER BY g.ratio DESC,g.x) rn
 FROM s JOIN {r_sig} g ON g.page_id=s.page_id AND g.band_idx=s.band_idx AND g.x BETWEEN s.x-4 AND s.x+4) WHERE rn=1)""", R))
def _(c):
    from pyspark.sql import Window

    s = signal(c)
    w = Window.partitionBy("page_id", "band_idx").orderBy("x")
    p = s.withColumns({"l": F.lag("ratio").over(w), "r": F.lead("ratio").over(w)}).where("ratio >= l AND ratio >= r")
    return raster.refine_peaks(p, s).withColumn("ratio", R6(F.col("ratio")))


@register("local_contrast", duck("""
SELECT page_id,band_idx,x,round(CASE WHEN m>0 THEN ratio/m END,6) AS contrast FROM (SELECT s.page_id,s.band_idx,s.x,s.ratio,quantile_cont(n.ratio,0.5) m
 FROM {r_sig} s JOIN {r_sig} n ON n.page_id=s.page_id AND n.band_idx=s.band_idx AND n.x<>s.x AND n.x BETWEEN s.x-12 AND s.x+12 GROUP BY ALL)""", R))
def _(c):
    return raster.local_contrast(signal(c)).select("page_id", "band_idx", "x", R6(F.col("contrast")).alias("contrast"))


# scan-line ratios of probe strips: fifty lines around each staff
_PR = f"""SELECT {PG},staff_index probe_id,CAST(y1-10+k AS INT) y,CAST((y1*7+k*(3+staff_index)+score_id)%17 AS DOUBLE)/CAST(16 AS DOUBLE) ratio FROM {{f_staff}}, (SELECT unnest(range(1,51)) k)"""


@register("tightest_staff_lines", duck(f"""
SELECT * FROM (WITH h AS (SELECT *, sum(CASE WHEN g>1 THEN 1 ELSE 0 END) OVER (PARTITION BY {PG},probe_id ORDER BY y) grp FROM (SELECT *, y-lag(y) OVER (PARTITION BY {PG},probe_id ORDER BY y) g FROM {{pr_}} WHERE ratio>=0.6)),
 gr AS (SELECT {PG},probe_id,grp,min(y) a,max(y) z FROM h GROUP BY ALL),
 q AS (SELECT *, lead(z,3) OVER (PARTITION BY {PG},probe_id ORDER BY grp) last FROM gr),
 m AS (SELECT q.score_id,q.page_index,q.probe_id,q.grp,q.a,q.last,round(avg(r.ratio),9) mean FROM q JOIN {{pr_}} r ON r.score_id=q.score_id AND r.page_index=q.page_index AND r.probe_id=q.probe_id AND r.y BETWEEN q.a AND q.last WHERE q.last IS NOT NULL GROUP BY ALL)
SELECT {PG},probe_id,a AS top,last AS bottom FROM (SELECT *, row_number() OVER (PARTITION BY {PG},probe_id ORDER BY last-a,mean DESC,grp) rn FROM m) WHERE rn=1)""",
    {"pr_": _PR}))
def _(c):
    k = F.explode(F.sequence(F.lit(1), F.lit(50)))
    r = c["f_staff"].select("*", k.alias("k")).select(
        *KEYS, F.col("staff_index").alias("probe_id"), (F.col("y1") - 10 + F.col("k")).alias("y"),
        (((F.col("y1") * 7 + F.col("k") * (3 + F.col("staff_index")) + F.col("score_id")) % 17).cast("double") / 16.0).alias("ratio"))
    return raster.tightest_lines(r, line_ratio=0.6, min_lines=4, keys=[*KEYS, "probe_id"])


# some rows lie above their band, which then takes its domain from the bars
_MR = f"SELECT {PG},y1+CASE WHEN (score_id+staff_index)%4=1 THEN -30 ELSE 12 END y,x1+CASE WHEN staff_index%3=0 THEN 500 ELSE 0 END xa,CASE WHEN staff_index%3=0 THEN x1+501 ELSE x2-40 END xb FROM {{f_staff}}"


@register("probe_x_domains", duck(f"""
SELECT * FROM (WITH m AS (SELECT b.score_id,b.page_index,b.band_idx,min(xa) a,max(xb) z FROM {{d_band}} b JOIN {{mr_}} r ON r.score_id=b.score_id AND r.page_index=b.page_index AND r.y BETWEEN b.b1 AND b.b2 GROUP BY ALL),
 e AS (SELECT b.score_id,b.page_index,b.band_idx,min(least(x1,x2)) a,max(greatest(x1,x2)) z FROM {{d_band}} b JOIN {{f_barline}} r ON r.score_id=b.score_id AND r.page_index=b.page_index AND (r.y1+r.y2)/2e0 BETWEEN b.b1 AND b.b2 GROUP BY ALL),
 j AS (SELECT b.score_id,b.page_index,b.band_idx,coalesce(m.a,e.a) a,coalesce(m.z,e.z) z FROM {{d_band}} b LEFT JOIN m USING (score_id,page_index,band_idx) LEFT JOIN e USING (score_id,page_index,band_idx)),
 k AS (SELECT *, greatest(0,least(1299,a-0)) p, greatest(0,least(1299,z+0)) q FROM j)
SELECT {PG},band_idx,CASE WHEN a IS NULL OR q-p+1<3 THEN 0 ELSE p END AS d1,CASE WHEN a IS NULL OR q-p+1<3 THEN 1299 ELSE q END AS d2 FROM k)""", {**EXP, "mr_": _MR}))
def _(c):
    return raster.x_domains(bands(c), c.sql(_MR), c["f_barline"], img_w=F.lit(1300), keys=KEYS)


_EXI = "CASE WHEN rec_id%13=0 THEN true ELSE false END"


@register("rightmost_rescue", duck(f"""
SELECT * FROM (WITH e AS (SELECT {PG},band_idx,CAST(max(col) AS DOUBLE) x FROM {{f_scan_record}} WHERE status='accepted' GROUP BY ALL),
 t AS (SELECT {PG},quantile_cont(x,0.5) target FROM (SELECT *, max(x) OVER (PARTITION BY {PG}) mx FROM e) WHERE x>=mx*0.8 GROUP BY ALL),
 nr AS (SELECT r.score_id,r.page_index,r.band_idx,CAST(r.col AS DOUBLE) col,r.status,r.rec_id,t.target FROM {{f_scan_record}} r JOIN t USING (score_id,page_index) WHERE status<>'accepted' AND abs(col-target)<=60),
 s AS (SELECT {PG},band_idx,col nx FROM (SELECT *, row_number() OVER (PARTITION BY {PG},band_idx ORDER BY abs(col-target),rec_id) rn FROM nr) WHERE rn=1),
 q AS (SELECT {PG} FROM e LEFT JOIN s USING (score_id,page_index,band_idx) JOIN t USING (score_id,page_index) WHERE abs(coalesce(nx,x)-target)<=60 GROUP BY ALL HAVING count(*)>=3)
SELECT {PG},band_idx,col,status,rec_id,target FROM (SELECT nr.*, row_number() OVER (PARTITION BY {PG},CAST(round_even(col,0) AS INT) ORDER BY rec_id) rn FROM nr JOIN q USING (score_id,page_index) WHERE NOT ({_EXI})) WHERE rn=1)"""))
def _(c):
    r = c["f_scan_record"]
    return raster.rightmost_rescue(
        r.where("status = 'accepted'"), r.where("status <> 'accepted'").withColumn("existing", F.expr(_EXI)),
        tolerance=60, min_rows=3, min_ratio=0.8, keys=KEYS)


@register("gap_rescue", duck(f"""
SELECT * FROM (WITH x AS (SELECT DISTINCT {PG},band_idx,CAST(col AS DOUBLE) x FROM {{f_scan_record}} WHERE status='accepted'),
 gp AS (SELECT *, nx-x gap FROM (SELECT *, lead(x) OVER (PARTITION BY {PG},band_idx ORDER BY x) nx FROM x) WHERE nx IS NOT NULL),
 m AS (SELECT {PG},quantile_cont(gap,0.5) md FROM gp GROUP BY ALL),
 b AS (SELECT gp.*,m.md FROM gp JOIN m USING (score_id,page_index) WHERE gap>=md*1.2),
 c AS (SELECT b.score_id,b.page_index,b.band_idx,b.x gx,b.gap,b.md,CAST(r.col AS DOUBLE) col,r.ratio,r.rec_id,row_number() OVER (PARTITION BY b.score_id,b.page_index,b.band_idx,b.x ORDER BY r.ratio DESC,r.rec_id) rn
  FROM b JOIN {{f_scan_record}} r ON r.score_id=b.score_id AND r.page_index=b.page_index AND r.band_idx=b.band_idx AND r.status<>'accepted' AND r.ratio>=0.1 AND r.col>b.x+b.gap*0.1 AND r.col<b.nx-b.gap*0.1)
SELECT {PG},band_idx,col,ratio,rec_id,gap,md AS median_gap FROM c WHERE rn=1 AND NOT ({_EXI}))"""))
def _(c):
    r = c["f_scan_record"]
    return raster.gap_rescue(
        r.where("status = 'accepted'").withColumnRenamed("col", "x"),
        r.where("status <> 'accepted'").withColumn("existing", F.expr(_EXI)),
        threshold_ratio=1.2, min_ratio=0.1, keys=KEYS)


@register("right_end_bins", duck(f"""
SELECT * FROM (WITH b AS (SELECT {PG},CAST(round_even(((x1+x2)/2e0)/8,0) AS INT) k,count(*) n FROM {{f_barline}} GROUP BY ALL HAVING count(*)>=2),
 t AS (SELECT {PG},max((x1+x2)/2e0) mx FROM {{f_barline}} GROUP BY ALL)
SELECT {PG},max(k)*8 AS x_ref FROM b JOIN t USING (score_id,page_index) WHERE k*8>=mx-40 GROUP BY ALL HAVING max(k)*8>=1300*0.7)"""))
def _(c):
    return raster.right_end_bin(c["f_barline"], img_w=F.lit(1300), keys=KEYS)


_ER = {"r_rows": "SELECT page_id,CAST(r AS INT) row_id,CAST(r*12 AS INT) y_top,CAST(r*12+14 AS INT) y_bottom FROM (SELECT DISTINCT page_id,unnest(range(4)) r FROM {f_raster})"}


def _row_groups(c):
    return c.raster().select("page_id").distinct().select(
        "page_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("row_id")).withColumns(
        {"y_top": F.col("row_id") * 12, "y_bottom": F.col("row_id") * 12 + 14})


@register("mask_right_ends", duck("""
SELECT page_id,row_id,quantile_cont(CAST(x AS DOUBLE),0.98) AS x_ref FROM (SELECT DISTINCT r.page_id,r.row_id,m.x FROM {r_rows} r JOIN (SELECT page_id,y,CAST(unnest(range(64)) AS INT) x,unnest(px) p FROM {r_head}) m
 ON m.page_id=r.page_id AND m.y>=r.y_top AND m.y<r.y_bottom AND m.p>0) GROUP BY ALL""", {**R, **_ER}))
def _(c):
    return raster.mask_right_end(_row_groups(c), head_mask(c))


_EB = """SELECT page_id,CAST(floor(y1/12) AS INT) row_id,x1+CASE WHEN y1%3=0 THEN 20 ELSE 0 END x1,y1,x2+CASE WHEN y1%3=0 THEN 20 ELSE 0 END x2,y2 FROM {rb_}"""


@register("recovered_end_bars", duck(f"""
SELECT * FROM (WITH rw AS (SELECT *, 50e0+page_id%5 x_ref FROM {{r_rows}} WHERE y_bottom-y_top>=14),
 ok AS (SELECT * FROM rw WHERE x_ref>=64*0.7 AND NOT EXISTS (SELECT 1 FROM {{eb_}} b WHERE b.page_id=rw.page_id AND b.row_id=rw.row_id AND abs((b.x1+b.x2)/2e0-rw.x_ref)<=6)),
 xs AS (SELECT *, CAST(unnest(range(greatest(0,CAST(round_even(x_ref-8,0) AS INT)),least(63,CAST(round_even(x_ref+8,0) AS INT))+1)) AS INT) x FROM ok),
 st AS (SELECT xs.page_id,xs.row_id,xs.y_top,xs.y_bottom,xs.x,least(64,xs.x+2) m,avg(CASE WHEN l.x<xs.x+2 THEN CASE WHEN l.p<{DARK} THEN 1e0 ELSE 0e0 END END) dr,avg(CASE WHEN l.x>=xs.x+2 THEN CASE WHEN l.p<{DARK} THEN 1e0 ELSE 0e0 END END) rr
  FROM xs JOIN {{r_long}} l ON l.page_id=xs.page_id AND l.y>=xs.y_top AND l.y<xs.y_bottom AND l.x>=xs.x AND l.x<least(64,xs.x+6) GROUP BY ALL)
SELECT page_id,row_id,x AS x1,y_top AS y1,m AS x2,y_bottom AS y2,round(dr,6) AS dark_ratio FROM (SELECT *, row_number() OVER (PARTITION BY page_id,row_id ORDER BY dr DESC,x) rn FROM st WHERE dr>=0.3 AND rr<=0.3 AND m<64) WHERE rn=1)""",
    {**R, **_ER, "eb_": _EB}))
def _(c):
    rows = _row_groups(c).withColumn("x_ref", 50.0 + F.col("page_id") % 5)
    b = boxes(c).withColumns({
        "row_id": F.floor(F.col("y1") / 12).cast("int"),
        "x1": F.col("x1") + F.when(F.col("y1") % 3 == 0, 20).otherwise(0),
        "x2": F.col("x2") + F.when(F.col("y1") % 3 == 0, 20).otherwise(0)})
    # y1 % 3 is taken before the shift in both engines: y1 itself never moves
    return raster.recover_end_bars(
        rows, b, c.raster(), img_w=IMG_W, median_height=17, dark=DARK, min_dark=0.3, right_max=0.3
    ).withColumn("dark_ratio", R6(F.col("dark_ratio")))


@register("staff_spacing", duck(f"""
SELECT * FROM (WITH r AS (SELECT DISTINCT {PG},y FROM {{sp_}}), n AS (SELECT *, y-row_number() OVER (PARTITION BY {PG} ORDER BY y) k FROM r),
 c AS (SELECT {PG},(min(y)+max(y))/2e0 c FROM n GROUP BY {PG},k), d AS (SELECT {PG},c-lag(c) OVER (PARTITION BY {PG} ORDER BY c) d FROM c),
 m AS (SELECT {PG},quantile_cont(d,0.5) m FROM d WHERE d>0 GROUP BY ALL)
SELECT {PG},round(avg(d),6) AS unit FROM d JOIN m USING (score_id,page_index) WHERE d>0 AND d BETWEEN m*0.5e0 AND m*1.5e0 GROUP BY ALL)""",
    {"sp_": f"SELECT {PG},CAST(y1+CAST(floor(k/2) AS INT)*(9+score_id%3)+k%2 AS INT) y FROM {{f_staff}}, (SELECT unnest(range(1,8)) k)"}))
def _(c):
    r = c["f_staff"].select("*", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k")).select(
        *KEYS, (F.col("y1") + F.floor(F.col("k") / 2).cast("int") * (9 + F.col("score_id") % 3) + F.col("k") % 2).alias("y"))
    return raster.spacing(r, KEYS).withColumn("unit", R6(F.col("unit")))


_OL = f"""SELECT {PG},staff_index,x1 x,CAST(y1 AS DOUBLE)+CASE WHEN score_id%3=0 THEN x1*0.01 ELSE CAST(det_id%3 AS DOUBLE) END upper,
 CAST(y2 AS DOUBLE)-CASE WHEN score_id%2=0 THEN x1*0.012 ELSE CAST(det_id%5 AS DOUBLE) END lower,CAST(2 AS DOUBLE) unit FROM {{f_barline}} JOIN (SELECT {PG},staff_index,y1 sy FROM {{f_staff}}) s USING (score_id,page_index) WHERE y1 BETWEEN sy AND sy+2"""


@register("opposing_line_fragments", duck(f"""
SELECT {PG},staff_index,round(su*w,6) AS upper_shift,round(sl*w,6) AS lower_shift,coalesce(n>=greatest(2,2*1e0) AND w>=2*20e0 AND su*w*sl*w<0 AND least(abs(su*w),abs(sl*w))>=2*0.47e0,false) AS opposing,
 coalesce(2<=2 AND n<2*2e0 AND n>=greatest(2,2*1e0) AND w>=2*20e0 AND su*w*sl*w<0 AND least(abs(su*w),abs(sl*w))>=2*0.47e0,false) AS fragment
FROM (SELECT {PG},staff_index,count(*) n,max(x)-min(x) w,regr_slope(upper,x) su,regr_slope(lower,x) sl FROM {{ol_}} GROUP BY ALL)""", {"ol_": _OL}))
def _(c):
    cols = c.sql(_OL)
    ids = [*KEYS, "staff_index"]
    o = raster.opposing_lines(cols, min_width=20.0, min_shift=0.47, keys=ids)
    n = cols.groupBy(*ids).agg(F.count("*").alias("span"))
    return o.join(n, ids).select(*ids, "upper_shift", "lower_shift", "opposing", raster.short_fragment(
        F.lit(2), F.col("span"), F.lit(2.0), F.col("opposing")).alias("fragment"))


@register("connector_density", duck(f"""
SELECT * FROM (WITH p AS (SELECT b.page_id,b.x1,b.y1,b.x2,b.y2,l.x,l.y FROM {{rd_}} b JOIN {{r_long}} l ON l.page_id=b.page_id AND l.x>=b.x1 AND l.x<b.x2 AND l.y>=b.y1 AND l.y<b.y2 WHERE l.p>124),
 r AS (SELECT *, y-row_number() OVER (PARTITION BY {BX},x ORDER BY y) k FROM p),
 o AS (SELECT {BX},sum(n) n FROM (SELECT {BX},x,k,count(*) n FROM r GROUP BY ALL HAVING count(*)>=least(y2-y1,greatest(3,CAST(trunc((y2-y1)*0.30) AS INT)))) GROUP BY {BX}),
 d AS (SELECT {BX},count(*) n FROM p GROUP BY {BX})
SELECT {BX},round(coalesce(d.n,0)/CAST((x2-x1)*(y2-y1) AS DOUBLE),6) AS density,round(coalesce(o.n,0)/CAST((x2-x1)*(y2-y1) AS DOUBLE),6) AS open_density,coalesce(o.n,0)/CAST((x2-x1)*(y2-y1) AS DOUBLE)>=0.05 AS present
FROM {{rd_}} LEFT JOIN d USING ({BX}) LEFT JOIN o USING ({BX}))""", R))
def _(c):
    mask = c.raster().withColumn("px", F.transform("px", lambda p: (p > 124).cast("int")))
    e = raster.connector_evidence(boxes(c).distinct(), mask, open_ratio=0.30)
    return e.select("page_id", *g.BOX, R6(F.col("density")).alias("density"),
                    R6(F.col("open_density")).alias("open_density"), "present")
