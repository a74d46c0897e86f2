"""Greedy folds, checked against row-by-row recursive SQL."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..functions import geometry as g
from ..operators import folds
from . import register
from .layout import PG
from .sqltext import expand_cols, iou, overlap_max

R6 = lambda c: F.round(c, 6)

# column signal per band: one value per x
_SIG = f"""SELECT {PG},band_idx,CAST(col%400 AS INT) x,max(CAST(floor(ratio*100+0.5) AS INT))/CAST(100 AS DOUBLE) ratio,
 20 d1,380 d2 FROM {{f_scan_record}} GROUP BY {PG},band_idx,CAST(col%400 AS INT)"""


def _peaks_sql(cap: int) -> str:
    return duck(f"""
SELECT * FROM (WITH RECURSIVE n AS (SELECT *, coalesce(lag(ratio) OVER w,last_value(ratio) OVER e) l, coalesce(lead(ratio) OVER w,first_value(ratio) OVER e) r
  FROM {{sig_}} WINDOW w AS (PARTITION BY {PG},band_idx ORDER BY x), e AS (PARTITION BY {PG},band_idx ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 p AS (SELECT *, row_number() OVER (PARTITION BY {PG},band_idx ORDER BY ratio DESC,x) rn, count(*) OVER (PARTITION BY {PG},band_idx) np
  FROM n WHERE ratio>=0.3 AND ratio>=l AND ratio>=r AND x BETWEEN d1 AND d2),
 f AS (SELECT {PG},band_idx,rn,np,x,ratio,[x] kept,true keep FROM p WHERE rn=1 UNION ALL
  SELECT p.score_id,p.page_index,p.band_idx,p.rn,p.np,p.x,p.ratio,
   CASE WHEN len(f.kept)<{cap} AND len(list_filter(f.kept,lambda k: abs(k-p.x)<25))=0 THEN list_append(f.kept,p.x) ELSE f.kept END,
   len(f.kept)<{cap} AND len(list_filter(f.kept,lambda k: abs(k-p.x)<25))=0
  FROM f JOIN p ON p.score_id=f.score_id AND p.page_index=f.page_index AND p.band_idx=f.band_idx AND p.rn=f.rn+1)
SELECT {PG},band_idx,np AS n_peaks,CAST(len(kept)-1 AS INT) AS rank,x,ratio FROM f WHERE keep)""", {"sig_": _SIG})


def _peaks(c, cap: int = 0):
    return folds.nearest_first_peaks(c.sql(_SIG), min_ratio=0.3, min_distance=25, max_peaks=cap, keys=[*KEYS, "band_idx"])


@register("signal_peaks", _peaks_sql(1 << 30))
def _(c):
    """Every peak of a band, strongest first and spaced."""
    return _peaks(c)


@register("signal_peaks_top", _peaks_sql(80))
def _(c):
    """The generation pass's 80 strongest peaks of a band; ``n_peaks`` tells how many stood to choose from."""
    return _peaks(c, 80)


_RUNS = f"""SELECT DISTINCT {PG},x1+CAST(det_id%4 AS INT) x,y1+CAST(det_id%3 AS INT)*3 y1,y2+CAST(det_id%5 AS INT) y2 FROM {{f_barline}}
 UNION SELECT {PG},x1+1+CAST(det_id%3 AS INT),y1+CAST(det_id%2 AS INT),y2+1 FROM {{f_barline}}"""


@register("merged_vertical_runs", duck(f"""
SELECT * FROM (WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY x,y1,y2) rn FROM {{runs_}}),
 f AS (SELECT {PG},rn,0 grp,x x1,y1,x+1 x2,y2 FROM p WHERE rn=1 UNION ALL
  SELECT p.score_id,p.page_index,p.rn,
   CASE WHEN j THEN grp ELSE grp+1 END, CASE WHEN j THEN fx1 ELSE px END, CASE WHEN j THEN least(fy1,py1) ELSE py1 END, px+1, CASE WHEN j THEN greatest(fy2,py2) ELSE py2 END
  FROM (SELECT p.score_id,p.page_index,p.rn,f.grp,f.x1 fx1,f.y1 fy1,f.y2 fy2,p.x px,p.y1 py1,p.y2 py2,
   p.x-f.x2<=1 AND abs(p.y1-f.y1)<=4 AND abs(p.y2-f.y2)<=4 j
   FROM f JOIN p ON p.score_id=f.score_id AND p.page_index=f.page_index AND p.rn=f.rn+1) p)
SELECT {PG},x1,y1,x2,y2 FROM (SELECT *, row_number() OVER (PARTITION BY {PG},grp ORDER BY rn DESC) z FROM f) WHERE z=1 AND x2-x1<=4)""", {"runs_": _RUNS}))
def _(c):
    return folds.merge_runs(c.sql(_RUNS), keys=KEYS)


# strokes: every detection with a near or exact copy
_ST = f"""SELECT {PG},x1,y1,x2,y2,CAST(det_id%97 AS DOUBLE)/CAST(100 AS DOUBLE) score,CAST(10 AS DOUBLE) unit FROM {{f_barline}} UNION ALL
 SELECT {PG},x1+CAST(det_id%3 AS INT),y1+CAST(det_id%4 AS INT)*2,x2+CAST(det_id%2 AS INT),y2,CAST(det_id%89 AS DOUBLE)/CAST(100 AS DOUBLE),CAST(10 AS DOUBLE) FROM {{f_barline}}"""


@register("deduplicated_strokes", duck(f"""
SELECT * FROM (WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY x1,x1-x2,y1,y2,x2,-score) rn FROM {{st_}}),
 f AS (SELECT {PG},rn,x1,y1,x2,y2,score,[{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}] kept,CAST(NULL AS STRUCT(x1 INT,y1 INT,x2 INT,y2 INT)) rep FROM p WHERE rn=1 UNION ALL
  SELECT score_id,page_index,rn,x1,y1,x2,y2,score,CASE WHEN rep IS NULL THEN list_append(kept,{{'x1':x1,'y1':y1,'x2':x2,'y2':y2}}) ELSE kept END,rep FROM (
  SELECT p.score_id,p.page_index,p.rn,p.x1,p.y1,p.x2,p.y2,p.score,f.kept,
   list_filter(f.kept,lambda k: abs(k.x1+k.x2-p.x1-p.x2)/2e0<=1 AND least(k.y2,p.y2)>greatest(k.y1,p.y1)
     AND (least(k.y2,p.y2)-greatest(k.y1,p.y1))/CAST(greatest(k.y2-k.y1,p.y2-p.y1,1) AS DOUBLE)>=0.8)[1] rep
  FROM f JOIN p ON p.score_id=f.score_id AND p.page_index=f.page_index AND p.rn=f.rn+1))
SELECT {PG},x1,y1,x2,y2,bool_or(rep IS NULL) AS kept,count(*) AS n,max(CASE WHEN rep IS NULL THEN score END) AS score,
 CASE WHEN bool_or(rep IS NULL) THEN NULL ELSE any_value(rep.x1) END AS rep_x1, CASE WHEN bool_or(rep IS NULL) THEN NULL ELSE any_value(rep.y1) END AS rep_y1,
 CASE WHEN bool_or(rep IS NULL) THEN NULL ELSE any_value(rep.x2) END AS rep_x2, CASE WHEN bool_or(rep IS NULL) THEN NULL ELSE any_value(rep.y2) END AS rep_y2
FROM f GROUP BY {PG},x1,y1,x2,y2)""", {"st_": _ST}))
def _(c):
    return folds.dedup_strokes(c.sql(_ST))


_SC = f"""SELECT {PG},det_id*2 det_id,x1,y1,x2,y2,CAST(det_id%101 AS DOUBLE)/CAST(100 AS DOUBLE) score FROM {{f_barline}} UNION ALL
 SELECT {PG},det_id*2+1,x1+CAST(det_id%7 AS INT)*2,y1+CAST(det_id%4 AS INT)*6,x2+CAST(det_id%6 AS INT)*2,y2+5,CAST(det_id%83 AS DOUBLE)/CAST(90 AS DOUBLE) FROM {{f_barline}}"""


@register("suppressed_detections", duck(f"""
SELECT * FROM (WITH RECURSIVE p AS (SELECT *, {expand_cols('e_')}, greatest(1e0,greatest(1,abs(y2-y1))/4e0) ru, row_number() OVER (PARTITION BY {PG} ORDER BY score DESC,det_id) rn FROM {{sc_}}),
 s AS (SELECT *, {{'x1':x1,'y1':y1,'x2':x2,'y2':y2,'e_x1':e_x1,'e_y1':e_y1,'e_x2':e_x2,'e_y2':e_y2,'ru':ru}} v FROM p),
 f AS (SELECT {PG},rn,det_id,x1,y1,x2,y2,score,true kept,[v] ks FROM s WHERE rn=1 UNION ALL
  SELECT score_id,page_index,rn,det_id,x1,y1,x2,y2,score,ok,CASE WHEN ok THEN list_append(ks,v) ELSE ks END FROM (
   SELECT s.*,f.ks,len(list_filter(f.ks,lambda k: {iou('k.e_', 's.e_')}>=0.5 OR (abs(k.x1+k.x2-s.x1-s.x2)/2e0<k.ru AND
     {overlap_max('k.y1', 'k.y2', 's.y1', 's.y2')}>=0.5)))=0 ok
   FROM f JOIN s ON s.score_id=f.score_id AND s.page_index=f.page_index AND s.rn=f.rn+1))
SELECT {PG},det_id,x1,y1,x2,y2,kept,CASE WHEN kept THEN score ELSE 0e0 END AS score FROM f)""", {"sc_": _SC}))
def _(c):
    return folds.nms(c.sql(_SC))


@register("merged_extra_bars", duck(f"""
SELECT * FROM (WITH RECURSIVE b AS (SELECT {PG},list({{'ord':det_id,'x1':x1,'y1':y1,'x2':x2,'y2':y2,'x':false}} ORDER BY det_id) st FROM {{f_barline}} GROUP BY ALL),
 e AS (SELECT {PG},{{'ord':ord,'x1':x1,'y1':y1,'x2':x2,'y2':y2,'x':true}} v,row_number() OVER (PARTITION BY {PG} ORDER BY ord) rn FROM {{f_extra_bar}}),
 f AS (SELECT {PG},0::BIGINT rn,st FROM b UNION ALL
  SELECT score_id,page_index,rn,CASE WHEN hit=0 THEN list_append(st,v) WHEN rep THEN list_concat(list_append(st[1:hit-1],v),st[hit+1:]) ELSE st END FROM (
   SELECT *, CASE WHEN hit=0 THEN false ELSE (SELECT CASE WHEN o>=0.6 THEN v.y2-v.y1>h ELSE greatest(v.y2-v.y1,1)>=h END FROM (SELECT greatest(st[hit].y2-st[hit].y1,1) h,
      {overlap_max('st[hit].y1', 'st[hit].y2', 'v.y1', 'v.y2')} o)) END rep FROM (
    SELECT e.score_id,e.page_index,e.rn,e.v,f.st,coalesce(list_position(list_transform(f.st,lambda p: abs((p.x1+p.x2)/2e0-(e.v.x1+e.v.x2)/2e0)<=2 AND
      ({overlap_max('p.y1', 'p.y2', 'e.v.y1', 'e.v.y2')}>=0.6 OR abs((p.y1+p.y2)/2e0-(e.v.y1+e.v.y2)/2e0)<=greatest(p.y2-p.y1,e.v.y2-e.v.y1,1))),true),0) hit
    FROM f JOIN e ON e.score_id=f.score_id AND e.page_index=f.page_index AND e.rn=f.rn+1))),
 z AS (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY rn DESC) k FROM f)
SELECT {PG},u.ord AS ord,u.x1 AS x1,u.y1 AS y1,u.x2 AS x2,u.y2 AS y2,u.x AS is_extra FROM (SELECT {PG},unnest(st) u FROM z WHERE k=1))"""))
def _(c):
    return folds.merge_extra(c["f_barline"].withColumnRenamed("det_id", "ord"), c["f_extra_bar"])


CROP = ["score_id", "page_index", "system", "measure", "staff", "view_name"]
_CK = ",".join(CROP)
# several glyph boxes per crop: digits of one number side by side
OCR = f"""SELECT {_CK},ord*3 ord,x1,y1,x2,y2,CASE WHEN ord%3=0 THEN CAST(ord%10 AS VARCHAR(9)) ELSE text END text,confidence FROM {{f_ocr_token}}
UNION ALL SELECT {_CK},ord*3+1,x2+CAST(ord%23 AS INT)-3,y1+CAST(ord%7 AS INT),x2+CAST(ord%23 AS INT)+9,y2+CAST(ord%5 AS INT),CAST(ord%12 AS VARCHAR(9)),confidence-0.05 FROM {{f_ocr_token}}
UNION ALL SELECT {_CK},ord*3+2,x2+12+CAST(ord%31 AS INT),y1+1,x2+24+CAST(ord%31 AS INT),y2+1,CAST(ord%7 AS VARCHAR(9)),confidence-0.01 FROM {{f_ocr_token}}"""

_JOIN = """(abs((cy1+cy2)/2e0-(ny1+ny2)/2e0)<mh*0.5 AND nx1-cx2<CASE WHEN sp AND abs((cy1+cy2)/2e0-(ny1+ny2)/2e0)<mh*0.2 THEN mh*1.5
 WHEN sp THEN mh*0.8 ELSE mh*0.3 END AND abs(ch-nh)/CAST(greatest(ch,nh) AS DOUBLE)<CASE WHEN sp THEN 0.4 ELSE 0.25 END AND regexp_full_match(concat(ct,nt),'\\d+'))"""
OCR_MERGE = f"""SELECT * FROM (WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY {_CK} ORDER BY x1,ord) rn FROM {{ocrt_}}),
 f AS (SELECT {_CK},rn,0 grp,ord,x1,y1,x2,y2,text,confidence,1 nm FROM p WHERE rn=1 UNION ALL
 SELECT {_CK},rn,CASE WHEN j THEN grp ELSE grp+1 END,CASE WHEN j THEN co ELSE no END,CASE WHEN j THEN least(cx1,nx1) ELSE nx1 END,CASE WHEN j THEN least(cy1,ny1) ELSE ny1 END,
  CASE WHEN j THEN greatest(cx2,nx2) ELSE nx2 END,CASE WHEN j THEN greatest(cy2,ny2) ELSE ny2 END,CASE WHEN j THEN concat(ct,nt) ELSE nt END,
  CASE WHEN j THEN (cc+nc)/2e0 ELSE nc END,CASE WHEN j THEN nm+1 ELSE 1 END FROM (SELECT *, {_JOIN} j FROM (
  SELECT {','.join('p.' + k for k in CROP)},p.rn,f.grp,f.nm,f.ord co,p.ord no,f.x1 cx1,f.y1 cy1,f.x2 cx2,f.y2 cy2,f.text ct,f.confidence cc,p.x1 nx1,p.y1 ny1,p.x2 nx2,p.y2 ny2,p.text nt,p.confidence nc,
   f.y2-f.y1 ch,p.y2-p.y1 nh,least(f.y2-f.y1,p.y2-p.y1) mh,regexp_full_match(trim(f.text),'[\\dIl|!i\\]\\[]') AND regexp_full_match(trim(p.text),'[\\dIl|!i\\]\\[]') sp
  FROM f JOIN p ON {' AND '.join(f'p.{k}=f.{k}' for k in CROP)} AND p.rn=f.rn+1)))
SELECT {_CK},ord,x1,y1,x2,y2,text,confidence,nm FROM (SELECT *, row_number() OVER (PARTITION BY {_CK},grp ORDER BY rn DESC) z FROM f) WHERE z=1)"""


@register("merged_ocr_tokens", duck(f"""
SELECT {_CK},ord,x1,y1,x2,y2,text,confidence,nm AS n_merged FROM {{ocrm_}}""", {"ocrt_": OCR, "ocrm_": OCR_MERGE}))
def _(c):
    return folds.merge_ocr_tokens(c.sql(OCR), CROP)


@register("ocr_candidate_tokens", duck(f"""
SELECT {_CK},ord,text,'raw' AS source FROM {{ocrt_}} UNION ALL SELECT {_CK},ord,text,'merged' FROM {{ocrm_}} WHERE nm>1""",
    {"ocrt_": OCR, "ocrm_": OCR_MERGE}))
def _(c):
    return folds.candidate_tokens(c.sql(OCR), CROP).select(*CROP, "ord", "text", "source")
