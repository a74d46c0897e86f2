"""Number votes and multi-measure-rest decisions over stored OCR tokens."""

from pyspark.sql import functions as F

from ..fixtures import duck
from ..functions.text import LABEL_WORDS
from ..operators import votes
from ..operators.readings import crop_readings
from ..session import materialize
from . import register
from .folds import CROP, OCR, OCR_MERGE

M = ["score_id", "page_index", "system", "measure"]
MK = ",".join(M)
CK = ",".join(CROP)
R6 = lambda c: F.round(c, 6)

_NUMS = """CASE WHEN regexp_matches(lower(text),'@WORDS@')
 THEN list_filter(regexp_split_to_array(regexp_replace(cleaned,'[0-9]*[A-Za-z]+[0-9]*','#','g'),'[^0-9]+'), lambda s: s<>'')
 ELSE regexp_extract_all(cleaned,'\\d+') END""".replace("@WORDS@", "(" + "|".join(LABEL_WORDS).lower() + ")")
V = {
    "ocrt_": OCR,
    "ocrm_": OCR_MERGE,
    "v_tok": f"SELECT {CK},ord,x1,y1,x2,y2,text,confidence,0 src FROM {{ocrt_}} UNION ALL SELECT {CK},ord,x1,y1,x2,y2,text,confidence,1 FROM {{ocrm_}} WHERE nm>1",
    "v_num": f"""SELECT *, TRY_CAST(digits AS INT) val FROM (SELECT *, unnest(nums) digits, unnest(range(len(nums))) pos FROM (SELECT *, {_NUMS} nums FROM
      (SELECT *, regexp_replace(regexp_replace(text,'^[EP](\\d)','\\1'),'[.,;]','','g') cleaned, CAST(90+score_id%3*30 AS INT) w, 100 h FROM {{v_tok}})))""",
    "v_cand": """SELECT *, CASE WHEN val>=2 THEN 100-abs((x1+x2)/2e0-w/2e0)/w*200-abs((y1+y2)/2e0-h/2e0)/h*100
 +CASE WHEN (y2-y1)/CAST(h AS DOUBLE) BETWEEN 0.4 AND 0.95 THEN 20 WHEN (y2-y1)/CAST(h AS DOUBLE)<0.3 THEN -30 ELSE 0 END
 -CASE WHEN contains(text,'=') AND contains(split_part(text,'=',2),digits) THEN 80 ELSE 0 END
 -CASE WHEN val>100 THEN 50 ELSE 0 END-CASE WHEN val>20 AND w<100 THEN 200 ELSE 0 END END score FROM {v_num}""",
    "v_best": f"""SELECT {CK},val,score,w FROM (SELECT *, row_number() OVER (PARTITION BY {CK} ORDER BY score DESC,src,ord,pos) rn FROM {{v_cand}} WHERE score IS NOT NULL) WHERE rn=1""",
    "v_res": f"SELECT b.*, p.prob FROM {{v_best}} b JOIN {{f_measure_prob}} p USING ({MK})",
    "v_cnt": f"""SELECT *, count(*) OVER (PARTITION BY {MK},view_name,val) n, min(staff) OVER (PARTITION BY {MK},view_name,val) fs FROM {{v_res}}""",
    "v_lead": f"""SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY {MK},view_name) m FROM {{v_cnt}}) WHERE n=m""",
    "v_tie": f"""SELECT {MK},view_name,count(DISTINCT val)>1 tied,max(prob) prob,max(w) w,bool_or(val<=20) sm FROM {{v_lead}} GROUP BY ALL""",
    "v_staff": f"""SELECT {MK},view_name,val,max(score) FILTER (WHERE true) OVER (PARTITION BY {MK},view_name,val) sc,tied,w,rn FROM (
      SELECT l.*, t.tied, row_number() OVER (PARTITION BY {MK},view_name ORDER BY
       CASE WHEN t.tied AND t.prob>0.5 THEN (CASE WHEN t.w<100 AND t.sm AND l.val>20 THEN 1e9 ELSE -l.score END) ELSE l.fs END, l.staff) rn
      FROM {{v_lead}} l JOIN {{v_tie}} t USING ({MK},view_name))""",
    "v_view": f"SELECT {MK},view_name,val,sc,tied,w FROM {{v_staff}} WHERE rn=1",
    "v_ok": f"""SELECT *, CASE view_name WHEN 'standard' THEN 0 WHEN 'no_dilate' THEN 1 ELSE 2 END vo FROM {{v_view}} WHERE NOT (val>20 AND w<100)""",
    "v_maj": f"""SELECT {MK},val,n,tot,ms FROM (SELECT *, row_number() OVER (PARTITION BY {MK} ORDER BY n DESC,fo) rn FROM (
      SELECT {MK},val,count(*) n,min(vo) fo,max(sc) ms,sum(count(*)) OVER (PARTITION BY {MK}) tot FROM {{v_ok}} GROUP BY {MK},val)) WHERE rn=1""",
    "v_conf": f"SELECT {MK},bool_or(tied) conflict FROM {{v_view}} GROUP BY ALL",
    "v_top": f"SELECT {MK},val,sc FROM (SELECT *, row_number() OVER (PARTITION BY {MK} ORDER BY sc DESC,vo) rn FROM {{v_ok}}) WHERE rn=1",
    "v_var": f"""SELECT {MK},CASE WHEN conflict AND n>=2 AND n>tot/2e0 THEN m.val ELSE t.val END val,CASE WHEN conflict AND n>=2 AND n>tot/2e0 THEN ms ELSE t.sc END sc,conflict
      FROM {{v_top}} t JOIN {{v_maj}} m USING ({MK}) JOIN {{v_conf}} USING ({MK})""",
    "v_evid": f"""SELECT {MK},max(n) evidence FROM (SELECT {MK},view_name,count(*) n FROM {{v_num}} a WHERE val=1 AND confidence>=0.8 AND NOT (src=0 AND EXISTS (
      SELECT 1 FROM {{v_num}} b WHERE b.src=1 AND b.val>=2 AND {' AND '.join(f'a.{k}=b.{k}' for k in CROP)} AND b.x1<=a.x1 AND b.y1<=a.y1 AND a.x2<=b.x2 AND a.y2<=b.y2)) GROUP BY ALL) GROUP BY {MK}""",
}


def candidates(c):
    t = c.sql(OCR).withColumns({"w": (90 + F.col("score_id") % 3 * 30).cast("int"), "h": F.lit(100)})
    return votes.number_candidates(t, CROP, "w", "h")


def crops(c):
    return crop_readings(c.sql(OCR), CROP, 90 + F.col("score_id") % 3 * 30, F.lit(100))


def crop_best(c, read=None):
    b = (read if read is not None else crops(c)).where("value IS NOT NULL").drop("ones")
    b = b.join(c["f_measure_prob"], M)
    return b.withColumn("width", (90 + F.col("score_id") % 3 * 30).cast("int"))


def per_view(c, read=None):
    return votes.staff_value(crop_best(c, read), [*M, "view_name"])


def per_measure(c, read=None):
    v = per_view(c, read).withColumn("vo", F.when(F.col("view_name") == "standard", 0).when(
        F.col("view_name") == "no_dilate", 1).otherwise(2))
    return votes.variant_value(v, M, "vo")


@register("best_numbers", duck(f"SELECT {CK},val AS value,round(score,6) AS score FROM {{v_best}}", V))
def _(c):
    return votes.best_number(candidates(c), CROP).withColumn("score", R6(F.col("score")))


@register("unique_staff_leaders", duck(f"""
SELECT {MK},view_name,CASE WHEN count(*)=1 THEN any_value(val) END AS value,CASE WHEN count(*)=1 THEN round(any_value(ms),6) ELSE 0e0 END AS score FROM (
 SELECT *, max(n) OVER (PARTITION BY {MK},view_name) m FROM (SELECT {MK},view_name,val,count(*) n,max(score) ms FROM {{v_res}} GROUP BY ALL)) WHERE n=m GROUP BY {MK},view_name""", V))
def _(c):
    return votes.unique_leader(crop_best(c), [*M, "view_name"], "staff").withColumn("score", R6(F.col("score")))


@register("staff_votes", duck(f"SELECT {MK},view_name,val AS value,round(sc,6) AS score,tied FROM {{v_view}}", V))
def _(c):
    return per_view(c).drop("width").withColumn("score", R6(F.col("score")))


@register("variant_votes", duck(f"SELECT {MK},val AS value,round(sc,6) AS score,conflict FROM {{v_var}}", V))
def _(c):
    return per_measure(c).withColumn("score", R6(F.col("score")))


@register("one_bar_evidence", duck(f"SELECT {MK},evidence FROM {{v_evid}}", V))
def _(c):
    return votes.one_bar_evidence(crops(c), M, "view_name")


_DEC = """CASE WHEN prob>0.1 AND val<>0 THEN CASE WHEN prob>0.5 AND prob<0.6 AND sc<0 AND coalesce(evidence,0)>=2 THEN 'one_bar_veto' WHEN prob>0.5 THEN 'found' WHEN sc>60 THEN 'rescue' END END"""


@register("rest_decisions", duck(f"""
SELECT {MK},{_DEC} AS status,CAST(CASE WHEN {_DEC} IN ('found','rescue') THEN val-1 END AS INT) AS skip
FROM {{f_measure_prob}} p LEFT JOIN {{v_var}} v USING ({MK}) LEFT JOIN {{v_evid}} e USING ({MK})""", V))
def _(c):
    read = materialize(crops(c), "readings")
    j = c["f_measure_prob"].join(per_measure(c, read), M, "left").join(
        votes.one_bar_evidence(read, M, "view_name"), M, "left")
    d = votes.decision(F.col("value"), F.col("prob"), F.col("score"), F.col("evidence"))
    return j.select(*M, d.alias("status"), F.when(d.isin("found", "rescue"), F.col("value") - 1).alias("skip"))


# stored results of jittered and retry crops: one per measure and view
VIEWS = ("baseline", "x_minus", "x_plus", "y_minus", "y_plus", "inset", "calibrated", "full_span", "shifted", "alternate", "fallback")
_CASES = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(VIEWS))
_VT = f"""SELECT {MK},CASE vi {_CASES} END view,vi view_no,CASE WHEN ord%5=0 THEN NULL ELSE CAST(ord%4+CASE WHEN vi=0 THEN 0 ELSE 1 END AS INT) END value,
 CAST(ord%47 AS DOUBLE)-20+CASE WHEN ord%13=0 THEN 60 ELSE 0 END score,CAST(ord%5 AS INT) evidence,ord%6=0 left_wide,CAST(ord%3 AS INT) x1 FROM (
 SELECT {MK},vi,min(ord) ord FROM (SELECT {MK},CAST(ord%11 AS INT) vi,ord FROM {{f_ocr_token}} UNION ALL SELECT {MK},CAST((ord+staff)%5 AS INT),ord FROM {{f_ocr_token}}
  UNION ALL SELECT {MK},0,ord FROM {{f_ocr_token}} UNION ALL SELECT {MK},CAST(1+(ord+measure)%4 AS INT),ord+1 FROM {{f_ocr_token}}) u GROUP BY {MK},vi) q"""
_J2 = {"vt_": _VT,
       "jv_": f"SELECT {MK},value,count(*) n,min(view_no) fo,max(score) ms FROM {{vt_}} WHERE view_no<5 AND value>=2 GROUP BY ALL",
       "jm_": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {MK} ORDER BY n DESC,fo) rn FROM {{jv_}}) WHERE rn=1",
       "j2_": f"""SELECT b.score_id,b.page_index,b.system,b.measure,coalesce(b.value IS NOT NULL AND b.score<=5 AND m.n>=3 AND m.value<>b.value,false) rep,m.value mv,m.ms,b.value bv,b.score bs
        FROM (SELECT * FROM {{vt_}} WHERE view_no=0) b LEFT JOIN {{jm_}} m USING ({MK})"""}


@register("jitter_consensus", duck(f"""
SELECT {MK},CASE WHEN rep THEN mv ELSE bv END AS value,CASE WHEN rep THEN ms ELSE bs END AS score,rep AS replaced FROM {{j2_}}""", _J2))
def _(c):
    return votes.jitter_consensus(c.sql(_VT).where("view_no < 5"), M)


def _wide(c):
    v = c.sql(_VT)
    pick = lambda n, col: F.max(F.when(F.col("view") == n, F.col(col)))
    cols = [pick(n, col).alias(f"{n}_{col}") for n in VIEWS for col in ("value", "score", "evidence", "x1")]
    w = v.groupBy(*M).agg(*cols, pick("baseline", "left_wide").alias("left_wide"))
    return c["f_measure_prob"].join(w, M)


_PIV = ",".join(f"max(CASE WHEN view='{n}' THEN {col} END) {n}_{col}" for n in VIEWS for col in ("value", "score", "evidence", "x1"))
_W = {**_J2, "w_": f"SELECT {MK},{_PIV},bool_or(CASE WHEN view='baseline' THEN left_wide END) left_wide FROM {{vt_}} GROUP BY ALL"}


@register("retry_ladder", duck(f"""
SELECT {MK},CASE WHEN prob<=0.5 OR (prob<0.6 AND baseline_evidence>=2) THEN 'j2' WHEN baseline_value IS NULL AND inset_value>=2 AND inset_score>0 THEN 'inset'
 WHEN baseline_value IS NOT NULL AND baseline_score>5 THEN CASE WHEN left_wide AND calibrated_value>=2 AND calibrated_score>0 THEN 'calibrated' ELSE 'baseline' END
 WHEN full_span_value>=2 AND full_span_score>0 THEN 'full_span' WHEN shifted_value>=2 AND shifted_score>0 THEN 'shifted' WHEN baseline_value IS NULL THEN 'baseline' ELSE 'j2' END AS source
FROM {{w_}} JOIN {{f_measure_prob}} USING ({MK})""", _W))
def _(c):
    w = _wide(c)
    for n in ("value", "score", "evidence"):
        w = w.withColumn(n, F.col(f"baseline_{n}"))
    return w.select(*M, votes.retry_ladder(w).alias("source"))


_SRC = """CASE WHEN prob<=0.5 OR (prob<0.6 AND baseline_evidence>=2) THEN 'j2' WHEN baseline_value IS NULL AND inset_value>=2 AND inset_score>0 THEN 'inset'
 WHEN baseline_value IS NOT NULL AND baseline_score>5 THEN CASE WHEN left_wide AND calibrated_value>=2 AND calibrated_score>0 THEN 'calibrated' ELSE 'baseline' END
 WHEN full_span_value>=2 AND full_span_score>0 THEN 'full_span' WHEN shifted_value>=2 AND shifted_score>0 THEN 'shifted' WHEN baseline_value IS NULL THEN 'baseline' ELSE 'j2' END"""
_OF = lambda k, j2: f"CASE source WHEN 'j2' THEN {j2} " + " ".join(f"WHEN '{n}' THEN {n}_{k}" for n in ("baseline", "inset", "calibrated", "full_span", "shifted")) + " END"


@register("retry_results", duck(f"""
SELECT {MK},source,{_OF("value", "CASE WHEN rep THEN mv ELSE bv END")} AS value,{_OF("score", "CASE WHEN rep THEN ms ELSE bs END")} AS score,
 CASE WHEN source='inset' THEN inset_evidence ELSE baseline_evidence END AS evidence
FROM (SELECT *, {_SRC} source FROM {{w_}} JOIN {{f_measure_prob}} USING ({MK})) LEFT JOIN {{j2_}} USING ({MK})""", _W))
def _(c):
    """Value, score and one-bar evidence of the view that decides each measure."""
    w = _wide(c)
    for n in ("value", "score", "evidence"):
        w = w.withColumn(n, F.col(f"baseline_{n}"))
    j2 = votes.jitter_consensus(c.sql(_VT).where("view_no < 5"), M).select(
        *M, F.col("value").alias("j2_value"), F.col("score").alias("j2_score"))
    w = w.join(j2, M, "left")
    return w.select(*M, votes.retry_result(w).alias("r")).select(*M, "r.*")


def _dec(p):
    return _DEC.replace("val", f"{p}_value").replace("sc<", f"{p}_score<").replace("sc>", f"{p}_score>").replace("evidence", f"{p}_evidence")


@register("support_view_decisions", duck(f"""
SELECT {MK},st AS status,CAST(CASE WHEN st IN ('found','rescue') THEN CASE WHEN baseline_value IS NULL AND prob>0.5 THEN fallback_value ELSE baseline_value END END AS INT) AS value FROM (
SELECT *, CASE WHEN prob<=0.1 THEN NULL WHEN baseline_value IS NULL AND prob>0.5 THEN {_dec('fallback')}
 WHEN {_dec('baseline')} IN ('found','rescue') AND coalesce(alternate_x1<>baseline_x1 AND alternate_value<>0 AND prob>0.5 AND prob<0.6 AND alternate_score<0 AND alternate_evidence>=2,false) THEN 'alternate_veto'
 ELSE {_dec('baseline')} END st FROM {{w_}} JOIN {{f_measure_prob}} USING ({MK}))""", _W))
def _(c):
    w = _wide(c)
    view = lambda n: F.struct(*(F.col(f"{n}_{k}").alias(k) for k in ("x1", "value", "score", "evidence")))
    d = votes.support_decision(F.col("prob"), view("baseline"), view("alternate"), view("fallback"))
    return w.select(*M, d.alias("d")).select(*M, "d.status", "d.value")
