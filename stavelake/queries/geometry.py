"""Scalar geometry and text functions over detections, pages and OCR tokens."""

from pyspark.sql import functions as F

from ..fixtures import duck
from ..functions import geometry as g
from ..functions import text as tx
from ..functions.text import LABEL_WORDS
from . import register
from .sqltext import expand, iou, overlap_max, rint, trunc

R6 = lambda c: F.round(c, 6)


@register("box_extents", duck("""
SELECT det_id, x2-x1 AS w, y2-y1 AS h, (x1+x2)/2e0 AS cx, (y1+y2)/2e0 AS cy,
 least(x1,x2-det_id%9) AS ox1, greatest(x1,x2-det_id%9) AS ox2
FROM {f_barline}"""))
def _(c):
    b = g.box()
    swapped = g.ordered(g.Box(b.x1, b.y1, b.x2 - F.col("det_id") % 9, b.y2))
    return c["f_barline"].select(
        "det_id", g.width(b).alias("w"), g.height(b).alias("h"), g.center_x(b).alias("cx"),
        g.center_y(b).alias("cy"), swapped.x1.alias("ox1"), swapped.x2.alias("ox2"))


_E = expand()


@register("expanded_boxes", duck(f"""
SELECT det_id, {_E[0]} AS ex1, {_E[1]} AS ey1, {_E[2]} AS ex2, {_E[3]} AS ey2,
 least({_E[0]},999) AS bx1,
 greatest(least({rint('(x1+x2)/2e0+greatest(greatest(1,x2-x1)/2e0,6e0)')}+3,999),least({_E[0]},999)+1) AS bx2
FROM {{f_barline}}"""))
def _(c):
    e, b = g.expand_box(g.box()), g.expand_box(g.box(), bounds=(1000, 1100))
    return c["f_barline"].select(
        "det_id", e.x1.alias("ex1"), e.y1.alias("ey1"), e.x2.alias("ex2"), e.y2.alias("ey2"),
        b.x1.alias("bx1"), b.x2.alias("bx2"))


_PAIR = """
SELECT a.det_id, a.score_id, a.page_index, a.x1 a_x1,a.y1 a_y1,a.x2 a_x2,a.y2 a_y2,
 b.x1 b_x1,b.y1 b_y1,b.x2 b_x2,b.y2 b_y2
FROM {f_barline} a JOIN {f_detection} b ON a.det_id=b.det_id AND b.source='omr'"""
_EA, _EB = expand("a_"), expand("b_")
_P = (", ".join(f"{e} ea_{n}" for e, n in zip(_EA, ("x1", "y1", "x2", "y2"))) + ", "
      + ", ".join(f"{e} eb_{n}" for e, n in zip(_EB, ("x1", "y1", "x2", "y2"))))


@register("detection_overlaps", duck(f"""
SELECT det_id, round({iou('ea_', 'eb_')},6) AS iou,
 round({overlap_max('a_y1', 'a_y2', 'b_y1', 'b_y2')},6) AS v_overlap,
 round(greatest(0,least(a_x2,b_x2)-greatest(a_x1,b_x1))/CAST(greatest(1,least(a_x2-a_x1,b_x2-b_x1)) AS DOUBLE),6) AS x_overlap,
 round(greatest(0,least(a_x2,b_x2)-greatest(a_x1,b_x1))*greatest(0,least(a_y2,b_y2)-greatest(a_y1,b_y1))
  /CAST(least(greatest(1,(a_x2-a_x1)*(a_y2-a_y1)),greatest(1,(b_x2-b_x1)*(b_y2-b_y1))) AS DOUBLE),6) AS area_overlap,
 round(abs((a_y1+a_y2)/2e0-(b_y1+b_y2)/2e0)/greatest(1,a_y2-a_y1,b_y2-b_y1),6) AS center_ratio,
 (least(a_y2,b_y2)>greatest(a_y1,b_y1) AND abs((a_y1+a_y2)/2e0-(b_y1+b_y2)/2e0)/greatest(1,a_y2-a_y1,b_y2-b_y1)<=0.5) AS is_match,
 round(greatest(0e0,least(b_y2,a_y2)-greatest(b_y1,a_y1))/greatest(1e0,greatest(1e0,b_y2-b_y1)+greatest(1e0,a_y2-a_y1)
   -greatest(0e0,least(b_y2,a_y2)-greatest(b_y1,a_y1))),6) AS band_iou,
 round(greatest(0,least(a_y2,b_y2)-greatest(a_y1,b_y1))/CAST(greatest(1,a_y2-a_y1) AS DOUBLE),6) AS own_overlap
FROM (SELECT *, {_P} FROM pairs_)""".replace("pairs_", "{pairs_}"), {"pairs_": _PAIR}))
def _(c):
    a, b = g.box("a_"), g.box("b_")
    return c.sql(_PAIR).select(
        "det_id", R6(g.iou(a, b)).alias("iou"), R6(g.vertical_overlap(a, b)).alias("v_overlap"),
        R6(g.axis_overlap(a, b, "x")).alias("x_overlap"),
        R6(g.min_area_overlap(a, b)).alias("area_overlap"),
        R6(g.center_distance_ratio(a, b)).alias("center_ratio"),
        g.staff_match(a, b).alias("is_match"), R6(g.band_iou(a, b.y1, b.y2)).alias("band_iou"),
        R6(g.candidate_overlap(a, b.y1, b.y2)).alias("own_overlap"))


# boxes pushed partly outside a 1000 x 500 image
_CLIP = """SELECT det_id, x1+CAST(det_id%3 AS INT)*400-300 x1, y1-150 y1, x2+CAST(det_id%3 AS INT)*400-300 x2,
 y2-150-CAST(det_id%5 AS INT)*12 y2 FROM {f_barline}"""


@register("clipped_boxes", duck("""
SELECT det_id, x1, y1, x2, y2 FROM (
 SELECT det_id, a x1, b y1, CASE WHEN c<=a THEN least(1000,a+1) ELSE c END x2,
  CASE WHEN d<=b THEN least(500,b+1) ELSE d END y2
 FROM (SELECT det_id, greatest(0,least(999,x1)) a, greatest(0,least(499,y1)) b,
   greatest(0,least(1000,x2)) c, greatest(0,least(500,y2)) d FROM {clip_}))
WHERE x2>x1 AND y2>y1""", {"clip_": _CLIP}))
def _(c):
    return c.sql(_CLIP).select("det_id", g.clip_box(g.box(), 1000, 500).alias("b")).where(
        "b IS NOT NULL").select("det_id", "b.*")


@register("frame_transforms", duck(f"""
SELECT det_id, greatest(0,least(1199,{rint('x1*(1e0/0.75)+15')})) AS ox1,
 greatest(0,least(899,{rint('y1*(1e0/0.5)+25')})) AS oy1,
 greatest(greatest(0,least(1199,{rint('x1*(1e0/0.75)+15')})),greatest(0,least(1199,{rint('x2*(1e0/0.75)+15')}))) AS ox2,
 greatest(greatest(0,least(899,{rint('y1*(1e0/0.5)+25')})),greatest(0,least(899,{rint('y2*(1e0/0.5)+25')}))) AS oy2,
 {trunc('x1/4e0')} AS down_x1, {trunc('y2/4e0')} AS down_y2,
 {rint('x2*2.5e0')} AS up_x2, {rint('y1*2.5e0')} AS up_y1
FROM {{f_barline}}"""))
def _(c):
    b = g.box()
    o = g.to_original(b, 15, 25, 0.75, 0.5, 1200, 900)
    d, u = g.downscale(b, 4), g.upscale(b, 2.5)
    return c["f_barline"].select(
        "det_id", o.x1.alias("ox1"), o.y1.alias("oy1"), o.x2.alias("ox2"), o.y2.alias("oy2"),
        d.x1.alias("down_x1"), d.y2.alias("down_y2"), u.x2.alias("up_x2"), u.y1.alias("up_y1"))


@register("measure_bar_boxes", duck("""
SELECT score_id,page_index,staff_index,0 side,x1-2 x1,y1,x1+2 x2,y2 FROM {f_staff}
UNION ALL SELECT score_id,page_index,staff_index,1,x2-2,y1,x2+2,y2 FROM {f_staff}"""))
def _(c):
    return c["f_staff"].select(
        "score_id", "page_index", "staff_index",
        F.posexplode(g.measure_bars(g.box())).alias("side", "b")).select(
        "score_id", "page_index", "staff_index", "side", "b.*")


_CH = rint("greatest(1,abs(y2-y1-det_id%60))*3e0")


@register("crop_sizes", duck(f"""
SELECT det_id, greatest(16,least(128,{rint('ch*0.5e0')})) AS w, ch AS h FROM (
 SELECT det_id, greatest(48,least(256,{_CH})) ch FROM {{f_barline}})"""))
def _(c):
    b = g.box()
    s = g.crop_size(g.Box(b.x1, b.y1, b.x2, b.y2 - F.col("det_id") % 60))
    return c["f_barline"].select("det_id", s.alias("s")).select("det_id", "s.*")


_SCALE = """SELECT doc_id, page_number, width_px ow, height_px oh,
 width_px*(1+page_number%4)+(page_number%3)*150 sw, height_px*(1+page_number%4)+(page_number%7)*40 sh
FROM {f_page_dim}"""


@register("inferred_scales", duck(f"""
SELECT doc_id, page_number, CASE WHEN v IS NULL THEN s END AS scale, v AS violation FROM (
 SELECT *, CASE WHEN s<2 OR abs(sw/oh0-s)>0.05 THEN 'unexpected_x_scale'
   WHEN abs(CAST(sh AS DOUBLE)/oh-s)>0.05 THEN 'unexpected_y_scale' END v FROM (
  SELECT *, CAST(ow AS DOUBLE) oh0, {rint('CAST(sw AS DOUBLE)/ow')} s FROM {{scale_}}))""",
    {"scale_": _SCALE}))
def _(c):
    s = g.inferred_scale(F.col("sw"), F.col("sh"), F.col("ow"), F.col("oh"))
    return c.sql(_SCALE).select("doc_id", "page_number", s.alias("s")).select(
        "doc_id", "page_number", "s.*")


_UN = """SELECT det_id, x1, y1-CAST(det_id%30 AS INT) y1, x2, y2, 10e0+CAST(det_id%3 AS INT) unit FROM {f_barline}"""


@register("unit_normalized_boxes", duck(f"""
WITH p AS (SELECT *, x2-x1 w, y2-y1 h, greatest(2,{rint('unit*1.0e0')}) nw, greatest(4,{rint('unit*4.0e0')}) nh,
  greatest(1,{rint('unit*1.2e0')}) aw, greatest(1,{rint('unit*4.6e0')}) ah, greatest(1,{rint('unit*2.5e0')}) mh FROM {{un_}}),
q AS (SELECT *, CASE WHEN w>aw THEN nw ELSE w END a, CASE WHEN h>ah THEN nh ELSE h END b FROM p
 WHERE h>=mh AND w>0 AND h/CAST(greatest(1,w) AS DOUBLE)>=3 AND (w>aw OR h>ah)),
r AS (SELECT det_id, x1 o1,y1 o2,x2 o3,y2 o4, greatest(0,least(1299,{rint('(x1+x2)/2e0-a/2e0')})) x1, greatest(0,least(1099,{rint('(y1+y2)/2e0-b/2e0')})) y1,
 greatest(0,least(1300,{rint('(x1+x2)/2e0+a/2e0')})) x2, greatest(0,least(1100,{rint('(y1+y2)/2e0+b/2e0')})) y2 FROM q)
SELECT det_id,x1,y1,x2,y2 FROM r WHERE NOT (x1=o1 AND y1=o2 AND x2=o3 AND y2=o4)""".replace("WITH p AS", "SELECT * FROM (WITH p AS", 1) + ")",
    {"un_": _UN.replace("10e0", "CAST(10 AS DOUBLE)")}))
def _(c):
    return c.sql(_UN.replace("10e0", "CAST(10 AS DOUBLE)")).select(
        "det_id", g.unit_normalized(g.box(), F.col("unit"), 1300, 1100).alias("b")).where(
        "b IS NOT NULL").select("det_id", "b.*")


_SU = """SELECT score_id,page_index,staff_index,x1,y1,x2,y2-staff_index%3 y2,
 CASE WHEN score_id%5=0 THEN NULL WHEN score_id%5=1 THEN CAST(-1 AS DOUBLE)
      WHEN score_id%5=2 AND staff_index%2=0 THEN NULL ELSE unit_size+staff_index END unit_size FROM {f_staff}"""


@register("staff_units", duck("""
SELECT score_id,page_index,staff_index, CASE WHEN unit_size>0 THEN unit_size ELSE (y2-y1)/4e0 END AS unit
FROM {su_}""", {"su_": _SU}))
def _(c):
    return c.sql(_SU).select("score_id", "page_index", "staff_index",
                             g.staff_unit(F.col("unit_size"), g.box()).alias("unit"))


@register("page_units", duck("""
SELECT score_id,page_index, coalesce(quantile_cont(CASE WHEN unit_size>0 THEN unit_size END,0.5),
 quantile_cont(CAST(y2-y1 AS DOUBLE),0.5)/4e0) AS unit FROM {su_} GROUP BY 1,2""", {"su_": _SU}))
def _(c):
    return c.sql(_SU).groupBy("score_id", "page_index").agg(
        g.system_unit_agg(F.col("unit_size"), g.box()).alias("unit"))


@register("seed_units", duck(f"""
SELECT score_id,page_index,unit, greatest(1,{rint('unit*0.3')}) AS min_peak_distance,
 greatest(0,{rint('unit*0.45')}) AS x_domain_pad FROM (
 SELECT score_id,page_index,greatest(1e0,quantile_cont(CASE WHEN h>0 THEN CAST(h AS DOUBLE) END,0.5)/4e0) unit
 FROM (SELECT *, abs(y2-y1-CASE WHEN det_id%3=0 THEN y2-y1 ELSE 0 END) h FROM {{f_barline}}) GROUP BY 1,2
 HAVING max(h)>0)
UNION ALL SELECT score_id,page_index,NULL,NULL,NULL FROM {{f_barline}} GROUP BY 1,2
 HAVING max(CASE WHEN det_id%3=0 THEN 0 ELSE y2-y1 END)=0"""))
def _(c):
    b = g.box()
    flat = F.when(F.col("det_id") % 3 == 0, b.y1).otherwise(b.y2)
    u = c["f_barline"].groupBy("score_id", "page_index").agg(
        g.seed_unit_agg(g.Box(b.x1, b.y1, b.x2, flat)).alias("unit"))
    return u.select("score_id", "page_index", "unit",
                    g.scaled_knob(F.col("unit"), 0.3, 1).alias("min_peak_distance"),
                    g.scaled_knob(F.col("unit"), 0.45, 0).alias("x_domain_pad"))


_PK = """SELECT score_id,page_index,staff_index,
 CASE staff_index%5 WHEN 0 THEN concat('(',CAST(staff_index-1 AS VARCHAR(9)),', ',CAST(staff_index AS VARCHAR(9)),')')
  WHEN 1 THEN concat('[',CAST(staff_index-1 AS VARCHAR(9)),',',CAST(staff_index AS VARCHAR(9)),']')
  WHEN 2 THEN concat(CAST(staff_index-1 AS VARCHAR(9)),'-',CAST(staff_index AS VARCHAR(9)))
  WHEN 3 THEN concat(CAST(staff_index AS VARCHAR(9)),',x') ELSE CAST(staff_index AS VARCHAR(9)) END pair_key, present
FROM {f_connector}"""


@register("staff_pair_keys", duck("""
SELECT score_id,page_index,staff_index,CAST(CASE WHEN staff_index%5<3 THEN staff_index-1 END AS INT) AS upper,
 CAST(CASE WHEN staff_index%5<3 THEN staff_index END AS INT) AS lower FROM {f_connector}"""))
def _(c):
    return c.sql(_PK).select("score_id", "page_index", "staff_index",
                             tx.staff_pair(F.col("pair_key")).alias("p")).select(
        "score_id", "page_index", "staff_index", "p.upper", "p.lower")


_CE = """SELECT score_id,page_index,staff_index,
 CASE WHEN score_id%6=0 THEN present END as_bool,
 CASE WHEN score_id%6=1 THEN page_index%3-1 END as_number,
 CASE WHEN score_id%6=2 THEN present END left_key,
 CASE WHEN score_id%6<=3 THEN NOT present END brace_key,
 CASE WHEN page_index%2=0 THEN CAST(page_index AS DOUBLE)/CAST(160 AS DOUBLE) END d1,
 CASE WHEN page_index%3=0 THEN CAST(staff_index AS DOUBLE)/CAST(100 AS DOUBLE) END d2 FROM {f_connector}"""


@register("connector_precedence", duck("""
SELECT score_id,page_index,staff_index, CASE WHEN as_bool IS NOT NULL THEN as_bool
 WHEN as_number IS NOT NULL THEN as_number>0 WHEN left_key IS NOT NULL THEN left_key
 WHEN brace_key IS NOT NULL THEN brace_key
 ELSE (coalesce(d1,0)>=0.05 OR coalesce(d2,0)>=0.05) END AS present FROM {ce_}""", {"ce_": _CE}))
def _(c):
    return c.sql(_CE).select(
        "score_id", "page_index", "staff_index",
        tx.connector_present(F.col("as_bool"), F.col("as_number"), F.col("left_key"),
                             F.col("brace_key"), F.col("d1"), F.col("d2")).alias("present"))


def _clipx(e, hi):
    return f"greatest(0,least({hi},{rint(e)}))"


@register("connector_regions", duck(f"""
SELECT score_id,page_index,staff_index,a AS x1,b AS y1,CASE WHEN c<=a THEN least(650,a+1) ELSE c END AS x2,
 CASE WHEN d<=b THEN least(2200,b+1) ELSE d END AS y2 FROM (
 SELECT l.score_id,l.page_index,l.staff_index,
  {_clipx("(least(u.x1,l.x1)-greatest(1e0,(u.y2-u.y1+l.y2-l.y1)/2e0)*0.65e0)*0.5e0", 650)} a,
  {_clipx("(least(u.x1,l.x1)+greatest(1e0,(u.y2-u.y1+l.y2-l.y1)/2e0)*0.80e0)*0.5e0", 650)} c,
  {_clipx("u.y2*2e0", 2200)} b, {_clipx("l.y1*2e0", 2200)} d
 FROM {{f_staff}} u JOIN {{f_staff}} l ON u.score_id=l.score_id AND u.page_index=l.page_index AND l.staff_index=u.staff_index+1)"""))
def _(c):
    from pyspark.sql import Window

    w = Window.partitionBy("score_id", "page_index").orderBy("staff_index")
    s = c["f_staff"].select("*", *(F.lag(n).over(w).alias(f"u_{n}") for n in g.BOX),
                            F.lag("staff_index").over(w).alias("u_idx"))
    s = s.where("u_idx = staff_index - 1")
    r = g.connector_roi(g.box("u_"), g.box(), 1300, 1100, 650, 2200)
    return s.select("score_id", "page_index", "staff_index",
                    *(v.alias(n) for v, n in zip(r, g.BOX)))


_NUMS = """CASE WHEN regexp_matches(lower(text),'@WORDS@')
 THEN list_filter(list_transform(regexp_split_to_array(regexp_replace(cleaned,'[0-9]*[A-Za-z]+[0-9]*','#','g'),'[^0-9]+'), lambda s: s), lambda s: s<>'')
 ELSE regexp_extract_all(cleaned,'\\d+') END""".replace("@WORDS@", "(" + "|".join(LABEL_WORDS).lower() + ")")
_CLEAN = """regexp_replace(regexp_replace(text,'^[EP](\\d)','\\1'),'[.,;]','','g')"""
OCR_NUMS = f"""SELECT *, {_NUMS} nums FROM (SELECT *, {_CLEAN} cleaned FROM {{f_ocr_token}})"""


@register("ocr_numbers", duck("""
SELECT ord, unnest(nums) AS digits FROM {ocr_}""", {"ocr_": OCR_NUMS}))
def _(c):
    return c["f_ocr_token"].select("ord", F.explode(tx.numbers_in(F.col("text"))).alias("digits"))


OCR_SCORED = """SELECT *, CASE WHEN val>=2 THEN 100-abs((x1+x2)/2e0-w/2e0)/w*200-abs((y1+y2)/2e0-h/2e0)/h*100
 +CASE WHEN (y2-y1)/CAST(h AS DOUBLE) BETWEEN 0.4 AND 0.95 THEN 20 WHEN (y2-y1)/CAST(h AS DOUBLE)<0.3 THEN -30 ELSE 0 END
 -CASE WHEN contains(text,'=') AND contains(split_part(text,'=',2),digits) THEN 80 ELSE 0 END
 -CASE WHEN val>100 THEN 50 ELSE 0 END-CASE WHEN val>20 AND w<100 THEN 200 ELSE 0 END END score
 FROM (SELECT *, CAST(digits AS INT) val, CAST(90+score_id%3*30 AS INT) w, 100 h FROM
  (SELECT *, unnest(nums) digits FROM {ocr_}))"""


@register("ocr_number_scores", duck("""
SELECT ord, val AS val, round(score,6) AS score FROM {scored_} WHERE score IS NOT NULL""",
    {"ocr_": OCR_NUMS, "scored_": OCR_SCORED}))
def _(c):
    t = c["f_ocr_token"].select(
        "*", (90 + F.col("score_id") % 3 * 30).alias("w"), F.lit(100).alias("h"),
        F.explode(tx.numbers_in(F.col("text"))).alias("digits"))
    t = t.withColumn("val", F.col("digits").cast("int"))
    s = tx.number_score(F.col("val"), F.col("digits"), F.col("text"), g.box(), F.col("w"), F.col("h"))
    return t.select("ord", "val", R6(s).alias("score")).where("score IS NOT NULL")


_RB = """SELECT det_id, x1, y1, x1+1+CAST(det_id%700 AS INT) x2, y2 FROM {f_barline}"""
_DX = f"least(x2-x1-1,greatest(1,{rint('(x2-x1)*0.01e0')}))"
_IN = f"least(greatest(1,{rint('(x2-x1)*0.0025e0')}),CAST(floor((x2-x1-1)/2e0) AS INT))"


@register("retry_boxes", duck(f"""
SELECT det_id, CASE WHEN x2-x1<=1 THEN x1 ELSE x1+{_DX} END AS shifted_x1,
 CASE WHEN x2-x1>2 AND x1+{_IN}<x2-{_IN} THEN x1+{_IN} ELSE x1 END AS inset_x1,
 CASE WHEN x2-x1>2 AND x1+{_IN}<x2-{_IN} THEN x2-{_IN} ELSE x2 END AS inset_x2 FROM {{rb_}}""", {"rb_": _RB}))
def _(c):
    s, i = g.shifted_retry(g.box()), g.inset_retry(g.box())
    return c.sql(_RB).select("det_id", s.x1.alias("shifted_x1"), i.x1.alias("inset_x1"),
                             i.x2.alias("inset_x2"))


_PS = """SELECT doc_id,page_number,width_px,height_px,
 CASE WHEN page_number%3=0 THEN CAST(595 AS DOUBLE)+doc_id END pw, CASE WHEN page_number%3=0 THEN CAST(842 AS DOUBLE) END ph,
 CASE WHEN page_number%3=1 THEN CAST(150*(page_number%4) AS DOUBLE) END dx, CASE WHEN page_number%3=1 THEN CAST(200 AS DOUBLE) END dy
FROM {f_page_dim}"""


@register("physical_page_sizes", duck("""
SELECT doc_id,page_number, round(CASE WHEN pw IS NOT NULL THEN pw WHEN dx>0 AND dy>0 THEN width_px*72e0/dx ELSE width_px*72e0/300 END,6) AS width_pt,
 round(CASE WHEN pw IS NOT NULL THEN ph WHEN dx>0 AND dy>0 THEN height_px*72e0/dy ELSE height_px*72e0/300 END,6) AS height_pt,
 CASE WHEN pw IS NOT NULL THEN NULL WHEN dx>0 AND dy>0 THEN NULL ELSE 'assumed_300_dpi' END AS warning FROM {ps_}""", {"ps_": _PS}))
def _(c):
    s = g.physical_size(*(F.col(n) for n in ("pw", "ph", "dx", "dy", "width_px", "height_px")))
    return c.sql(_PS).select("doc_id", "page_number", s.alias("s")).select(
        "doc_id", "page_number", R6(F.col("s.width_pt")).alias("width_pt"),
        R6(F.col("s.height_pt")).alias("height_pt"), "s.warning")


_NAMES = """SELECT 'doc' kind, doc_id id, text nm FROM {documents} UNION ALL SELECT 'url', page_id, url FROM {pages}
 UNION ALL SELECT 'part', p_partkey, p_name FROM {part}
 UNION ALL SELECT 'dot', s_suppkey, CASE CAST(s_suppkey%3 AS INT) WHEN 0 THEN '..' WHEN 1 THEN '  ' ELSE s_name END FROM {supplier}"""


@register("safe_names", duck("""
SELECT kind,id,(trim(nm)<>'' AND nm NOT IN ('.','..') AND NOT regexp_matches(nm,'[/\\\\\\x00-\\x1f\\x7f]')
 AND octet_length(encode(nm))<=200) AS safe FROM {names_}""", {"names_": _NAMES}))
def _(c):
    return c.sql(_NAMES).select("kind", "id", tx.safe_name(F.col("nm")).alias("safe"))


_JS = """SELECT l_orderkey*10000000000+l_partkey*100000+l_suppkey*10+l_linenumber id,
 CASE CAST(l_partkey%7 AS INT) WHEN 0 THEN 'true' WHEN 1 THEN '3.0' WHEN 2 THEN '2.5' WHEN 3 THEN '"7"' WHEN 4 THEN '-4'
  WHEN 5 THEN '"x"' ELSE CAST(l_suppkey AS VARCHAR(9)) END js, CAST(l_partkey%7 AS INT) k, l_suppkey v FROM {lineitem}"""


@register("strict_integers", duck("""
SELECT id, CAST(CASE k WHEN 1 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN -4 WHEN 6 THEN v END AS BIGINT) AS boundary_int,
 CAST(CASE k WHEN 6 THEN v END AS BIGINT) AS contract_int,
 CAST(CASE k WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 7 WHEN 4 THEN -4 WHEN 6 THEN v END AS INT) AS lenient_int
FROM {js_}""", {"js_": _JS}))
def _(c):
    v = F.try_parse_json(F.col("js"))
    return c.sql(_JS).select(
        "id", tx.boundary_int(v).alias("boundary_int"), tx.contract_int(v).alias("contract_int"),
        tx.lenient_int(F.try_variant_get(v, "$", "string")).alias("lenient_int"))


@register("span_to_skip", duck("""
SELECT ord, CAST(CASE WHEN skip>=1 THEN skip-1 END AS INT) AS skip,
 CASE WHEN skip<1 THEN 'measure_span_below_one' END AS violation FROM {f_override} WHERE op='set_measure_span'"""))
def _(c):
    s = tx.span_to_skip(F.col("skip"))
    return c["f_override"].where("op = 'set_measure_span'").select(
        "ord", s.alias("skip"), F.when(s.isNull(), "measure_span_below_one").alias("violation"))
