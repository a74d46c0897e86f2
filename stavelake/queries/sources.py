"""Source shapes: page inventory, JSON documents, resolution, identities."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..functions import text as tx
from ..session import shared_dir
from ..sources import io
from . import register
from .layout import PG

_FILES = f"""SELECT score_id,concat('img/',CASE WHEN score_id%4=1 THEN 'scan' ELSE 'page' END,'_',CASE WHEN page_index<9 THEN '00' ELSE '0' END,CAST(page_index+1 AS VARCHAR(9)),
 CASE WHEN score_id%7=2 AND page_index=4 THEN '.tif' ELSE '.png' END) path FROM {{f_page}}
 UNION ALL SELECT score_id,'img/cover.png' FROM {{f_page}} WHERE page_index=0 AND score_id%5=3"""
_IDS = """SELECT score_id,path,row_number() OVER (PARTITION BY score_id ORDER BY path) ordinal,CASE WHEN bool_and(starts_with(split_part(path,'/',-1),'page_')) OVER (PARTITION BY score_id)
 THEN regexp_replace(split_part(path,'/',-1),'\\.[^.]*$','') ELSE concat('page_',lpad(CAST(row_number() OVER (PARTITION BY score_id ORDER BY path) AS VARCHAR),3,'0')) END page_id FROM {files_}"""


@register("page_inventory", duck("SELECT score_id,path,ordinal,page_id FROM {ids_}", {"files_": _FILES, "ids_": _IDS}))
def _(c):
    return io.page_ids(c.sql(_FILES))


@register("limited_pages", duck("SELECT score_id,path,ordinal,page_id FROM {ids_} WHERE ordinal<=5", {"files_": _FILES, "ids_": _IDS}))
def _(c):
    """The first five pages of each score (the page-limit option)."""
    return io.limit_pages(io.page_ids(c.sql(_FILES)), 5)


# one detection document per staff, in three shapes; some malformed
_DR = f"""SELECT {PG},staff_index,x1,y1,x2,y2,CAST(staff_index%3 AS INT) shape,CAST((score_id*3+page_index+staff_index)%13 AS INT) f FROM {{f_staff}}"""
_SCALARS = "CASE WHEN f=1 THEN concat(CAST(x1 AS VARCHAR(9)),'.75') ELSE CAST(x1 AS VARCHAR(9)) END,',',CASE WHEN f=2 THEN 'true' WHEN f=3 THEN '\"9\"' ELSE CAST(y1 AS VARCHAR(9)) END,',',CASE WHEN f=4 THEN CAST(x1-5 AS VARCHAR(9)) WHEN f=5 THEN CAST(x1 AS VARCHAR(9)) ELSE CAST(x2 AS VARCHAR(9)) END,CASE WHEN f=6 THEN '' ELSE concat(',',CAST(y2 AS VARCHAR(9))) END"
_DJ = f"""SELECT {PG},staff_index,CASE WHEN f=7 THEN '[1,' WHEN f=8 THEN '{{{{"boxes":[]}}}}' WHEN f=9 THEN '[]' WHEN shape=0 THEN concat('[[',{_SCALARS},'],[1,2,3,4]]')
 WHEN shape=1 THEN concat('[{{{{"barline_location":[',{_SCALARS},']}}}},{{{{"barline_location":[1,2,3,4]}}}}]') ELSE concat('{{{{"predictions":[{{{{"pred_bbox":[0,0,1,1],"orig_bbox":[',{_SCALARS},']}}}},{{{{"orig_bbox":[1,2,3,4]}}}}]}}}}') END text FROM {{dr_}}"""
IDS = [*KEYS, "staff_index"]
IK = f"{PG},staff_index"
_OK = f"""SELECT {IK},0 pos,x1,y1,CASE WHEN f=5 THEN x1 ELSE x2 END x2,y2 FROM {{dr_}} WHERE f NOT IN (2,3,4,6,7,8,9) UNION ALL SELECT {IK},1,1,2,3,4 FROM {{dr_}} WHERE f NOT IN (2,3,4,6,7,8,9)"""


def _docs(c):
    return c.spark.sql(_DJ, dr_=c.sql(_DR))


@register("detection_documents_strict", duck(_OK, {"dr_": _DR}))
def _(c):
    return io.read_boxes(_docs(c), IDS)[0]


@register("detection_document_violations", duck(f"""
SELECT {IK},CASE f WHEN 7 THEN 'invalid_json' WHEN 8 THEN 'unsupported_shape' WHEN 6 THEN 'four_coordinates_required' WHEN 4 THEN 'reversed_bounds' ELSE 'non_numeric_coordinate' END AS violation
FROM {{dr_}} WHERE f IN (2,3,4,6,7,8)""", {"dr_": _DR}))
def _(c):
    return io.read_boxes(_docs(c), IDS)[1]


@register("detection_documents_tolerant", duck(f"""
SELECT {IK},0 AS pos,x1,CASE WHEN f=3 THEN 9 WHEN f=2 THEN 1 ELSE y1 END AS y1,CASE WHEN f=5 THEN x1 WHEN f=4 THEN x1-5 ELSE x2 END AS x2,y2 FROM {{dr_}} WHERE f NOT IN (6,7,8,9)
UNION ALL SELECT {IK},1,1,2,3,4 FROM {{dr_}} WHERE f NOT IN (7,8,9)""", {"dr_": _DR}))
def _(c):
    return io.read_boxes(_docs(c), IDS, strict=False)[0]


_NJ = f"""SELECT {PG},staff_index,concat('[{{{{"barline_location":',CASE WHEN f%3=0 THEN '[]' WHEN f%3=1 THEN 'null' ELSE concat('[',CAST(x1 AS VARCHAR(9)),',1,2,3]') END,',"orig_bbox":',CASE WHEN f%2=0 THEN '[]' ELSE '[7,7,8,8]' END,
 ',"pred_bbox":[5,5,6,',CAST(y2 AS VARCHAR(9)),']}}}},[1,2,3],[4,3,2,',CAST(y1 AS VARCHAR(9)),'.9]]') text FROM {{dr_}}"""


@register("normalized_bar_documents", duck(f"""
SELECT {IK},0 AS pos,CASE WHEN f%3=2 THEN x1 WHEN f%2=1 THEN 7 ELSE 5 END AS x1,CASE WHEN f%3=2 THEN 1 WHEN f%2=1 THEN 7 ELSE 5 END AS y1,CASE WHEN f%3=2 THEN 2 WHEN f%2=1 THEN 8 ELSE 6 END AS x2,CASE WHEN f%3=2 THEN 3 WHEN f%2=1 THEN 8 ELSE y2 END AS y2 FROM {{dr_}}
UNION ALL SELECT {IK},2,4,3,2,y1 FROM {{dr_}}""", {"dr_": _DR}))
def _(c):
    return io.normalize_bars(c.spark.sql(_NJ, dr_=c.sql(_DR)), IDS)


_OJ = f"""SELECT {PG},ord,CAST(ord%9 AS INT) f,system,measure,skip,set_number,concat('{{{{"',CASE WHEN ord%9=1 THEN 'overrides' ELSE 'measure_overrides' END,'":[{{{{"page":',CAST(page_index AS VARCHAR(9)),',"system":',CASE WHEN ord%9=2 THEN '"first"' WHEN ord%9=3 THEN concat('"',CAST(system AS VARCHAR(9)),'"') ELSE CAST(system AS VARCHAR(9)) END,
 ',"measure":',CAST(measure AS VARCHAR(9)),',"skip":',CASE WHEN ord%9=4 THEN concat(CAST(skip AS VARCHAR(9)),'.9') ELSE CAST(skip AS VARCHAR(9)) END,CASE WHEN set_number IS NULL THEN ',"set_number":null' ELSE concat(',"set_number":',CAST(set_number AS VARCHAR(9))) END,CASE WHEN force_measure THEN ',"force_measure":true' ELSE '' END,'}}}},7]}}}}') text FROM {{f_override}}"""


@register("override_documents", duck(f"""
SELECT {PG},ord,0 AS pos,page_index AS page,CASE WHEN ord%9<>2 THEN system END AS system,CASE WHEN ord%9=2 THEN 'first' END AS system_text,measure,skip,set_number,force_measure FROM {{f_override}}"""))
def _(c):
    d = c.spark.sql(_OJ, f_override=c["f_override"])
    return io.read_overrides(d, [*KEYS, "ord"]).drop("page_text", "measure_text", "skip_text", "set_number_text")


@register("progress_jsonl_roundtrip", duck("""
SELECT CAST(job_id AS VARCHAR) AS job_id,CAST(sequence AS BIGINT) AS sequence,kind,stage_id,CAST(completed_units AS BIGINT) AS completed_units FROM {f_progress}"""))
def _(c):
    import uuid

    path = f"{shared_dir(c.spark, 'tables')}/progress-{uuid.uuid4().hex}"
    io.write_jsonl(c["f_progress"].withColumn("job_id", F.col("job_id").cast("string")), path)
    return io.read_progress(c.spark, path).select("job_id", "sequence", "kind", "stage_id", "completed_units")


_CI = f"""SELECT {PG},CASE staff_index%3 WHEN 0 THEN concat('Score_page_x',CAST(score_id AS VARCHAR(9)),'_page_',CAST(page_index AS VARCHAR(9))) WHEN 1 THEN concat('s',CAST(score_id AS VARCHAR(9)),'_page_',CAST(page_index AS VARCHAR(9))) ELSE concat('page_',CAST(page_index AS VARCHAR(9))) END id FROM {{f_staff}}"""


@register("composite_page_ids", duck("""
SELECT id,CASE WHEN contains(id,'_page_') THEN regexp_extract(id,'^(.*)_page_(.*)$',1) END AS score,CASE WHEN contains(id,'_page_') THEN concat('page_',regexp_extract(id,'^(.*)_page_(.*)$',2)) END AS page FROM {ci_}""", {"ci_": _CI}))
def _(c):
    return c.sql(_CI).select("id", tx.split_composite_id(F.col("id")).alias("s")).select("id", "s.score", "s.page")


_SR = f"""SELECT {PG},CAST(det_id%11 AS INT) priority,concat('loc',CAST(det_id%11 AS VARCHAR(9)),'/',CAST(score_id AS VARCHAR(9)),'-',CAST(page_index AS VARCHAR(9)),'.json') path FROM {{f_barline}}"""


@register("first_available_seeds", duck(f"""
SELECT p.score_id,p.page_index,s.priority,s.path FROM {{f_page}} p LEFT JOIN (SELECT {PG},min(priority) priority,arg_min(path,priority) path FROM {{sr_}} GROUP BY ALL) s USING (score_id,page_index)""", {"sr_": _SR}))
def _(c):
    return io.first_available(c.sql(_SR), c["f_page"], list(KEYS))[0]


@register("missing_seeds", duck(f"""
SELECT {PG},'seed_missing' AS violation FROM {{f_page}} p WHERE NOT EXISTS (SELECT 1 FROM {{sr_}} s WHERE s.score_id=p.score_id AND s.page_index=p.page_index)""", {"sr_": _SR}))
def _(c):
    return io.first_available(c.sql(_SR), c["f_page"], list(KEYS), require=True)[1]


_MK = f"""SELECT {PG},CAST(det_id%2 AS INT) priority,concat('mask',CAST(det_id%7 AS VARCHAR(9)),'.png') path FROM {{f_barline}}"""
_CM = f"""SELECT {PG},concat('cur',CAST(det_id%5 AS VARCHAR(9)),'.png') path FROM {{f_barline}}"""


@register("resolved_masks", duck(f"""
SELECT p.score_id,p.page_index,coalesce(m.path,'MISSING_STAFF_MASK.png') AS staff_mask,CASE WHEN c.n=1 THEN c.path WHEN c.n IS NULL THEN 'MISSING_CURRENT_STAFF_MASK.png' END AS current_mask,CASE WHEN c.n>1 THEN 'ambiguous_current_mask' END AS violation
FROM {{f_page}} p LEFT JOIN (SELECT {PG},path FROM (SELECT *, row_number() OVER (PARTITION BY {PG} ORDER BY priority,path) rn FROM {{mk_}}) WHERE rn=1) m USING (score_id,page_index)
LEFT JOIN (SELECT {PG},count(*) n,min(path) path FROM {{cm_}} GROUP BY ALL) c USING (score_id,page_index)""", {"mk_": _MK, "cm_": _CM}))
def _(c):
    return io.resolve_artifacts(c["f_page"], c.sql(_MK), c.sql(_CM), list(KEYS))


@register("page_manifest", duck(f"""
SELECT p.score_id,p.page_index,p.n_staves,s.status,coalesce(t.j,'LBRB') AS barline_overrides FROM {{f_page}} p
LEFT JOIN (SELECT {PG},arg_min(op,ord) status FROM {{f_override}} GROUP BY ALL) s USING (score_id,page_index)
LEFT JOIN (SELECT {PG},concat('LB"added":',CAST(sum(CASE WHEN op='add' THEN 1 ELSE 0 END) AS VARCHAR),',"removed":',CAST(sum(CASE WHEN op='remove' THEN 1 ELSE 0 END) AS VARCHAR),'RB') j FROM {{f_bar_override}} GROUP BY ALL) t USING (score_id,page_index)""").replace("LB", "{").replace("RB", "}"))
def _(c):
    stats = c["f_bar_override"].groupBy(*KEYS).agg(
        F.sum((F.col("op") == "add").cast("int")).alias("added"), F.sum((F.col("op") == "remove").cast("int")).alias("removed"))
    return io.build_manifest(c["f_page"].select(*KEYS, "n_staves"),
                             c["f_override"].withColumnRenamed("op", "status"), stats, list(KEYS))


@register("content_identities", duck("""
SELECT 'override' AS kind,ord AS id,sha256(concat('{"measure":',CAST(measure AS VARCHAR),',"op":"',op,'","set_number":',coalesce(CAST(set_number AS VARCHAR),'null'),',"skip":',CAST(skip AS VARCHAR),'}')) AS sha256 FROM {f_override}
UNION ALL SELECT 'document',doc_id,sha256(text) FROM {documents} UNION ALL SELECT 'page',page_id,sha256(html) FROM {pages}""".replace("'{\"measure", "'LB\"measure").replace("'}'", "'RB'")).replace("LB\"", "{\"").replace("'RB'", "'}'"))
def _(c):
    cols = {n: F.col(n) for n in ("op", "measure", "skip", "set_number")}
    o = c["f_override"].select(F.lit("override").alias("kind"), F.col("ord").alias("id"), io.identity(cols).alias("sha256"))
    d = c["documents"].select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha256"))
    p = c["pages"].select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.sha2("html", 256).alias("sha256"))
    return o.unionByName(d).unionByName(p)


_EX = "SELECT doc_id,page_number,CAST(doc_id%9 AS INT) source_sha,width_px size,width_px*31+height_px image_sha FROM {f_page_dim}"
_AX = "SELECT doc_id,page_number,CAST(doc_id%9+CASE WHEN doc_id%14=3 THEN 1 ELSE 0 END AS INT) source_sha,width_px+CASE WHEN doc_id%5=1 AND page_number=3 THEN 1 ELSE 0 END size,width_px*31+height_px-CASE WHEN doc_id%4=2 AND page_number=7 THEN 1 ELSE 0 END image_sha FROM {f_page_dim} WHERE NOT (doc_id%6=5 AND page_number=2)"


@register("render_cache_validity", duck("""
SELECT doc_id,source_ok,pages_ok,sizes_ok,images_ok,source_ok AND pages_ok AND sizes_ok AND images_ok AS valid FROM (SELECT doc_id,bool_and(coalesce(e.source_sha=a.source_sha,false)) source_ok,bool_and(e.size IS NOT NULL AND a.size IS NOT NULL) pages_ok,
 bool_and(coalesce(e.size=a.size,false)) sizes_ok,bool_and(coalesce(e.image_sha=a.image_sha,false)) images_ok FROM {ex_} e FULL JOIN {ax_} a USING (doc_id,page_number) GROUP BY doc_id)""", {"ex_": _EX, "ax_": _AX}))
def _(c):
    return io.valid_render_cache(c.sql(_EX), c.sql(_AX))
