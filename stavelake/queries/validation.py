"""Contract validation over correction sets, job results, page requests and documents."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..operators import validate
from . import register
from .layout import PG

_LID = "l_orderkey*10000000000+l_partkey*100000+l_suppkey*10+l_linenumber"
# raw fields of a correction record and its JSON text, both portable
_CR = f"""SELECT l_orderkey set_id,{_LID} ord,CAST(l_partkey%7 AS INT) o,CAST(l_suppkey%11 AS INT) f,CAST(l_quantity AS INT) q,l_linenumber ln,
 CASE CAST(l_partkey%7 AS INT) WHEN 0 THEN 'mmr.set_measure_span' WHEN 1 THEN 'mmr.suppress' WHEN 2 THEN 'measure.force_measure' WHEN 3 THEN 'barline.add'
  WHEN 4 THEN 'barline.remove' WHEN 5 THEN 'movement_boundary.set_decision' ELSE 'group.staves' END op FROM {{lineitem}}"""
_CJ = """SELECT set_id,ord,o,f,q,ln,op,concat('{"correction_id":',CASE WHEN f=1 THEN '""' WHEN f=2 THEN '7' ELSE concat('"c',CAST(ln AS VARCHAR(9)),'"') END,
 ',"operation":"',op,'","target":{"page":',CASE WHEN f=3 THEN '-1' WHEN f=4 THEN 'true' ELSE CAST(q AS VARCHAR(9)) END,
 CASE WHEN f=5 THEN '' ELSE concat(',"system":',CASE WHEN f=6 THEN '1.5' ELSE CAST(ln AS VARCHAR(9)) END) END,
 CASE WHEN f=7 THEN ',"measure":null' ELSE ',"measure":3' END,',"bbox":[1,',CASE WHEN f=8 THEN 'true' ELSE '2.5' END,',30',CASE WHEN f=9 THEN '' ELSE ',40' END,']},"value":{"measure_span":',
 CAST(q%4 AS VARCHAR(9)),',"decision":',CASE WHEN f=10 THEN '"maybe"' ELSE '"boundary"' END,'}',CASE WHEN q%9=0 THEN ',"reason":" "' WHEN q%9=1 THEN ',"reason":null' WHEN q%9=2 THEN ',"reason":5' ELSE ',"reason":"ok"' END,'}') js FROM {cr_}"""


@register("correction_record_violations", duck("""
SELECT set_id AS correction_set_id,ord,v AS violation FROM (SELECT *, CASE WHEN f IN (1,2) THEN 'missing_correction_id' WHEN o=6 THEN 'unsupported_operation' WHEN f IN (3,4) THEN 'bad_page'
  WHEN o<=2 AND f IN (5,6) THEN 'bad_system' WHEN o<=2 AND f=7 THEN 'bad_measure' WHEN o=0 AND q%4<1 THEN 'bad_measure_span' WHEN o IN (3,4) AND f IN (8,9) THEN 'bad_bbox'
  WHEN o=5 AND f IN (5,6) THEN 'bad_system' WHEN o=5 AND f=10 THEN 'bad_decision' WHEN q%9 IN (0,2) THEN 'bad_reason' END v FROM {cr_}) WHERE v IS NOT NULL
UNION ALL SELECT set_id,max(ord),'duplicate_correction_id' FROM {cr_} GROUP BY set_id,CASE WHEN f=1 THEN '' WHEN f=2 THEN '7' ELSE concat('c',CAST(ln AS VARCHAR)) END HAVING count(*)>1""", {"cr_": _CR}))
def _(c):
    d = c.spark.sql(_CJ.replace("{cr_}", "CR__").replace("{", "{{").replace("}", "}}").replace("CR__", "{cr_}"), cr_=c.sql(_CR))
    return validate.check_corrections(d.select(
        F.col("set_id").alias("correction_set_id"), "ord", F.try_parse_json("js").alias("record")))


_JR = """SELECT o_orderkey job_id,CASE CAST(o_orderkey%5 AS INT) WHEN 0 THEN 'succeeded' WHEN 1 THEN 'review_required' WHEN 2 THEN 'failed' WHEN 3 THEN 'cancelled' ELSE CASE WHEN o_custkey%3=0 THEN 'paused' ELSE 'succeeded' END END status,
 CAST(o_custkey%12 AS INT) requested,CAST(o_custkey%7 AS INT)-CASE WHEN o_orderkey%97=0 THEN 20 ELSE 0 END processed,CAST(o_orderkey%4 AS INT) skipped,
 (o_orderkey%5 IN (2,3))<>(o_custkey%10=0) has_failure,(o_orderkey%5=1)<>(o_custkey%13=0) review_required,
 CASE WHEN o_orderkey%5=1 AND o_custkey%8<>0 THEN concat('a',CAST(o_custkey%6 AS VARCHAR(9))) WHEN o_custkey%9=0 THEN 'a1' END source_artifact_id,
 CASE WHEN o_orderkey%41=0 THEN CAST(-1 AS DOUBLE) ELSE o_totalprice END wall_time FROM {orders}"""
_AR = """SELECT l_orderkey job_id,concat('a',CAST(l_linenumber AS VARCHAR(9))) artifact_id,max(CASE WHEN l_partkey%5<>0 THEN concat('sha',CAST(l_partkey AS VARCHAR(9))) END) sha256,
 max(CASE WHEN l_suppkey%4<>0 THEN 'source_page' END) space FROM {lineitem} GROUP BY l_orderkey,l_linenumber
 UNION ALL SELECT o_orderkey,'a1',NULL,NULL FROM {orders} WHERE o_custkey%17=0"""


@register("job_result_violations", duck("""
SELECT job_id,v AS violation FROM (SELECT r.job_id,CASE WHEN status NOT IN ('succeeded','review_required','failed','cancelled') THEN 'unsupported_status' WHEN requested<0 OR processed<0 OR skipped<0 THEN 'negative_page_count'
 WHEN processed+skipped>requested THEN 'too_many_pages' WHEN d.job_id IS NOT NULL THEN 'duplicate_artifact_id' WHEN status IN ('failed','cancelled') AND NOT has_failure THEN 'failure_missing'
 WHEN status IN ('succeeded','review_required') AND has_failure THEN 'unexpected_failure' WHEN status='review_required' AND NOT review_required THEN 'review_flag_missing'
 WHEN status='succeeded' AND review_required THEN 'unexpected_review' WHEN status='review_required' AND source_artifact_id IS NULL THEN 'review_source_missing'
 WHEN source_artifact_id IS NOT NULL AND a.job_id IS NULL THEN 'review_source_unknown' WHEN a.job_id IS NOT NULL AND a.sha256 IS NULL THEN 'review_source_without_sha256'
 WHEN a.job_id IS NOT NULL AND a.space IS NULL THEN 'review_source_without_coordinate_space' WHEN wall_time<0 THEN 'bad_resource' END v
 FROM {jr_} r LEFT JOIN (SELECT job_id,artifact_id,max(sha256) sha256,max(space) space FROM {ar_} GROUP BY ALL) a ON a.job_id=r.job_id AND a.artifact_id=r.source_artifact_id
 LEFT JOIN (SELECT DISTINCT job_id FROM {ar_} GROUP BY job_id,artifact_id HAVING count(*)>1) d ON d.job_id=r.job_id) WHERE v IS NOT NULL""", {"jr_": _JR, "ar_": _AR}))
def _(c):
    return validate.check_results(c.sql(_JR), c.sql(_AR))


_SS = """SELECT o_orderkey job_id,concat('j',CAST(o_orderkey-CASE WHEN o_custkey%11=0 THEN 1 ELSE 0 END AS VARCHAR(12))) source_job_id,'a1' source_artifact_id,
 concat('sha',CAST(o_custkey-CASE WHEN o_custkey%7=3 THEN 1 ELSE 0 END AS VARCHAR(12))) source_artifact_sha256,CASE WHEN o_orderkey%19=0 THEN '0' ELSE '1' END source_contract_version,
 CASE WHEN o_orderkey%23<>1 THEN 'source_page' END coordinate_space FROM {orders}"""
_SA = """SELECT o_orderkey job_id,concat('j',CAST(o_orderkey AS VARCHAR(12))) source_job_id,CASE WHEN o_orderkey%29=4 THEN 'a2' ELSE 'a1' END source_artifact_id,concat('sha',CAST(o_custkey AS VARCHAR(12))) source_artifact_sha256,
 '1' source_contract_version,'source_page' coordinate_space FROM {orders}"""


@register("stale_correction_sources", duck("""
SELECT job_id,v AS violation FROM (SELECT s.job_id,CASE WHEN s.source_job_id<>a.source_job_id THEN 'stale_source_job_id' WHEN s.source_artifact_id<>a.source_artifact_id THEN 'stale_source_artifact_id'
 WHEN s.source_artifact_sha256<>a.source_artifact_sha256 THEN 'stale_source_artifact_sha256' WHEN s.source_contract_version<>a.source_contract_version THEN 'stale_source_contract_version'
 WHEN s.coordinate_space IS DISTINCT FROM a.coordinate_space THEN 'stale_coordinate_space' END v FROM {ss_} s JOIN {sa_} a USING (job_id)) WHERE v IS NOT NULL""", {"ss_": _SS, "sa_": _SA}))
def _(c):
    return validate.stale_sources(c.sql(_SS), c.sql(_SA), ["job_id"])


@register("duplicate_override_keys", duck(f"""
SELECT {PG},system,measure,count(*) AS n FROM {{f_override}} GROUP BY ALL HAVING count(*)>1"""))
def _(c):
    return validate.duplicates(c["f_override"], [*KEYS, "system", "measure"])


_PSEL = """SELECT o_orderkey request_id,CAST(o_custkey%30+3 AS INT) total_pages,CASE CAST(o_orderkey%6 AS INT) WHEN 0 THEN '' WHEN 1 THEN '3,1,,3' WHEN 2 THEN concat(CAST(o_custkey%40 AS VARCHAR(9)),', 2')
 WHEN 3 THEN '2,x' WHEN 4 THEN concat(' ',CAST(o_custkey%5+1 AS VARCHAR(9)),' ,',CAST(o_custkey%7+1 AS VARCHAR(9))) ELSE NULL END selection FROM {orders}"""


@register("page_selections", duck("""
SELECT request_id,array_to_string(list_transform(CASE WHEN selection IS NULL OR selection='' THEN range(total_pages) WHEN k=2 AND (a<1 OR a>total_pages) THEN NULL WHEN k=1 THEN [0,2] WHEN k=3 THEN NULL
  WHEN k=2 THEN list_sort(list_distinct([a-1,1])) ELSE CASE WHEN greatest(b,d)>total_pages THEN NULL ELSE list_sort(list_distinct([b-1,d-1])) END END,lambda x: CAST(x AS VARCHAR)),',') AS pages,
 CASE WHEN k=3 THEN 'invalid_index' WHEN k=2 AND (a<1 OR a>total_pages) THEN 'out_of_bounds' WHEN k=4 AND greatest(b,d)>total_pages THEN 'out_of_bounds' END AS violation
FROM (SELECT p.*, request_id%6 k, CAST(o_custkey%40 AS BIGINT) a, CAST(o_custkey%5+1 AS BIGINT) b, CAST(o_custkey%7+1 AS BIGINT) d FROM {psel_} p JOIN orders ON o_orderkey=request_id)""", {"psel_": _PSEL}))
def _(c):
    s = validate.page_selection(c.sql(_PSEL))
    return s.select("request_id", F.array_join(F.transform("pages", lambda v: v.cast("string")), ",").alias("pages"), "violation")


@register("render_budget", duck("""
SELECT doc_id,arg_min(page_number,page_number) FILTER (WHERE why IS NOT NULL) AS page_number,arg_min(why,page_number) FILTER (WHERE why IS NOT NULL) AS violation,CAST(sum(px) AS BIGINT) AS total_px FROM (
SELECT *, CASE WHEN width_px>12000 OR height_px>12000 THEN 'dimension_limit' WHEN px>64000000 THEN 'page_pixel_limit' WHEN tot>1000000000 THEN 'total_pixel_limit' END why FROM (
SELECT *, CAST(width_px AS BIGINT)*height_px px,sum(CAST(width_px AS BIGINT)*height_px) OVER (PARTITION BY doc_id ORDER BY page_number) tot FROM {f_page_dim})) GROUP BY doc_id"""))
def _(c):
    return validate.render_budget(c["f_page_dim"], block=4)


_ER = """SELECT event_id job_id,CASE event_type WHEN 'error' THEN 'internal' WHEN 'click' THEN 'input' WHEN 'view' THEN 'resource' ELSE event_type END category,
 CASE WHEN event_id%13=0 THEN ' ' ELSE concat('code_',CAST(event_id%5 AS VARCHAR(9))) END code,CASE WHEN event_id%17=0 THEN NULL ELSE 'The input could not be read.' END public_message,
 event_id%2=0 user_actionable,event_id%3=0 retryable,props FROM {events}"""


@register("public_errors", duck("""
SELECT job_id,category,code,public_message,user_actionable,retryable,CASE WHEN category NOT IN ('invalid_request','input','correction','resource','dependency','cancelled','internal') THEN 'unsupported_category'
 WHEN trim(code)='' THEN 'missing_code' WHEN public_message IS NULL THEN 'missing_message' END AS violation FROM {er_}""", {"er_": _ER}))
def _(c):
    e = c.sql(_ER).withColumn("debug_context", F.from_json("props", "map<string,string>")).drop("props")
    return validate.public_errors(e)
