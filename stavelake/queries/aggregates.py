"""Roll-ups over scans, boxes and review states."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..operators import rollups
from . import register
from .layout import PG


@register("page_envelopes", duck(f"""
SELECT {PG},min(x1) AS x1,min(y1) AS y1,max(x2) AS x2,max(y2) AS y2 FROM {{f_barline}} GROUP BY ALL"""))
def _(c):
    return rollups.envelope(c["f_barline"], KEYS)


@register("median_heights", duck(f"""
SELECT {PG},quantile_cont(CAST(y2-y1 AS DOUBLE),0.5) AS median_height,quantile_cont(CAST(x2-x1 AS DOUBLE),0.5) AS median_width FROM {{f_barline}} GROUP BY ALL"""))
def _(c):
    return c["f_barline"].groupBy(*KEYS).agg(
        F.median((F.col("y2") - F.col("y1")).cast("double")).alias("median_height"),
        F.median((F.col("x2") - F.col("x1")).cast("double")).alias("median_width"))


_SS = f"SELECT score_id,page_index,CASE WHEN score_id%5=0 THEN 0 ELSE n_staves*1300 END full_width_columns,CASE WHEN score_id%5=0 THEN 0 ELSE n_staves*(900+page_index) END eligible_columns,CASE WHEN score_id%5=0 THEN 0 ELSE n_staves*950 END projected_columns FROM {{f_page}}"
_SUM = ",".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("full_width_columns", "eligible_columns", "projected_columns"))


@register("scan_totals", duck(f"""
SELECT score_id,count(*) AS processed,{_SUM},round(CASE WHEN sum(full_width_columns)>0 THEN sum(eligible_columns)/CAST(sum(full_width_columns) AS DOUBLE) ELSE 1 END,6) AS eligible_width_ratio,
 round(CASE WHEN sum(full_width_columns)>0 THEN sum(projected_columns)/CAST(sum(full_width_columns) AS DOUBLE) ELSE 1 END,6) AS projected_width_ratio FROM {{ss_}} GROUP BY score_id""", {"ss_": _SS}))
def _(c):
    t = rollups.scan_totals(c.sql(_SS), ["score_id"])
    return t.withColumns({n: F.round(n, 6) for n in ("eligible_width_ratio", "projected_width_ratio")})


_RS = """SELECT CAST(floor(o_orderkey/40) AS BIGINT) package_id,CASE WHEN o_custkey%50=0 AND o_orderkey%3=0 THEN 'pending' ELSE 'none' END edit_status,CASE WHEN CAST(floor(o_orderkey/40) AS BIGINT)%3=0 AND o_custkey%4=0 THEN 'recorded' ELSE 'not_recorded' END recording_status,
 CASE WHEN CAST(floor(o_orderkey/40) AS BIGINT)%5=0 THEN 'stale' WHEN CAST(floor(o_orderkey/40) AS BIGINT)%5=1 AND o_custkey%9=0 THEN 'current' WHEN CAST(floor(o_orderkey/40) AS BIGINT)%5=2 THEN 'applying' ELSE 'not_applied' END application_status,
 o_custkey%500=7 has_error,CAST(floor(o_orderkey/40) AS BIGINT)%17=4 apply_error FROM {orders}"""
_N = ",".join(f"count(*) FILTER (WHERE application_status='{s}') AS {s}" for s in ("current", "stale", "not_applied", "applying"))


@register("review_package_states", duck(f"""
SELECT package_id,recorded,not_recorded,pending,current,stale,not_applied,applying,error,CASE WHEN error>0 THEN 'error' WHEN r>1 OR a>1 THEN 'mixed' WHEN pending>0 THEN 'pending' ELSE st END AS status FROM (
SELECT package_id,count(*) FILTER (WHERE recording_status='recorded') AS recorded,count(*) FILTER (WHERE recording_status='not_recorded') AS not_recorded,count(*) FILTER (WHERE edit_status='pending') AS pending,{_N},
 count(*) FILTER (WHERE has_error OR apply_error) AS error,count(DISTINCT recording_status) r,count(DISTINCT application_status) a,min(application_status) st FROM {{rs_}} GROUP BY package_id)""", {"rs_": _RS}))
def _(c):
    return rollups.review_state(c.sql(_RS))


_AT = "SELECT l_partkey package_id,l_orderkey*10+l_linenumber attempt,l_returnflag<>'R' success,concat('run-',CAST(l_suppkey AS VARCHAR(9))) result FROM {lineitem}"
_AT1 = "SELECT package_id,attempt,bool_and(success) success,max(result) result FROM {at_} GROUP BY package_id,attempt"


@register("last_successful_results", duck("""
SELECT package_id,max(attempt) AS attempt,arg_max(success,attempt) AS last_ok,arg_max(result,attempt) FILTER (WHERE success) AS last_successful_result FROM {at1_} GROUP BY package_id""", {"at_": _AT, "at1_": _AT1}))
def _(c):
    return rollups.last_success(c.spark.sql(_AT1, at_=c.sql(_AT)))


@register("confident_candidates", duck(f"""
SELECT {PG},det_id,score FROM {{f_barline}} WHERE score>=0.4965248107910156"""))
def _(c):
    """Acceptance threshold of the scorer on stored scores (pushed to the scan)."""
    return c["f_barline"].where(F.col("score") >= 0.4965248107910156).select(*KEYS, "det_id", "score")
