"""Layout tables derived from the driver's parquet with portable SQL.

Each view is one SQL text whose sources are ``{name}`` placeholders.  Spark binds
them to DataFrames; the DuckDB oracles bind them to plain names in a WITH list.
Only integer arithmetic and engine-neutral casts are used, so both agree exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_PAGE_O = "CAST(floor(o_orderkey/128) AS INT) score_id, CAST(floor(o_orderkey/8) AS INT)%16 page_index"
_PAGE_L = "CAST(floor(l_orderkey/128) AS INT) score_id, CAST(floor(l_orderkey/8) AS INT)%16 page_index"
# an id from the whole row: order, line and quantity stay apart, parts and suppliers by a remainder; 64 bits last to sf 10,000
_LID = (
    "((l_orderkey*8+l_linenumber)*64+CAST(floor(l_quantity) AS BIGINT))*99991"
    "+(l_partkey*31+l_suppkey)%99991"
)
_YOFF = (
    "(o_orderkey%8)*80+CAST(floor((o_orderkey%8+1)/3) AS INT)*100"
    "+CASE WHEN o_custkey%7=0 THEN 21 ELSE 0 END"
)

VIEWS: dict[str, str] = {
    "f_staff": f"""
SELECT {_PAGE_O}, CAST(o_orderkey%8 AS INT) staff_index,
       CAST(60+o_custkey%5 AS INT) x1, CAST(100+{_YOFF} AS INT) y1,
       1160 x2, CAST(140+{_YOFF} AS INT) y2, CAST(10.0 AS DOUBLE) unit_size
FROM {{orders}}""",
    "f_barline": f"""
SELECT {_PAGE_L}, {_LID} det_id,
 CAST(l_linenumber*150-55+(l_partkey%5)*7 AS INT) x1, s.y1+CAST(l_partkey%3 AS INT) y1,
 CAST(l_linenumber*150-55+(l_partkey%5)*7+2+l_suppkey%9 AS INT) x2, s.y2-CAST(l_suppkey%3 AS INT) y2,
 l_discount*10 score
FROM {{lineitem}} JOIN {{f_staff}} s ON s.score_id=CAST(floor(l_orderkey/128) AS INT)
 AND s.page_index=CAST(floor(l_orderkey/8) AS INT)%16 AND s.staff_index=l_orderkey%8""",
    "f_connector": f"""
SELECT {_PAGE_O}, CAST(o_orderkey%8 AS INT) staff_index, o_custkey%4<3 present
FROM {{orders}}""",
    "f_detection": """
SELECT score_id,page_index,'baseline' source,det_id,x1,y1,x2,y2 FROM {f_barline}
UNION ALL SELECT b.score_id,b.page_index,'sr',det_id,b.x1+CAST(det_id%4 AS INT)*3,b.y1,
 b.x2+CAST(det_id%4 AS INT)*3,b.y2 FROM {f_barline} b WHERE det_id%3<>0
UNION ALL SELECT b.score_id,b.page_index,'omr',det_id,b.x1-CAST(det_id%5 AS INT)*2,
 b.y1+CAST(det_id%7 AS INT)*4,b.x2-CAST(det_id%5 AS INT)*2,b.y2+CAST(det_id%7 AS INT)*4
 FROM {f_barline} b WHERE det_id%3=1""",
    "f_override": f"""
SELECT {_PAGE_L}, CAST(l_partkey%4 AS INT) system, CAST(l_linenumber-1 AS INT) measure, {_LID} ord,
 CASE WHEN l_returnflag='A' THEN 'auto' WHEN l_returnflag='R' THEN 'mmr_measure_span'
      ELSE 'measure_construction' END kind,
 CASE WHEN l_returnflag='R' AND l_linestatus='O' THEN 'suppress'
      WHEN l_returnflag='R' THEN 'set_measure_span'
      WHEN l_returnflag='N' THEN 'force_measure' ELSE 'auto' END op,
 CAST(floor(l_quantity) AS INT)%7 skip,
 CASE WHEN l_suppkey%29=0 THEN CAST(l_partkey%300 AS INT) END set_number,
 l_returnflag='N' force_measure
FROM {{lineitem}}""",
    "f_bar_override": """
SELECT score_id,page_index,det_id ord,CASE WHEN det_id%2=0 THEN 'remove' ELSE 'add' END op,
 x1+CAST(det_id%3 AS INT)-1 x1,y1,x2+CAST(det_id%3 AS INT)-1 x2,y2
FROM {f_barline}""",
    "f_boundary": f"""
SELECT {_PAGE_O}, CAST(o_orderkey%8 AS INT) system, 1 reset_number, 'manual' source
FROM {{orders}} WHERE o_orderpriority='1-URGENT'""",
    "f_evidence": f"""
SELECT {_PAGE_O}, CAST(o_orderkey%8 AS INT) system,
 CASE WHEN o_orderstatus='F' THEN 'ambiguous_review_required'
      WHEN o_orderstatus='O' AND o_orderpriority='5-LOW' THEN 'no_boundary' ELSE 'confirmed_automatic' END state
FROM {{orders}}""",
    "f_review": f"""
SELECT {_PAGE_O}, CAST(o_orderkey%8 AS INT) system,
 CASE WHEN o_orderpriority='1-URGENT' THEN 'boundary' ELSE 'no_boundary' END op
FROM {{orders}} WHERE o_orderpriority IN ('1-URGENT','2-HIGH')""",
    "f_scan_record": f"""
SELECT {_PAGE_L}, CAST(l_orderkey%8 AS INT) band_idx, {_LID} rec_id,
 CAST(70+l_linenumber*150+l_partkey%90 AS INT) col,
 CASE WHEN l_discount*10<0.45 THEN 'scan_ratio_low' WHEN l_tax>0.07 THEN 'scan_ratio_rel_low'
      ELSE 'accepted' END status, l_discount*10 ratio
FROM {{lineitem}}""",
    "f_ocr_token": f"""
SELECT {_PAGE_L}, CAST(l_partkey%4 AS INT) system, CAST(l_linenumber-1 AS INT) measure,
 CAST(l_orderkey%8 AS INT) staff,
 CASE CAST(l_suppkey%3 AS INT) WHEN 0 THEN 'standard' WHEN 1 THEN 'no_dilate' ELSE 'heavy_dilate' END view_name,
 {_LID} ord,
 CAST(l_partkey%120 AS INT) x1, CAST(l_suppkey%20 AS INT) y1, CAST(l_partkey%120+12 AS INT) x2,
 CAST(l_suppkey%20+30+l_linenumber*4 AS INT) y2,
 CASE CAST(l_partkey%6 AS INT) WHEN 0 THEN concat('E',CAST(CAST(l_quantity AS INT) AS VARCHAR(9)))
  WHEN 1 THEN concat('Viol ',CAST(CAST(l_quantity AS INT) AS VARCHAR(9)))
  WHEN 2 THEN concat('q=',CAST(CAST(l_quantity AS INT) AS VARCHAR(9))) WHEN 3 THEN '1'
  WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(9)),'.')
  ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR(9)) END text, 1-l_tax*5 confidence
FROM {{lineitem}}""",
    "f_page_dim": """
SELECT CAST(floor(p_partkey/20) AS INT) doc_id, CAST(p_partkey%20 AS INT)+1 page_number,
 2000+p_size*240 width_px, 2500+CAST(floor(p_retailprice) AS INT)*5 height_px FROM {part}""",
    "f_progress": """
SELECT user_id job_id, event_id,
 row_number() over (partition by user_id order by ts)-1+CASE WHEN event_id%50=0 THEN -1 ELSE 0 END sequence,
 CASE event_type WHEN 'signup' THEN 'stage_started' WHEN 'view' THEN 'stage_progress'
  WHEN 'click' THEN 'stage_progress' WHEN 'purchase' THEN 'stage_completed'
  ELSE CASE WHEN value>190 THEN 'job_failed' ELSE 'stage_progress' END END kind,
 CASE CAST(event_id%4 AS INT) WHEN 0 THEN 'pdf_render' WHEN 1 THEN 'score_detection'
  WHEN 2 THEN 'measure_construction' ELSE 'numbering' END stage_id, ts,
 CAST(event_id%12 AS INT) completed_units, 10 total_units FROM {events}""",
    # per-page inventory: one row per page that has staves
    "f_page": """
SELECT score_id, page_index, 1300 width, 1100 height, count(*) n_staves
FROM {f_staff} GROUP BY score_id, page_index""",
    # extra bars found by a second detector, merged in order
    "f_extra_bar": """
SELECT score_id,page_index,det_id ord,x1+CAST(det_id%9 AS INT)-4 x1,y1+CAST(det_id%41 AS INT)-20 y1,
 x2+CAST(det_id%9 AS INT)-4 x2,y2+CAST(det_id%37 AS INT)-9 y2
FROM {f_barline}""",
    # OCR probability per measure (mean over its detections)
    "f_measure_prob": f"""
SELECT {_PAGE_L}, CAST(l_partkey%4 AS INT) system, CAST(l_linenumber-1 AS INT) measure,
 CAST(sum(CAST(floor(l_discount*100+0.5) AS INT)) AS DOUBLE)/CAST(count(*)*10 AS DOUBLE) prob
FROM {{lineitem}} GROUP BY 1,2,3,4""",
}


def placeholders(sql: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", sql)


class Corpus:
    """Lazily bound driver tables and derived views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                self._cache[name] = self.sql(VIEWS[name])
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self[n] for n in set(placeholders(text))})

    def raster(self) -> DataFrame:
        """raster_row(page_id, y, px): 64 grey values per row, 50 rows per page.

        Float literals keep the grey value of a float component in single precision, as DuckDB does.
        """
        return self["embeddings"].selectExpr(
            "CAST(floor(vec_id/50) AS INT) page_id",
            "CAST(vec_id%50 AS INT) y",
            "transform(embedding, v -> CAST(floor((v+1F)*127F) AS INT)) px",
        )


# DuckDB text of the same raster, for the oracles
DUCK_RASTER = """
SELECT CAST(floor(vec_id/50) AS INT) page_id, CAST(vec_id%50 AS INT) y,
 list_transform(embedding, lambda v: CAST(floor((v+1)*127) AS INT)) px FROM embeddings"""


def duck(select: str, extra: dict[str, str] | None = None) -> str:
    """Self-contained DuckDB query: ``{view}`` placeholders become WITH entries.

    An entry that recurses on itself names itself without braces.
    """
    extra = {"f_raster": DUCK_RASTER, **(extra or {})}
    order: list[str] = []

    def need(sql: str) -> None:
        for n in placeholders(sql):
            if n in TABLES or n in order:
                continue
            need(extra.get(n) or VIEWS[n])
            order.append(n)

    need(select)
    plain = {n: n for n in TABLES + order}

    def bind(sql: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: plain[m.group(1)], sql)

    ctes = [f"{n} AS ({bind(extra.get(n) or VIEWS[n])})" for n in order]
    head = "WITH RECURSIVE " + ",\n".join(ctes) if ctes else ""
    return f"{head}\n{bind(select)}"
