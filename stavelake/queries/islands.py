"""Gaps-and-islands over boxes and mask rows."""

from pyspark.sql import functions as F

from .. import KEYS
from ..fixtures import duck
from ..operators import islands
from . import register
from .layout import PG

_BX = f"SELECT {PG},x1,y1+CAST(det_id%23 AS INT) y1,x2,y2+CAST(det_id%29 AS INT) y2 FROM {{f_barline}}"
ROWS_SQL = f"""SELECT {PG},CAST(row_number() OVER (PARTITION BY {PG} ORDER BY center,cl)-1 AS INT) row_idx,n,center,top,bottom FROM (
 SELECT {PG},cl,count(*) n,quantile_cont(cy,0.5) center,quantile_cont(CAST(y1 AS DOUBLE),0.5) top,quantile_cont(CAST(y2 AS DOUBLE),0.5) bottom FROM (
 SELECT *, sum(brk) OVER (PARTITION BY {PG} ORDER BY cy,y1,y2 ROWS UNBOUNDED PRECEDING) cl FROM (
 SELECT *, CASE WHEN cy-lag(cy) OVER (PARTITION BY {PG} ORDER BY cy,y1,y2)>lim THEN 1 ELSE 0 END brk FROM (
 SELECT *, (y1+y2)/2e0 cy, 0.12*quantile_cont(CAST(CASE WHEN y2<>y1 THEN abs(y2-y1) END AS DOUBLE),0.5) OVER (PARTITION BY {PG}) lim FROM {{bx_}}))) GROUP BY {PG},cl) WHERE n>=3"""


def _rows(c):
    b = c.sql(_BX)
    return islands.row_stats(b, min_count=3)


@register("row_clusters", duck(f"SELECT {PG},row_idx,n,center,top,bottom FROM {{rows_}}",
                               {"bx_": _BX, "rows_": ROWS_SQL.replace("0.12*", "0.5*")}))
def _(c):
    return _rows(c)


@register("row_bands", duck(f"""
SELECT {PG},CAST(row_number() OVER (PARTITION BY {PG} ORDER BY row_idx)-1 AS INT) AS band_idx,CAST(trunc(top) AS INT) AS b1,CAST(trunc(bottom) AS INT) AS b2
FROM {{rows_}} WHERE bottom>=top""", {"bx_": _BX, "rows_": ROWS_SQL.replace("0.12*", "0.5*")}))
def _(c):
    return islands.row_bands(_rows(c))


# five thin lines per staff, some of them short, plus fragments: loose ones in every tenth score, on the lines elsewhere
_LINES = " UNION ALL ".join(
    f"SELECT {PG},y1+{10 * k + t} y,x1 xa,CASE WHEN (score_id+staff_index+{k})%7=0 OR (score_id+page_index*3+{k})%13=1 THEN x1+150 ELSE x2 END xb FROM {{f_staff}}"
    for k in range(5) for t in range(2))
_MASK = f"""SELECT {PG},y,min(xa) xa,max(xb) xb,1300 img_w,1100 img_h FROM ({_LINES}
 UNION ALL SELECT {PG},y2+22-staff_index%3,200,260 FROM {{f_staff}}
 UNION ALL SELECT {PG},y1+CAST(CASE WHEN score_id%10=9 THEN det_id%40 ELSE 10*(det_id%4) END AS INT),x1,x2+CASE WHEN score_id%10=9 THEN 300 ELSE 0 END FROM {{f_barline}}) l GROUP BY {PG},y"""


@register("mask_bands", duck(f"""
SELECT * FROM (WITH a AS (SELECT *, sum(CASE WHEN g>1 THEN 1 ELSE 0 END) OVER (PARTITION BY {PG} ORDER BY y) s FROM (SELECT *, y-lag(y) OVER (PARTITION BY {PG} ORDER BY y) g FROM {{mask_}})),
 seg AS (SELECT {PG},s,min(y) y1,max(y) y2,min(xa) xa,max(xb) xb FROM a GROUP BY ALL),
 sg AS (SELECT *, y1-lag(y2) OVER (PARTITION BY {PG} ORDER BY y1)-1 gap FROM seg),
 st AS (SELECT {PG},count(*) n,quantile_cont(CAST(y2-y1+1 AS DOUBLE),0.5) mh,quantile_cont(CAST(CASE WHEN gap>0 THEN gap END AS DOUBLE),0.5) mg FROM sg GROUP BY ALL),
 j AS (SELECT sg.*,coalesce(n>=5 AND mh<=3*greatest(1,mg) AND mg<=55,false) ll,greatest(2,CAST(round_even(mg*1.8,0) AS INT)) mgap FROM sg JOIN st USING (score_id,page_index)),
 k AS (SELECT *, sum(CASE WHEN ll AND gap<=mgap THEN 0 ELSE 1 END) OVER (PARTITION BY {PG} ORDER BY y1) grp FROM j),
 m AS (SELECT {PG},grp,ll,min(y1) b1,max(y2) b2,count(*) c,sum(CASE WHEN xb-xa+1>=390 THEN 1 ELSE 0 END) lc FROM k GROUP BY ALL)
SELECT {PG},CAST(row_number() OVER (PARTITION BY {PG} ORDER BY b1)-1 AS INT) AS band_idx,b1,b2 FROM m WHERE NOT ll OR (c>=3 AND lc>=2))""", {"mask_": _MASK}))
def _(c):
    return islands.mask_bands(c.sql(_MASK), keys=KEYS)


@register("vertical_runs", duck("""
SELECT * FROM (WITH p AS (SELECT page_id,y,unnest(range(64)) x,unnest(px) v FROM {f_raster}),
 h AS (SELECT page_id,max(y)+1 h FROM {f_raster} GROUP BY 1),
 a AS (SELECT *, sum(CASE WHEN gy>3 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id,x ORDER BY y) r FROM (SELECT *, y-lag(y) OVER (PARTITION BY page_id,x ORDER BY y) gy FROM p WHERE v<118)),
 q AS (SELECT page_id,CAST(x AS INT) x,CASE WHEN min(y)<=1 THEN 0 ELSE min(y) END y1,CASE WHEN any_value(h)-max(y)-1<=1 THEN any_value(h) ELSE max(y)+1 END y2 FROM a JOIN h USING (page_id) GROUP BY page_id,x,r)
SELECT page_id,x,y1,y2 FROM q WHERE y2-y1 BETWEEN 3 AND 24)"""))
def _(c):
    r = c.raster()
    h = r.groupBy("page_id").agg((F.max("y") + 1).alias("img_h"))
    px = r.join(h, "page_id").select("page_id", "y", "img_h", F.posexplode("px").alias("x", "v")).where("v < 118")
    return islands.vertical_runs(px, min_height=4, max_height=24)
