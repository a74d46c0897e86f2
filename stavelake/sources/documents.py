"""Nested numbering documents: JSON sink and source, row labels, score summaries."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import geometry as g

PAGE_SCHEMA = (
    "struct<page_number:int,width:int,height:int,"
    "systems:array<struct<staves:array<struct<bbox:array<int>>>,"
    "measures:array<struct<number:bigint,bbox:array<int>>>>>,"
    "empty_systems:array<struct<staves:array<struct<bbox:array<int>>>,reason:string>>>"
)
DOCUMENT_SCHEMA = f"struct<pages:array<{PAGE_SCHEMA}>>"


def page_documents(
    measures: DataFrame, staff: DataFrame, systems: DataFrame, pages: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One numbering document per page; systems without measures go to ``empty_systems``.

    Nesting happens here, at the sink: a document is bounded by one page.
    """
    sysid = [*keys, "system_raw"]
    bbox = F.array(*g.BOX)
    st = staff.groupBy(*sysid).agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct(bbox.alias("bbox")).alias("s")))).alias("a"))
    ms = measures.groupBy(*sysid).agg(
        F.array_sort(F.collect_list(F.struct(
            "measure", F.struct("number", bbox.alias("bbox")).alias("m")))).alias("m"))
    one = st.join(ms, sysid, "left").select(
        *sysid, F.transform("a", lambda v: v["s"]).alias("staves"),
        F.transform("m", lambda v: v["m"]).alias("measures"))
    full = F.when(F.col("measures").isNotNull(), F.struct(
        "system_raw", F.struct("staves", "measures").alias("s")))
    empty = F.when(F.col("measures").isNull(), F.struct(
        "system_raw", F.struct("staves", F.lit("no_measures").alias("reason")).alias("s")))
    nest = one.groupBy(*keys).agg(
        F.array_sort(F.collect_list(full)).alias("f"), F.array_sort(F.collect_list(empty)).alias("e"))
    page = F.struct(
        (F.col(keys[-1]) + 1).cast("int").alias("page_number"),
        F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        F.coalesce(F.transform("f", lambda v: v["s"]), F.array().cast(
            "array<struct<staves:array<struct<bbox:array<int>>>,measures:array<struct<number:bigint,bbox:array<int>>>>>")).alias("systems"),
        F.coalesce(F.transform("e", lambda v: v["s"]), F.array().cast(
            "array<struct<staves:array<struct<bbox:array<int>>>,reason:string>>")).alias("empty_systems"),
    )
    return pages.select(*keys, "width", "height").join(nest, list(keys), "left").select(
        *keys, F.to_json(F.struct(F.array(page).alias("pages"))).alias("document"))


def read_documents(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Measures of numbering documents (``document`` JSON text), one row each.

    Pages without systems keep one row with NULL measure fields.
    """
    p = docs.select(*keys, F.explode(F.from_json("document", DOCUMENT_SCHEMA)["pages"]).alias("p"))
    s = p.select(*keys, "p", F.posexplode_outer("p.systems").alias("system", "s"))
    return s.select(
        *keys, "p.page_number", "system", F.posexplode_outer("s.measures").alias("measure", "m"),
    ).select(
        *keys, "page_number", "system", "measure", F.col("m.number").alias("number"),
        *(F.get("m.bbox", i).alias(n) for i, n in enumerate(g.BOX)))


def document_shape(docs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    d = docs.select(*keys, F.get(F.from_json("document", DOCUMENT_SCHEMA)["pages"], 0).alias("p"))
    n = F.aggregate("p.systems", F.lit(0), lambda a, s: a + F.size(s["measures"]))
    return d.select(
        *keys, F.size("p.systems").alias("n_systems"), n.alias("n_measures"),
        F.size("p.empty_systems").alias("n_empty"),
        F.get(F.get("p.systems", 0)["measures"], 0)["number"].alias("first_number"))


def score_summary(page_numbers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Combined score metadata: next number of the last page and the page count."""
    return page_numbers.groupBy(*keys[:-1]).agg(
        F.count("*").alias("n_pages"), F.max_by("next_number", keys[-1]).alias("next_number"))


def row_labels(
    measures: DataFrame, staff: DataFrame, systems: DataFrame, *, page_width: int,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """First number of each system row with its font size and label position.

    Text extents are inputs in principle; here a digit is half the font wide.
    """
    at = [*keys, "system"]
    rows = measures.groupBy(*at).agg(
        F.min_by("number", "measure").alias("number"), F.min("x1").alias("mx1"),
        F.min("y1").alias("my1"), F.max("x2").alias("mx2"), F.max("y2").alias("my2"))
    idx = systems.where("system IS NOT NULL").select(*keys, "system_raw", "system")
    st = staff.join(idx, [*keys, "system_raw"]).groupBy(*at).agg(
        F.min("x1").alias("a1"), F.min("y1").alias("a2"), F.max("x2").alias("a3"),
        F.max("y2").alias("a4"),
        F.min_by(F.col("y2") - F.col("y1"), F.struct("y1", "pos")).alias("th"))
    j = rows.join(st, at).select(
        *at, "number", F.least("mx1", "a1").alias("x1"), F.least("my1", "a2").alias("y1"),
        F.greatest("mx2", "a3").alias("x2"), F.greatest("my2", "a4").alias("y2"),
        F.col("a2").alias("top"), F.greatest(F.lit(1), "th").alias("th"))
    med = F.median(F.col("th").cast("double")).over(Window.partitionBy(*keys))
    j = j.withColumn("font_size", g.label_font_size(med))
    tw = F.length(F.col("number").cast("string")) * F.floor(F.col("font_size") / 2).cast("int")
    j = j.withColumn("tw", tw)
    lab = g.label_box(F.col("font_size"), g.box(), F.col("top"), F.col("tw"), F.col("font_size"),
                      F.lit(page_width))
    return j.select(*at, "number", "font_size", lab.alias("l")).select(
        *at, "number", "font_size", "l.x", "l.y", "l.placement")
