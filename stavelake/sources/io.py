"""Readers, writers and source resolution for page-level JSON, JSONL and image folders."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import scan
from ..operators.blocking import pin

PROGRESS_SCHEMA = (
    "job_id string, sequence bigint, kind string, stage_id string, terminal boolean, page_number int, "
    "completed_units bigint, total_units bigint, unit string, elapsed_ms bigint, detail_code string, ts timestamp"
)
SPAN_SCHEMA = (
    "schema_version string, run_id string, pid bigint, ppid bigint, process_role string, stage string, "
    "start_monotonic double, end_monotonic double, duration_sec double, cpu_time_sec double, "
    "success boolean, error string, call_count bigint, bytes bigint"
)


# ---- page inventory -------------------------------------------------------------


def list_images(spark: SparkSession, root: str, glob: str = "page_*.png") -> DataFrame:
    """Image files of a folder tree with their content digest (no pixel decoding)."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true").load(root)
        .select("path", "length", F.sha2("content", 256).alias("sha256"))
    )


def page_ids(files: DataFrame, *, keys: Sequence[str] = ("score_id",), prefix: str = "page") -> DataFrame:
    """Ordered page ids of each score: the stems if all start with ``page_``, else numbered.

    ``files`` has ``path``.  Ordinals are counted in blocks of similar size, so the pages of
    one huge score do not pass through one window partition.
    """
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    f = files.withColumn("stem", stem)
    named = f.groupBy(*keys).agg(F.bool_and(F.col("stem").startswith("page_")).alias("_named"))
    f = scan.row_numbers(f, list(keys), ["path"], "ordinal")
    return f.join(named, list(keys)).select(
        *keys, "path", "ordinal",
        F.when(F.col("_named"), F.col("stem")).otherwise(F.format_string(f"{prefix}_%03d", "ordinal")).alias("page_id"))


def limit_pages(pages: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` pages of each score by ordinal (a filter, not a sort)."""
    return pages.where(F.col("ordinal") <= limit)


# ---- box documents ---------------------------------------------------------------


def _boxes(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def _shape(v: Column) -> Column:
    """coordinates | barline_location | predictions | NULL of a parsed detection document."""
    rows = _boxes(v, "$")
    first = F.get(rows, 0)
    return (
        F.when(rows.isNotNull() & ((F.size(rows) == 0) | _boxes(first, "$").isNotNull()), "coordinates")
        .when(rows.isNotNull(), "barline_location")
        .when(_boxes(v, "$.predictions").isNotNull(), "predictions")
    )


def _coords(r: Column, shape: Column) -> Column:
    return (
        F.when(shape == "coordinates", _boxes(r, "$"))
        .when(shape == "barline_location", _boxes(r, "$.barline_location"))
        .otherwise(_boxes(r, "$.orig_bbox"))
    )


def read_boxes(docs: DataFrame, keys: Sequence[str], *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Boxes of detection documents (``text`` = JSON) and the documents' violations.

    Three shapes are accepted: a list of coordinates, a list of ``barline_location`` objects
    and ``predictions[].orig_bbox``.  Strict: one malformed box (wrong length, non-number,
    boolean, reversed bounds) rejects its document; zero-width boxes are fine.  Tolerant:
    malformed entries are skipped.  Documents are parsed where they lie and unnested by
    ``posexplode``; nothing is grouped.
    """
    d = pin(docs.select(*keys, "text"), keys, v=F.try_parse_json("text"))
    d = pin(d, [*keys, "v"], shape=_shape(F.col("v")), rows=F.coalesce(
        _boxes(F.col("v"), "$.predictions"), _boxes(F.col("v"), "$")))
    d = pin(d, [*keys, "v", "shape"],
             coords=F.transform("rows", lambda r: F.coalesce(_coords(r, F.col("shape")), F.array().cast("array<variant>"))))
    d = pin(d, [*keys, "v", "shape"], parsed=F.transform("coords", lambda c: F.struct(
        F.size(c).alias("n"),
        F.exists(c, lambda x: ~F.coalesce(
            F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))).alias("odd"),
        F.transform(c, lambda x: F.try_variant_get(x, "$", "double")).alias("p"))))
    at = lambda b, i: F.get(b["p"], i)
    bad = lambda b: (
        F.when(b["n"] != 4, "four_coordinates_required").when(b["odd"], "non_numeric_coordinate")
        .when((at(b, 2) < at(b, 0)) | (at(b, 3) < at(b, 1)), "reversed_bounds"))
    first_bad = F.get(F.filter(F.transform("parsed", bad), lambda w: w.isNotNull()), 0)
    why = F.when(F.col("v").isNull(), "invalid_json").when(F.col("shape").isNull(), "unsupported_shape")
    if strict:
        why = why.when(F.size("parsed") > 0, first_bad)
    d = pin(d, [*keys, "parsed"], violation=why)
    ok = d.where("violation IS NULL").select(*keys, F.posexplode("parsed").alias("pos", "b"))
    if not strict:
        ok = ok.where("b.n = 4 AND NOT exists(b.p, x -> x IS NULL)")
    return (
        ok.select(*keys, "pos", *(F.get("b.p", i).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))),
        d.where("violation IS NOT NULL").select(*keys, "violation"),
    )


def normalize_bars(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes of reviewed bar documents: per item the first non-empty location field."""
    v = F.try_parse_json("text")
    d = docs.select(*keys, F.coalesce(_boxes(v, "$.predictions"), _boxes(v, "$")).alias("rows"))
    r = d.select(*keys, F.posexplode("rows").alias("pos", "r"))
    full = lambda p: F.when(F.size(_boxes(F.col("r"), p)) > 0, _boxes(F.col("r"), p))
    loc = F.coalesce(_boxes(F.col("r"), "$"), full("$.barline_location"), full("$.orig_bbox"), full("$.pred_bbox"))
    r = r.select(*keys, "pos", loc.alias("c")).where("size(c) = 4")
    return r.select(*keys, "pos", *(
        F.try_variant_get(F.get("c", i), "$", "double").cast("int").alias(n)
        for i, n in enumerate(("x1", "y1", "x2", "y2"))))


# ---- override payloads -------------------------------------------------------------

OVERRIDE_INTS = ("page", "system", "measure", "skip", "set_number")


def read_overrides(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of override payloads: ``measure_overrides`` when it is a list, else ``overrides``.

    Integer fields are coerced leniently; a value that cannot be coerced is kept as text in
    ``<field>_text``.
    """
    v = F.try_parse_json("text")
    d = docs.select(*keys, F.coalesce(_boxes(v, "$.measure_overrides"), _boxes(v, "$.overrides")).alias("rows"))
    r = d.select(*keys, F.posexplode("rows").alias("pos", "r")).where(
        F.schema_of_variant("r").startswith("OBJECT"))
    raw = {f: F.try_variant_get("r", f"$.{f}", "string") for f in OVERRIDE_INTS}
    cols = []
    for f, t in raw.items():
        n = tx.lenient_int(t)
        cols += [n.alias(f), F.when(n.isNull(), t).alias(f"{f}_text")]
    return r.select(*keys, "pos", *cols,
                    F.coalesce(F.try_variant_get("r", "$.force_measure", "boolean"), F.lit(False)).alias("force_measure"))


# ---- JSON lines -----------------------------------------------------------------------


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS_SCHEMA).json(path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Performance spans, one JSONL file per process."""
    return spark.read.schema(SPAN_SCHEMA).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


# ---- resolution ------------------------------------------------------------------------


def first_available(
    sources: DataFrame, wanted: DataFrame, keys: Sequence[str], *, require: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Per key the source with the lowest ``priority``; missing keys as violations if required."""
    best = sources.groupBy(*keys).agg(F.min_by(F.struct("priority", "path"), "priority").alias("s")).select(
        *keys, "s.priority", "s.path")
    got = wanted.select(*keys).distinct().join(best, list(keys), "left")
    missing = got.where("path IS NULL").select(*keys, F.lit("seed_missing").alias("violation"))
    return got, missing if require else missing.limit(0)


def resolve_artifacts(
    pages: DataFrame, masks: DataFrame, current: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Mask of each page by pattern priority, its unique current mask, and sentinels.

    More than one current mask for a page is ambiguous and reported in ``violation``.
    """
    m = masks.groupBy(*keys).agg(F.min_by("path", F.struct("priority", "path")).alias("staff_mask"))
    c = current.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("path").alias("_p"))
    j = pages.select(*keys).distinct().join(m, list(keys), "left").join(c, list(keys), "left")
    return j.select(
        *keys, F.coalesce("staff_mask", F.lit("MISSING_STAFF_MASK.png")).alias("staff_mask"),
        F.when(F.col("_n") == 1, F.col("_p")).when(F.col("_n").isNull(), "MISSING_CURRENT_STAFF_MASK.png").alias("current_mask"),
        F.when(F.col("_n") > 1, "ambiguous_current_mask").alias("violation"))


def build_manifest(
    pages: DataFrame, statuses: DataFrame, stats: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Page entries with the first matching status (by ``ord``) and override statistics."""
    st = statuses.groupBy(*keys).agg(F.min_by("status", "ord").alias("status"))
    so = stats.select(*keys, F.to_json(F.struct("added", "removed")).alias("barline_overrides"))
    return pages.join(st, list(keys), "left").join(so, list(keys), "left").withColumn(
        "barline_overrides", F.coalesce("barline_overrides", F.lit("{}")))


# ---- identity ------------------------------------------------------------------------------


def canonical_json(cols: dict[str, Column]) -> Column:
    """JSON text with sorted keys, no blanks and explicit nulls."""
    return F.to_json(F.struct(*(cols[k].alias(k) for k in sorted(cols))), {"ignoreNullFields": "false"})


def identity(cols: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(cols), 256)


def valid_render_cache(expected: DataFrame, actual: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Documents whose cached pages all match: source digest, page list, sizes, image digests.

    ``expected`` / ``actual``: page_number, source_sha, size, image_sha per page.
    """
    e = expected.select(*keys, "page_number", *(F.col(c).alias(f"e_{c}") for c in ("source_sha", "size", "image_sha")))
    a = actual.select(*keys, "page_number", *(F.col(c).alias(f"a_{c}") for c in ("source_sha", "size", "image_sha")))
    j = e.join(a, [*keys, "page_number"], "full")
    same = lambda c: F.coalesce(F.col(f"e_{c}") == F.col(f"a_{c}"), F.lit(False))
    return j.groupBy(*keys).agg(
        F.bool_and(same("source_sha")).alias("source_ok"),
        F.bool_and(F.col("e_image_sha").isNotNull() & F.col("a_image_sha").isNotNull()).alias("pages_ok"),
        F.bool_and(same("size")).alias("sizes_ok"), F.bool_and(same("image_sha")).alias("images_ok"),
    ).withColumn("valid", F.col("source_ok") & F.col("pages_ok") & F.col("sizes_ok") & F.col("images_ok"))
