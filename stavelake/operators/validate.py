"""Violation tables: rows that break a contract, with a reason code.

A validator never raises and never collects; strict callers turn a non-empty violation
table into an error (``require_empty``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from . import scan
from .blocking import pin

# The stage, kind and operation names of the accepted documents.
STAGES = (
    "job", "input_validation", "pdf_render", "score_detection", "measure_construction",
    "measure_number_recognition", "correction_application", "numbering", "artifact_materialization",
)
KINDS = (
    "job_started", "stage_started", "stage_progress", "stage_completed", "job_succeeded",
    "job_review_required", "job_failed", "job_cancelled",
)
TERMINAL = ("job_succeeded", "job_review_required", "job_failed", "job_cancelled")
OPERATIONS = (
    "mmr.set_measure_span", "mmr.suppress", "measure.force_measure", "barline.add",
    "barline.remove", "movement_boundary.set_decision",
)
MEASURE_OPS = OPERATIONS[:3]
SHA256 = "^[0-9a-f]{64}$"
MAX_PAGE_ENTRIES = 200


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise when a violation table has a row (reads at most one)."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{what}: {first[0].asDict()}")


def duplicates(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*ids).agg(F.count("*").alias("n")).where("n > 1")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def first_reason(*checks: tuple[Column, str]) -> Column:
    """First failing check's code; NULL when all pass.  NULL conditions count as passing."""
    out = None
    for cond, code in checks:
        cond = F.coalesce(cond, F.lit(False))
        out = F.when(cond, code) if out is None else out.when(cond, code)
    return out


def correction_violation(record: Column) -> Column:
    """First contract violation of one correction record (VARIANT)."""
    get = lambda p, t: F.try_variant_get(record, p, t)
    sub = lambda p: F.try_variant_get(record, p, "variant")
    op = get("$.operation", "string")
    idx = lambda p, m=0: tx.contract_int(sub(p), m).isNull()
    box = get("$.target.bbox", "array<variant>")
    bad_box = box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: ~F.coalesce(
        F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.lit(False)))
    decision = get("$.value.decision", "string")
    reason_kind = F.schema_of_variant(sub("$.reason"))
    return first_reason(
        (blank(get("$.correction_id", "string")) | ~F.coalesce(
            F.schema_of_variant(sub("$.correction_id")) == "STRING", F.lit(False)), "missing_correction_id"),
        (~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), "unsupported_operation"),
        (idx("$.target.page"), "bad_page"),
        (op.isin(*MEASURE_OPS) & idx("$.target.system"), "bad_system"),
        (op.isin(*MEASURE_OPS) & idx("$.target.measure"), "bad_measure"),
        ((op == OPERATIONS[0]) & idx("$.value.measure_span", 1), "bad_measure_span"),
        (op.startswith("barline.") & bad_box, "bad_bbox"),
        ((op == OPERATIONS[5]) & idx("$.target.system"), "bad_system"),
        ((op == OPERATIONS[5]) & ~F.coalesce(decision.isin("boundary", "no_boundary"), F.lit(False)),
         "bad_decision"),
        (reason_kind.isNotNull() & (reason_kind != "VOID") & (
            (reason_kind != "STRING") | blank(get("$.reason", "string"))), "bad_reason"),
    )


def check_corrections(sets: DataFrame) -> DataFrame:
    """Violations of correction records (``correction_set_id``, ``ord``, VARIANT ``record``)."""
    sets = pin(sets.select("correction_set_id", "ord", "record"), ["correction_set_id", "ord"],
               record=F.col("record"))
    rows = sets.select("correction_set_id", "ord", correction_violation(F.col("record")).alias("violation"),
                       F.try_variant_get("record", "$.correction_id", "string").alias("cid"))
    rows = materialize(rows, "correction-checks")  # records are parsed once for both uses
    dup = rows.where("cid IS NOT NULL").groupBy("correction_set_id", "cid").agg(
        F.count("*").alias("n"), F.max("ord").alias("ord")).where("n > 1").select(
        "correction_set_id", "ord", F.lit("duplicate_correction_id").alias("violation"))
    return rows.where("violation IS NOT NULL").select("correction_set_id", "ord", "violation").unionByName(dup)


SOURCE_FIELDS = ("source_job_id", "source_artifact_id", "source_artifact_sha256",
                 "source_contract_version", "coordinate_space")


def stale_sources(sets: DataFrame, artifacts: DataFrame, on: Sequence[str]) -> DataFrame:
    """First of five identity fields in which a correction set differs from its artifact."""
    a = artifacts.select(*on, *(F.col(f).alias(f"a_{f}") for f in SOURCE_FIELDS))
    j = sets.join(a, list(on), "left")
    why = first_reason(*((~F.col(f).eqNullSafe(F.col(f"a_{f}")), f"stale_{f}") for f in SOURCE_FIELDS))
    return j.select(*on, why.alias("violation")).where("violation IS NOT NULL")


def check_results(results: DataFrame, artifacts: DataFrame) -> DataFrame:
    """First violated invariant per job result.

    ``results``: job_id, status, requested, processed, skipped, has_failure, review_required,
    source_artifact_id, wall_time.  ``artifacts``: job_id, artifact_id, sha256, space.
    """
    c = F.col
    src = artifacts.groupBy("job_id", "artifact_id").agg(
        F.count("*").alias("_n"), F.first("sha256").alias("_sha"), F.first("space").alias("_space"))
    dup = artifacts.groupBy("job_id", "artifact_id").count().where("count > 1").select(
        "job_id", F.lit(True).alias("_dup")).distinct()
    j = results.join(
        src.withColumnRenamed("artifact_id", "source_artifact_id").withColumn("_found", F.lit(True)),
        ["job_id", "source_artifact_id"], "left").join(dup, "job_id", "left")
    failing = c("status").isin("failed", "cancelled")
    why = first_reason(
        (~c("status").isin("succeeded", "review_required", "failed", "cancelled"), "unsupported_status"),
        ((c("requested") < 0) | (c("processed") < 0) | (c("skipped") < 0), "negative_page_count"),
        (c("processed") + c("skipped") > c("requested"), "too_many_pages"),
        (c("_dup"), "duplicate_artifact_id"),
        (failing & ~c("has_failure"), "failure_missing"),
        (c("status").isin("succeeded", "review_required") & c("has_failure"), "unexpected_failure"),
        ((c("status") == "review_required") & ~c("review_required"), "review_flag_missing"),
        ((c("status") == "succeeded") & c("review_required"), "unexpected_review"),
        ((c("status") == "review_required") & c("source_artifact_id").isNull(), "review_source_missing"),
        (c("source_artifact_id").isNotNull() & c("_found").isNull(), "review_source_unknown"),
        (c("_found") & c("_sha").isNull(), "review_source_without_sha256"),
        (c("_found") & c("_space").isNull(), "review_source_without_coordinate_space"),
        (F.isnan("wall_time") | (c("wall_time") < 0) | (c("wall_time") == float("inf")), "bad_resource"),
    )
    return j.select("job_id", why.alias("violation")).where("violation IS NOT NULL")


def progress_violation() -> Column:
    """First field violation of a progress event (columns of the event table)."""
    c = F.col
    return first_reason(
        (blank(c("job_id").cast("string")), "missing_job_id"),
        (c("sequence").isNull() | (c("sequence") < 0), "bad_sequence"),
        (c("kind").isNull() | ~c("kind").isin(*KINDS), "unknown_kind"),
        (c("stage_id").isNull() | ~c("stage_id").isin(*STAGES), "unknown_stage"),
        (c("page_number") < 1, "bad_page_number"),
        (c("completed_units").isNull() != c("total_units").isNull(), "unpaired_units"),
        ((c("completed_units") < 0) | (c("total_units") < 1), "bad_units"),
        (c("completed_units") > c("total_units"), "too_many_completed"),
        (c("completed_units").isNotNull() & blank(c("unit")), "missing_unit"),
        (c("elapsed_ms") < 0, "bad_elapsed"),
        (c("terminal").isNotNull() & (c("terminal") != c("kind").isin(*TERMINAL)), "terminal_disagrees"),
    )


def page_selection(requests: DataFrame, *, limit: int = MAX_PAGE_ENTRIES) -> DataFrame:
    """``"3,1,,3"`` → sorted distinct 0-based indices, or the first violation.

    ``requests``: request_id, selection, total_pages.  An empty selection means all pages.
    """
    tok = F.filter(F.transform(F.split("selection", ","), lambda t: F.trim(t)), lambda t: t != "")
    n = F.transform(tok, lambda t: F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("int")))
    every = F.when(F.col("total_pages") > 0, F.sequence(F.lit(0), F.col("total_pages") - 1)).otherwise(
        F.array().cast("array<int>"))
    picked = F.array_sort(F.array_distinct(F.transform(n, lambda v: v - 1)))
    why = first_reason(
        (F.size(n) > limit, "too_many_entries"),
        (F.exists(n, lambda v: v.isNull()), "invalid_index"),
        (F.exists(n, lambda v: (v < 1) | (v > F.col("total_pages"))), "out_of_bounds"))
    empty = F.coalesce(F.col("selection"), F.lit("")) == ""
    return requests.select(
        "request_id",
        F.when(empty, every).when(why.isNull(), picked).alias("pages"),
        F.when(~empty, why).alias("violation"))


# Fixed preflight limits.
BUDGET = dict(max_pages=500, max_selected=200, max_width=12_000, max_height=12_000,
              max_page_px=64_000_000, max_total_px=1_000_000_000)


def render_budget(pages: DataFrame, *, limits: dict = BUDGET, block: int = 256) -> DataFrame:
    """First violated render limit per document, in page order; NULL when it fits.

    The running pixel total is a blocked scan; the first offending page is a ``min_by``.
    """
    c, m = F.col, {**BUDGET, **limits}
    px = c("width_px").cast("bigint") * c("height_px")
    p = scan.running_sum(pages.withColumn("px", px), ["doc_id"], "page_number", "px", "total", block=block)
    why = first_reason(
        ((c("width_px") <= 0) | (c("height_px") <= 0), "invalid_page"),
        ((c("width_px") > m["max_width"]) | (c("height_px") > m["max_height"]), "dimension_limit"),
        (c("px") > m["max_page_px"], "page_pixel_limit"),
        (c("total") > m["max_total_px"], "total_pixel_limit"))
    d = p.withColumn("why", why).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("why").isNotNull(), F.struct("page_number", "why"))).alias("f"),
        F.sum("px").alias("total_px"))
    over = F.when(c("n") > m["max_pages"], "document_page_limit").when(
        c("n") > m["max_selected"], "selected_page_limit")
    return d.select(
        "doc_id", F.when(over.isNull(), c("f.page_number")).alias("page_number"),
        F.coalesce(over, c("f.why")).alias("violation"), "total_px")


def public_errors(errors: DataFrame, *, include_debug: bool = False) -> DataFrame:
    """Errors as shown to callers; the debug context stays out unless asked for."""
    cols = ["job_id", "category", "code", "public_message", "user_actionable", "retryable"]
    why = first_reason(
        (~F.col("category").isin("invalid_request", "input", "correction", "resource", "dependency",
                                 "cancelled", "internal"), "unsupported_category"),
        (blank(F.col("code")), "missing_code"), (blank(F.col("public_message")), "missing_message"))
    extra = [F.when(F.size("debug_context") > 0, F.col("debug_context")).alias("debug_context")] if include_debug else []
    return errors.select(*cols, *extra, why.alias("violation"))
