"""Reviewed corrections: last-wins merges, bar edits, boundary decisions, reuse.

A log row is addressed by page, system and measure and ordered by a unique ``ord``.
Keeping the last row per key is one map-side combined ``max_by``, so a key that holds a
large part of the log is reduced before the shuffle.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import KEYS
from ..functions import geometry as g
from . import blocking as bl
from . import joins

AT = ("system", "measure")


def measure_span_ops(log: DataFrame) -> DataFrame:
    """Rows of the measure-span log that change something, with ``skip`` = span - 1.

    ``suppress`` keeps skip NULL; spans below one carry a violation; other ops vanish.
    """
    span = F.col("measure_span")
    return log.where(F.col("op").isin("suppress", "set_measure_span")).select(
        *[c for c in log.columns if c not in ("skip", "measure_span")],
        F.when((F.col("op") == "set_measure_span") & (span >= 1), span - 1).alias("skip"),
        F.when((F.col("op") == "set_measure_span") & (F.coalesce(span, F.lit(0)) < 1),
               "measure_span_below_one").alias("violation"),
    )


def force_measures(log: DataFrame) -> DataFrame:
    """Interval-level ``force_measure`` overrides of the construction log."""
    return log.where("op = 'force_measure'").withColumn("force_measure", F.lit(True))


def bar_edits(log: DataFrame) -> DataFrame:
    """``add_barline`` / ``remove_barline`` log rows as add / remove edits."""
    return log.where(F.col("op").isin("add_barline", "remove_barline")).withColumn(
        "op", F.when(F.col("op") == "add_barline", "add").otherwise("remove"))


def merge(
    auto: DataFrame, construction: DataFrame, spans: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """One effective override per key.

    Automatic rows first, forced intervals appended, then the measure-span log in order: a
    key it touches takes its last operation (nothing when that is ``suppress``).
    """
    ids = [*keys, *AT]
    row = lambda df, stage, force: df.select(
        *ids, F.lit(stage).alias("stage"), F.col("ord").cast("bigint").alias("ord"),
        F.col("skip").cast("int").alias("skip"), F.col("set_number").cast("int").alias("set_number"),
        F.lit(force).alias("force_measure"),
        (F.col("op") == "suppress").alias("gone") if "op" in df.columns else F.lit(False).alias("gone"))
    log = (
        row(auto, 0, False)
        .unionByName(row(construction, 1, True))
        .unionByName(row(spans.where("violation IS NULL"), 2, False))
    )
    last = log.groupBy(*ids).agg(F.max(F.struct(
        "stage", "ord", "skip", "set_number", "force_measure", "gone")).alias("r"))
    return last.where(~F.col("r.gone")).select(
        *ids, "r.skip", "r.set_number", "r.force_measure", "r.stage")


def suppressions(log: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``suppress`` operations as neutral ``skip = 0`` overrides, first per key."""
    ids = [*keys, *AT]
    return log.where("op = 'suppress'").groupBy(*ids).agg(
        F.min("ord").alias("ord")).select(*ids, "ord", F.lit(0).alias("skip"))


def concat_overrides(*logs: DataFrame) -> DataFrame:
    """Ordered concatenation of override payloads: (``payload``, ``ord``) is the order."""
    out = None
    for i, df in enumerate(logs):
        d = df.withColumn("payload", F.lit(i))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def apply_bar_overrides(
    bar: DataFrame,
    overrides: DataFrame,
    *,
    iou: float = 0.5,
    cell: int = 64,
    keys: Sequence[str] = KEYS,
) -> tuple[DataFrame, DataFrame]:
    """Apply ordered add / remove edits; returns (bars, per-page statistics).

    A remove deletes every box present at its time whose padded IoU is ≥ ``iou``: base
    boxes and boxes added *earlier*.  A box is charged to the first remove that meets it;
    a remove that is first for no box is counted as unmatched.

    Geometry is compared once per pair of *distinct* boxes; the order question is then a
    merge of two sorted logs per distinct box, not a product of its copies.
    """
    box = list(g.BOX)
    base = bar.groupBy(*keys, *box).agg(F.count("*").alias("n")).withColumn("ord", F.lit(-1).cast("bigint"))
    adds = overrides.where("op = 'add'").groupBy(*keys, *box, F.col("ord").cast("bigint").alias("ord")).agg(
        F.count("*").alias("n"))
    rem = overrides.where("op = 'remove'").select(*keys, *box, F.col("ord").cast("bigint").alias("ord"))
    items = base.unionByName(adds.select(*base.columns))

    r_geo = rem.select(*keys, *(F.col(n).alias(f"r_{n}") for n in box)).distinct()
    r_geo = bl.iou_cover(bl.expanded(r_geo, "s_", g.box("r_")), "s_", cell, iou)
    i_geo = bl.iou_anchor(bl.expanded(items.select(*keys, *box).distinct(), "e_"), "e_", cell)
    pairs = i_geo.join(
        r_geo, bl.eq(i_geo, r_geo, [*keys, "_cx", "_cy"])
        & (g.iou_expanded(g.box("e_"), g.box("s_")) >= iou)
    ).select(*(i_geo[k] for k in keys), *box, *(f"r_{n}" for n in box))

    # removes that can meet a distinct item box, in one timeline with the items themselves
    r_by_item = pairs.join(
        rem.select(*keys, *(F.col(n).alias(f"r_{n}") for n in box), "ord"),
        [*keys, *(f"r_{n}" for n in box)],
    ).select(*keys, *box, "ord", F.lit(None).cast("bigint").alias("n"))
    line = items.unionByName(r_by_item)
    w = Window.partitionBy(*keys, *box).orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("n").isNull(), F.col("ord"))).over(w)
    state = line.withColumn("removed_by", nxt).where("n IS NOT NULL")

    kept = state.where("removed_by IS NULL").select(*keys, *box, "n", "ord")
    tally = state.groupBy(*keys).agg(
        F.sum(F.when(F.col("removed_by").isNotNull(), F.col("n")).otherwise(0)).alias("removed"),
        F.sum(F.when(F.col("ord") >= 0, F.col("n")).otherwise(0)).alias("added"))
    matched = state.where("removed_by IS NOT NULL").select(*keys, "removed_by").distinct().groupBy(
        *keys).agg(F.count("*").alias("matched"))
    asked = rem.groupBy(*keys).agg(F.count("*").alias("remove_requests"))
    z = F.lit(0)
    stats = tally.join(asked, list(keys), "full").join(matched, list(keys), "left").select(
        *keys, F.coalesce("removed", z).alias("removed"), F.coalesce("added", z).alias("added"),
        F.coalesce("remove_requests", z).alias("remove_requests"),
        (F.coalesce("remove_requests", z) - F.coalesce("matched", z)).alias("unmatched_remove"))
    return kept, stats


def page_local(overrides: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Readdress overrides of every page as page 0 of its own single-page score.

    The global page stays in ``source_page``; filter on it to take one page.
    """
    return overrides.withColumn("source_page", F.col(keys[-1])).withColumn(keys[-1], F.lit(0))


# ---- movement boundaries ---------------------------------------------------------

STATES = ("confirmed_automatic", "explicit_manual_configured", "ambiguous_review_required",
          "no_boundary")


def check_evidence(evidence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Violations of movement evidence: bad index, unknown state, duplicate place or id."""
    at = [*keys, "system"]
    eid = F.coalesce("candidate_id", F.concat(F.lit("page:"), F.col(keys[-1]), F.lit(":system:"),
                                              F.col("system")))
    e = evidence.withColumn("candidate_id", eid)
    # counted by aggregation, not by a window over a possibly hot key
    dup_place = e.groupBy(*at).count().where("count > 1").select(
        *at, F.lit("duplicate_location").alias("violation"))
    dup_id = e.where("candidate_id <> ''").groupBy(keys[0], "candidate_id").agg(
        F.count("*").alias("n"), F.min(F.struct(keys[-1], "system")).alias("p")).where("n > 1").select(
        keys[0], F.col(f"p.{keys[-1]}").alias(keys[-1]), "p.system", F.lit("duplicate_id").alias("violation"))
    row = F.when((F.col(keys[-1]) < 0) | (F.col("system") < 0), "negative_index").when(
        ~F.col("state").isin(*STATES) | F.col("state").isNull(), "unknown_state").when(
        F.col("candidate_id") == "", "empty_id")
    return (
        e.select(*at, row.alias("violation")).where("violation IS NOT NULL")
        .unionByName(dup_place).unionByName(dup_id)
    )


def classify_reviews(review: DataFrame, evidence: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Review rows with their kind and violation.

    Accepting or rejecting needs an unresolved candidate; a boundary elsewhere is manual; a
    ``no_boundary`` without candidate is invalid.
    """
    at = [*keys, "system"]
    open_ = evidence.where("state = 'ambiguous_review_required'").select(
        *at, F.coalesce("candidate_id", F.concat(
            F.lit("page:"), F.col(keys[-1]), F.lit(":system:"), F.col("system"))).alias("evidence_candidate_id"))
    dup = review.groupBy(*at).agg(F.count("*").alias("_n"))
    r = review.join(open_, at, "left").join(dup, at)
    has = F.col("evidence_candidate_id").isNotNull()
    return r.select(
        *review.columns, "evidence_candidate_id",
        F.when(has & (F.col("op") == "boundary"), "accepted_candidate")
        .when(has, "rejected_candidate").otherwise("manual_boundary").alias("review_kind"),
        F.when(~F.col("op").isin("boundary", "no_boundary"), "unknown_op")
        .when(F.col("_n") > 1, "duplicate_location")
        .when(~has & (F.col("op") == "no_boundary"), "no_boundary_without_candidate")
        .alias("violation"),
    )


def unresolved(evidence: DataFrame, review: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Places that require a review and have none."""
    at = [*keys, "system"]
    return evidence.where("state = 'ambiguous_review_required'").select(*at).distinct().join(
        review.select(*at).distinct(), at, "left_anti")


#: Fixed value: the schema of evidence documents, named in each boundary's provenance.
EVIDENCE_SCHEMA = "issue333.movement_boundary_evidence.v1"


def resolve_boundaries(
    evidence: DataFrame,
    review: DataFrame,
    *,
    evidence_artifact: str,
    evidence_sha256: str,
    allow_unresolved: bool = False,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Boundary rows (reset to 1) from explicit decisions, with provenance.

    A score with an invalid or missing decision yields no boundaries unless
    ``allow_unresolved``; the gate is an anti-join on the score, not a driver check.
    """
    score = list(keys[:-1])
    c = classify_reviews(review, evidence, keys)
    bad = c.where("violation IS NOT NULL").select(*score)
    if not allow_unresolved:
        bad = bad.unionByName(unresolved(evidence, review, keys).select(*score))
    ok = c.where("op = 'boundary' AND violation IS NULL").join(bad.distinct(), score, "left_anti")
    accepted = F.col("review_kind") == "accepted_candidate"
    reason = F.col("reason") if "reason" in review.columns else F.lit(None).cast("string")
    return ok.select(
        *keys, "system", F.lit(1).alias("reset_number"),
        F.when(accepted, "reviewed_candidate").otherwise("manual").alias("source"),
        F.struct(
            F.lit("movement_boundary_review").alias("kind"),
            F.struct(
                F.lit(EVIDENCE_SCHEMA).alias("schema_version"),
                F.lit(evidence_artifact).alias("artifact"),
                F.lit(evidence_sha256.lower()).alias("sha256"),
                F.when(accepted, F.col("evidence_candidate_id")).alias("candidate_id"),
            ).alias("evidence"),
            F.struct(
                F.when(accepted, "accepted_candidate").otherwise("manual_boundary").alias("action"),
                F.coalesce(F.when(reason != "", reason), F.lit("manual movement-boundary review"))
                .alias("reason"),
            ).alias("review"),
        ).alias("provenance"),
    )


def check_boundaries(boundaries: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Violations of boundary rows: integers ≥ 0, unique place, source, provenance."""
    at = [*keys, "system"]
    dup = boundaries.groupBy(*at).count().where("count > 1").select(
        *at, F.lit("duplicate_boundary").alias("violation"))
    bad = F.when(
        F.col("page_index").isNull() | F.col("system").isNull() | F.col("reset_number").isNull(),
        "not_an_integer",
    ).when((F.col(keys[-1]) < 0) | (F.col("system") < 0), "negative_index").when(
        F.coalesce(F.trim("source"), F.lit("")) == "", "missing_source")
    if "provenance" in boundaries.columns:
        bad = bad.when(F.col("provenance").isNull(), "missing_provenance")
    return boundaries.select(*at, bad.alias("violation")).where(
        "violation IS NOT NULL").unionByName(dup)


def boundary_targets(
    boundaries: DataFrame, pages: DataFrame, excluded: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Boundaries that hit an unknown or an excluded page."""
    b = boundaries.select(*keys, "system")
    out = b.join(pages.select(*keys).distinct(), list(keys), "left_anti").withColumn(
        "violation", F.lit("unknown_page"))
    hit = b.join(excluded.select(*keys).distinct(), list(keys), "left_semi").withColumn(
        "violation", F.lit("excluded_page"))
    return out.unionByName(hit)


# ---- incremental recompute --------------------------------------------------------


def remap_user_overrides(
    overrides: DataFrame, changed: DataFrame, old: DataFrame, new: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """User overrides re-addressed on pages whose bars changed.

    Unchanged pages keep their keys; on changed ones the measure is remapped strictly and a
    forced interval is an error.  Adds ``new_measure`` and ``violation``.
    """
    ids = [*keys, *AT]
    o = overrides.join(changed.select(*keys).distinct().withColumn("_c", F.lit(True)), list(keys), "left")
    force = F.coalesce("force_measure", F.lit(False))
    m = joins.remap_measures(
        o.where(F.col("_c") & ~force), old, new, keys=keys)
    return o.join(m, ids, "left").select(
        *overrides.columns,
        F.when(F.col("_c").isNull() | force, F.col("measure")).otherwise(F.col("remapped")).alias("new_measure"),
        F.when(F.col("_c") & force, "force_measure_on_changed_bars")
        .when(F.col("_c"), F.col("reason")).alias("violation"),
    )


def reuse_auto(
    auto: DataFrame,
    changed: DataFrame,
    old: DataFrame,
    new: DataFrame,
    affected_old: DataFrame,
    affected_new: DataFrame,
    manual: DataFrame,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Automatic overrides that stay valid outside the corrected neighbourhood.

    Dropped when near a changed bar (old or new geometry) or overridden by hand; an
    unmappable one is reported in ``violation``.  Last row per resulting key wins.
    """
    ids = [*keys, *AT]
    a = auto.join(affected_old.select(*ids).distinct(), ids, "left_anti")
    a = a.join(changed.select(*keys).distinct().withColumn("_c", F.lit(True)), list(keys), "left")
    m = joins.remap_measures(a.where("_c"), old, new, keys=keys)
    a = a.join(m, ids, "left").select(
        *keys, "system", F.when(F.col("_c").isNull(), F.col("measure")).otherwise(F.col("remapped")).alias("measure"),
        "skip", "set_number", "ord", F.when(F.col("_c"), F.col("reason")).alias("violation"),
        F.col("measure").alias("old_measure"))
    for block in (affected_new, manual):
        a = a.join(block.select(*ids).distinct(), ids, "left_anti")
    good = joins.last_wins(a.where("violation IS NULL").drop("violation", "old_measure"), ids)
    bad = a.where("violation IS NOT NULL").select(
        *keys, "system", F.col("old_measure").alias("measure"), "skip", "set_number", "ord", "violation")
    return good.withColumn("violation", F.lit(None).cast("string")).unionByName(bad)


def selective_merge(reused: DataFrame, selective: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Selective results overwrite reused ones on the same key."""
    ids = [*keys, *AT]
    cols = [*ids, "skip", "set_number", "ord"]
    both = reused.select(*cols, F.lit(0).alias("_s")).unionByName(
        selective.select(*cols, F.lit(1).alias("_s")))
    return both.groupBy(*ids).agg(
        F.max(F.struct("_s", "ord", "skip", "set_number")).alias("r")
    ).select(*ids, "r.skip", "r.set_number", (F.col("r._s") == 1).alias("selective"))


def page_reuse(
    before: DataFrame, after: DataFrame, corrected: DataFrame, boundaries: DataFrame,
    *, keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Pages whose final numbering can be reused unchanged.

    Unchanged bars and overrides, before the first movement boundary of the score, and the
    recorded start equal to the recomputed one with a recorded next number.
    """
    score = list(keys[:-1])
    first = boundaries.groupBy(*score).agg(F.min(keys[-1]).alias("first_boundary"))
    c = corrected.select(*keys).distinct().withColumn("_c", F.lit(True))
    b = before.select(*keys, F.col("start_number").alias("old_start"), F.col("next_number").alias("old_next"))
    j = after.join(b, list(keys), "left").join(c, list(keys), "left").join(first, score, "left")
    ok = (
        F.col("_c").isNull()
        & (F.col("first_boundary").isNull() | (F.col(keys[-1]) < F.col("first_boundary")))
        & F.coalesce(F.col("old_start") == F.col("start_number"), F.lit(False))
        & F.col("old_next").isNotNull()
    )
    return j.select(*keys, "start_number", "next_number", ok.alias("reused"))


def reusable_state(
    persisted: DataFrame, expected: DataFrame, *, schema: str, contract: str,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Persisted next number where schema, contract, start and boundaries all match."""
    e = expected.select(*keys, F.col("start_number").alias("_s"), F.col("boundaries").alias("_b"))
    j = persisted.join(e, list(keys))
    ok = (
        (F.col("schema_version") == schema)
        & (F.col("system_index_contract") == contract)
        & (F.col("start_number") == F.col("_s"))
        & F.col("boundaries").eqNullSafe(F.col("_b"))
    )
    return j.select(*keys, F.when(ok, F.col("next_number")).alias("reusable_next"))
