"""Votes and decisions over stored OCR results.

A measure has one result per staff and stored view, so the candidate arrays below hold at
most one entry per distinct number seen by the staves of one system.  Counting happens in
a map-side combined aggregation before anything is collected.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from . import folds

PROB = 0.5
RESCUE_PROB = 0.1
RESCUE_SCORE = 60
VETO_PROB_MAX = 0.60
VETO_MIN_EVIDENCE = 2
JITTER_SCORE = 5.0


def number_candidates(tokens: DataFrame, keys: Sequence[str], img_w: str, img_h: str) -> DataFrame:
    """Every number of every raw or merged token with its spatial score."""
    crop = Window.partitionBy(*keys)
    sized = tokens.select("*", F.max(img_w).over(crop).alias("_w"), F.max(img_h).over(crop).alias("_h"))
    t = folds.candidate_tokens(sized, keys, ("_w", "_h"))
    t = t.select("*", F.posexplode(tx.numbers_in(F.col("text"))).alias("pos", "digits"))
    t = t.withColumn("value", F.col("digits").try_cast("int"))
    s = tx.number_score(F.col("value"), F.col("digits"), F.col("text"), g.box(), F.col("_w"), F.col("_h"))
    return t.withColumn("score", s).drop("_w", "_h")


def best_number(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best-scored number per crop; ties go to raw before merged, then to reading order."""
    order = F.struct(
        -F.col("score"), F.when(F.col("source") == "raw", 0).otherwise(1), F.col("ord"), F.col("pos"))
    return candidates.where("score IS NOT NULL").groupBy(*keys).agg(
        F.min_by(F.struct("value", "score"), order).alias("r")
    ).select(*keys, "r.value", "r.score")


def one_bar_evidence(readings: DataFrame, measure: Sequence[str], view: str) -> DataFrame:
    """Confident printed "1"s of crops: summed over staves per view, then the maximum over views."""
    per_view = readings.where("ones > 0").groupBy(*measure, view).agg(F.sum("ones").alias("n"))
    return per_view.groupBy(*measure).agg(F.max("n").alias("evidence"))


def _tally(results: DataFrame, keys: Sequence[str], order: str, *more: Column) -> DataFrame:
    """Per distinct value: votes, best score (first on ties) and first occurrence."""
    return results.groupBy(*keys, "value").agg(
        F.count("*").alias("n"), F.max("score").alias("best"), F.min(order).alias("first"),
        F.min_by(order, F.struct(-F.col("score"), F.col(order))).alias("best_at"), *more,
    )


def unique_leader(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Value with strictly most votes among numbers ≥ 2; NULL and score 0 on a tie."""
    real = lambda c: F.when(F.col("value") >= 2, c)
    top = _tally(results, keys, order).groupBy(*keys).agg(
        F.max(real(F.struct("n", "value", "best"))).alias("high"), F.max(real(F.struct("n", (-F.col("value")).alias("v")))).alias("low"))
    one = F.col("high.value") == -F.col("low.v")  # of values with equal votes, the largest is the smallest
    return top.select(
        *keys, F.when(one, F.col("high.value")).alias("value"),
        F.when(one, F.col("high.best")).otherwise(F.lit(0.0)).alias("score"))


def staff_value(results: DataFrame, keys: Sequence[str], order: str = "staff") -> DataFrame:
    """Number a system's staves agree on.

    A tie is broken by the best score when the probability is high – among values ≤ 20 in
    narrow measures if any – and by first occurrence otherwise.  ``results`` carries
    ``prob`` and ``width``.
    """
    t = _tally(results, keys, order, F.max("prob").alias("prob"), F.max("width").alias("width"))
    t = t.withColumn("result", F.struct("value", "best"))
    real = lambda *c: F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), *c))
    score = (-F.col("best"), "best_at", "value")
    # one value each: of those with most votes the first, the best-scored, the best-scored up to 20 if any
    a = t.groupBy(*keys).agg(
        F.min_by("result", real("first", "value")).alias("by_first"),
        F.min_by("result", real(*score)).alias("by_score"),
        F.min_by("result", real(F.col("value") > 20, *score)).alias("by_small"),
        F.min(real("value")).alias("low"), F.min(real((-F.col("value")).alias("v"))).alias("high"),
        F.max("prob").alias("prob"), F.max("width").alias("width"),
    ).where("low IS NOT NULL")
    tied = F.col("low.value") != -F.col("high.v")
    best = F.when(F.col("width") < 100, F.col("by_small")).otherwise(F.col("by_score"))
    won = F.when(tied & (F.col("prob") > PROB), best).otherwise(F.col("by_first"))
    return a.select(*keys, won["value"].alias("value"), won["best"].alias("score"), tied.alias("tied"), "width")


def variant_value(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Result over stored variants: best score, or after a staff conflict the best of a
    majority (≥ 2 and more than half) when there is one.

    Variants reading more than 20 in a narrow measure are ignored; the conflict flag of an
    ignored variant still counts.
    """
    ok = F.coalesce(~((F.col("value") > 20) & (F.col("width") < 100)), F.lit(False))
    t = _tally(results.withColumn("ok", ok), [*keys, "ok"], order, F.bool_or("tied").alias("tied"))
    if_ok = lambda c: F.when(F.col("ok"), c)
    a = t.groupBy(*keys).agg(
        F.sum(if_ok(F.col("n"))).alias("total"),
        F.min_by(F.struct("value", "best"), if_ok(F.struct(-F.col("best"), F.col("best_at")))).alias("top"),
        F.min_by(F.struct("n", "value", "best"), if_ok(F.struct(-F.col("n"), F.col("first")))).alias("maj"),
        F.bool_or("tied").alias("conflict"),
    ).where("total IS NOT NULL")
    use = F.col("conflict") & (F.col("maj.n") >= 2) & (F.col("maj.n") > F.col("total") / 2)
    return a.select(
        *keys, F.when(use, F.col("maj.value")).otherwise(F.col("top.value")).alias("value"),
        F.when(use, F.col("maj.best")).otherwise(F.col("top.best")).alias("score"), "conflict")


def jitter_consensus(views: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace a weak baseline when ≥ 3 of 5 jittered views agree on another number.

    ``views``: (view_no, value, score) with the baseline as view 0.
    """
    base = views.where("view_no = 0").select(*keys, F.col("value").alias("b_value"), F.col("score").alias("b_score"))
    t = _tally(views.where("value >= 2"), keys, "view_no")
    m = t.groupBy(*keys).agg(F.min_by(
        F.struct("n", "value", "best"), F.struct(-F.col("n"), F.col("first"))).alias("m"))
    j = base.join(m, list(keys), "left")
    replace = (
        F.col("b_value").isNotNull() & (F.col("b_score") <= JITTER_SCORE)
        & (F.coalesce(F.col("m.n"), F.lit(0)) >= 3) & (F.col("m.value") != F.col("b_value")))
    replace = F.coalesce(replace, F.lit(False))
    return j.select(
        *keys, F.when(replace, F.col("m.value")).otherwise(F.col("b_value")).alias("value"),
        F.when(replace, F.col("m.best")).otherwise(F.col("b_score")).alias("score"),
        replace.alias("replaced"))


# ---- decisions ---------------------------------------------------------------------


def vetoed(value: Column, prob: Column, score: Column, evidence: Column) -> Column:
    """Printed one-bar rest instead of a multi-measure rest."""
    return F.coalesce(
        (value != 0) & (prob > PROB) & (prob < VETO_PROB_MAX) & (score < 0)
        & (evidence >= VETO_MIN_EVIDENCE), F.lit(False))


def decision(value: Column, prob: Column, score: Column, evidence: Column) -> Column:
    """Status of one measure: one_bar_veto, found, rescue or NULL (no override)."""
    return F.when(
        (prob > RESCUE_PROB) & value.isNotNull() & (value != 0),
        F.when(vetoed(value, prob, score, evidence), "one_bar_veto")
        .when(prob > PROB, "found")
        .when(score > RESCUE_SCORE, "rescue"),
    )


def acceptable(value: Column, score: Column) -> Column:
    return F.coalesce((value >= 2) & (score > 0), F.lit(False))


def retry_ladder(df: DataFrame) -> Column:
    """Which stored view decides: baseline, j2, inset, calibrated, full_span or shifted.

    ``df`` columns: prob, evidence, value/score (baseline), left_wide and for each retry
    view ``<view>_value`` / ``<view>_score``.
    """
    c = F.col
    good = lambda v: acceptable(c(f"{v}_value"), c(f"{v}_score"))
    marginal = (c("prob") > PROB) & (c("prob") < VETO_PROB_MAX) & (
        F.coalesce(c("evidence"), F.lit(0)) >= VETO_MIN_EVIDENCE)
    none = c("value").isNull()
    return (
        F.when((c("prob") <= PROB) | marginal, "j2")
        .when(none & good("inset"), "inset")
        .when(~none & (c("score") > JITTER_SCORE),
              F.when(F.coalesce(c("left_wide"), F.lit(False)) & good("calibrated"), "calibrated")
              .otherwise("baseline"))
        .when(good("full_span"), "full_span")
        .when(good("shifted"), "shifted")
        .when(none, "baseline")
        .otherwise("j2")
    )


def retry_result(df: DataFrame) -> Column:
    """What the deciding view of ``retry_ladder`` gives: struct(source, value, score, evidence).

    Besides the ladder's columns ``df`` has j2_value / j2_score, the consensus of the jittered
    crops, and inset_evidence.  Only the inset crop counts its own evidence; every other retry
    keeps that of the baseline.
    """
    c = F.col
    source = retry_ladder(df)
    view = lambda n, value, score, evidence: (n, F.struct(
        F.lit(n).alias("source"), value.alias("value"), score.alias("score"), evidence.alias("evidence")))
    own = [view("baseline", c("value"), c("score"), c("evidence")), view("inset", c("inset_value"), c("inset_score"), c("inset_evidence"))]
    own += [view(n, c(f"{n}_value"), c(f"{n}_score"), c("evidence")) for n in ("j2", "calibrated", "full_span", "shifted")]
    out = F.lit(None)
    for n, s in own:
        out = F.when(source == n, s).otherwise(out)
    return out


def support_decision(prob: Column, primary: Column, alternate: Column, fallback: Column) -> Column:
    """Decision over three support views: struct(status, value, score).

    Each view is a struct(x1, value, score, evidence).  A valid primary is dropped when the
    alternate crop (only if its left edge differs) shows a one-bar rest; without any number
    and at high probability the fallback view decides.
    """
    d = decision(primary["value"], prob, primary["score"], primary["evidence"])
    alt = (alternate["x1"] != primary["x1"]) & vetoed(
        alternate["value"], prob, alternate["score"], alternate["evidence"])
    retry = primary["value"].isNull() & (prob > PROB)
    fb = decision(fallback["value"], prob, fallback["score"], fallback["evidence"])
    status = F.when(prob <= RESCUE_PROB, None).when(retry, fb).when(
        d.isin("found", "rescue") & F.coalesce(alt, F.lit(False)), "alternate_veto").otherwise(d)
    ok = status.isin("found", "rescue")
    src = lambda n: F.when(retry, fallback[n]).otherwise(primary[n])
    return F.struct(
        status.alias("status"), F.when(ok, src("value")).alias("value"),
        F.when(ok, src("score")).alias("score"))
