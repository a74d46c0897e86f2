"""Registered queries against their DuckDB oracles at sf0.01; where rows could be mixed up, at sf0.001 too, where ids repeat.

The quick subset runs by default; ORACLES=all runs every query.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stavelake.fixtures import TABLES

QUICK = """
box_extents expanded_boxes detection_overlaps clipped_boxes inferred_scales unit_normalized_boxes staff_units
seed_units connector_precedence ocr_number_scores strict_integers measure_numbering page_carry_over
systems_by_geometry unknown_boundaries detector_consensus nearest_existing_bar suppressed_by_existing double_bars
remapped_measures bars_assigned_to_bands staff_strokes staff_overlap_filter divisi_links merged_measure_overrides
bars_after_edits bar_edit_statistics movement_evidence_violations movement_review_kinds resolved_movement_boundaries
row_clusters mask_bands x_cluster_filter stripe_signal local_contrast scan_acceptance rightmost_rescue gap_rescue
staff_votes rest_decisions retry_ladder support_view_decisions correction_record_violations job_result_violations
page_selections render_budget page_inventory detection_documents_strict override_documents page_manifest
sequence_violations stage_spans cpu_percentages scan_totals review_package_states streamed_sequence_violations
band_projections band_profiles divisi_positions probe_scan retry_results merged_ocr_tokens streamed_stage_spans streamed_cpu_percentages
""".split()
NAMES = list(entry.oracle_sql()) if os.environ.get("ORACLES") == "all" else QUICK


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert table(df.columns, map(tuple, df.collect())) == table(cols, cur.fetchall())


REPEATED_IDS = "staff_strokes staff_overlap_filter suppressed_detections bars_assigned_to_bands signal_peaks signal_peaks_top".split()


@pytest.mark.parametrize("name", REPEATED_IDS)
def test_query_matches_oracle_where_ids_repeat(spark, name):
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = entry.queries()[name](spark, small)
    cur = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, map(tuple, df.collect())) == table([d[0] for d in cur.description], cur.fetchall())


def test_shared_folder_is_required_off_a_local_master(spark, monkeypatch):
    from stavelake import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        session.shared_dir(Session(), "tables")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
