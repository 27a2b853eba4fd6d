"""Registered queries against their SQL twins; ``KEYLOOM_ALL_QUERIES=1`` runs every one."""

import os

import pytest

import check
from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ("islands mask_confusion element_tags run_totals sample_track_mixed curve_points match_tol1 soft_iou "
          "frame_split resolve_claims nest_flatten simplify_count live_summary sweep sweep_best noisy_mask ablate_noise "
          "project_ingest project_nodes project_quarantine resolve_configs ancestors resolve_layers").split()
NAMES = list(queries()) if os.environ.get("KEYLOOM_ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.fixture(scope="module", autouse=True)
def shipped_plans(spark):
    """Queries are tested with adaptive execution and whole-stage code, as they run."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.codegen.wholeStage")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "true")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_entry_and_names(spark):
    assert entry(spark).limit(1).count() == 1
    assert set(oracle_sql()) <= set(queries())
