"""Queries that bind every row of their tables, against their twins or brute force."""

import duckdb
import pytest

import check
from __spark_entry__ import oracle_sql, queries
from keyloom.plans.pipelines import TOL

SF = "/root/testdata/sf0.001"
WHOLE = "apply_group_transforms_all probe_temporal_error_all frame_coverage_all shift_cov_all with_opacity_all".split()


@pytest.mark.parametrize("name", WHOLE)
def test_equals_its_twin(spark, name):
    assert name in oracle_sql()
    ok, note = check.compare(spark, check.duck(SF), SF, name)
    assert ok, note


def test_no_matrix_label_or_side_is_left_out(spark):
    con = check.duck(SF)
    q = queries()
    every = {r[0] for r in con.execute("SELECT vec_id FROM embeddings").fetchall()}
    assert {r.frame for r in q["apply_group_transforms_all"](spark, SF).collect()} == every
    labels = {r[0] for r in con.execute("SELECT DISTINCT label FROM embeddings").fetchall()}
    assert len(labels) > 1 and {r.label for r in q["probe_temporal_error_all"](spark, SF).collect()} == labels
    for name in ("frame_coverage_all", "shift_cov_all", "with_opacity_all"):
        assert {r.side for r in q[name](spark, SF).select("side").distinct().collect()} == {"O", "F"}


def test_ledger_scores_both_sides(spark, monkeypatch):
    from keyloom.operators import quality as Q
    seen = []
    plain = Q.check_self_score
    monkeypatch.setattr(Q, "check_self_score", lambda scores: seen.append(scores) or plain(scores))
    ok, note = check.compare(spark, check.duck(SF), SF, "ledger")
    assert ok, note
    assert {r.side for r in seen[0].select("side").distinct().collect()} == {"O", "F"}


def fits(v, a, b):
    return all(abs(v[m] - (v[a] * (1 - (m - a) / (b - a)) + v[b] * ((m - a) / (b - a)))) <= TOL for m in range(a + 1, b))


def fewest(v):
    best = {0: 1}
    for b in range(1, len(v)):
        best[b] = min(best[a] + 1 for a in range(b) if fits(v, a, b))
    return best[len(v) - 1]


def furthest(v, patience=8):
    """Knots of the greedy that ends its search after ``patience`` misses in a row."""
    at, n = 0, 1
    while at < len(v) - 1:
        best, misses = at + 1, 0
        for b in range(at + 1, len(v)):
            best, misses = (b, 0) if fits(v, at, b) else (best, misses + 1)
            if misses >= patience:
                break
        at, n = best, n + 1
    return n


def test_simplify_count_of_every_track(spark):
    rows = duckdb.sql(f"SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM '{SF}/events.parquet' GROUP BY 1").fetchall()
    want = {u: ("trivial", len(v)) if len(v) <= 2 else ("dp", fewest(v)) if len(v) <= 64 else ("greedy", furthest(v)) for u, v in rows}
    got = {r.user_id: (r.method, r.n_knots) for r in queries()["simplify_count_all"](spark, SF).collect()}
    assert got == want and "greedy" in {m for m, _ in want.values()}
