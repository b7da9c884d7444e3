"""Every registered query equals its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01); queries without an oracle must run.

The same pass guards every plan: no cartesian products, and no nested-loop
joins except Catalyst's one-row existence probe (an anti/semi join against a
constant key becomes a nested loop whose broadcast side is ``LIMIT 1``)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def _pairwise_loops(plan: str) -> list[str]:
    lines = plan.split("\n")
    bad = [line for line in lines if "CartesianProduct" in line]
    for i, line in enumerate(lines):
        if "BroadcastNestedLoopJoin" in line:
            nxt = [j for j in range(i + 1, min(i + 60, len(lines))) if "BroadcastExchange" in lines[j]]
            if not (nxt and "Limit 1" in lines[nxt[0] + 1]):
                bad.append(line)
    return bad


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not _pairwise_loops(plan), plan
    if name not in ORACLES:
        assert df.count() >= 0
        return
    ok, msg = compare(df, con, ORACLES[name])
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"product_id", "nama_produk", "tipe", "total"}


TIME_DEPENDENT = ["overdue_tickets", "retention_purge", "burst_failures", "burst_failures_simple", "delivery_outcome",
                  "dead_letter", "technician_today", "voucher_status", "monthly_stats", "avg_resolution_asof",
                  "ticket_intake", "status_kpis", "technician_upcoming_dates", "stream_burst_failures",
                  "voucher_candidates"]


def test_results_do_not_depend_on_session_time_zone(spark, con):
    """Text dates are wall-clock values: the same results under a non-UTC session."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for name in TIME_DEPENDENT:
            ok, msg = compare(QUERIES[name](spark, SF), con, ORACLES[name])
            assert ok, f"{name}: {msg}"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
