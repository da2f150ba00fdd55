"""Counts FIXTURES.md expects at sf0.01 for the derived inputs."""

from provenant.plans.catalog import QUERIES

from conftest import SF_MID


def test_transition_counts(spark):
    got = {r.verdict: r.n_events for r in QUERIES["transition_summary"](spark, SF_MID).collect()}
    assert got == {"ok": 6395, "bad_start": 1599, "to_uninitialized": 2006}


def test_verify_counts(spark):
    got = {r.status: r["count"] for r in QUERIES["verify_entries"](spark, SF_MID).groupBy("status").count().collect()}
    assert got == {"VERIFIED": 576, "FAILED": 96, "MISSING": 328}
