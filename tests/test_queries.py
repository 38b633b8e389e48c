"""A cross-section of the registered queries against their SQL on the smallest tables."""

import helpers
import pytest

import __spark_entry__ as registry

KEYS = [
    "src_gitignore", "src_multi_target", "file_signals", "match_all", "comment_inline", "taint_join", "scan_findings",
    "scan_code", "dedup_active", "rule_action", "scope_files", "scope_rules", "reconcile", "recon_counters", "exc_match",
    "exc_decide", "exc_ack_mark", "exc_pending_push", "audit_history", "ins_signals", "rep_remediation", "rep_context",
    "export_rule_stats", "rules_registry", "fleet_verify", "dep_requirements", "queue_dispose", "st_tumbling",
    "sink_state_overwrite",
]


@pytest.fixture(scope="module")
def con(sf):
    return helpers.connect(sf)


@pytest.mark.parametrize("key", KEYS)
def test_query(spark, sf, con, key):
    df = registry.queries()[key](spark, sf)
    got = helpers.canonical([tuple(r) for r in df.collect()], df.columns)
    rel = con.execute(registry.oracle_sql()[key])
    cols = [c[0] for c in rel.description]
    assert got == helpers.canonical(rel.fetchall(), cols)
    assert got[0]


def test_entry(spark):
    assert registry.entry(spark).count() >= 0
