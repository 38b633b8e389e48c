"""Whole jobs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx, scan as sc_cat, state as st
from siftlake.catalog.files import CLASSIFY, EXT, both, q
from siftlake.catalog.fixtures import sql
from siftlake.operators import reports as rp, rules as rl
from siftlake.plans import scan_job
from siftlake.sources import files as src

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


def scan_everything(s, d):
    """All built-in packs over documents, pages and code files, with the default policy."""
    out = scan_job.scan(src.balanced(both(s, d)), as_of=st.AS_OF, vendor="include", max_kb=1 << 20)
    return out.findings.select("repo_id", "path", "line", "rule_id", "base_severity", "severity", "confidence", "action", "finding_id")


register("scan_builtin", scan_everything)


def report_of_scan(s, d):
    """Severity counts of the flagship scan, per repository."""
    f = sc_cat.scan_findings(s, d)
    return f.groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


register("rep_scan_severity", report_of_scan,
         sql("files", "SELECT repo_id, severity, count(*) AS findings FROM kept GROUP BY ALL", *sc_cat.FOUND_ALL, *sc_cat.DEDUP_SQL))
