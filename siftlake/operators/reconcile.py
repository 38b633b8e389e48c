"""Findings over time: one scan is merged into the stored state.

A finding seen again is refreshed or reopened, a new one is inserted, and an open one is resolved only
on evidence: its file was covered, its rule ran, and it was neither reported nor suppressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlake.operators.scope import flag_rule_excludes
from siftlake.session import written

KEY = ["repo_id", "finding_id"]
# Columns that this module knows; all others of a state are kept as they are.
STORED = [
    *KEY, "rule_id", "path", "line", "code_hash", "status", "severity", "base_severity", "first_seen", "last_seen", "last_scan_id", "times_seen",
    "reopen_count", "snippet", "confidence", "branch", "is_default_branch", "resolved_at",
]
MUTABLE = ["snippet", "severity", "base_severity", "line"]
DEFAULT_BRANCHES = ["main", "master", "trunk", "develop"]  # fixed values


def branch_flags(branch: Column, remote_default: Column | None = None) -> Column:
    """1 for the default branch, else 0; well-known names stand in for an unknown remote default."""
    fallback = F.coalesce(branch.isin(DEFAULT_BRANCHES), F.lit(False))
    known = fallback if remote_default is None else F.when(
        remote_default.isNotNull(), F.coalesce(branch == remote_default, F.lit(False))
    ).otherwise(fallback)
    return known.cast("int")


def scan_presence(scan: DataFrame) -> DataFrame:
    """One row per identity: the first active occurrence `f` and the two presence flags.

    A single aggregation with map-side combine replaces sorting occurrences in a window.
    """
    active = ~F.col("suppressed")
    fields = F.struct(
        "rule_id", "path", "line", "code_hash", "severity", "base_severity", "snippet", "confidence"
    )
    return (
        scan.where(F.col("finding_id").isNotNull())
        .groupBy(*KEY)
        .agg(
            F.min_by(F.when(active, fields), F.when(active, F.struct("ord", "line"))).alias("f"),
            F.max(active).alias("is_active"),
            F.max("suppressed").alias("is_suppressed"),
        )
    )


def unique_findings(scan: DataFrame) -> DataFrame:
    """First active occurrence of each identity."""
    return scan_presence(scan).where("is_active").select(*KEY, "f.*")


def null_hash_counts(scan: DataFrame) -> DataFrame:
    """(repo_id, skipped): identities whose first occurrence has no code hash."""
    return unique_findings(scan).groupBy("repo_id").agg(F.count_if(F.col("code_hash").isNull()).alias("skipped"))


def eligible_rules(rules: DataFrame) -> DataFrame:
    """(rule_id, in_secrets) of a registry(rule_id, pack), for the domain test of the resolve step."""
    return rules.groupBy("rule_id").agg(F.max(F.col("pack") == "secrets").alias("in_secrets"))


def reconcile(
    state: DataFrame, scan: DataFrame, *, scan_id: str, at: str, coverage: DataFrame | None = None,
    rules: DataFrame | None = None, scope_rules: DataFrame | None = None, branch: str | None = None,
    is_default_branch: int = 0,
) -> DataFrame:
    """State rows after the scan with a `transition` column.

    transition: inserted, refreshed, reopened, resolved, untouched or skipped (reported without a code
    hash; such a row has no status when the identity is unknown). Without coverage nothing resolves.
    The full outer join is the only exchange of the state; the resolve evidence is looked up for open
    rows that were not seen.
    """
    seen = scan_presence(scan).withColumn("_seen", F.lit(True))
    old = state.withColumn("_known", F.lit(True))
    j = old.alias("o").join(seen.alias("n"), KEY, "full_outer")
    known = F.coalesce(F.col("_known"), F.lit(False))
    active = F.coalesce(F.col("is_active"), F.lit(False))
    has_hash = F.col("f.code_hash").isNotNull()
    status = F.col("o.status")
    kind = (
        F.when(~known & ~active, F.lit(None).cast("string"))
        .when(active & ~has_hash, "skipped")
        .when(active & ~known, "inserted")
        .when(active & (status == "open"), "refreshed")
        .when(active & (status == "resolved"), "reopened")
        .when(~active & (status == "open") & ~F.coalesce(F.col("is_suppressed"), F.lit(False)), "absent")
        .otherwise("untouched")
    )
    j = j.withColumn("transition", kind).where(F.col("transition").isNotNull())
    sighted = F.col("transition").isin("inserted", "refreshed", "reopened")
    new, back = F.col("transition") == "inserted", F.col("transition") == "reopened"

    def pick(new_value: Column, old_value: Column) -> Column:
        return F.when(sighted, new_value).otherwise(old_value)

    o = lambda c: F.col(f"o.{c}")
    f = lambda c: F.col(f"f.{c}")
    base = F.coalesce(f("base_severity"), f("severity"))
    merged = j.select(
        *KEY,
        F.when(new, f("rule_id")).otherwise(o("rule_id")).alias("rule_id"),
        F.when(new, f("path")).otherwise(o("path")).alias("path"),
        pick(f("line"), o("line")).alias("line"),
        F.when(new, f("code_hash")).otherwise(o("code_hash")).alias("code_hash"),
        F.when(sighted, "open").otherwise(o("status")).alias("status"),
        pick(f("severity"), o("severity")).alias("severity"),
        pick(base, o("base_severity")).alias("base_severity"),
        F.when(new, F.lit(at)).otherwise(o("first_seen")).alias("first_seen"),
        pick(F.lit(at), o("last_seen")).alias("last_seen"),
        pick(F.lit(scan_id), o("last_scan_id")).alias("last_scan_id"),
        F.when(sighted, F.coalesce(o("times_seen"), F.lit(0)) + 1).otherwise(o("times_seen")).cast("bigint").alias(
            "times_seen"
        ),
        (F.when(new, F.lit(0)).otherwise(F.coalesce(o("reopen_count"), F.lit(0))) + F.when(back, 1).otherwise(0))
        .cast("bigint").alias("reopen_count"),
        pick(f("snippet"), o("snippet")).alias("snippet"),
        F.when(sighted, F.coalesce(f("confidence"), _old(state, "confidence"))).otherwise(
            _old(state, "confidence")
        ).alias("confidence"),
        pick(F.lit(branch), _old(state, "branch")).alias("branch"),
        pick(F.lit(is_default_branch), _old(state, "is_default_branch", "int")).alias("is_default_branch"),
        F.when(~sighted, o("resolved_at")).alias("resolved_at"),
        *[o(c).alias(c) for c in state.columns if c not in STORED],
        "transition",
    )
    return _resolve(merged, at, coverage, rules, scope_rules)


def _old(state: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(f"o.{name}") if name in state.columns else F.lit(None).cast(kind)


def _resolve(merged, at, coverage, rules, scope_rules) -> DataFrame:
    """Turn `absent` into resolved where the evidence is complete, else into untouched."""
    absent = F.col("transition") == "absent"
    if coverage is None or rules is None:
        return merged.withColumn("transition", F.when(absent, "untouched").otherwise(F.col("transition")))
    domains = coverage.groupBy("repo_id", "path").agg(
        F.max(F.col("rule_domain") == "all").alias("_all"), F.max(F.col("rule_domain") == "secrets").alias("_sec")
    )
    # Only absent rows take part in the look-ups; the others pass by without being exchanged again. The rows are written, as
    # the look-ups read them several times and the outer join would be made again each time.
    merged = written(merged, "merged")
    absent = F.col("transition") == "absent"
    rest, cand = merged.where(~absent), merged.where(absent)
    cand = cand.join(domains, ["repo_id", "path"], "left").join(eligible_rules(rules), "rule_id", "left")
    if scope_rules is not None:
        cand = flag_rule_excludes(cand, scope_rules)
    else:
        cand = cand.withColumn("scope_excluded", F.lit(False))
    ran = F.coalesce(
        F.col("in_secrets").isNotNull() & (F.col("_all") | (F.col("_sec") & F.col("in_secrets"))), F.lit(False)
    )
    gone = ran & ~F.col("scope_excluded")
    cand = cand.withColumns(
        {
            "status": F.when(gone, "resolved").otherwise(F.col("status")),
            "resolved_at": F.when(gone, F.lit(at)).otherwise(F.col("resolved_at")),
            "transition": F.when(gone, "resolved").otherwise("untouched"),
        }
    )
    return rest.unionByName(cand.select(*rest.columns))


def new_state(merged: DataFrame) -> DataFrame:
    """Rows to store (a skipped identity that was never stored is left out)."""
    return merged.where(F.col("status").isNotNull()).drop("transition")


def counters(merged: DataFrame) -> DataFrame:
    """One row per repository: what the scan changed."""
    t = F.col("transition")
    return merged.groupBy("repo_id").agg(
        F.count_if(t == "inserted").alias("added"), F.count_if(t == "refreshed").alias("refreshed"),
        F.count_if(t == "skipped").alias("skipped"), F.count_if(t == "resolved").alias("resolved"),
        F.count_if(t == "reopened").alias("reopened"), F.count_if(F.col("status") == "open").alias("total_open"),
        F.count_if(F.col("status").isNotNull()).alias("total"),
    )


def bootstrap(scan: DataFrame, *, scan_id: str, scan_date: str, empty_state: DataFrame) -> DataFrame:
    """First state out of the latest snapshot, dated at that scan; it never resolves anything."""
    return new_state(reconcile(empty_state, scan, scan_id=scan_id, at=scan_date))
