"""A complete scan: choose files, classify, match, route, de-duplicate, apply scope and exceptions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from siftlake.operators import audit, classify, exceptions as ex, match, reconcile as rc, rules as rl, scope as sc, severity as sev
from siftlake.sources import files as src, store


@dataclass
class ScanResult:
    """DataFrames of one scan; nothing has run yet."""

    findings: DataFrame
    suppressed: DataFrame
    coverage: DataFrame
    skipped: DataFrame
    excluded_rules: DataFrame
    routed: DataFrame
    finish: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def select_files(
    files: DataFrame, *, lang: str | None = None, vendor: str = "exclude", ignore_lines: DataFrame | None = None,
    scope_files: DataFrame | None = None, max_kb: int | None = None, no_limit: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(files to scan, skipped files). Path predicates come first, so the text of a file that is not
    wanted is not even decoded."""
    chosen = src.keep_language(files, lang) if lang else src.keep_supported(files)
    chosen = src.vendor_filter(src.drop_ignored_dirs(chosen), vendor)
    if ignore_lines is not None:
        chosen = src.apply_ignore(chosen, src.parse_ignore_lines(ignore_lines))
    if scope_files is not None:
        chosen = sc.exclude_files(chosen, scope_files)
    return src.size_guard(chosen, max_kb, no_limit)


def scan(
    files: DataFrame, rules: list[rl.Rule] | None = None, *, as_of: str, exceptions: DataFrame | None = None,
    policy: DataFrame | None = None, overrides: DataFrame | None = None, scope_rules: DataFrame | None = None,
    mode: str = "full", inline_comments: bool = False, no_limit: bool = False, low_score: int = 0,
    trace: bool = False, taint_max_kb: int | None = None, **selection,
) -> ScanResult:
    """Scan files(repo_id, path, content) with the given rules (default: the built-in packs).

    One narrow stage reads the texts; only findings are exchanged after it. `as_of` (ISO-8601 UTC) is
    the time exceptions are judged at, so a repeated run gives the same result.
    """
    rules = rules if rules is not None else rl.load_packs()
    kept, skipped = select_files(files, no_limit=no_limit, **selection)
    classified = classify.classify_files(kept)
    raw = match.scan_files(classified, rules, mode=mode, inline_comments=inline_comments, taint_max_kb=taint_max_kb)
    routed = sev.apply_context(raw, low_score=low_score, trace=trace)
    none = files.sparkSession.createDataFrame([], "rule_id string, findings_excluded bigint")

    def finish(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(findings, suppressed, excluded rules) of routed rows, lazily scanned or read from a table."""
        active, suppressed = sev.split_routes(rows)
        findings, excluded = sev.dedup_active(active), none
        if scope_rules is not None:
            findings, excluded = sc.exclude_rules(findings, scope_rules)
        if exceptions is not None:
            findings = ex.apply_exceptions(findings, exceptions, as_of)
        else:
            no = F.lit(False)
            findings = findings.withColumns({"excepted": no, "exception_expired": no, "exception_rejected": no})
        if policy is None and overrides is None:
            findings = findings.withColumn("action", sev.rule_action_noconfig(F.col("base_severity")))
        else:
            findings = sev.rule_action(findings, policy, overrides)
        findings = findings.withColumn("blocks", ~F.col("excepted") & (F.col("action") == "block"))
        return findings, sev.dedup_suppressed(suppressed), excluded

    findings, suppressed, excluded = finish(routed)
    return ScanResult(findings, suppressed, match.coverage(classified), skipped, excluded, routed, finish)


def persist(result: ScanResult, *, root: str, scan_id: str, at: str, rules: DataFrame, empty_state: DataFrame,
            branch: str | None = None, scope_rules: DataFrame | None = None, exceptions: DataFrame | None = None,
            scans: DataFrame | None = None) -> DataFrame:
    """Write the scan, merge it into the state, log it and archive exceptions that are over; returns the transitions.

    The texts are scanned a single time: the routed rows are written, and all other tables are derived from that table.
    scans(session_id, ts, hook, scan_mode, files_count, git_user) is the one row of this scan for the event log.
    Order: snapshot, log of the scan, reconciliation, log of transitions, archive of resolved and expired exceptions.
    """
    spark = result.findings.sparkSession
    one = lambda name: spark.read.parquet(f"{root}/{name}/scan_id={scan_id}")
    store.write_scan(result.routed, f"{root}/routed", scan_id)
    store.write_scan(result.coverage, f"{root}/coverage", scan_id)
    findings, suppressed, _ = result.finish(one("routed"))
    store.write_scan(findings, f"{root}/findings", scan_id)
    store.write_scan(suppressed, f"{root}/suppressed", scan_id)
    if scans is not None:
        logged = one("findings").withColumn("session_id", F.lit(scan_id))
        if "exc" not in logged.columns:
            logged = logged.withColumn("exc", F.lit(None).cast("struct<id:string,reviewed_by:string>"))
        store.append_events(audit.scan_events(logged, scans).withColumn("ts", F.col("ts").cast("timestamp")), f"{root}/events")
    cols = ["repo_id", "finding_id", "rule_id", "path", "line", "code_hash", "severity", "base_severity", "snippet", "confidence", "off"]
    rows = one("findings").select(*cols, F.lit(False).alias("suppressed")).unionByName(
        one("suppressed").select(*cols, F.lit(True).alias("suppressed"))
    ).withColumnRenamed("off", "ord")

    def merge(state: DataFrame | None) -> DataFrame:
        merged = rc.reconcile(
            empty_state if state is None else state, rows, scan_id=scan_id, at=at, coverage=one("coverage"), rules=rules,
            scope_rules=scope_rules, branch=branch, is_default_branch=1 if branch in rc.DEFAULT_BRANCHES else 0,
        )
        merged.write.mode("overwrite").parquet(f"{root}/transitions/scan_id={scan_id}")
        return rc.new_state(one("transitions"))

    store.update_state(spark, f"{root}/state", merge)
    written = one("transitions")
    if scans is not None:
        store.append_events(audit.reconcile_events(written, scan_id, at).withColumn("ts", F.to_timestamp("ts")), f"{root}/events")
    if exceptions is not None:
        resolved = written.where("transition = 'resolved'")
        ended = ex.archive_expired(ex.archive_resolved(exceptions, resolved, at), at)
        store.write_state(ended, f"{root}/exceptions")
    return written
