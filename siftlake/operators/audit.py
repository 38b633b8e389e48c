"""The event log: what a scan writes to it, and the reports read from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.functions.ranking import numbered, tail
from siftlake.session import written

# Fixed values.
FINDING_EVENTS = ["finding_blocked", "finding_warned", "finding_excepted", "finding_exception_expired"]
TOP_RULES, SESSIONS_PER_CHUNK = 20, 10
PART_ROWS = 1000


def finding_event(f_excepted: Column, expired: Column, blocks: Column) -> Column:
    """Event name of a finding: an expired exception is reported as such, then excepted, blocked, warned."""
    return (
        F.when(expired, "finding_exception_expired").when(f_excepted, "finding_excepted")
        .when(blocks, "finding_blocked").otherwise("finding_warned")
    )


def scan_events(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Events of finished scans.

    scans(session_id, ts, hook, scan_mode, files_count, git_user); findings(session_id, rule_id, name,
    category, severity, path, line, code_hash, finding_id, action, blocks, excepted,
    exception_expired, exc struct). One row per event; `seq` orders the kinds within a session.
    """
    started = scans.select(
        "session_id", "ts", "hook", "git_user", F.lit("scan_started").alias("event"), F.lit(0).alias("phase"),
        F.col("files_count"), F.col("scan_mode"),
    )
    per_finding = findings.join(scans.select("session_id", "ts", "hook", "git_user"), "session_id").select(
        "session_id", "ts", "hook", "git_user",
        finding_event(F.col("excepted"), F.col("exception_expired"), F.col("blocks")).alias("event"),
        F.lit(1).alias("phase"), "rule_id", "category", "severity", F.col("path").alias("file"), "line", "code_hash",
        "finding_id", "action", F.col("exc.id").alias("exception_id"), F.col("exc.reviewed_by").alias("exception_by"),
    )
    totals = findings.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(F.col("blocks") & ~F.col("excepted")).alias("blocked_findings"),
        F.count_if("excepted").alias("excepted_findings"),
        F.count_if("exception_expired").alias("expired_exceptions"),
    )
    zero = ["total_findings", "blocked_findings", "excepted_findings", "expired_exceptions"]
    outcome = scans.select("session_id", "ts", "hook", "git_user").join(totals, "session_id", "left").fillna(0, zero)
    outcome = outcome.withColumns(
        {
            "event": F.when(F.col("blocked_findings") > 0, "scan_blocked").otherwise("scan_passed"),
            "phase": F.lit(2),
        }
    )
    return started.unionByName(per_finding, allowMissingColumns=True).unionByName(outcome, allowMissingColumns=True)


def _sev(name: str) -> Column:
    return F.count_if(F.col("severity") == name)


def scan_summary(findings: DataFrame, accepted: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts per scan; no paths and no identities.

    findings(session_id, severity, action) are all findings, accepted(session_id, action) those that an approved
    exception covers. Both are only counted, so findings get no verdict of their own. A scan is blocked if more of its
    findings block than are accepted.
    """
    blocking = F.count_if(F.col("action") == "block").alias("_block")
    agg = findings.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("findings_total"), _sev("CRITICAL").alias("findings_critical"),
        _sev("HIGH").alias("findings_high"), _sev("MEDIUM").alias("findings_medium"),
        _sev("EXPOSURE").alias("findings_exposure"), blocking,
    )
    off = accepted.groupBy("session_id").agg(F.count(F.lit(1)).alias("exceptions_applied"), blocking.alias("_off"))
    names = [c for c in [*agg.columns, *off.columns] if c != "session_id"]
    return (
        scans.select("session_id", "hook", "scan_mode", "files_count")
        .join(agg, "session_id", "left").join(off, "session_id", "left").fillna(0, names)
        .withColumn("blocked", F.col("_block") > F.col("_off")).drop("_block", "_off")
    )


def category_breakdown(findings: DataFrame) -> DataFrame:
    """(session_id, category, critical, high, medium, exposure)."""
    return (
        findings.where(F.col("category").isNotNull()).groupBy("session_id", "category")
        .agg(*[_sev(s.upper()).alias(s) for s in ("critical", "high", "medium", "exposure")])
    )


def top_rules(findings: DataFrame, n: int = TOP_RULES) -> DataFrame:
    """The n most frequent rules of each scan; the window ranks one row per rule."""
    counts = findings.groupBy("session_id", "rule_id").agg(F.count(F.lit(1)).alias("count"))
    w = W.partitionBy("session_id").orderBy(F.desc("count"), "rule_id")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def batches(
    findings: DataFrame, payload: list[str | Column], key: list[str], part_rows: int = PART_ROWS,
    made: Callable[[DataFrame], DataFrame] | None = None, accepted: DataFrame | None = None,
) -> DataFrame:
    """Findings packed for delivery: (session_id, part, n, findings array).

    A session of any size is cut into parts of about `part_rows` by a hash of the finding's key, so no
    task ever holds a whole large session; the parts together hold every finding.

    Rows are exchanged once. `made` adds the columns of a finding to a row, row by row, so that rows may be a few numbers and texts
    are made behind the exchange. accepted(session_id, key) names the findings that an approved exception covers; they go to the
    parts of their findings, which get `excepted` there. The key tells findings of a session apart. The sizes are written, so that
    few of them are sent to the rows.
    """
    made = made or (lambda rows: rows)
    sizes = written(made(findings).groupBy("session_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts")), "sizes")
    part = F.pmod(F.xxhash64(*key), F.col("_parts")).alias("part")
    rows = made(findings).join(sizes, "session_id").select(*[c for c in findings.columns if c != "part"], F.col("session_id").alias("_session"), part)
    if accepted is not None:
        names = accepted.join(sizes, "session_id").select(F.col("session_id").alias("_session"), part, F.lit(True).alias("_name"), *[F.col(k).alias(f"_of_{k}") for k in key])
        rows = rows.withColumn("_name", F.lit(False)).unionByName(names, allowMissingColumns=True)
    group = ["_session", "part"]
    rows = rows.repartition(*group)
    if accepted is not None:
        # only the key is made before rows are sorted by it
        own = [F.when(F.col("_name"), F.col(f"_of_{k}")).otherwise(F.col(k)).alias(f"_of_{k}") for k in key]
        rows = made(rows).select(*[c for c in rows.columns if not c.startswith("_of_")], *own)
        same = W.partitionBy(*group, *[f"_of_{k}" for k in key])
        rows = rows.withColumn("excepted", F.max("_name").over(same)).where(~F.col("_name"))
    rows = made(rows)
    packed = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*payload))).alias("findings"))
    return packed.withColumnRenamed("_session", "session_id")


def reconcile_events(transitions: DataFrame, session_id: str, ts: str) -> DataFrame:
    """finding_resolved and finding_reopened events of a reconciliation."""
    event = F.when(F.col("transition") == "resolved", "finding_resolved").when(
        F.col("transition") == "reopened", "finding_reopened"
    )
    return transitions.where(F.col("transition").isin("resolved", "reopened")).select(
        F.lit(session_id).alias("session_id"), F.lit(ts).alias("ts"), event.alias("event"), "repo_id", "rule_id",
        F.col("path").alias("file"), "line", "code_hash", "finding_id",
        F.when(F.col("transition") == "resolved", F.col("resolved_at")).alias("resolved_at"),
        F.when(F.col("transition") == "reopened", F.col("reopen_count")).alias("reopen_count"),
    )


def exception_events(records: DataFrame) -> DataFrame:
    return records.select(
        F.lit("exception_requested").alias("event"), "repo_id", F.col("id").alias("exception_id"), "type", "rule_id",
        F.col("path").alias("file"), "line", F.col("line_hash").alias("code_hash"), "reason",
    )


def hook_events(actions: DataFrame) -> DataFrame:
    """actions(repo_id, action enable/disable, reason) -> control events."""
    return actions.select(
        F.when(F.col("action") == "disable", "hooks_disabled").otherwise("hooks_enabled").alias("event"),
        "repo_id", "action", "reason",
    )


def history(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sendable finding rows with chunk, skipped count) rebuilt from the log.

    A session's hook and time come from its first finding event. Rows without code hash, rule or file
    cannot be rebuilt and are counted. Sessions are numbered in log order, ten to a chunk.
    """
    rows = events.where(F.col("session_id").isNotNull() & F.col("event").isin(FINDING_EVENTS))
    ok = F.col("code_hash").isNotNull() & F.col("rule_id").isNotNull() & F.col("file").isNotNull()
    skipped = rows.agg(F.count_if(~ok).alias("skipped"))
    heads = rows.groupBy("session_id").agg(
        F.min(F.struct("ts", "seq")).alias("_first"), F.min_by("hook", F.struct("ts", "seq")).alias("first_hook"),
        F.count_if(ok).alias("n"),
    ).where("n > 0").select(
        "session_id", F.col("_first.ts").alias("first_ts"), F.col("_first.seq").alias("first_seq"), "first_hook"
    )
    sendable = rows.where(ok).join(_number_sessions(heads), "session_id")
    return sendable, skipped


def _number_sessions(heads: DataFrame) -> DataFrame:
    ranked = numbered(heads, [], ["first_ts", "first_seq"], "_n")
    return ranked.select(
        "session_id", "first_ts", "first_hook", F.floor((F.col("_n") - 1) / SESSIONS_PER_CHUNK).alias("chunk")
    )


def recent(events: DataFrame, n: int | None = None) -> DataFrame:
    """Counts over the log, or its last n events, and the time of the last scan."""
    e = F.col("event")
    return (tail(events, n) if n else events).agg(
        F.count_if(e == "scan_started").alias("total_scans"), F.count_if(e == "finding_blocked").alias("total_blocked"),
        F.count_if(e == "finding_excepted").alias("total_excepted"),
        F.count_if(e == "finding_exception_expired").alias("expired_exceptions"),
        F.max(F.when(e == "scan_started", F.col("ts"))).alias("last_scan"),
    )


def report_counts(events: DataFrame, n: int | None = None) -> DataFrame:
    e = F.col("event")
    names = {
        "scans": "scan_started", "blocked_scans": "scan_blocked", "blocked": "finding_blocked",
        "warned": "finding_warned", "excepted": "finding_excepted", "expired": "finding_exception_expired",
    }
    return (tail(events, n) if n else events).agg(*[F.count_if(e == v).alias(k) for k, v in names.items()])


def report_last(events: DataFrame, n: int | None = None) -> DataFrame:
    """Rows of the report: last 10 expired and blocked, the excepted of the last 20 unique by rule and
    file, last 5 scans with their outcome, of the whole log or its last n events."""
    t = (tail(events, n) if n else events)
    last = lambda kind, k: t.where(F.col("event") == kind).orderBy(F.desc("ts"), F.desc("seq")).limit(k)
    expired = last("finding_exception_expired", 10).withColumn("section", F.lit("expired"))
    blocked = last("finding_blocked", 10).withColumn("section", F.lit("blocked"))
    excepted = last("finding_excepted", 20).withColumn("section", F.lit("excepted"))
    first = W.partitionBy("rule_id", "file").orderBy("ts", "seq")
    excepted = excepted.withColumn("_f", F.row_number().over(first)).where("_f = 1").drop("_f")
    outcome = t.where("event = 'scan_blocked'").select("session_id", F.lit("blocked").alias("outcome")).distinct()
    scans = last("scan_started", 5).withColumn("section", F.lit("scan")).join(outcome, "session_id", "left")
    scans = scans.withColumn("outcome", F.coalesce("outcome", F.lit("passed")))
    out = expired.unionByName(blocked).unionByName(excepted).unionByName(scans, allowMissingColumns=True)
    return out
