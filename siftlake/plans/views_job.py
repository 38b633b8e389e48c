"""Jobs that read stored tables: findings view, insights, export, decision sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siftlake.operators import exceptions as ex, export as xp, insights as ins, reports as rp


def findings_view(
    state: DataFrame, exceptions: DataFrame, rule_texts: DataFrame, as_of: str, *, view: str = "open",
    severity: str | None = None, rule: str | None = None, by_file: bool = False,
) -> DataFrame:
    """Stored open findings with rule text and exception verdicts derived at read time, never stored."""
    rows = state.where("status = 'open'").withColumns({"suppressed": F.lit(False), "off": F.xxhash64("finding_id")})
    rows = ex.apply_exceptions(rows, exceptions, as_of)
    if severity:
        rows = rows.where(F.col("severity") == severity.upper())
    if rule:
        rows = rows.where(F.col("rule_id") == rule)
    return rp.findings_view(rp.hydrate(rows, rule_texts), view, by_file)


def insights(events: DataFrame, as_of: str, days: int = ins.DAYS, n: int | None = None) -> dict[str, DataFrame]:
    """All analyses over one window of the event log."""
    window = ins.window_events(events, as_of, days, n)
    found = ins.finding_events(window)
    return {
        "meta": ins.meta(window), "recurring": ins.recurring(found), "avoidance": ins.avoidance(window),
        "avoidance_tops": ins.avoidance_tops(found), "hours": ins.by_hour(found), "weekdays": ins.by_weekday(found),
        "time": ins.time_pattern(found), "gaps": ins.gaps(found), "hotspots": ins.hotspots(found),
        "trend": ins.trend(found), "weeks": ins.last_weeks(found), "developers": ins.developers(found),
        "signals": ins.signals(window),
    }


def export(findings: DataFrame, verdicts: DataFrame, files: DataFrame, **filters) -> dict[str, DataFrame]:
    """Finding records, rule statistics, rules with many false positives and languages of an export."""
    stats = xp.rule_stats(xp.join_verdicts(findings, verdicts))
    return {
        "findings": xp.export_findings(findings, verdicts, files, **filters), "rules": stats,
        "high_fp": xp.high_fp(stats), "languages": xp.languages(findings),
    }


def sync_decisions(decisions: DataFrame, exceptions: DataFrame, marks: DataFrame) -> dict[str, DataFrame]:
    """Outcomes, exceptions after the decisions and the acknowledgement mark per repository."""
    decided = ex.decide(decisions, exceptions)
    return {
        "outcomes": decided, "exceptions": ex.apply_decisions(exceptions, decided), "marks": ex.ack_mark(decided, marks),
    }
