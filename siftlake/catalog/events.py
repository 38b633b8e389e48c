"""Event log and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx, scan as sc_cat, state as st
from siftlake.catalog.fixtures import sql
from siftlake.functions.ranking import tail
from siftlake.operators import audit as au, exceptions as ex, insights as ins, severity as sev
from siftlake.session import let_go, written

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


TSF = "yyyy-MM-dd'T'HH:mm:ss"
register(
    "src_tail", lambda s, d: tail(fx.audit_events(s, d), 500).select("seq", "event", F.date_format("ts", TSF).alias("ts")),
    sql("audit_events", "SELECT seq, event, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM audit_events ORDER BY audit_events.ts DESC, seq DESC LIMIT 500"),
)


def in_sessions(f):
    """Findings with actions, one scan session per repository."""
    return sev.rule_action(f).withColumn("session_id", F.concat(F.lit("s-"), F.col("repo_id")))


def session_texts(rows):
    """Rows of numbers with the columns of their findings, in sessions."""
    cat = F.element_at(F.lit(fx.CATEGORIES), (F.col("off") % 5 + 1).cast("int"))
    return in_sessions(st.hashed_texts(rows)).withColumns({
        "severity": F.col("base_severity"), "category": F.when(F.col("off") % 9 != 0, cat), "finding_id": F.concat(F.lit("f-"), F.col("off").cast("string"))})


def session_rows(s, d):
    """Findings of sessions without verdicts, for reports that do not ask for any."""
    return session_texts(fx.first_numbers(s, d)).select(
        "repo_id", "path", "line", "rule_id", "off", "base_severity", "code_hash", "snippet", "action", "session_id", "severity", "category", "finding_id")


def session_findings(s, d):
    """The same with verdicts."""
    f = ex.apply_exceptions(session_rows(s, d), fx.exceptions(s, d), st.AS_OF)
    return f.withColumn("blocks", ~F.col("excepted") & (F.col("action") == "block"))


def session_accepted(s, d):
    """The findings that approved exceptions cover. The few rows that may be covered are written; what was exchanged to find them goes."""
    key, exc = [*ex.FINDING_KEY, "base_severity"], fx.exceptions(s, d)
    some = written(ex.possible(fx.first_numbers(s, d), exc, st.hashed_texts), "possible")
    let_go(s)
    return in_sessions(ex.accepted(st.hashed_texts(some), exc, st.AS_OF, key))


def sessions(s, d):
    n = F.col("n_nationkey")
    return fx.table(s, d, "nation").select(
        F.concat(F.lit("s-r"), n.cast("string")).alias("session_id"), F.lit("2024-01-01T00:00:00Z").alias("ts"), F.lit("manual").alias("hook"),
        F.lit("full").alias("scan_mode"), (n * 10).alias("files_count"), F.concat(F.lit("u"), n.cast("string")).alias("git_user"))


SF_SQL = (
    st.HASHED_SQL, st.EXPIRY, st.MATCH_SQL,
    f"""sf AS (SELECT f.*, 's-' || f.repo_id AS session_id, exc_id, coalesce(v = 'approved', false) AS excepted, coalesce(v = 'expired', false) AS expired,
  base_severity AS severity, CASE WHEN off % 9 <> 0 THEN ({fx._sql_list(fx.CATEGORIES)})[off % 5 + 1] END AS category,
  NOT coalesce(v = 'approved', false) AND base_severity IN ('CRITICAL', 'HIGH') AS blocks
  FROM hashed f LEFT JOIN (SELECT repo_id, path, line, rule_id, exc_id, {st.VERDICT % ('exc_status', 'exc_status')} AS v FROM matched) m USING (repo_id, path, line, rule_id))""",
    "sess AS (SELECT 's-r' || n_nationkey AS session_id, n_nationkey * 10 AS files_count FROM nation)",
)
EXC = "line_findings exceptions"
register(
    "audit_scan_events",
    lambda s, d: au.scan_events(session_findings(s, d), sessions(s, d)).select("session_id", "event", "rule_id", "file", "line", "exception_id", "files_count", "total_findings", "blocked_findings", "excepted_findings", "expired_exceptions"),
    sql(EXC, """SELECT session_id, 'scan_started' AS event, NULL AS rule_id, NULL AS file, NULL AS line, NULL AS exception_id, files_count, NULL AS total_findings, NULL AS blocked_findings, NULL AS excepted_findings, NULL AS expired_exceptions FROM sess
    UNION ALL SELECT session_id, CASE WHEN expired THEN 'finding_exception_expired' WHEN excepted THEN 'finding_excepted' WHEN blocks THEN 'finding_blocked' ELSE 'finding_warned' END, rule_id, path, line, exc_id, NULL, NULL, NULL, NULL, NULL FROM sf JOIN sess USING (session_id)
    UNION ALL SELECT session_id, CASE WHEN coalesce(b, 0) > 0 THEN 'scan_blocked' ELSE 'scan_passed' END, NULL, NULL, NULL, NULL, NULL, coalesce(n, 0), coalesce(b, 0), coalesce(e, 0), coalesce(x, 0) FROM sess
    LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (blocks) AS b, count(*) FILTER (excepted) AS e, count(*) FILTER (expired) AS x FROM sf GROUP BY 1) USING (session_id)""", *SF_SQL),
)
register(
    "audit_summary", lambda s, d: au.scan_summary(session_rows(s, d), session_accepted(s, d), sessions(s, d)).drop("hook", "scan_mode"),
    sql(EXC, """SELECT session_id, files_count, coalesce(n, 0) AS findings_total, coalesce(c, 0) AS findings_critical, coalesce(h, 0) AS findings_high, coalesce(m, 0) AS findings_medium, coalesce(x, 0) AS findings_exposure, coalesce(e, 0) AS exceptions_applied, coalesce(b, false) AS blocked
    FROM sess LEFT JOIN (SELECT session_id, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, count(*) FILTER (severity = 'MEDIUM') AS m, count(*) FILTER (severity = 'EXPOSURE') AS x,
    count(*) FILTER (excepted) AS e, bool_or(blocks) AS b FROM sf GROUP BY 1) USING (session_id)""", *SF_SQL),
)
register(
    "audit_categories", lambda s, d: au.category_breakdown(session_rows(s, d)),
    sql(EXC, """SELECT session_id, category, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'EXPOSURE') AS exposure FROM sf WHERE category IS NOT NULL GROUP BY ALL""", *SF_SQL),
)
register(
    "audit_top_rules", lambda s, d: au.top_rules(session_rows(s, d), 4).withColumn("rank", F.col("rank").cast("bigint")),
    sql(EXC, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY count DESC, rule_id) AS rank FROM (SELECT session_id, rule_id, count(*) AS count FROM sf GROUP BY ALL)) WHERE rank <= 4", *SF_SQL),
)
PAYLOAD = ["rule_id", "category", "severity", "path", "line", "code_hash", "finding_id", "excepted"]


def packed_findings(s, d):
    """All findings with their verdicts in parts, one after the other: what one step has exchanged goes before the next."""
    accepted = written(session_accepted(s, d).select("session_id", "path", "line", "rule_id"), "accepted")
    let_go(s)
    blocks = (~F.col("excepted") & (F.col("action") == "block")).alias("blocks")
    return au.batches(fx.first_numbers(s, d), [*PAYLOAD, blocks], ["path", "line", "rule_id"], made=session_texts, accepted=accepted)


def _batches(s, d):
    b = packed_findings(s, d)
    return b.groupBy("session_id").agg(F.sum("n").alias("n"), F.sum(F.size("findings")).alias("packed"), (F.max("n") < 2000).alias("bounded"))


register("audit_findings_batch", _batches, sql(EXC, "SELECT session_id, count(*) AS n, count(*) AS packed, true AS bounded FROM sf GROUP BY 1", *SF_SQL))
register(
    "audit_reconcile", lambda s, d: au.reconcile_events(st.merged(s, d), "scan-1", st.AT).select("event", "repo_id", "finding_id", "rule_id", "file", "resolved_at", "reopen_count"),
    sql(st.RECON, """SELECT 'finding_' || transition AS event, repo_id, finding_id, rule_id, path AS file, CASE WHEN transition = 'resolved' THEN resolved_at END AS resolved_at, CASE WHEN transition = 'reopened' THEN reopen_count END AS reopen_count
    FROM state WHERE transition IN ('resolved', 'reopened')""", st.UNIQ_SQL, st.OUTCOME, st.STATE_SQL),
)
register(
    "audit_exception", lambda s, d: au.exception_events(fx.exceptions(s, d)),
    sql("exceptions", "SELECT 'exception_requested' AS event, repo_id, id AS exception_id, type, rule_id, path AS file, line, line_hash AS code_hash, reason FROM exceptions"),
)


def _hooks(s, d):
    c = F.col("c_custkey")
    return au.hook_events(fx.table(s, d, "customer").select(F.concat(F.lit("r"), c.cast("string")).alias("repo_id"), F.when(c % 3 == 0, "disable").otherwise("enable").alias("action"), F.col("c_name").alias("reason")))


register(
    "audit_hooks", _hooks,
    "SELECT CASE WHEN c_custkey % 3 = 0 THEN 'hooks_disabled' ELSE 'hooks_enabled' END AS event, 'r' || c_custkey AS repo_id, CASE WHEN c_custkey % 3 = 0 THEN 'disable' ELSE 'enable' END AS action, c_name AS reason FROM customer",
)
FE = "event IN ('finding_blocked', 'finding_warned', 'finding_excepted', 'finding_exception_expired')"


def _history(s, d):
    rows, skipped = au.history(fx.audit_events(s, d))
    per = rows.groupBy("session_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event") == "finding_blocked").alias("blocked"))
    return per.crossJoin(F.broadcast(skipped))


register(
    "audit_history", _history,
    sql("audit_events", f"""SELECT session_id, (row_number() OVER (ORDER BY ts, seq) - 1) // 10 AS chunk, n, blocked, (SELECT count(*) FROM fe WHERE code_hash IS NULL) AS skipped
    FROM (SELECT session_id, (min((ts, seq))).ts AS ts, (min((ts, seq))).seq AS seq, count(code_hash) AS n, count(*) FILTER (code_hash IS NOT NULL AND event = 'finding_blocked') AS blocked FROM fe GROUP BY 1) WHERE n > 0""".replace("(min((ts, seq))).ts", "arg_min(ts, {'a': ts, 'b': seq})").replace("(min((ts, seq))).seq", "arg_min(seq, {'a': ts, 'b': seq})"),
        f"fe AS (SELECT * FROM audit_events WHERE {FE})"),
)
register(
    "audit_recent", lambda s, d: au.recent(fx.audit_events(s, d)).withColumn("last_scan", F.date_format("last_scan", TSF)),
    sql("audit_events", """SELECT count(*) FILTER (event = 'scan_started') AS total_scans, count(*) FILTER (event = 'finding_blocked') AS total_blocked, count(*) FILTER (event = 'finding_excepted') AS total_excepted, 0 AS expired_exceptions,
    strftime(max(ts) FILTER (event = 'scan_started'), '%Y-%m-%dT%H:%M:%S') AS last_scan FROM audit_events"""),
)
register(
    "audit_report_counts", lambda s, d: au.report_counts(fx.audit_events(s, d)),
    sql("audit_events", "SELECT count(*) FILTER (event = 'scan_started') AS scans, count(*) FILTER (event = 'scan_blocked') AS blocked_scans, count(*) FILTER (event = 'finding_blocked') AS blocked, count(*) FILTER (event = 'finding_warned') AS warned, count(*) FILTER (event = 'finding_excepted') AS excepted, 0 AS expired FROM audit_events"),
)
register(
    "audit_report_last", lambda s, d: au.report_last(fx.audit_events(s, d)).select("section", "seq", "rule_id", "file", "outcome"),
    sql("audit_events", """SELECT 'blocked' AS section, seq, rule_id, file, NULL AS outcome FROM r WHERE event = 'finding_blocked' AND n <= 10
    UNION ALL SELECT 'excepted', seq, rule_id, file, NULL FROM (SELECT *, row_number() OVER (PARTITION BY rule_id, file ORDER BY ts, seq) AS f FROM r WHERE event = 'finding_excepted' AND n <= 20) WHERE f = 1
    UNION ALL SELECT 'scan', seq, rule_id, file, CASE WHEN session_id IN (SELECT session_id FROM audit_events WHERE event = 'scan_blocked') THEN 'blocked' ELSE 'passed' END FROM r WHERE event = 'scan_started' AND n <= 5""",
        "r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ts DESC, seq DESC) AS n FROM audit_events)"),
)

# ------------------------------------------------------------------ insights over the whole log
AS_OF = "2024-04-05 00:00:00"
EV = lambda s, d: ins.window_events(fx.audit_events(s, d), AS_OF)
FI = lambda s, d: ins.finding_events(EV(s, d))
WIN = "w AS (SELECT * FROM audit_events WHERE ts >= TIMESTAMP '2024-04-05' - INTERVAL 90 DAYS)"
FW = f"f AS (SELECT * FROM w WHERE {FE})"
register(
    "ins_window", lambda s, d: ins.finding_events(ins.window_events(fx.audit_events(s, d), "2024-04-27 00:00:00")).select("seq", "event"),
    sql("audit_events", f"SELECT seq, event FROM audit_events WHERE ts >= TIMESTAMP '2024-04-27' - INTERVAL 90 DAYS AND {FE}"),
)
register(
    "ins_meta", lambda s, d: ins.meta(EV(s, d)),
    sql("audit_events", "SELECT (SELECT count(*) FROM w WHERE event = 'scan_started') AS total_scans, count(*) AS total_findings, count(DISTINCT git_user) AS developers, strftime(min(ts), '%Y-%m-%d') AS first_finding, strftime(max(ts), '%Y-%m-%d') AS last_finding FROM f", WIN, FW),
)
RECUR = """rec AS (SELECT rule_id, count(*) AS count, arg_min(severity, {'a': ts, 'b': seq}) AS severity, arg_min(category, {'a': ts, 'b': seq}) AS category, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen,
  CAST(floor((floor(epoch(max(ts))) - floor(epoch(min(ts)))) / 86400 + 0.5) AS BIGINT) AS span_days FROM f GROUP BY 1 HAVING count(*) >= 3)"""
register("ins_recurring", lambda s, d: ins.recurring(FI(s, d)), sql("audit_events", "SELECT * FROM rec", WIN, FW, RECUR))
AVOID = """av AS (SELECT n AS total_findings, e AS excepted, 0 AS expired, CAST(floor(100.0 * e / n + 0.5) AS BIGINT) AS except_rate, CAST(floor(100.0 * b / s + 0.5) AS BIGINT) AS block_rate,
  CASE WHEN floor(100.0 * e / n + 0.5) >= 25 THEN 'HIGH' WHEN floor(100.0 * e / n + 0.5) >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS signal
  FROM (SELECT count(*) FILTER (event LIKE 'finding%') AS n, count(*) FILTER (event = 'finding_excepted') AS e, count(*) FILTER (event = 'scan_blocked') AS b, count(*) FILTER (event = 'scan_started') AS s FROM w))"""
register("ins_avoidance", lambda s, d: ins.avoidance(EV(s, d)), sql("audit_events", "SELECT * FROM av", WIN, AVOID))
register(
    "ins_avoidance_tops", lambda s, d: ins.avoidance_tops(FI(s, d)),
    sql("audit_events", """(SELECT exception_by AS key, count(*) AS count, 'approver' AS kind FROM f WHERE exception_by IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 3)
    UNION ALL (SELECT file, count(*), 'file' FROM f WHERE event = 'finding_excepted' GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 3)""", WIN, FW),
)
HOURS = "hours AS (SELECT h AS hour, count(f.ts) AS count FROM range(24) r(h) LEFT JOIN f ON hour(f.ts) = h GROUP BY 1)"
DAYS = "days AS (SELECT wd AS weekday, count(f.ts) AS count FROM range(7) r(wd) LEFT JOIN f ON dayofweek(f.ts) = wd GROUP BY 1)"
NAMES = "(['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'])"
TIMEP = f"""tp AS (SELECT arg_min(hour, {{'a': -count, 'b': hour}}) AS peak_hour, (SELECT {NAMES}[arg_min(weekday, {{'a': -count, 'b': weekday}}) + 1] FROM days) AS peak_weekday,
  CAST(sum(count) FILTER (hour >= 20 OR hour < 5) AS BIGINT) AS late, CAST(floor(100.0 * sum(count) FILTER (hour >= 20 OR hour < 5) / sum(count) + 0.5) AS BIGINT) AS late_rate,
  (SELECT CAST(floor(100.0 * sum(count) FILTER (weekday IN (0, 5, 6)) / sum(count) + 0.5) AS BIGINT) FROM days) AS weekend_rate, CAST(sum(count) FILTER (hour BETWEEN 8 AND 17) AS BIGINT) AS business FROM hours)"""
LEVEL = "CASE WHEN late_rate >= 25 THEN 'HIGH' WHEN late_rate >= 10 THEN 'MEDIUM' ELSE 'LOW' END AS signal"
register("ins_time", lambda s, d: ins.time_pattern(FI(s, d)).withColumn("peak_hour", F.col("peak_hour").cast("bigint")), sql("audit_events", f"SELECT *, {LEVEL} FROM tp", WIN, FW, HOURS, DAYS, TIMEP))
register("ins_time_hours", lambda s, d: ins.by_hour(FI(s, d)).withColumn("hour", F.col("hour").cast("bigint")), sql("audit_events", "SELECT * FROM hours", WIN, FW, HOURS))
register("ins_time_weekdays", lambda s, d: ins.by_weekday(FI(s, d)).select(F.col("weekday").cast("bigint").alias("weekday"), "name", "count"), sql("audit_events", f"SELECT weekday, {NAMES}[weekday + 1] AS name, count FROM days", WIN, FW, DAYS))
GAPS = """gap AS (SELECT category, count(*) AS count, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM f) + 0.5) AS BIGINT) AS percent, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'EXPOSURE') AS exposure, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS n FROM f GROUP BY 1)"""
register("ins_gaps", lambda s, d: ins.gaps(FI(s, d)), sql("audit_events", "SELECT * EXCLUDE (n), n = 1 AND percent >= 30 AS dominant FROM gap WHERE n <= 6", WIN, FW, GAPS))
HOT = "hot AS (SELECT file, count(*) AS count, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high FROM f GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 8)"
register("ins_hotspots", lambda s, d: ins.hotspots(FI(s, d)), sql("audit_events", "SELECT * FROM hot", WIN, FW, HOT))
WEEKS = "weeks AS (SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical FROM f GROUP BY 1)"
TREND = """tr AS (SELECT CASE WHEN n < 10 OR weeks < 3 THEN 'INSUFFICIENT_DATA' WHEN p >= 20 THEN 'WORSENING' WHEN p <= -20 THEN 'IMPROVING' ELSE 'STABLE' END AS signal, CAST(p AS BIGINT) AS trend_pct, weeks, recent, earlier,
  CAST(floor(recent / 2 + 0.5) AS BIGINT) AS recent_avg, CAST(floor(earlier / 2 + 0.5) AS BIGINT) AS earlier_avg FROM (SELECT *, CASE WHEN earlier > 0 AND n >= 10 AND weeks >= 3 THEN floor((recent - earlier) * 100.0 / earlier + 0.5) ELSE 0 END AS p FROM
  (SELECT CAST(sum(total) FILTER (r <= 2) AS BIGINT) AS recent, CAST(coalesce(sum(total) FILTER (r IN (3, 4)), 0) AS BIGINT) AS earlier, count(*) AS weeks, sum(total) AS n FROM (SELECT *, row_number() OVER (ORDER BY week DESC) AS r FROM weeks))))"""
register("ins_trend", lambda s, d: ins.trend(FI(s, d)), sql("audit_events", "SELECT * FROM tr", WIN, FW, WEEKS, TREND))
register("ins_weeks_view", lambda s, d: ins.last_weeks(FI(s, d)), sql("audit_events", "SELECT * FROM weeks ORDER BY week DESC LIMIT 8", WIN, FW, WEEKS))
register("ins_hour_buckets", lambda s, d: ins.hour_buckets(FI(s, d)), sql("audit_events", "SELECT hour // 4 * 4 AS from_hour, CAST(sum(count) AS BIGINT) AS count FROM hours GROUP BY 1", WIN, FW, HOURS))
register(
    "ins_developers", lambda s, d: ins.developers(FI(s, d)),
    sql("audit_events", """SELECT git_user AS developer, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (event = 'finding_excepted') AS excepted,
    (SELECT rule_id FROM f g WHERE g.git_user = f.git_user GROUP BY rule_id ORDER BY count(*) DESC, min(seq) LIMIT 1) AS top_rule, (SELECT category FROM f g WHERE g.git_user = f.git_user GROUP BY category ORDER BY count(*) DESC, min(seq) LIMIT 1) AS top_category,
    CAST(floor(100.0 * count(*) FILTER (severity = 'CRITICAL') / count(*) + 0.5) AS BIGINT) AS critical_rate, CAST(floor(100.0 * count(*) FILTER (event = 'finding_excepted') / count(*) + 0.5) AS BIGINT) AS except_rate, (SELECT count(DISTINCT git_user) > 1 FROM f) AS is_team FROM f GROUP BY 1""", WIN, FW),
)
register(
    "ins_signals", lambda s, d: ins.signals(EV(s, d)),
    sql("audit_events", f"""SELECT 'RECURRING_RULE' AS type, CASE WHEN severity = 'CRITICAL' THEN 'RISK' ELSE 'WARN' END AS level, count AS metric FROM rec WHERE rule_id = (SELECT rule_id FROM f GROUP BY 1 ORDER BY count(*) DESC, min(seq) LIMIT 1) AND count >= 5
    UNION ALL SELECT 'AVOIDANCE', 'WARN', except_rate FROM av WHERE signal = 'HIGH' UNION ALL SELECT 'TIME_PRESSURE', 'NOTE', late_rate FROM tp WHERE late_rate >= 25
    UNION ALL SELECT 'KNOWLEDGE_GAP', 'WARN', percent FROM gap WHERE n = 1 AND percent >= 30 UNION ALL SELECT 'TREND', CASE signal WHEN 'WORSENING' THEN 'RISK' ELSE 'GOOD' END, trend_pct FROM tr WHERE signal IN ('WORSENING', 'IMPROVING')
    UNION ALL SELECT 'HOTSPOT', CASE WHEN critical >= 3 THEN 'RISK' ELSE 'NOTE' END, count FROM (SELECT * FROM hot ORDER BY count DESC, (SELECT min(seq) FROM f WHERE f.file = hot.file) LIMIT 1) WHERE count >= 5""", WIN, FW, RECUR, AVOID, HOURS, DAYS, TIMEP, GAPS, WEEKS, TREND, HOT),
)
