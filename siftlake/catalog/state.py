"""Reconciliation of findings and the lifecycle of exceptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx
from siftlake.catalog.fixtures import sql
from siftlake.functions import identity as idn
from siftlake.operators import exceptions as ex, reconcile as rc

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


AT, SCAN_ID = "1999-01-01T00:00:00Z", "scan-1"
SCOPE_EX = [("R4", ["o1*"]), ("R5", None)]


def _scope(s):
    return s.createDataFrame(SCOPE_EX, "rule_id string, globs array<string>")


def merged(s, d, covered=True):
    kw = dict(coverage=fx.coverage_files(s, d), rules=fx.registry_rules(s, d), scope_rules=_scope(s)) if covered else {}
    return rc.reconcile(
        fx.finding_state(s, d), fx.scan_rows(s, d), scan_id=SCAN_ID, at=AT, branch="main", is_default_branch=1, **kw
    )


UNIQ_SQL = """uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, finding_id ORDER BY ord, line) AS n
  FROM scan_rows WHERE NOT suppressed) WHERE n = 1)"""
OUTCOME = """merged AS (SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.finding_id, n.finding_id) AS finding_id,
  CASE WHEN n.finding_id IS NOT NULL AND n.code_hash IS NULL THEN 'skipped'
    WHEN n.finding_id IS NOT NULL AND o.finding_id IS NULL THEN 'inserted'
    WHEN n.finding_id IS NOT NULL AND o.status = 'open' THEN 'refreshed'
    WHEN n.finding_id IS NOT NULL AND o.status = 'resolved' THEN 'reopened'
    WHEN n.finding_id IS NULL AND o.status = 'open' AND p.finding_id IS NULL AND c.path IS NOT NULL AND r.rule_id IS NOT NULL
      AND (c.rule_domain = 'all' OR r.pack = 'secrets')
      AND NOT (o.rule_id = 'R5' OR (o.rule_id = 'R4' AND regexp_matches(o.path, '^o1[^/]*$'))) THEN 'resolved'
    ELSE 'untouched' END AS transition, o.status AS old_status, o.first_seen, o.last_seen, o.times_seen, o.reopen_count,
  o.resolved_at, o.line AS o_line, n.line AS n_line, o.severity AS o_sev, n.severity AS n_sev, o.snippet AS o_snip, n.snippet AS n_snip,
  coalesce(o.rule_id, n.rule_id) AS rule_id, coalesce(o.path, n.path) AS path, coalesce(o.code_hash, n.code_hash) AS code_hash,
  o.last_scan_id
  FROM finding_state o FULL OUTER JOIN uniq n ON o.repo_id = n.repo_id AND o.finding_id = n.finding_id
  LEFT JOIN (SELECT DISTINCT repo_id, finding_id FROM scan_rows WHERE suppressed) p ON o.repo_id = p.repo_id AND o.finding_id = p.finding_id
  LEFT JOIN coverage c ON o.repo_id = c.repo_id AND o.path = c.path LEFT JOIN registry r ON o.rule_id = r.rule_id)"""
STATE_SQL = """state AS (SELECT repo_id, finding_id, rule_id, path, code_hash, transition,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN 'open' WHEN transition = 'resolved' THEN 'resolved' ELSE old_status END AS status,
  CASE WHEN transition = 'inserted' THEN '1999-01-01T00:00:00Z' ELSE first_seen END AS first_seen,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN '1999-01-01T00:00:00Z' ELSE last_seen END AS last_seen,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN 'scan-1' ELSE last_scan_id END AS last_scan_id,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN coalesce(times_seen, 0) + 1 ELSE times_seen END AS times_seen,
  coalesce(reopen_count, 0) + CASE WHEN transition = 'reopened' THEN 1 ELSE 0 END AS reopen_count,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN n_line ELSE o_line END AS line,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN n_sev ELSE o_sev END AS severity,
  CASE WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN n_snip ELSE o_snip END AS snippet,
  CASE WHEN transition = 'resolved' THEN '1999-01-01T00:00:00Z' WHEN transition IN ('inserted', 'refreshed', 'reopened') THEN NULL ELSE resolved_at END AS resolved_at
  FROM merged)"""
RECON = "keyed finding_state scan_rows coverage registry"
SCOLS = ["repo_id", "finding_id", "rule_id", "path", "code_hash", "status", "first_seen", "last_seen", "last_scan_id", "times_seen", "reopen_count", "line", "severity", "snippet", "resolved_at"]

register(
    "recon_unique", lambda s, d: rc.unique_findings(fx.scan_rows(s, d)).select("repo_id", "finding_id", "line", "code_hash", "snippet"),
    sql("keyed scan_rows", "SELECT repo_id, finding_id, line, code_hash, snippet FROM uniq", UNIQ_SQL),
)
register(
    "recon_null_hash", lambda s, d: rc.null_hash_counts(fx.scan_rows(s, d)),
    sql("keyed scan_rows", "SELECT repo_id, count(*) FILTER (code_hash IS NULL) AS skipped FROM uniq GROUP BY 1", UNIQ_SQL),
)
for name in ("inserted", "refreshed", "reopened", "resolved", "untouched"):
    key = {"inserted": "recon_insert", "refreshed": "recon_refresh", "reopened": "recon_reopen", "resolved": "recon_resolve", "untouched": "recon_other"}[name]
    register(
        key, lambda s, d, name=name: merged(s, d).where(F.col("transition") == name).select(*SCOLS),
        sql(RECON, "SELECT " + ", ".join(SCOLS) + f" FROM state WHERE transition = '{name}'", UNIQ_SQL, OUTCOME, STATE_SQL),
    )
register(
    "reconcile", lambda s, d: rc.new_state(merged(s, d)).select(*SCOLS, F.element_at("extras", "note").alias("note")),
    sql(RECON, "SELECT " + ", ".join(SCOLS) + ", CASE WHEN transition <> 'inserted' THEN 'n' || finding_id END AS note FROM state WHERE status IS NOT NULL", UNIQ_SQL, OUTCOME, STATE_SQL),
)
register(
    "recon_counters", lambda s, d: rc.counters(merged(s, d)),
    sql(RECON, """SELECT repo_id, count(*) FILTER (transition = 'inserted') AS added, count(*) FILTER (transition = 'refreshed') AS refreshed,
    count(*) FILTER (transition = 'skipped') AS skipped, count(*) FILTER (transition = 'resolved') AS resolved, count(*) FILTER (transition = 'reopened') AS reopened,
    count(*) FILTER (status = 'open') AS total_open, count(status) AS total FROM state GROUP BY 1""", UNIQ_SQL, OUTCOME, STATE_SQL),
)


def _domain(s, d):
    cov = fx.coverage_files(s, d).withColumn("rule_domain", F.when(F.substring("path", -1, 1) == "1", "secrets").when(F.substring("path", -1, 1) == "2", "odd").otherwise("all"))
    out = rc.reconcile(fx.finding_state(s, d), fx.scan_rows(s, d), scan_id=SCAN_ID, at=AT, coverage=cov, rules=fx.registry_rules(s, d))
    return out.where("transition = 'resolved'").select("repo_id", "finding_id", "rule_id")


register(
    "recon_domain", _domain,
    sql(RECON, """SELECT o.repo_id, o.finding_id, o.rule_id FROM finding_state o JOIN coverage c USING (repo_id, path) JOIN registry r ON o.rule_id = r.rule_id
    WHERE status = 'open' AND NOT EXISTS (FROM scan_rows n WHERE n.repo_id = o.repo_id AND n.finding_id = o.finding_id)
    AND (right(path, 1) NOT IN ('1', '2') OR (right(path, 1) = '1' AND pack = 'secrets'))"""),
)


def _bootstrap(s, d):
    return rc.bootstrap(fx.scan_rows(s, d), scan_id="s0", scan_date="1997-05-05T00:00:00Z", empty_state=fx.finding_state(s, d).where(F.lit(False))).select("repo_id", "finding_id", "status", "first_seen", "times_seen", "line")


register(
    "recon_bootstrap", _bootstrap,
    sql("keyed scan_rows", "SELECT repo_id, finding_id, 'open' AS status, '1997-05-05T00:00:00Z' AS first_seen, 1 AS times_seen, line FROM uniq WHERE code_hash IS NOT NULL", UNIQ_SQL),
)
BRANCH = "CASE c_custkey % 6 WHEN 0 THEN 'main' WHEN 1 THEN 'feature/x' WHEN 2 THEN 'trunk' WHEN 3 THEN NULL WHEN 4 THEN 'develop' ELSE 'master' END"
REMOTE = "CASE c_custkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'develop' END"
register(
    "branch_flags",
    lambda s, d: fx.table(s, d, "customer").select("c_custkey", rc.branch_flags(F.expr(BRANCH), F.expr(REMOTE)).cast("bigint").alias("is_default_branch")),
    f"SELECT c_custkey, CASE WHEN r IS NOT NULL THEN CAST(coalesce(b = r, false) AS BIGINT) ELSE CAST(coalesce(b IN ('main', 'master', 'trunk', 'develop'), false) AS BIGINT) END AS is_default_branch FROM (SELECT c_custkey, {BRANCH} AS b, {REMOTE} AS r FROM customer)",
)

# ------------------------------------------------------------------ exceptions
AS_OF = "1999-01-01T00:00:00Z"


def hashed(s, d):
    """Findings with hashes; some have no snippet, some a deeper folder in front of the path."""
    return hashed_texts(fx.first_numbers(s, d)).select("repo_id", "path", "line", "rule_id", "off", "base_severity", "code_hash", "snippet")


def hashed_texts(rows):
    """Rows of numbers with the columns of their findings."""
    deep = F.when(F.col("off") % 3 == 0, F.concat(F.lit("./app/"), F.col("path"))).otherwise(F.col("path"))
    snippet = F.when(F.col("off") % 5 != 0, F.trim("raw")).otherwise(F.lit("[REDACTED]"))
    return fx.first_texts(rows).withColumns({"path": deep, "code_hash": idn.code_hash(F.col("raw")), "snippet": snippet})


HASHED_SQL = """hashed AS (SELECT repo_id, CASE WHEN off % 3 = 0 THEN './app/' || path ELSE path END AS path, line, rule_id, off, base_severity,
  substring(sha256(raw), 1, 32) AS code_hash, CASE WHEN off % 5 <> 0 THEN trim(raw) ELSE '[REDACTED]' END AS snippet, path AS inner_path
  FROM (SELECT repo_id, path, line, rule_id, min_by(raw, off) AS raw, min(off) AS off, min_by(base_severity, off) AS base_severity FROM line_findings GROUP BY ALL))"""
EXPIRY = """expx AS (SELECT *, CASE WHEN coalesce(expires, '') <> '' THEN try_strptime(expires, '%Y-%m-%dT%H:%M:%SZ')
  WHEN status = 'pending' THEN strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 14 DAYS END AS expiry FROM exceptions)"""
MATCH_SQL = """matched AS (SELECT f.repo_id, f.path, f.line, f.rule_id, f.off, min_by(e.id, e.exc_ord) AS exc_id, min_by(e.status, e.exc_ord) AS exc_status, min_by(coalesce(e.expiry, TIMESTAMP '9999-01-01'), e.exc_ord) AS expiry
  FROM hashed f JOIN expx e ON f.repo_id = e.repo_id AND f.rule_id = e.rule_id AND f.inner_path = e.path
  WHERE e.archived_at IS NULL AND (coalesce(e.line_hash = f.code_hash, false) OR coalesce(length(e.line_hash) = 16 AND starts_with(f.code_hash, e.line_hash), false)
   OR coalesce(e.line_hash IS NOT NULL AND f.snippet = '[REDACTED]' AND e.line = f.line, false)
   OR (e.line_hash IS NULL AND (e.range_from IS NULL OR f.line BETWEEN e.range_from AND e.range_to))) GROUP BY ALL)"""
EXC = "line_findings exceptions"
register(
    "exc_match", lambda s, d: ex.match_exceptions(hashed(s, d), fx.exceptions(s, d)).select("repo_id", "path", "line", "rule_id", F.col("exc.id").alias("exc_id")),
    sql(EXC, "SELECT repo_id, path, line, rule_id, exc_id FROM matched", HASHED_SQL, EXPIRY, MATCH_SQL),
)
register(
    "exc_expiry",
    lambda s, d: fx.exceptions(s, d).select("id", F.unix_timestamp(ex.effective_expiry(F.col("status"), F.col("created_at"), F.col("expires"))).alias("expiry")),
    sql("exceptions", "SELECT id, CAST(epoch(expiry) AS BIGINT) AS expiry FROM expx", EXPIRY),
)
VERDICT = "CASE WHEN expiry < TIMESTAMP '1999-01-01' THEN 'expired' WHEN %s = 'rejected' THEN 'rejected' WHEN %s = 'approved' THEN 'approved' ELSE 'pending' END"
register(
    "exc_verdict", lambda s, d: ex.apply_exceptions(hashed(s, d), fx.exceptions(s, d), AS_OF).select("repo_id", "path", "line", "rule_id", "exc_verdict", "excepted", "exception_expired"),
    sql(EXC, f"""SELECT f.repo_id, f.path, f.line, f.rule_id, v AS exc_verdict, coalesce(v = 'approved', false) AS excepted, coalesce(v = 'expired', false) AS exception_expired
    FROM hashed f LEFT JOIN (SELECT *, {VERDICT % ('exc_status', 'exc_status')} AS v FROM matched) m USING (repo_id, path, line, rule_id)""", HASHED_SQL, EXPIRY, MATCH_SQL),
)
REVIEW = "CASE c_custkey % 7 WHEN 0 THEN '30d' WHEN 1 THEN ' 2 W' WHEN 2 THEN '3m' WHEN 3 THEN '10' WHEN 4 THEN '0d' WHEN 5 THEN 'soon' ELSE NULL END"


def requests(s, d):
    ck = F.col("c_custkey")
    return fx.table(s, d, "customer").select(
        F.concat(F.lit("r"), (ck % 20).cast("string")).alias("repo_id"), F.concat(F.lit("new-"), ck.cast("string")).alias("id"),
        F.lit("exception").alias("type"), F.concat(F.lit("  tag of "), F.col("c_name"), F.lit(" with a very long remainder ")).alias("tag"),
        F.when(ck % 11 != 0, F.concat(F.lit("R"), (ck % 12).cast("string"))).alias("rule_id"), F.concat(F.lit("src\\o"), ck.cast("string")).alias("path"),
        (ck % 4).alias("line"), F.lit(None).cast("string").alias("code_hash"), F.when(ck % 13 == 0, "  ").otherwise(F.lit(" why ")).alias("reason"), F.expr(REVIEW).alias("review_in"))


register(
    "exc_build", lambda s, d: ex.build_exceptions(requests(s, d), AT, standalone=False).select("repo_id", "id", "tag", "status", "rule_id", "path", "reason", "created_at", "expires"),
    f"""SELECT 'r' || (c_custkey % 20) AS repo_id, 'new-' || c_custkey AS id, regexp_replace(substring(trim('  tag of ' || c_name || ' with a very long remainder '), 1, 40), '\\s+', '_', 'g') AS tag,
    'pending' AS status, 'R' || (c_custkey % 12) AS rule_id, 'src/o' || c_custkey AS path, 'why' AS reason, '1999-01-01T00:00:00Z' AS created_at,
    CASE c_custkey % 7 WHEN 0 THEN '1999-01-31T00:00:00Z' WHEN 1 THEN '1999-01-15T00:00:00Z' WHEN 2 THEN '1999-04-01T00:00:00Z' WHEN 3 THEN '1999-01-11T00:00:00Z' END AS expires
    FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""",
)
register(
    "exc_review_in", lambda s, d: fx.table(s, d, "customer").select("c_custkey", ex.review_days(F.expr(REVIEW)).alias("days")),
    "SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 30 WHEN 1 THEN 14 WHEN 2 THEN 90 WHEN 3 THEN 10 END AS days FROM customer",
)
register(
    "exc_duplicate",
    lambda s, d: ex.duplicates(fx.exceptions(s, d).where("exc_ord % 2 = 0").select("repo_id", "rule_id", "path", F.col("line"), "id"), fx.exceptions(s, d)).select("id"),
    sql("exceptions", "SELECT id FROM exceptions a WHERE exc_ord % 2 = 0 AND EXISTS (FROM exceptions b WHERE b.status IN ('pending', 'approved') AND a.repo_id = b.repo_id AND a.rule_id = b.rule_id AND a.path = b.path AND a.line = b.line)"),
)
ARCH = ["id", "archived_at", "archive_reason"]
register(
    "exc_archive_resolved", lambda s, d: ex.archive_resolved(fx.exceptions(s, d), hashed(s, d).where("off % 2 = 0"), AT).select(*ARCH),
    sql(EXC, """SELECT id, CASE WHEN archived_at IS NULL AND hit.exc_id IS NOT NULL THEN '1999-01-01T00:00:00Z' ELSE archived_at END AS archived_at,
    CASE WHEN archived_at IS NULL AND hit.exc_id IS NOT NULL THEN 'finding_resolved' ELSE archive_reason END AS archive_reason
    FROM exceptions LEFT JOIN (SELECT DISTINCT exc_id FROM matched WHERE off % 2 = 0) hit ON id = exc_id""", HASHED_SQL, EXPIRY, MATCH_SQL),
)
register(
    "exc_archive_expired", lambda s, d: ex.archive_expired(fx.exceptions(s, d), AS_OF).select(*ARCH),
    sql("exceptions", "SELECT id, CASE WHEN archived_at IS NULL AND expiry < TIMESTAMP '1999-01-01' THEN '1999-01-01T00:00:00Z' ELSE archived_at END AS archived_at, CASE WHEN archived_at IS NULL AND expiry < TIMESTAMP '1999-01-01' THEN 'review_expired' ELSE archive_reason END AS archive_reason FROM expx", EXPIRY),
)
for key, reason, mod in (("exc_archive", "identity_changed", 6), ("exc_withdraw", "withdrawn", 10)):
    register(
        key,
        lambda s, d, reason=reason, mod=mod: ex.archive(fx.exceptions(s, d), fx.exceptions(s, d).where(F.col("exc_ord") % mod == 0).select("repo_id", "id", F.lit(reason).alias("reason")), AT).select(*ARCH),
        sql("exceptions", f"SELECT id, CASE WHEN archived_at IS NULL AND exc_ord % {mod} = 0 THEN '1999-01-01T00:00:00Z' ELSE archived_at END AS archived_at, CASE WHEN archived_at IS NULL AND exc_ord % {mod} = 0 THEN '{reason}' ELSE archive_reason END AS archive_reason FROM exceptions"),
    )


def _scan_ids(s, d):
    return fx.line_findings(s, d).select("repo_id", "rule_id", "path", "line", idn.finding_id(F.col("rule_id"), F.col("path"), F.col("raw")).alias("finding_id"), F.col("off").alias("ord"))


def _list(s, d):
    out = None
    for status in ("pending", "all", "archived"):
        part = ex.list_exceptions(fx.exceptions(s, d), status, _scan_ids(s, d)).select(F.lit(status).alias("view"), "id", "finding_id")
        out = part if out is None else out.unionByName(part)
    return out


register(
    "exc_list", _list,
    sql(EXC, """SELECT view, id, finding_id FROM (SELECT 'pending' AS view, * FROM exceptions WHERE status = 'pending' AND archived_at IS NULL
    UNION ALL SELECT 'all', * FROM exceptions WHERE archived_at IS NULL UNION ALL SELECT 'archived', * FROM exceptions WHERE archived_at IS NOT NULL) e
    LEFT JOIN (SELECT repo_id, rule_id, path, line, max_by('f-' || substring(sha256(rule_id || '|' || path || '|' || raw), 1, 10), off) AS finding_id FROM line_findings GROUP BY ALL) USING (repo_id, rule_id, path, line)"""),
)
register(
    "exc_expiring_soon", lambda s, d: ex.expiring_soon(fx.exceptions(s, d), "1996-06-01T00:00:00Z").select("id"),
    sql("exceptions", "SELECT id FROM expx WHERE archived_at IS NULL AND expiry > TIMESTAMP '1996-06-01' AND expiry <= TIMESTAMP '1996-06-08'", EXPIRY),
)


def _notice(s, d):
    e = fx.exceptions(s, d)
    handled = e.where("exc_ord % 3 = 0").select("repo_id", "id")
    synced = fx.table(s, d, "nation").where("n_nationkey % 3 <> 0").select(
        F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo_id"), F.concat(F.lit("1998-12-31T0"), (F.col("n_nationkey") % 8).cast("string"), F.lit(":30:00Z")).alias("last_synced")
    ).unionByName(s.createDataFrame([("r0", "1998-12-01T00:00:00Z")], "repo_id string, last_synced string"))
    return ex.sync_notice(e, handled, synced, AS_OF)


register(
    "exc_sync_notice", _notice,
    sql("exceptions", """SELECT repo_id, pending, CAST(floor(epoch(TIMESTAMP '1999-01-01' - strptime(last_synced, '%Y-%m-%dT%H:%M:%SZ')) / 3600) AS BIGINT) AS hours_since,
    coalesce(epoch(TIMESTAMP '1999-01-01' - strptime(last_synced, '%Y-%m-%dT%H:%M:%SZ')) / 3600 >= 24, true) AS stale
    FROM (SELECT repo_id, count(*) AS pending FROM exceptions WHERE status = 'pending' AND exc_ord % 3 <> 0 GROUP BY 1)
    LEFT JOIN (SELECT 'r' || n_nationkey AS repo_id, '1998-12-31T0' || (n_nationkey % 8) || ':30:00Z' AS last_synced FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'r0', '1998-12-01T00:00:00Z') USING (repo_id)"""),
)


def decisions(s, d):
    """Decisions on orders: some by id, some by tuple, some repeated, some of an unsupported status."""
    e = fx.exceptions(s, d)
    o = F.col("exc_ord")
    rnd = lambda k: e.select(
        "repo_id", (o * 3 + k).alias("ord"), F.when(o % 4 == 0, F.col("id")).alias("id"), F.lit(None).cast("string").alias("finding_id"),
        "rule_id", "path", F.when(o % 3 != 0, F.col("line")).alias("line"), F.when(o % 7 == 0, F.lit("zz")).otherwise(F.col("line_hash")).alias("code_hash"),
        F.when((o + k) % 5 == 0, "resolved").when((o + k) % 3 == 0, "rejected").otherwise("approved").alias("status"),
        F.when((o + k) % 4 != 1, F.concat(F.lit("lead"), ((o + k) % 3).cast("string"))).alias("reviewed_by"), F.lit("note").alias("review_comment"),
        F.when(o % 997 != 0, F.col("created_at")).alias("updated_at"))
    return rnd(0).unionByName(rnd(1).where("ord % 2 = 0"))


DECISIONS_SQL = """drows AS (SELECT *, exc_ord * 3 + k AS ord FROM exceptions, (SELECT unnest([0, 1]) AS k)),
dec AS (SELECT repo_id, ord, CASE WHEN exc_ord % 4 = 0 THEN id END AS id, rule_id, path, CASE WHEN exc_ord % 3 <> 0 THEN line END AS line,
  CASE WHEN exc_ord % 7 = 0 THEN 'zz' ELSE line_hash END AS code_hash, CASE WHEN (exc_ord + k) % 5 = 0 THEN 'resolved' WHEN (exc_ord + k) % 3 = 0 THEN 'rejected' ELSE 'approved' END AS status,
  CASE WHEN (exc_ord + k) % 4 <> 1 THEN 'lead' || ((exc_ord + k) % 3) END AS reviewed_by, CASE WHEN exc_ord % 997 <> 0 THEN created_at END AS updated_at
  FROM drows WHERE k = 0 OR ord % 2 = 0)"""
DECIDED_SQL = (
    DECISIONS_SQL,
    """tgt AS (SELECT d.repo_id, d.ord, min_by(e.id, e.exc_ord) AS rid, min_by(e.status, e.exc_ord) AS rstatus, min_by(coalesce(e.reviewed_by, '-'), e.exc_ord) AS rby FROM dec d JOIN exceptions e ON d.repo_id = e.repo_id
  AND (d.id = e.id OR (d.rule_id = e.rule_id AND d.path = e.path AND (coalesce(d.line, 0) = 0 OR coalesce(e.line = d.line, false))
    AND (e.line_hash IS NULL OR coalesce(e.line_hash = d.code_hash OR (length(e.line_hash) = 16 AND starts_with(d.code_hash, e.line_hash)), false))))
  WHERE d.status IN ('approved', 'rejected') GROUP BY ALL)""",
    """fold AS (SELECT d.*, rid, coalesce(lag(d.status) OVER w, rstatus) AS before, coalesce(max(d.reviewed_by IS NOT NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) OR rby <> '-' AS reviewed
  FROM dec d LEFT JOIN tgt USING (repo_id, ord) WINDOW w AS (PARTITION BY repo_id, coalesce(rid, '?' || ord) ORDER BY ord))""",
    """decided AS (SELECT *, CASE WHEN status NOT IN ('approved', 'rejected') THEN 'skipped' WHEN rid IS NULL THEN 'unknown'
  WHEN before <> status OR (reviewed_by IS NOT NULL AND NOT reviewed) THEN 'applied' ELSE 'alreadyApplied' END AS outcome FROM fold)""",
)
register(
    "exc_decide", lambda s, d: ex.decide(decisions(s, d), fx.exceptions(s, d)).select("repo_id", "ord", F.col("r_id").alias("rid"), "outcome"),
    sql("exceptions", "SELECT repo_id, ord, rid, outcome FROM decided", *DECIDED_SQL),
)


def _applied(s, d):
    e = fx.exceptions(s, d)
    return ex.apply_decisions(e, ex.decide(decisions(s, d), e)).select("id", "status", "reviewed_by", "review_comment")


register(
    "exc_decide_apply", _applied,
    sql("exceptions", """SELECT e.id, coalesce(s, status) AS status, coalesce(reviewed_by, r) AS reviewed_by,
    CASE WHEN reviewed_by IS NULL AND r IS NOT NULL THEN 'note' ELSE review_comment END AS review_comment FROM exceptions e LEFT JOIN
    (SELECT repo_id, rid, max_by(status, ord) AS s, min_by(reviewed_by, ord) FILTER (reviewed_by IS NOT NULL AND NOT reviewed) AS r FROM decided WHERE outcome IN ('applied', 'alreadyApplied') GROUP BY ALL) x ON e.repo_id = x.repo_id AND e.id = x.rid""", *DECIDED_SQL),
)


def _ack(s, d):
    e = fx.exceptions(s, d)
    stored = fx.table(s, d, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("repo_id"), F.when(F.col("n_nationkey") % 2 == 0, "1996-01-01T00:00:00Z").alias("mark"))
    return ex.ack_mark(ex.decide(decisions(s, d), e), stored)


register(
    "exc_ack_mark", _ack,
    sql("exceptions", """SELECT repo_id, greatest(mark, m) AS mark FROM (SELECT 'r' || n_nationkey AS repo_id, CASE WHEN n_nationkey % 2 = 0 THEN '1996-01-01T00:00:00Z' END AS mark FROM nation)
    FULL OUTER JOIN (SELECT repo_id, max_by(updated_at, ord) AS m FROM decided LEFT JOIN (SELECT repo_id, min(ord) AS stop FROM decided WHERE updated_at IS NULL GROUP BY 1) USING (repo_id) WHERE stop IS NULL OR ord < stop GROUP BY 1) USING (repo_id)""", *DECIDED_SQL),
)


def _reassert(s, d):
    e = fx.exceptions(s, d)
    files = e.where("exc_ord % 5 <> 0").select("repo_id", "path")
    return ex.reassert(e, files, e.where(F.col("path").startswith("vendor/")).select("repo_id", "path")).select("id", "route")


register(
    "exc_reassert", _reassert,
    sql("exceptions", "SELECT id, CASE WHEN starts_with(path, 'vendor/') THEN 'scoped' WHEN exc_ord % 5 <> 0 THEN 'send' ELSE 'gone' END AS route FROM exceptions WHERE status = 'approved' AND line_hash IS NOT NULL"),
)


def pending_ids(s, d):
    return fx.table(s, d, "orders").select(
        F.concat(F.lit("r"), (F.col("o_orderkey") % 3).cast("string")).alias("repo_id"), F.concat(F.lit("exc-"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 9 == 0, 10**9).otherwise(0)).cast("string")).alias("id"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("queued_at"))


PENDING_SQL = """pend AS (SELECT 'r' || (o_orderkey % 3) AS repo_id, 'exc-' || (o_orderkey + CASE WHEN o_orderkey % 9 = 0 THEN 1000000000 ELSE 0 END) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS queued_at FROM orders),
exc3 AS (SELECT 'r' || (exc_ord % 3) AS repo_id, id, rule_id FROM exceptions)"""


def _push(s, d):
    e = fx.exceptions(s, d).withColumn("repo_id", F.concat(F.lit("r"), (F.col("exc_ord") % 3).cast("string")))
    out, orphans = ex.pending_push(pending_ids(s, d), e)
    return out.select("repo_id", "id", "rule_id", F.col("batch").cast("bigint").alias("batch")).unionByName(orphans.select("repo_id", "id", F.lit(None).cast("string").alias("rule_id"), F.lit(-1).cast("bigint").alias("batch")))


register(
    "exc_pending_push", _push,
    sql("exceptions", """SELECT repo_id, id, rule_id, (row_number() OVER (PARTITION BY repo_id ORDER BY queued_at, id) - 1) // 100 AS batch FROM pend JOIN exc3 USING (repo_id, id)
    UNION ALL SELECT repo_id, id, NULL, -1 FROM pend ANTI JOIN exc3 USING (repo_id, id)""", PENDING_SQL),
)
register(
    "exc_oldest_pending", lambda s, d: ex.oldest_pending(pending_ids(s, d)),
    sql("exceptions", "SELECT repo_id, count(*) AS pending, min(queued_at) AS oldest FROM pend GROUP BY 1", PENDING_SQL),
)


def _migrate(s, d):
    e = fx.exceptions(s, d)
    o = F.col("exc_ord")
    new = e.where(~((F.col("repo_id") == "r3") & (o % 100 == 3))).withColumns({
        "rule_id": F.when((F.col("repo_id") == "r4") & (o % 50 == 4), "R99").otherwise(F.col("rule_id")),
        "line_hash": F.when((F.col("repo_id") == "r5") & (o % 50 == 5), F.lit("x")).otherwise(F.col("line_hash"))})
    return ex.migrate_gate(e, new)


register(
    "exc_migrate_gate", _migrate,
    sql("exceptions", """SELECT repo_id, count(*) AS n_legacy, count(*) FILTER (NOT gone) AS n_migrated, count(*) FILTER (gone) AS missing, count(*) FILTER (drift) AS identity_drift, count(*) FILTER (hdrift) AS hash_drift,
    count(*) FILTER (gone OR drift OR hdrift) = 0 AS ok FROM (SELECT *, repo_id = 'r3' AND exc_ord % 100 = 3 AS gone, repo_id = 'r4' AND exc_ord % 50 = 4 AS drift, repo_id = 'r5' AND exc_ord % 50 = 5 AS hdrift FROM exceptions) GROUP BY 1"""),
)
MIG_COLS = ["s_suppkey", "old_id", "new_id", "target"]


def _repo_migrate(s, d):
    from siftlake.catalog.scan import remotes
    from siftlake.operators.fleet import migrate_repo_ids

    r = remotes(s, d)
    stores = r.where("s_suppkey % 3 <> 0").select(idn.repo_id_legacy(F.col("remote")).alias("repo_id")).unionByName(
        r.where("s_suppkey % 5 = 0").select(idn.repo_id(F.col("remote")).alias("repo_id"))).distinct()
    return migrate_repo_ids(stores, r.select("remote"))


def _mig_sql():
    from siftlake.catalog.scan import CANON_SQL, REMOTES_SQL

    return f"WITH {REMOTES_SQL}, " + ", ".join(CANON_SQL) + """, ids AS (SELECT substring(sha256(remote), 1, 16) AS old_id, min(substring(sha256(canonical), 1, 16)) AS new_id FROM canon WHERE remote <> canonical GROUP BY 1),
    stores AS (SELECT substring(sha256(remote), 1, 16) AS repo_id FROM canon WHERE s_suppkey % 3 <> 0 UNION SELECT substring(sha256(canonical), 1, 16) FROM canon WHERE s_suppkey % 5 = 0),
    cand AS (SELECT repo_id, new_id, new_id IN (SELECT repo_id FROM stores) OR count(*) OVER (PARTITION BY new_id) > 1 AS clash FROM stores JOIN ids ON repo_id = old_id)
    SELECT s.repo_id, CASE WHEN c.new_id IS NOT NULL AND NOT clash THEN c.new_id ELSE s.repo_id END AS target_id, coalesce(clash, false) AS collision FROM stores s LEFT JOIN cand c USING (repo_id)"""


register("repo_id_migrate", _repo_migrate, _mig_sql())
