"""Streams, readers and writers; each run uses a folder of its own below the checkpoint folder."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F, types as T

from siftlake.catalog import fixtures as fx, scan as sc_cat, state as st
from siftlake.catalog.files import q
from siftlake.catalog.fixtures import sql
from siftlake.operators import reconcile as rc, rules as rl
from siftlake.session import checkpoint_dir, let_go
from siftlake.sources import files as src, store
from siftlake.streaming import jobs, merge as mg

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


def scratch(s, name):
    return f"{checkpoint_dir(s)}/siftlake-{name}-{uuid.uuid4().hex}"


SENTINEL = "2030-01-01 00:00:00"


def event_stream(s, d):
    """Finding events of the event table as a stream. The first event is repeated once at a far later
    time: it closes all open windows and is left out of the results."""
    schema = fx.table(s, d, "events").schema
    raw = jobs.table_stream(s, d, "events.parquet", schema)
    first = F.col("event_id") == 0
    times = F.when(first, F.array("ts", F.to_timestamp_ntz(F.lit(SENTINEL)))).otherwise(F.array("ts"))
    ev = raw.withColumn("ts", F.explode(times))
    v = F.col("value")
    return ev.select(
        jobs.as_instant(F.col("ts")).alias("ts"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("git_user"),
        F.when(v >= 300, "CRITICAL").when(v >= 150, "HIGH").when(v >= 50, "MEDIUM").otherwise("EXPOSURE").alias("severity"), "event_type")


def _run(s, name, stream):
    base = scratch(s, name)
    return jobs.run(stream, f"{base}/out", f"{base}/ckpt")


before = lambda df: df.where(F.col("start") < F.to_timestamp(F.lit("2029-01-01T00:00:00Z")))
txt = lambda c: jobs.utc_text(F.col(c)).alias(c)


def _tumbling(s, d):
    hours = before(_run(s, "hour", jobs.tumbling(event_stream(s, d)))).select(F.lit("hour").alias("kind"), txt("start"), "total", "critical")
    weeks = before(_run(s, "week", jobs.tumbling(event_stream(s, d), "7 days", start=jobs.MONDAY))).select(F.lit("week").alias("kind"), txt("start"), "total", "critical")
    return hours.unionByName(weeks)


FMT = "'%Y-%m-%d %H:%M:%S'"
register(
    "st_tumbling", _tumbling,
    sql("audit_events", f"""SELECT 'hour' AS kind, strftime(date_trunc('hour', ts), {FMT}) AS start, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical FROM audit_events GROUP BY ALL
    UNION ALL SELECT 'week', strftime(CAST(date_trunc('week', ts) AS TIMESTAMP), {FMT}), count(*), count(*) FILTER (severity = 'CRITICAL') FROM audit_events GROUP BY ALL"""),
)
register(
    "st_sliding", lambda s, d: before(_run(s, "slide", jobs.sliding(event_stream(s, d)))).select(txt("start"), "total"),
    sql("audit_events", f"SELECT strftime(CAST(date_trunc('week', ts) AS TIMESTAMP) - to_days(k), {FMT}) AS start, count(*) AS total FROM audit_events, unnest([0, 7]) u(k) GROUP BY ALL"),
)
register(
    "st_session", lambda s, d: before(_run(s, "session", jobs.sessions(event_stream(s, d)))).select("git_user", txt("start"), txt("end"), "events"),
    sql("audit_events", f"""SELECT git_user, strftime(min(ts), {FMT}) AS start, strftime(max(ts) + INTERVAL 30 MINUTES, {FMT}) AS end, count(*) AS events FROM (
    SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY git_user ORDER BY ts, seq) AS grp FROM (SELECT *, lag(ts) OVER (PARTITION BY git_user ORDER BY ts, seq) AS prev FROM audit_events)) GROUP BY git_user, grp"""),
)


def _dedupe(s, d):
    twice = event_stream(s, d).withColumn("delivery", F.explode(F.sequence(F.lit(1), (F.col("seq") % 3 + 1).cast("int")))).where("ts < '2029-01-01'")
    return _run(s, "dedupe", jobs.dedupe(twice, ["git_user", "seq"])).select("git_user", "seq", "severity")


register("st_dedupe", _dedupe, sql("audit_events", "SELECT git_user, seq, severity FROM audit_events"))


def _late(s, d):
    """Two deliveries: two thirds of the events, then the others, of which the old ones come late."""
    base = scratch(s, "late")
    events = event_stream(s, d).where("ts < '2029-01-01'")
    for part in ("seq % 3 <> 0", "seq % 3 = 0"):
        rows = fx.audit_events(s, d).where(part)
        rows.select(jobs.as_instant(F.col("ts")).alias("ts"), "seq").write.mode("append").parquet(f"{base}/in")
        stream = jobs.table_stream(s, f"{base}/in", "*.parquet", events.select("ts", "seq").schema)
        jobs.run_each(stream, jobs.late_router(base, "15 days"), f"{base}/ckpt")
    return jobs.routed(s, base).select(F.when(F.col("late"), "late").otherwise("on_time").alias("route"), F.col("batch").cast("long").alias("batch"), "seq")


register("st_late", _late, sql("audit_events", """SELECT CASE WHEN seq % 3 = 0 AND ts < (SELECT max(ts) FROM audit_events WHERE seq % 3 <> 0) - INTERVAL 15 DAYS THEN 'late' ELSE 'on_time' END AS route,
    CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END AS batch, seq FROM audit_events"""))


def log_lines(s, d):
    """The event log as JSON lines, every 17th line cut short."""
    e = fx.audit_events(s, d)
    line = F.to_json(F.struct("seq", "event", "git_user", "rule_id", "severity"))
    return e.select(F.when(F.col("seq") % 17 == 5, F.substring(line, 1, 25)).otherwise(line).alias("value"))


LOG = T.StructType([T.StructField("seq", T.LongType()), *[T.StructField(n, T.StringType()) for n in ("event", "git_user", "rule_id", "severity")]])


def _st_events(s, d):
    base = scratch(s, "log")
    log_lines(s, d).write.text(f"{base}/in")
    return _run(s, "events", jobs.log_stream(s, f"{base}/in", LOG)).groupBy(F.coalesce("event", F.lit("-")).alias("event"), F.col("corrupt_line").isNotNull().alias("corrupt")).agg(F.count(F.lit(1)).alias("n"))


def _jsonl(s, d):
    base = scratch(s, "jsonl")
    log_lines(s, d).write.text(f"{base}/in")
    good, bad = store.read_json_lines(s, f"{base}/in", LOG)
    return good.groupBy("event").agg(F.count(F.lit(1)).alias("n")).withColumn("corrupt", F.lit(False)).unionByName(
        bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit("-").alias("event"), "n", F.lit(True).alias("corrupt")))


LOG_SQL = "SELECT CASE WHEN seq % 17 = 5 THEN '-' ELSE event END AS event, seq % 17 = 5 AS corrupt, count(*) AS n FROM audit_events GROUP BY ALL"
register("st_events", _st_events, sql("audit_events", LOG_SQL))
register("src_jsonl_tolerant", _jsonl, sql("audit_events", LOG_SQL))


def _st_scan(s, d):
    """Documents and pages as one stream of files."""
    docs = jobs.table_stream(s, d, "documents.parquet", fx.table(s, d, "documents").schema)
    pages = jobs.table_stream(s, d, "pages.parquet", fx.table(s, d, "pages").schema)
    out = jobs.scan_stream(fx.file_rows(docs, pages), sc_cat.CORPUS).select("repo_id", "path", "rule_id", "line", "off", "severity", "finding_id")
    return _run(s, "scan", out)


register(
    "st_scan", _st_scan,
    sql("files", "SELECT repo_id, path, rule_id, line, off, severity, finding_id FROM routed", *sc_cat.FOUND_ALL, *sc_cat.DEDUP_SQL[:2]),
)


def scan_feed(s, d):
    """Scan and coverage rows of two scans as (scan rows, coverage rows), the later scan first and once more in part."""
    rows, cov = fx.scan_rows(s, d), fx.coverage_files(s, d)
    tag = lambda df, n: df.withColumns({"scan_id": F.lit(f"scan-{n}"), "at": F.lit(f"1999-01-0{n}T00:00:00Z")})
    one, two = rows.where("ord % 3 <> 0"), rows.where("ord % 3 <> 1")
    return [(tag(two, 2), tag(cov, 2)), (tag(one, 1), tag(cov, 1)), (tag(two.where("ord % 2 = 0"), 2), tag(cov, 2))]


#: Bytes of scan events that a batch takes.
FEED_BYTES = 512 << 20


def _st_reconcile(s, d):
    s.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    base = scratch(s, "recon")
    rules = {r.rule_id: r.in_secrets for r in rc.eligible_rules(fx.registry_rules(s, d)).toLocalIterator()}
    put = lambda df: df.write.mode("append").option("compression", "zstd").parquet(f"{base}/in")
    for scan, coverage in scan_feed(s, d):
        events = mg.scan_events(scan, coverage)
        put(mg.laid_out(events))
        let_go(s)
    end = s.read.schema(events.schema).parquet(f"{base}/in").limit(1).withColumns({"ts": F.to_timestamp(F.lit("2000-01-01T00:00:00Z")), "at_ms": F.unix_millis(F.to_timestamp(F.lit("2000-01-01T00:00:00Z"))), "path": F.lit("end"), "finding_id": F.lit(None).cast("string"), "scan_id": F.lit("end")})
    time.sleep(1)  # the end comes last, also where files are dated by whole seconds
    put(end)
    stream = jobs.table_stream(s, f"{base}/in", "*.parquet", events.schema, per_bytes=FEED_BYTES, used_up=True)
    changes = _run(s, "recon", mg.reconciled(stream, "7 days", rules=rules))
    return mg.current(changes, ["status", "times_seen", "reopen_count", "first_seen", "last_seen"])


ST_U = "u{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, finding_id ORDER BY ord, line) AS k FROM scan_rows WHERE NOT suppressed AND ord % 3 <> {m}) WHERE k = 1)"
register(
    "st_reconcile", _st_reconcile,
    sql("keyed scan_rows coverage registry", """SELECT coalesce(a.repo_id, b.repo_id) AS repo_id, coalesce(a.finding_id, b.finding_id) AS finding_id,
    CASE WHEN b.finding_id IS NULL AND NOT any2 AND covered THEN 'resolved' ELSE 'open' END AS status, CASE WHEN a.ok THEN 1 ELSE 0 END + CASE WHEN b.ok THEN 1 ELSE 0 END AS times_seen, 0 AS reopen_count,
    CASE WHEN a.ok THEN '1999-01-01T00:00:00Z' ELSE '1999-01-02T00:00:00Z' END AS first_seen, CASE WHEN b.ok THEN '1999-01-02T00:00:00Z' ELSE '1999-01-01T00:00:00Z' END AS last_seen
    FROM (SELECT *, code_hash IS NOT NULL AS ok FROM u1) a FULL OUTER JOIN (SELECT *, code_hash IS NOT NULL AS ok FROM u2) b ON a.repo_id = b.repo_id AND a.finding_id = b.finding_id
    LEFT JOIN (SELECT DISTINCT repo_id AS r2, finding_id AS f2 FROM scan_rows WHERE suppressed AND ord % 3 <> 1) s ON s.r2 = a.repo_id AND s.f2 = a.finding_id,
    LATERAL (SELECT s.f2 IS NOT NULL AS any2, a.path IN (SELECT path FROM coverage) AND a.rule_id IN (SELECT rule_id FROM registry) AS covered) x
    WHERE coalesce(a.ok, false) OR coalesce(b.ok, false)""", ST_U.format(n=1, m=0), ST_U.format(n=2, m=1)),
)


def _st_expiry(s, d):
    base = scratch(s, "expiry")
    e = fx.exceptions(s, d).where("status <> 'rejected'").select("id", F.to_timestamp("created_at").alias("ts"), F.lit("pending").alias("status"), "exc_ord")
    decided = e.where("exc_ord % 2 = 0").select("id", (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("ts"), F.lit("approved").alias("status"))
    late = e.where("exc_ord % 7 = 3").select("id", (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("approved").alias("status"))
    events = e.select("id", "ts", "status").unionByName(decided).unionByName(late)
    cut = F.to_timestamp(F.lit("1996-01-01T00:00:00Z"))
    events.where(F.col("ts") < cut).write.parquet(f"{base}/in")
    events.where(F.col("ts") >= cut).write.mode("append").parquet(f"{base}/in")
    end = e.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit("approved").alias("status"))
    end.write.mode("append").parquet(f"{base}/in")
    stream = jobs.table_stream(s, f"{base}/in", "*.parquet", end.schema)
    return _run(s, "expiry", jobs.expiries(stream)).select("id", (F.col("expired_ms") / 1000).cast("bigint").alias("expired_at"))


register(
    "st_expiry", _st_expiry,
    sql("exceptions", "SELECT id, CAST(epoch(strptime(created_at, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 14 DAYS) AS BIGINT) AS expired_at FROM exceptions WHERE status <> 'rejected' AND exc_ord % 2 <> 0"),
)

# ------------------------------------------------------------------ readers and writers
register("src_files", lambda s, d: src.text_lengths(s, d, "given", "*.parquet").select("repo_id", "path", (F.col("n_chars") > 0).alias("has_text")))


def rule_json(s, d):
    """Rule records made of the part table, as JSON text of a pack."""
    p = F.col("p_partkey")
    rec = F.struct(
        F.when(p % 50 != 0, F.concat(F.lit("P-"), p.cast("string"))).alias("id"), F.when(p % 3 != 0, F.col("p_name")).alias("name"), F.when(p % 4 != 0, "MEDIUM").alias("severity"),
        F.when(p % 41 != 0, F.concat(F.lit("x"), p.cast("string"))).alias("pattern"), F.when(p % 2 == 0, F.lit("safe")).alias("antipattern"),
        F.when(p % 5 == 0, F.array(F.lit("a1"), F.lit("a2"))).alias("antipatterns"), F.when(p % 7 == 0, "LINK_EXAMPLE").alias("antipattern_preset"), F.when(p % 6 == 0, 50).alias("lookahead"))
    return fx.table(s, d, "part").select(F.lit("parts").alias("source"), p.alias("rule_ord"), F.to_json(rec).alias("j"))


def _src_rules(s, d):
    parsed = rule_json(s, d).select("source", "rule_ord", F.from_json("j", rl.RULE_SCHEMA).alias("r")).select("source", "rule_ord", "r.*")
    full = rl.with_defaults(parsed)
    bad = rl.rule_problems(full)
    ok = full.where(F.col("id").isNotNull() & F.col("pattern").isNotNull())
    return ok.select("id", "name", "severity", "category", "flags", "antipattern", "lookahead", "lookbehind", "match_mode", F.lit(None).cast("string").alias("problem")).unionByName(
        bad.select("id", *[F.lit(None).cast("string").alias(c) for c in ("name", "severity", "category", "flags", "antipattern")], F.lit(None).cast("int").alias("lookahead"), F.lit(None).cast("int").alias("lookbehind"), F.lit(None).cast("string").alias("match_mode"), "problem")
    ).withColumns({"lookahead": F.col("lookahead").cast("bigint"), "lookbehind": F.col("lookbehind").cast("bigint")})


register(
    "src_rules", _src_rules,
    f"""WITH r AS (SELECT p_partkey AS p, CASE WHEN p_partkey % 50 <> 0 THEN 'P-' || p_partkey END AS id, p_partkey % 41 <> 0 AS has_pattern, * FROM part)
    SELECT id, CASE WHEN p % 3 <> 0 THEN p_name ELSE id END AS name, CASE WHEN p % 4 <> 0 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, 'Uncategorised' AS category, 'gi' AS flags,
    nullif(array_to_string(list_filter([CASE WHEN p % 2 = 0 THEN 'safe' END, CASE WHEN p % 5 = 0 THEN 'a1|a2' END, CASE WHEN p % 7 = 0 THEN {q(rl.PRESETS['LINK_EXAMPLE'])} END], lambda x: x IS NOT NULL), '|'), '') AS antipattern,
    CASE WHEN p % 6 = 0 THEN 50 ELSE 300 END AS lookahead, 120 AS lookbehind, 'content' AS match_mode, NULL AS problem FROM r WHERE id IS NOT NULL AND has_pattern
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing id' FROM r WHERE id IS NULL
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'missing pattern' FROM r WHERE NOT has_pattern""",
)


def _state_sink(s, d):
    root = scratch(s, "state")
    store.write_state(fx.finding_state(s, d), root)
    cov = dict(coverage=fx.coverage_files(s, d), rules=fx.registry_rules(s, d), scope_rules=st._scope(s))
    merged = rc.reconcile(store.read_state(s, root), fx.scan_rows(s, d), scan_id=st.SCAN_ID, at=st.AT, branch="main", is_default_branch=1, **cov)
    store.write_state(rc.new_state(merged), root)
    return store.read_state(s, root).select(*st.SCOLS)


register("sink_state_overwrite", _state_sink, sql(st.RECON, "SELECT " + ", ".join(st.SCOLS) + " FROM state WHERE status IS NOT NULL", st.UNIQ_SQL, st.OUTCOME, st.STATE_SQL))


def _append_sink(s, d):
    root = scratch(s, "events")
    e = fx.audit_events(s, d)
    store.append_events(e.where("seq % 2 = 0"), root)
    store.append_events(e.where("seq % 2 = 1"), root)
    return s.read.parquet(root).groupBy(F.col("day").cast("string").alias("day"), "event").agg(F.count(F.lit(1)).alias("n"))


register("sink_append_events", _append_sink, sql("audit_events", "SELECT strftime(ts, '%Y-%m-%d') AS day, event, count(*) AS n FROM audit_events GROUP BY ALL"))


def _snapshot(s, d):
    root = scratch(s, "scans")
    f = fx.line_findings(s, d)
    for n in (1, 2):
        store.write_scan(f.where(F.col("off") % 2 == n - 1).withColumns({"scan_date": F.lit(f"2024-01-0{n}"), "target": F.lit(".")}), root, f"s{n}")
    scans = store.read_scans(s, root)
    missing = F.array_join(F.lit([r[0] for r in store.missing_scan_fields(scans).orderBy("field").collect()]), ",")
    return scans.groupBy("scan_id", "scan_date").agg(F.count(F.lit(1)).alias("findings")).withColumn("missing", missing)


register(
    "sink_scan_snapshot", _snapshot,
    sql("line_findings", "SELECT 's' || (off % 2 + 1) AS scan_id, '2024-01-0' || (off % 2 + 1) AS scan_date, count(*) AS findings, 'findings,repo_root,scan_mode,skipped,total_files' AS missing FROM line_findings GROUP BY ALL"),
)
