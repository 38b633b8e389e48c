"""Reports, exports, rule registry, fleet views, dependencies and delivery queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx
from siftlake.catalog.files import q
from siftlake.catalog.fixtures import sql
from siftlake.operators import deps as dp, export as xp, fleet as fl, queue as qu, reports as rp, rules as rl
from siftlake.session import checkpoint_dir

QUERIES, ORACLE = {}, {}


def register(key, fn, text=None):
    QUERIES[key] = fn
    if text:
        ORACLE[key] = text


def report_findings(s, d):
    o = F.col("off")
    return fx.line_findings(s, d).withColumns({
        "severity": F.when(F.col("base_severity") == "LOW", "INFO").otherwise(F.col("base_severity")), "name": F.concat(F.lit("Name_"), "rule_id"),
        "excepted": o % 4 == 0, "exception_rejected": o % 9 == 0, "suppressed": o % 11 == 0,
        "confidence": F.when(o % 5 == 0, "LOW").otherwise("HIGH"), "snippet": F.trim("raw")})


RF_SQL = """rf AS (SELECT *, CASE WHEN base_severity = 'LOW' THEN 'INFO' ELSE base_severity END AS severity, off % 4 = 0 AS excepted, off % 9 = 0 AS exception_rejected, off % 11 = 0 AS suppressed,
  CASE WHEN off % 5 = 0 THEN 'LOW' ELSE 'HIGH' END AS confidence, trim(raw) AS snippet FROM line_findings)"""
RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END"
WEIGHT = "CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 5 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 1 ELSE 0 END"
RISK = f"risk AS (SELECT repo_id, count(*) AS findings, least(100, CAST(floor(sum({WEIGHT}) / count(*) * 5 + 0.5) AS BIGINT)) AS risk_score FROM rf GROUP BY 1)"
LABEL = "CASE WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 55 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' WHEN risk_score >= 10 THEN 'LOW' ELSE 'MINIMAL' END AS risk_label"
L = "line_findings"
register("rep_risk_score", lambda s, d: rp.risk_score(report_findings(s, d)).select("repo_id", "findings", "risk_score"), sql(L, "SELECT * FROM risk", RF_SQL, RISK))
register("rep_risk_label", lambda s, d: rp.risk_score(report_findings(s, d)).select("repo_id", "risk_label"), sql(L, f"SELECT repo_id, {LABEL} FROM risk", RF_SQL, RISK))
register("rep_by_severity", lambda s, d: rp.by_severity(report_findings(s, d).where("severity <> 'MEDIUM'")),
         sql(L, "SELECT s AS severity, count(rf.off) AS count FROM unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'EXPOSURE', 'INFO']) t(s) LEFT JOIN rf ON severity = s AND s <> 'MEDIUM' GROUP BY 1", RF_SQL))
register("rep_by_category", lambda s, d: rp.by_category(report_findings(s, d)), sql(L, "SELECT category, count(*) AS count FROM rf GROUP BY 1", RF_SQL))
register("rep_severity_and_category", lambda s, d: rp.severity_and_category(report_findings(s, d)),
         sql(L, "SELECT 'category' AS kind, category AS value, count(*) AS count FROM rf GROUP BY ALL UNION ALL SELECT 'severity', severity, count(*) FROM rf GROUP BY ALL", RF_SQL))
register("rep_checklist", lambda s, d: rp.checklist(report_findings(s, d)).select("rule_id", "severity", "occurrences"),
         sql(L, f"SELECT rule_id, (['CRITICAL', 'HIGH', 'MEDIUM', 'EXPOSURE', 'INFO'])[min({RANK}) + 1] AS severity, count(*) AS occurrences FROM rf GROUP BY 1", RF_SQL))
register("rep_owasp", lambda s, d: rp.owasp_coverage(report_findings(s, d)),
         sql(L, "SELECT id, name, count(rf.off) AS findings, count(rf.off) > 0 AS hit FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in rp.OWASP) + ") o(id, name) LEFT JOIN rf ON contains(category, id) GROUP BY ALL", RF_SQL))
register("rep_remediation", lambda s, d: rp.remediation(report_findings(s, d)),
         sql(L, f"""SELECT rule_id, severity, count, files, (SELECT string_agg(n, ' ' ORDER BY o, repo_id, path) FROM (SELECT regexp_extract(path, '[^/]*$') AS n, min(off) AS o, repo_id, path FROM op WHERE op.rule_id = g.rule_id GROUP BY repo_id, path ORDER BY o, repo_id, path LIMIT 3)) AS first_files,
    greatest(files - 3, 0) AS more_files, nullif(regexp_extract(category, 'A(?:0[1-9]|10)'), '') AS owasp FROM (SELECT rule_id, count(*) AS count, count(DISTINCT repo_id || ':' || path) AS files, arg_min(severity, off) AS severity, arg_min(category, off) AS category FROM op GROUP BY 1) g
    ORDER BY {RANK}, count DESC, rule_id LIMIT 20""", RF_SQL, "op AS (SELECT * FROM rf WHERE NOT excepted)"))
register("rep_partition", lambda s, d: rp.partition_findings(report_findings(s, d)).select("repo_id", "path", "line", "rule_id", "severity", "section"),
         sql(L, """SELECT repo_id, path, line, rule_id, severity, CASE WHEN excepted THEN 'excepted' WHEN exception_rejected THEN 'rejected' WHEN severity = 'EXPOSURE' THEN 'exposure' ELSE 'active' END AS section
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, path, line, rule_id ORDER BY off) AS n FROM rf) WHERE n = 1""", RF_SQL))
register("rep_top_issues", lambda s, d: rp.top_issues(report_findings(s, d)),
         sql(L, f"SELECT rule_id, count, severity FROM (SELECT rule_id, count(*) AS count, arg_min(severity, off) AS severity FROM rf WHERE NOT excepted GROUP BY 1) ORDER BY {RANK}, count DESC, rule_id LIMIT 8", RF_SQL))
register("rep_top_files", lambda s, d: rp.top_files(report_findings(s, d), 50, 2).select("repo_id", "path", F.col("worst").cast("bigint").alias("worst"), "count", F.array_join("lines", ",").alias("lines"), "more"),
         sql(L, f"""SELECT repo_id, path, min({RANK}) AS worst, count(*) AS count, array_to_string(list_sort(list_distinct(list(line) FILTER (line > 0)))[1:2], ',') AS lines, len(list_distinct(list(line) FILTER (line > 0))) > 2 AS more
    FROM rf WHERE NOT excepted GROUP BY ALL ORDER BY worst, count DESC, repo_id, path LIMIT 50""", RF_SQL))
register("rep_low_conf", lambda s, d: rp.low_confidence(report_findings(s, d)),
         sql(L, "SELECT severity, count(*) AS count, count(*) FILTER (confidence = 'LOW') AS low, count(taint_source) AS tainted FROM rf WHERE NOT excepted GROUP BY 1", RF_SQL))


def _view(s, d):
    out = None
    for view in ("open", "all", "excepted", "suppressed"):
        part = rp.findings_view(report_findings(s, d), view, by_file=view == "all").select(F.lit(view).alias("view"), "repo_id", "path", "line", "off", F.col("rank").cast("bigint").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


register("rep_view", _view, sql(L, f"SELECT view, repo_id, path, line, off, {RANK} AS rank FROM rf, unnest(CASE WHEN suppressed THEN ['suppressed'] WHEN excepted THEN ['all', 'excepted'] ELSE ['all', 'open'] END) v(view)", RF_SQL))
register("rep_churn", lambda s, d: rp.churn(fx.finding_state(s, d).withColumn("first_seen", F.col("last_seen")), "1998-05-15T00:00:00Z"),
         sql("keyed finding_state", "SELECT repo_id, finding_id, greatest(times_seen, 1) AS times_seen, CAST(floor(epoch(TIMESTAMP '1998-05-15' - strptime(last_seen, '%Y-%m-%dT%H:%M:%SZ')) / 86400) AS BIGINT) AS age_days, epoch(TIMESTAMP '1998-05-15' - strptime(last_seen, '%Y-%m-%dT%H:%M:%SZ')) > 30 * 86400 AS lingering FROM finding_state"))
RULE_ROWS = "SELECT 'R' || (p_partkey % 12) AS rule_id, min(p_name) AS title FROM part WHERE p_partkey % 12 <> 7 GROUP BY 1"
register("rep_hydrate", lambda s, d: rp.hydrate(fx.finding_state(s, d), fx.table(s, d, "part").where("p_partkey % 12 <> 7").groupBy(F.concat(F.lit("R"), (F.col("p_partkey") % 12).cast("string")).alias("rule_id")).agg(F.min("p_name").alias("title"))).select("repo_id", "finding_id", "rule_id", "title"),
         sql("keyed finding_state", f"SELECT repo_id, finding_id, rule_id, title FROM finding_state LEFT JOIN ({RULE_ROWS}) USING (rule_id)"))


def doc_findings(s, d):
    """Findings spread over the lines of documents, page texts included."""
    f = fx.document_files(s, d)
    n = F.length("content")
    spots = F.array(F.lit(0), n % 7 + 1, n % 40 + 1, n % 400 + 1)
    return f.select("repo_id", "path", n.alias("n"), F.explode(F.array_distinct(spots)).alias("line")).select(
        "repo_id", "path", F.col("line").cast("bigint").alias("line"), F.concat(F.lit("R"), (F.col("n") % 5).cast("string")).alias("rule_id"),
        F.element_at(F.lit(fx.SEVERITY_CYCLE), (F.col("line") % 5 + 1).cast("int")).alias("severity"), F.lit("code").alias("snippet"))


DF_SQL = f"""df AS (SELECT repo_id, path, line::BIGINT AS line, 'R' || (n % 5) AS rule_id, ({fx._sql_list(fx.SEVERITY_CYCLE)})[line % 5 + 1] AS severity FROM
  (SELECT repo_id, path, length(content) AS n, unnest(list_distinct([0, length(content) % 7 + 1, length(content) % 40 + 1, length(content) % 400 + 1])) AS line FROM files))"""
_ctx = lambda k: f"list_transform(range(greatest(line - {k} - 1, 0) + 1, least(len(ls), line + {k}) + 1), lambda i: i || ': ' || ls[i])"
CTX = lambda k, name="ctx": f"{name} AS (SELECT repo_id, path, line, {_ctx(k)} AS context FROM (SELECT DISTINCT repo_id, path, line, string_split(content, chr(10)) AS ls FROM df JOIN files USING (repo_id, path)))"
register("rep_context", lambda s, d: rp.with_context(doc_findings(s, d), fx.document_files(s, d)).select("repo_id", "path", "line", F.sha2(F.array_join("context", "\n"), 256).alias("context")),
         sql("files", "SELECT repo_id, path, line, sha256(array_to_string(context, chr(10))) AS context FROM ctx", DF_SQL, CTX(5)))
register("review_eligible", lambda s, d: rp.review_payload(doc_findings(s, d), fx.document_files(s, d)).select("repo_id", "path", "line", "rule_id", "severity", F.sha2("context", 256).alias("context")),
         sql("files", "SELECT repo_id, path, line, rule_id, severity, sha256(array_to_string(context, chr(10))) AS context FROM df JOIN ctx USING (repo_id, path, line) WHERE severity IN ('CRITICAL', 'HIGH')", DF_SQL, CTX(8)))
register("review_warning", lambda s, d: rp.review_warning(doc_findings(s, d)),
         sql("files", "SELECT repo_id, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) AS eligible, count(*) FILTER (severity IN ('CRITICAL', 'HIGH')) > 20 AS large FROM df GROUP BY 1", DF_SQL))
def report_rows(s, d):
    """Findings with the texts of their rules, some of which have none."""
    n = F.substring("rule_id", 2, 9).cast("long")
    return report_findings(s, d).withColumns({"why": F.when(n % 2 == 0, F.concat(F.lit("Why of "), "rule_id")), "fix": F.when(n % 3 != 0, F.concat(F.lit("Fix "), "rule_id"))})


def report_scans(s, d):
    return report_findings(s, d).groupBy("repo_id").agg(F.countDistinct("path").alias("total_files"), F.count_if(F.col("off") % 7 == 0).alias("skipped")).withColumns(
        {"scan_date": F.lit("2024-05-01T00:00:00Z"), "target": F.concat(F.lit("src_"), "repo_id")})


def _folder(s, name):
    return f"{checkpoint_dir(s)}/siftlake-{name}-{uuid.uuid4().hex}"


def _json(s, d):
    """The whole report, written as JSON lines and read again."""
    path = _folder(s, "report-json")
    rp.write_json(rp.report_json(report_rows(s, d), report_scans(s, d)), path, "gzip")
    return s.read.option("basePath", path).schema("value string, repo_id string, section string").text(path).select("repo_id", "section", F.col("value").alias("json"))


def _md(s, d):
    """All lines of the report, written as text and read again."""
    path = _folder(s, "report-md")
    rp.write_markdown(rp.report_markdown(report_rows(s, d), report_scans(s, d)), path, "gzip")
    return s.read.option("basePath", path).schema("value string, repo_id string").text(path).select("repo_id", F.col("value").alias("text"))


RR_SQL = (
    RF_SQL, RISK,
    """rr AS (SELECT *, 'Name_' || rule_id AS name, CASE WHEN CAST(substring(rule_id, 2) AS BIGINT) % 2 = 0 THEN 'Why of ' || rule_id END AS why,
    CASE WHEN CAST(substring(rule_id, 2) AS BIGINT) % 3 <> 0 THEN 'Fix ' || rule_id END AS fix FROM rf)""",
    "sc AS (SELECT repo_id, count(DISTINCT path) AS total_files, count(*) FILTER (off % 7 = 0) AS skipped, '2024-05-01T00:00:00Z' AS scan_date, 'src_' || repo_id AS target FROM rf GROUP BY 1)",
    "sm AS (SELECT repo_id, " + ", ".join(f"count(*) FILTER (severity = '{x}') AS {x}" for x in rp.sev.ORDER) + " FROM rr GROUP BY 1)",
    "ca AS (SELECT repo_id, list(struct_pack(category := category, count := n) ORDER BY n DESC, category) AS cats FROM (SELECT repo_id, category, count(*) AS n FROM rr GROUP BY ALL) GROUP BY 1)",
    f"it AS (SELECT repo_id, rule_id, min({RANK}) AS r, arg_min(name, ({RANK}) * 1000000000000 + off) AS name, arg_min(category, ({RANK}) * 1000000000000 + off) AS category, count(*) AS n FROM rr GROUP BY ALL)",
    f"ru AS (SELECT repo_id, rule_id, {RANK} AS r, any_value(name) AS name, arg_min(category, off) AS category, any_value(why) AS why, any_value(fix) AS fix FROM rr GROUP BY ALL)",
)
_SEVERITY = "(['CRITICAL', 'HIGH', 'MEDIUM', 'EXPOSURE', 'INFO'])[r + 1]"
_esc = lambda c: rf"regexp_replace({c}, '([`*_\[\]<>|\\])', '\\\1', 'g')"
register("sink_report_json", _json, sql(L, f"""SELECT repo_id, 'meta' AS section, CAST(to_json(struct_pack("scanDate" := scan_date, target := target, "totalFiles" := total_files, "skippedFiles" := skipped)) AS VARCHAR) AS json FROM sc
    UNION ALL SELECT repo_id, 'summary', CAST(to_json(struct_pack("riskScore" := risk_score, "riskLabel" := {LABEL.split(' AS ')[0]}, "totalFindings" := findings, "bySeverity" := struct_pack({', '.join(f'"{x}" := {x}' for x in rp.sev.ORDER)}), "byCategory" := cats)) AS VARCHAR)
    FROM risk JOIN sm USING (repo_id) JOIN ca USING (repo_id)
    UNION ALL SELECT repo_id, 'finding', CAST(to_json(struct_pack("findingId" := NULL::VARCHAR, "ruleId" := rule_id, severity := severity, name := name, category := category, "filePath" := path, line := line, match := snippet, why := why, scenario := NULL::VARCHAR,
    fix := fix, excepted := excepted, "codeHash" := NULL::VARCHAR)) AS VARCHAR) FROM rr
    UNION ALL SELECT repo_id, 'checklist', CAST(to_json(struct_pack("ruleId" := rule_id, severity := {_SEVERITY}, name := name, category := category, occurrences := n, resolved := false)) AS VARCHAR) FROM it""", *RR_SQL))
register("sink_report_md", _md, sql(L, rf"""SELECT repo_id, unnest(list_filter(['# Code scan report', '', '> Date: **' || scan_date || '**, target: `' || {_esc('target')} || '`, files: **' || total_files || '**', '', '## Summary', '', '| Property | Value |', '|---|---|',
    '| Risk | ' || {LABEL.split(' AS ')[0]} || ' (' || risk_score || '/100) |', '| Findings | **' || findings || '** |', CASE WHEN skipped > 0 THEN '| Skipped files | ' || skipped || ' |' END, '', '### Findings by severity', '', '| Severity | Count | Meaning |', '|---|---|---|',
    {', '.join(f"CASE WHEN {x} > 0 THEN '| {x} | **' || {x} || '** | {rp.MEANING[x]} |' END" for x in rp.sev.ORDER)}, '', '---', '', '## Findings', '', '## Checklist', '', 'Tick off what is resolved:', '', '', '---'], lambda x: x IS NOT NULL)) AS text
    FROM risk JOIN sm USING (repo_id) JOIN sc USING (repo_id)
    UNION ALL SELECT repo_id, unnest(['### ' || {_SEVERITY} || ' (' || n || ')', '']) FROM (SELECT repo_id, {RANK} AS r, count(*) AS n FROM rr GROUP BY ALL)
    UNION ALL SELECT repo_id, unnest(list_filter(['#### ' || {_esc('rule_id')} || ' - ' || {_esc('name')}, '', '**Category:** ' || {_esc('category')}, '', '**Occurrences:**', '', '', '**Why:** ' || why, CASE WHEN why IS NOT NULL THEN '' END, '**Fix:** ' || fix, CASE WHEN fix IS NOT NULL THEN '' END, '---', ''], lambda x: x IS NOT NULL)) FROM ru
    UNION ALL SELECT repo_id, '- `' || {_esc('path')} || '` line **' || line || '**  `' || {_esc('snippet')} || '`' FROM rr
    UNION ALL SELECT repo_id, '- [ ] `' || {_SEVERITY} || '` **' || {_esc('rule_id')} || '** - ' || {_esc('name')} || CASE WHEN n > 1 THEN ' _(' || n || ' occurrences)_' ELSE '' END FROM it""", *RR_SQL))

# ------------------------------------------------------------------ export
def verdict_rows(s, d):
    """A verdict for a third of the order lines, with short, full and longer paths; some errored."""
    f = fx.line_findings(s, d).where(F.col("off") % 3 == 0)
    return f.select(
        "repo_id", F.when(F.col("off") % 2 == 0, F.substring_index("path", "/", -1)).when(F.col("off") % 5 == 0, F.concat(F.lit("/work/"), "path")).otherwise(F.col("path")).alias("path"),
        "rule_id", "line", F.col("off").alias("ord"), (F.col("off") % 7 < 3).alias("confirmed"),
        F.when(F.col("off") % 4 == 0, F.lit("0.85")).when(F.col("off") % 4 == 1, "0.6").when(F.col("off") % 4 == 2, "MEDIUM").alias("confidence"),
        F.when(F.col("off") % 13 == 0, "timeout").alias("error"))


V_SQL = (
    RF_SQL,
    """ver AS (SELECT repo_id, CASE WHEN off % 2 = 0 THEN regexp_extract(path, '[^/]*$') WHEN off % 5 = 0 THEN '/work/' || path ELSE path END AS path, rule_id, line, off AS ord, off % 7 < 3 AS confirmed,
  CASE off % 4 WHEN 0 THEN '0.85' WHEN 1 THEN '0.6' WHEN 2 THEN 'MEDIUM' END AS confidence, CASE WHEN off % 13 = 0 THEN 'timeout' END AS error FROM line_findings WHERE off % 3 = 0)""",
    """hit AS (SELECT f.repo_id, f.path, f.line, f.rule_id, arg_min(v.confirmed, v.ord) AS confirmed, arg_min(coalesce(v.confidence, '-'), v.ord) AS confidence FROM (SELECT DISTINCT repo_id, path, line, rule_id FROM rf) f
  JOIN ver v ON f.repo_id = v.repo_id AND f.rule_id = v.rule_id AND f.line = v.line AND (f.path = v.path OR ends_with(f.path, '/' || v.path) OR ends_with(v.path, '/' || f.path)) WHERE error IS NULL GROUP BY ALL)""",
    "paired AS (SELECT rf.*, hit.confirmed, hit.confidence AS vconf, hit.rule_id IS NOT NULL AS has FROM rf LEFT JOIN hit USING (repo_id, path, line, rule_id))",
    """stats AS (SELECT rule_id, count(*) AS triggered, count(*) FILTER (has AND confirmed) AS confirmed, count(*) FILTER (has AND NOT confirmed) AS false_positives, count(*) FILTER (NOT has) AS no_verdict, count(*) FILTER (has) AS sample,
  CASE WHEN count(*) FILTER (has) > 0 THEN count(*) FILTER (has AND NOT confirmed) / count(*) FILTER (has) ELSE 0 END AS rate FROM paired GROUP BY 1)""",
)
PAIRED = lambda s, d: xp.join_verdicts(report_findings(s, d), verdict_rows(s, d))
register("export_verdict_join", lambda s, d: PAIRED(s, d).select("repo_id", "path", "line", "rule_id", "off", F.col("verdict.confirmed").alias("confirmed")),
         sql(L, "SELECT repo_id, path, line, rule_id, off, confirmed FROM paired", *V_SQL))
register("verdict_merge", lambda s, d: xp.merge_verdicts(report_findings(s, d), verdict_rows(s, d)).select("repo_id", "path", "line", "rule_id", "off", "confirmed", "review_confidence"),
         sql(L, "SELECT repo_id, path, line, rule_id, off, confirmed, CASE WHEN has THEN CASE vconf WHEN '0.85' THEN 'HIGH' WHEN '0.6' THEN 'MEDIUM' WHEN '-' THEN 'LOW' ELSE vconf END END AS review_confidence FROM paired", *V_SQL))
register("export_rule_stats", lambda s, d: xp.rule_stats(PAIRED(s, d)).drop("rate"), sql(L, "SELECT * EXCLUDE (rate), floor(rate * 100 + 0.5) / 100 AS fp_rate FROM stats", *V_SQL))
register("export_high_fp", lambda s, d: xp.high_fp(xp.rule_stats(PAIRED(s, d))).select("rule_id", "rate", "sample"), sql(L, "SELECT rule_id, rate, sample FROM stats WHERE rate >= 0.5 AND sample >= 3", *V_SQL))
register("export_languages", lambda s, d: xp.languages(report_findings(s, d)).select("repo_id", F.array_join("languages", ",").alias("languages")),
         sql(L, "SELECT repo_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM (SELECT repo_id, CASE lower(regexp_extract(path, '[^.]*$')) WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'log' THEN 'text' ELSE lower(regexp_extract(path, '[^.]*$')) END AS lang FROM line_findings) GROUP BY 1"))


def doc_verdicts(s, d):
    lab = fx.table(s, d, "labels").join(fx.table(s, d, "documents").select("doc_id", "source"), "doc_id")
    i = F.col("doc_id")
    path = F.concat(fx._pick(fx.DIRS, i % 8), F.lit("/f"), i.cast("string"), F.lit("."), fx._pick(fx.DOC_EXTS, F.floor(i / 8) % 6))
    return doc_findings(s, d).select("repo_id", "path", "line", "rule_id").join(
        lab.select(F.col("source").alias("repo_id"), path.alias("path"), (F.col("quality") == 1).alias("confirmed"), i.alias("ord")), ["repo_id", "path"]
    ).withColumns({"confidence": F.lit("0.9"), "error": F.lit(None).cast("string")})


def _export(s, d):
    e = xp.export_findings(doc_findings(s, d), doc_verdicts(s, d), fx.document_files(s, d), severity="critical", deep_only=True)
    return e.select("repo_id", "path", "line", "rule_id", "verdict_kind", F.sha2(F.array_join("context", "\n"), 256).alias("context"))


DV_SQL = f"dv AS (SELECT source AS repo_id, ({fx._sql_list(fx.DIRS)})[doc_id % 8 + 1] || '/f' || doc_id || '.' || ({fx._sql_list(fx.DOC_EXTS)})[(doc_id // 8) % 6 + 1] AS path, quality = 1 AS confirmed FROM labels JOIN documents USING (doc_id))"
EXPORT_SQL = sql("files", "SELECT repo_id, path, line, rule_id, CASE WHEN confirmed THEN 'confirmed' ELSE 'false_positive' END AS verdict_kind, sha256(array_to_string(context, chr(10))) AS context FROM df JOIN dv USING (repo_id, path) JOIN ctx USING (repo_id, path, line) WHERE severity = 'CRITICAL'", DF_SQL, CTX(5), DV_SQL)
register("export_findings", _export, EXPORT_SQL)


def _export_sink(s, d):
    """All findings, written as JSON lines to the shared folder and read back."""
    cols = ["repo_id", "path", "line", "rule_id", "verdict_kind", "context"]
    out = f"{checkpoint_dir(s)}/siftlake-export-{uuid.uuid4().hex}"
    records = xp.export_findings(doc_findings(s, d), doc_verdicts(s, d), fx.document_files(s, d)).select(*cols)
    records.write.json(out)
    back = s.read.schema(records.schema).json(out)
    return back.select(*cols[:-1], F.sha2(F.array_join("context", "\n"), 256).alias("context"))


register("sink_export", _export_sink, sql("files", "SELECT repo_id, path, line, rule_id, CASE WHEN confirmed THEN 'confirmed' WHEN NOT confirmed THEN 'false_positive' END AS verdict_kind, sha256(array_to_string(context, chr(10))) AS context FROM df LEFT JOIN dv USING (repo_id, path) JOIN ctx USING (repo_id, path, line)", DF_SQL, CTX(5), DV_SQL))

# ------------------------------------------------------------------ registry
def rule_rows(s, d):
    p = F.col("p_partkey")
    src = F.element_at(F.lit(["js", "ts", "sensitive", "infra"]), (p % 4 + 1).cast("int"))
    return fx.table(s, d, "part").select(
        F.concat(F.element_at(F.lit(["AB-", "CD-", "EF-"]), (p % 3 + 1).cast("int")), (p % 150).cast("string")).alias("rule_id"), src.alias("source"), (p % 4).alias("source_ord"), p.alias("rule_ord"),
        F.col("p_name").alias("name"), F.element_at(F.lit(fx.SEVERITY_CYCLE), (F.floor(p / 4) % 5 + 1).cast("int")).alias("severity"), F.element_at(F.lit(fx.CATEGORIES), (p % 5 + 1).cast("int")).alias("category"),
        F.when(p % 4 == 2, F.when(p % 8 == 2, F.array(F.lit("json"), F.lit("env"))).otherwise(F.array(F.lit("sql")))).alias("file_types"), F.lit("content").alias("match_mode"), F.col("p_name").alias("why"), F.lit(None).cast("string").alias("fix"))


LANGS = [(p, False, v) for p, v in rl.REGISTRY_LANGUAGES.items()] + [("js", True, rl.EXPOSURE_JS_LANGUAGES)] + [(p, True, v) for p, v in rl.REGISTRY_LANGUAGES.items() if p != "js"]


def registry(s, d):
    return rl.registry(rule_rows(s, d), s.createDataFrame(LANGS, "source string, exposure boolean, languages array<string>"))


REG_SQL = (
    f"""rr AS (SELECT (['AB-', 'CD-', 'EF-'])[p_partkey % 3 + 1] || (p_partkey % 150) AS rule_id, (['js', 'ts', 'sensitive', 'infra'])[p_partkey % 4 + 1] AS source, p_partkey % 4 AS so, p_partkey AS ro, p_name AS name,
  ({fx._sql_list(fx.SEVERITY_CYCLE)})[(p_partkey // 4) % 5 + 1] AS severity, ({fx._sql_list(fx.CATEGORIES)})[p_partkey % 5 + 1] AS category FROM part)""",
    """reg AS (SELECT *, CASE source WHEN 'js' THEN CASE WHEN severity = 'EXPOSURE' THEN ['js', 'ts', 'mjs', 'cjs', 'jsx', 'tsx', 'html', 'php', 'py'] ELSE ['js', 'ts', 'mjs', 'cjs', 'jsx', 'tsx'] END WHEN 'ts' THEN ['ts', 'tsx']
  WHEN 'sensitive' THEN CASE WHEN ro % 8 = 2 THEN ['json', 'env'] ELSE ['sql'] END ELSE ['all'] END AS languages FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY so, ro) AS n FROM rr) WHERE n = 1)""",
)


def _registry(s, d):
    from pyspark.sql import Window as W

    return registry(s, d).select("rule_id", "source", "severity", F.array_join("languages", ",").alias("languages"), F.row_number().over(W.orderBy(*rl.natural_order("rule_id"))).cast("bigint").alias("position"))


register("rules_registry", _registry,
         sql("", "WITH " + ", ".join(REG_SQL) + """ SELECT rule_id, source, severity, array_to_string(languages, ',') AS languages, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'EXPOSURE' THEN 3 WHEN 'LOW' THEN 4 ELSE 9 END,
    substring(rule_id, 1, 3), CAST(substring(rule_id, 4) AS INT)) AS position FROM reg"""))


def _rules_query(s, d):
    r = registry(s, d)
    parts = [("id", rl.query_registry(r, rule_id="ab-12")), ("lang", rl.query_registry(r, lang="TS, sql", severity="high")), ("search", rl.query_registry(r, search="INJECTION"))]
    out = None
    for name, p in parts:
        p = p.select(F.lit(name).alias("kind"), "rule_id")
        out = p if out is None else out.unionByName(p)
    return out


register("rules_query", _rules_query,
         sql("", "WITH " + ", ".join(REG_SQL) + """ SELECT 'id' AS kind, rule_id FROM reg WHERE lower(rule_id) = 'ab-12' UNION ALL SELECT 'lang', rule_id FROM reg WHERE list_has_any(languages, ['ts', 'sql', 'all']) AND severity = 'HIGH'
    UNION ALL SELECT 'search', rule_id FROM reg WHERE contains(lower(concat_ws('|', rule_id, name, category)), 'injection')"""))
register("rules_stats", lambda s, d: rl.registry_stats(registry(s, d)),
         sql("", "WITH " + ", ".join(REG_SQL) + " SELECT 'severity' AS kind, severity AS value, count(*) AS count FROM reg GROUP BY ALL UNION ALL SELECT 'category', category, count(*) FROM reg GROUP BY ALL UNION ALL SELECT 'language', l, count(*) FROM reg, unnest(languages) u(l) GROUP BY ALL"))

# ------------------------------------------------------------------ fleet
def repos(s, d):
    k = F.col("s_suppkey")
    ds = lambda n: F.concat(F.lit("2024-0"), (n % 9 + 1).cast("string"), F.lit("-11T00:00:00Z"))
    return fx.table(s, d, "supplier").select(
        F.concat(F.lit("r"), k.cast("string")).alias("repo_id"), F.when(k % 4 != 0, F.col("s_name")).alias("name"), F.when(k % 6 != 0, ds(k)).alias("last_seen"), F.when(k % 5 != 0, ds(k + 1)).alias("last_scan"),
        (k % 50).alias("last_findings"), (k % 7).alias("last_critical"), F.when(k % 3 == 0, "path-based").otherwise("remote").alias("type"),
        F.when(k % 9 != 0, F.concat(F.lit("/srv/n"), F.col("s_nationkey").cast("string"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("/p"), (k % 10).cast("string"))), F.when(k % 8 == 1, F.concat(F.lit("/q"), k.cast("string"))).otherwise(""))).alias("local_path"),
        F.when(k % 10 != 0, F.concat(F.lit("git@h:"), "s_name")).alias("remote"))


REPOS_SQL = """repos AS (SELECT s_suppkey AS k, 'r' || s_suppkey AS repo_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 6 <> 0 THEN '2024-0' || (s_suppkey % 9 + 1) || '-11T00:00:00Z' END AS last_seen,
  CASE WHEN s_suppkey % 5 <> 0 THEN '2024-0' || ((s_suppkey + 1) % 9 + 1) || '-11T00:00:00Z' END AS last_scan, s_suppkey % 50 AS last_findings, s_suppkey % 7 AS last_critical, CASE WHEN s_suppkey % 3 = 0 THEN 'path-based' ELSE 'remote' END AS type,
  CASE WHEN s_suppkey % 9 <> 0 THEN '/srv/n' || s_nationkey || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '/p' || (s_suppkey % 10) END || CASE WHEN s_suppkey % 8 = 1 THEN '/q' || s_suppkey ELSE '' END END AS local_path,
  CASE WHEN s_suppkey % 10 <> 0 THEN 'git@h:' || s_name END AS remote FROM supplier)"""
register("fleet_repos", lambda s, d: fl.list_repos(repos(s, d)), f"WITH {REPOS_SQL} SELECT repo_id, coalesce(name, repo_id) AS name, last_seen, last_scan, last_findings, last_critical, type = 'path-based' AS path_based FROM repos")


def scans(s, d):
    return fx.line_findings(s, d).select("repo_id", F.concat(F.lit("s"), (F.col("off") % 4).cast("string")).alias("scan_id"), F.concat(F.lit("2024-01-0"), (F.col("off") % 4 + 1).cast("string")).alias("scan_date"),
                                         F.col("base_severity").alias("severity"), (F.col("off") % 1000 == 0).alias("has_verdict"))


register("fleet_scans", lambda s, d: fl.list_scans(scans(s, d)),
         sql(L, "SELECT repo_id, 's' || (off % 4) AS scan_id, '2024-01-0' || (off % 4 + 1) AS scan_date, count(*) AS findings, count(*) FILTER (base_severity = 'CRITICAL') AS critical, bool_or(off % 1000 = 0) AS has_deep FROM line_findings GROUP BY ALL"))


def _verify(s, d):
    r = repos(s, d)
    n = F.substring("repo_id", 2, 20).cast("bigint")
    obs = r.where(F.col("local_path").isNotNull()).groupBy("local_path").agg(F.min(n).alias("n"), F.min("remote").alias("actual_remote")).where(F.col("n") % 5 != 1).select(
        "local_path", (F.col("n") % 7 != 2).alias("has_git"), "actual_remote")
    return fl.verify(r, obs)


register("fleet_verify", _verify,
         f"""WITH {REPOS_SQL}, obs AS (SELECT local_path, min(k) % 7 <> 2 AS has_git, min(remote) AS actual FROM repos WHERE local_path IS NOT NULL GROUP BY 1 HAVING min(k) % 5 <> 1)
    SELECT repo_id, r.local_path, CASE WHEN r.local_path IS NULL THEN 'ORPHAN' WHEN o.local_path IS NULL THEN 'MISSING' WHEN type = 'path-based' THEN 'OK' WHEN NOT has_git THEN 'STALE' WHEN remote <> actual THEN 'STALE' ELSE 'OK' END AS status FROM repos r LEFT JOIN obs o ON r.local_path = o.local_path""")
register("fleet_scan_counts", lambda s, d: fl.scan_counts(fx.audit_events(s, d).withColumn("repo_id", F.col("git_user"))),
         sql("audit_events", "SELECT git_user AS repo_id, count(*) AS scans FROM audit_events WHERE event = 'scan_started' GROUP BY 1"))
register("fleet_overlap", lambda s, d: fl.nesting(repos(s, d)),
         f"""WITH {REPOS_SQL}, folders AS (SELECT local_path, min(repo_id) AS parent FROM repos WHERE local_path IS NOT NULL GROUP BY 1)
    SELECT b.repo_id AS child, arg_max(a.parent, length(a.local_path)) AS parent, count(*) AS depth FROM repos b JOIN folders a ON starts_with(b.local_path, a.local_path || '/') GROUP BY 1""")
register("fleet_overlap_of", lambda s, d: fl.overlapping(repos(s, d), "/srv/n3/p7"),
         f"""WITH {REPOS_SQL} SELECT repo_id, CASE WHEN starts_with(local_path, '/srv/n3/p7/') THEN 'child' ELSE 'parent' END AS relation FROM repos
    WHERE starts_with(local_path, '/srv/n3/p7/') OR starts_with('/srv/n3/p7/', local_path || '/') AND local_path <> '/srv/n3/p7'""")
register("age_bucket", lambda s, d: fx.table(s, d, "orders").select("o_orderkey", fl.age_text(F.col("o_orderkey") * F.col("o_orderkey") % 400000).alias("age")),
         """SELECT o_orderkey, CASE WHEN x >= 86400 THEN (x // 86400) || ' day' || CASE WHEN x // 86400 > 1 THEN 's' ELSE '' END || ' ago' WHEN x >= 3600 THEN (x // 3600) || ' hour' || CASE WHEN x // 3600 > 1 THEN 's' ELSE '' END || ' ago'
    WHEN x >= 60 THEN (x // 60) || ' minute' || CASE WHEN x // 60 > 1 THEN 's' ELSE '' END || ' ago' ELSE 'just now' END AS age FROM (SELECT o_orderkey, o_orderkey * o_orderkey % 400000 AS x FROM orders)""")

# ------------------------------------------------------------------ dependencies
PKG = '{"name":"a","dependencies":{"express":"^%s","@nestjs/core":"1","left":"2"},"devDependencies":{"jest":"9","left":"3"}}'
COMPOSER = '{"require":{"php":">=8","laravel/framework":"%s"},"require-dev":{"phpunit/phpunit":"9"}}'
REQS = "# top\nFlask==%s\n-r other.txt\nrequests >= 2.1\n  PyJWT\nflask==9\n"
PYPROJ = '[tool.poetry]\nname = "x"\n[tool.poetry.dependencies]\ndjango = "^%s"\n"sqlalchemy>=2"\n[other]\nz = "1"\n'
CSPROJ = '<Project><TargetFramework>net%s</TargetFramework><PackageReference Include="Microsoft.AspNetCore.App" Version="7" /><packagereference include="Dapper" version="%s"/></Project>'


def manifests(s, d):
    """Manifest files of every customer's repository; the version is the customer's nation key."""
    c, v = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    kinds = [("package.json", PKG, 0), ("composer.json", COMPOSER, 1), ("requirements.txt", REQS, 2), ("pyproject.toml", PYPROJ, 3), ("app.csproj", CSPROJ, 4), ("pyproject.toml", PYPROJ, 2)]
    out = None
    for name, text, slot in kinds:
        part = fx.table(s, d, "customer").where(c % 5 == slot).select(
            F.concat(F.lit("r"), (c % 40).cast("string")).alias("repo_id"), F.concat(F.lit("m"), c.cast("string"), F.lit(f"/{name}")).alias("path"), F.replace(F.lit(text), F.lit("%s"), v).alias("content"))
        out = part if out is None else out.unionByName(part)
    return out


_c = "SELECT 'r' || (c_custkey % 40) AS repo_id, 'm' || c_custkey || '/{}' AS path, '{}' AS language, {} AS name, {} AS version, {} AS dev FROM customer WHERE c_custkey % 5 = {}"


def _rows(file_name, language, slot, items):
    """Expected rows; a version text that begins with a quote is an SQL expression."""
    value = lambda v: "c_nationkey::VARCHAR" if v == "NK" else v if v.startswith("'") else q(v)
    return " UNION ALL ".join(_c.format(file_name, language, q(n), value(v), dev, slot) for n, v, dev in items)


DEP_SQL = {
    "dep_package_json": _rows("package.json", "javascript", 0, [("express", "'^' || c_nationkey", "false"), ("@nestjs/core", "1", "false"), ("jest", "9", "true"), ("left", "3", "true")]),
    "dep_composer": _rows("composer.json", "php", 1, [("laravel/framework", "NK", "false"), ("phpunit/phpunit", "9", "true")]),
    "dep_requirements": _rows("requirements.txt", "python", 2, [("flask", "==9", "false"), ("requests", ">= 2.1", "false"), ("pyjwt", "*", "false")]),
    "dep_pyproject": _rows("pyproject.toml", "python", 3, [("django", "'^' || c_nationkey", "false"), ("sqlalchemy", ">=2", "false")]),
    "dep_csproj": _rows("app.csproj", "csharp", 4, [("microsoft.aspnetcore.app", "7", "false"), ("dapper", "NK", "false")]),
}
DEP_FN = {"dep_package_json": dp.package_json, "dep_composer": dp.composer_json, "dep_requirements": dp.requirements_txt, "dep_pyproject": dp.pyproject_toml, "dep_csproj": dp.csproj}
for key, text in DEP_SQL.items():
    register(key, lambda s, d, key=key: DEP_FN[key](manifests(s, d)).select(*dp.OUT), text)
INV = "inv AS (" + " UNION ALL ".join(DEP_SQL.values()) + ")"
register("dep_frameworks", lambda s, d: dp.frameworks(dp.inventory(manifests(s, d))),
         f"""WITH {INV} SELECT DISTINCT repo_id, path, fw AS framework FROM inv JOIN (VALUES ('express', 'express'), ('@nestjs/core', 'nestjs'), ('laravel/framework', 'laravel'), ('flask', 'flask'), ('pyjwt', 'pyjwt'), ('django', 'django'), ('sqlalchemy', 'sqlalchemy'), ('microsoft.aspnetcore.app', 'aspnetcore')) m(n, fw) ON name = n""")
register("dep_rollup", lambda s, d: dp.rollup(dp.inventory(manifests(s, d))).withColumn("languages", F.array_join("languages", ",")),
         f"WITH {INV} SELECT repo_id, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, count(DISTINCT path) AS manifests, count(DISTINCT language || ':' || name) AS dependencies FROM inv GROUP BY 1")


def _dep_changed(s, d):
    new = dp.inventory(manifests(s, d))
    n = F.substring("repo_id", 2, 9).cast("int")
    old = new.withColumn("version", F.when((n % 4 == 0) & (F.col("name") == "express"), F.lit("old")).otherwise(F.col("version"))).where(n % 9 != 1)
    return dp.changed(old, new)


register("dep_changed", _dep_changed,
         f"WITH {INV} SELECT repo_id, bool_or(name = 'express') AND CAST(substring(repo_id, 2) AS INT) % 4 = 0 OR CAST(substring(repo_id, 2) AS INT) % 9 = 1 AS changed FROM inv GROUP BY repo_id")

# ------------------------------------------------------------------ queue
QAS = "2024-02-05 00:00:00"
Q = lambda s, d: fx.delivery_queue(s, d)
STALE_SQL = "st AS (SELECT *, CASE WHEN attempts >= 10 AND ts < TIMESTAMP '2024-02-05' - INTERVAL 30 DAYS THEN 'both' WHEN attempts >= 10 THEN 'attempts' WHEN ts < TIMESTAMP '2024-02-05' - INTERVAL 30 DAYS THEN 'age' END AS reason FROM delivery_queue)"
register("queue_stale", lambda s, d: qu.with_staleness(Q(s, d), QAS).select("id", "reason", "stale", "auth_blocked"),
         sql("delivery_queue", "SELECT id, reason, reason IS NOT NULL AS stale, coalesce(last_error = 'auth', false) AS auth_blocked FROM st", STALE_SQL))


def _queue_batches(s, d):
    b = qu.batches(Q(s, d), QAS).groupBy("repo_id").agg(F.sum("n").alias("n"), F.sum(F.size("entries")).alias("packed"))
    return b.crossJoin(F.broadcast(qu.unattributed(Q(s, d), QAS)))


register("queue_batches", _queue_batches,
         sql("delivery_queue", "SELECT repo_id, count(*) AS n, count(*) AS packed, (SELECT count(*) FROM st WHERE reason IS NULL AND repo_id IS NULL) AS dropped FROM st WHERE reason IS NULL AND repo_id IS NOT NULL GROUP BY 1", STALE_SQL))
CODES = [200, 503, 401, 413, 500, None, 204, 403, 503, 429]


def responses(s, d):
    n = F.col("n_nationkey")
    code = F.element_at(F.lit([-1 if c is None else c for c in CODES]), (n % len(CODES) + 1).cast("int"))
    return fx.table(s, d, "nation").where("n_nationkey between 1 and 17").select(F.concat(F.lit("r"), n.cast("string")).alias("repo_id"), F.when(code > 0, code).alias("code"), (n % 10 == 8).alias("license_invalid"))


RESP = "resp AS (SELECT 'r' || n_nationkey AS repo_id, ([200, 503, 401, 413, 500, NULL, 204, 403, 503, 429])[n_nationkey % 10 + 1] AS code, n_nationkey % 10 = 8 AS lic FROM nation WHERE n_nationkey BETWEEN 1 AND 17)"
register("queue_dispose", lambda s, d: qu.dispose(Q(s, d), responses(s, d), QAS).select("id", "attempts", "last_error"),
         sql("delivery_queue", """SELECT id, CASE WHEN reason IS NULL AND code IN (500, 429) THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN reason IS NULL AND code IN (401, 403) THEN 'auth' WHEN reason IS NULL AND code IN (500, 429) THEN NULL ELSE last_error END AS last_error
    FROM st LEFT JOIN resp USING (repo_id) WHERE reason IS NOT NULL OR (repo_id IS NOT NULL AND coalesce(code, 0) NOT IN (200, 204, 413))""", STALE_SQL, RESP))
register("queue_status", lambda s, d: qu.worst_status(responses(s, d)).unionByName(qu.worst_status(responses(s, d).where("code < 400 or code = 503"))),
         "SELECT 'rejected' AS status UNION ALL SELECT 'license_invalid'")
register("queue_health", lambda s, d: qu.health(Q(s, d), QAS),
         sql("delivery_queue", "SELECT count(*) FILTER (reason IS NULL) AS pending, count(reason) AS stale, min(ts) FILTER (attempts < 10) < TIMESTAMP '2024-02-05' - INTERVAL 7 DAYS AS past_grace FROM st", STALE_SQL))
register("queue_purge", lambda s, d: qu.purge(Q(s, d), QAS).select("id"), sql("delivery_queue", "SELECT id FROM st WHERE reason IS NULL", STALE_SQL))
register("queue_reset", lambda s, d: qu.reset(Q(s, d)).groupBy("attempts", "last_error").agg(F.count(F.lit(1)).alias("n")).crossJoin(qu.reset_report(Q(s, d), QAS)),
         sql("delivery_queue", "SELECT 0 AS attempts, NULL AS last_error, count(*) AS n, count(*) AS total, count(reason) AS were_stale, count(*) FILTER (reason IN ('age', 'both')) AS age_stale_remaining FROM st", STALE_SQL))
