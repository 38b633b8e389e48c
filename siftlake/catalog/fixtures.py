"""Domain tables derived from the given parquet tables, in Spark and as SQL text.

Every derivation is deterministic and grows with its source table, so the operators run on all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlake.sources.files import balanced

DIRS = ["src", "lib", "tests", "vendor", "dist", "fixtures", "docs", "config"]
DIR_TYPES = ["source", "source", "test", "vendor", "generated", "fixture", "docs", "config"]
DOC_EXTS = ["js", "py", "php", "json", "log", "env"]
CODE_EXTS = ["js", "ts", "py", "php", "cs", "sql", "sh", "xml", "ps1", "bat", "ini", "rb"]
SEVERITY_CYCLE = ["CRITICAL", "HIGH", "MEDIUM", "EXPOSURE", "LOW"]
CATEGORIES = [
    "Injection (OWASP A03)", "Broken Access Control (OWASP A01)", "Cryptographic Failures (OWASP A02)",
    "Security Misconfiguration (OWASP A05)", "Infrastructure Leakage",
]
N_LINES = 12
AS_OF = "1999-01-01 00:00:00"
EVENTS_AS_OF = "2024-02-01 00:00:00"

# Lines that the generated code files are made of, per extension.
_C_LINES = [
    "let total = base + 1;", "/* start of a note", "   still in the note */", "// plain remark",
    "call(a); // trailing remark", "x = \"http://host/a\";", "/* one line */", "y = 2; /* opens here",
    "closes */ z = 3;", "", "  return total;", "s = 'it /* is' + t;",
]
CODE_LINES = {
    "js": _C_LINES + [
        "const id = req.query.id;", "const { name, role: kind } = req.body;", "//# sourceMappingURL=a.js.map",
        "db.run(\"select \" + id);", "out(`v ${name} w`);", "var q = request.params.q;",
    ],
    "ts": _C_LINES + [
        "const id = req.params['id'];", "let { kind } = req.query;", "//@ directive", "run(\"x\" + id + \"y\");",
    ],
    "py": [
        "x = 1", "\"\"\"one line doc\"\"\"", "\"\"\"open doc", "text with ''' inside", "end doc\"\"\"", "# remark",
        "y = '''data", "'''single", "tail'''", "uid = request.args.get('uid')", "cmd = sys.argv[1]",
        "os.run(\"ls \" + cmd)", "body = request.json['b']", "", "    return x  # note",
    ],
    "php": _C_LINES + [
        "$id = $_GET['id'];", "  $host = $_SERVER['HTTP_HOST'];", "extract($_POST);", "# remark",
        "$n = trim($_POST['n']);", "mysql_query(\"select * from t where a=\" . $id);", "echo \"hi $n\";",
        "exec(\"ls \" . $cmd);", "#$id = $_GET['q'];",
    ],
    "cs": _C_LINES, "sql": ["select 1;", "-- remark", "/* open", "close */", "select a -- tail", "", "update t;"],
    "sh": ["ls -l", "# remark", "export A=1 # tail", "", "echo '# no'"],
    "xml": ["<a>", "<!-- open", "close -->", "<b/> <!-- tail -->", "<c> <!-- opens", "</a>", ""],
    "ps1": ["Get-A", "<# open", "close #>", "# remark", "$x = 1 # tail", ""],
    "bat": ["echo hi", "REM remark", "rem\tx", ":: note", "remark", ""],
    "ini": ["[a]", "; note", "# note", "k = v", "", "k = 'a;b'"],
    "rb": ["x = 1", "=begin", "=end", "# remark", "puts 'a # b'", "y = 2 # tail", ""],
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pick(values, index):
    """values[index] for a 0-based bigint index column."""
    return F.element_at(F.lit(list(values)), (index + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """files(repo_id, path, content) made of documents and pages."""
    return file_rows(table(spark, d, "documents"), table(spark, d, "pages"))


def file_rows(docs: DataFrame, pages: DataFrame) -> DataFrame:
    doc_dir = _pick(DIRS, F.col("doc_id") % 8)
    ext = _pick(DOC_EXTS, F.floor(F.col("doc_id") / 8) % 6)
    part = docs.select(
        F.col("source").alias("repo_id"),
        F.concat(doc_dir, F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"),
        F.col("text").alias("content"),
    )
    pages = pages.select(
        F.lit("pages").alias("repo_id"),
        F.concat(F.lit("web/page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.col("html").alias("content"),
    )
    return part.unionByName(pages)


FILES_SQL = f"""files AS (
  SELECT source AS repo_id, ({_sql_list(DIRS)})[doc_id % 8 + 1] || '/f' || doc_id || '.'
         || ({_sql_list(DOC_EXTS)})[(doc_id // 8) % 6 + 1] AS path, text AS content FROM documents
  UNION ALL SELECT 'pages', 'web/page_' || page_id || '.html', html FROM pages)"""


def code_files(spark: SparkSession, d: str) -> DataFrame:
    """files(repo_id, path, content) of short code texts, one per order.

    The numbers that texts are made of are dealt out by key: orders may lie in one row group, which one task would read, and
    making and matching the texts costs far more than moving two numbers.
    """
    okey = F.col("o_orderkey")
    seed = F.floor(okey / len(CODE_EXTS))
    content = F.lit(None).cast("string")
    for ext, lines in CODE_LINES.items():
        body = F.array_join(
            F.transform(F.sequence(F.lit(1), F.lit(N_LINES)), _line_picker(lines, okey, seed)), "\n"
        )
        content = F.when(F.col("ext") == ext, body).otherwise(content)
    base = table(spark, d, "orders").select("o_orderkey", "o_custkey").repartition("o_orderkey").withColumn(
        "ext", _pick(CODE_EXTS, okey % len(CODE_EXTS))
    )
    return base.select(
        F.concat(F.lit("team"), (F.col("o_custkey") % 50).cast("string")).alias("repo_id"),
        F.concat(
            _pick(DIRS, F.floor(okey / 12) % 8), F.lit("/o"), okey.cast("string"), F.lit("."), F.col("ext")
        ).alias("path"),
        content.alias("content"),
    )


def _line_picker(lines, okey, seed):
    return lambda i: F.element_at(
        F.lit(lines), ((okey * 7 + i * i * 3 + seed * i) % len(lines) + 1).cast("int")
    )


def _code_sql() -> str:
    cases = "\n".join(
        f"WHEN '{ext}' THEN array_to_string(list_transform(range(1, {N_LINES + 1}), lambda i: ({_sql_list(lines)})"
        f"[(o_orderkey * 7 + i * i * 3 + (o_orderkey // {len(CODE_EXTS)}) * i) % {len(lines)} + 1]), chr(10))"
        for ext, lines in CODE_LINES.items()
    )
    return f"""code_files AS (SELECT repo_id, path, CASE ext {cases} END AS content, ext FROM (
  SELECT 'team' || (o_custkey % 50) AS repo_id, o_orderkey, ext,
    ({_sql_list(DIRS)})[(o_orderkey // 12) % 8 + 1] || '/o' || o_orderkey || '.' || ext AS path
  FROM (SELECT *, ({_sql_list(CODE_EXTS)})[o_orderkey % {len(CODE_EXTS)} + 1] AS ext FROM orders)))"""


CODE_SQL = _code_sql()


def line_findings(spark: SparkSession, d: str) -> DataFrame:
    """Raw findings made of lineitem: several rules and severities meet on one line.

    The distinct findings are found on the numbers that all their columns are made of, before any text is.
    """
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    ok, p300 = F.col("l_orderkey"), F.col("p300")
    slot = ok % 8
    raw = F.concat(F.lit("  call("), (p300 % 50).cast("string"), F.lit(")  "))
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return (
        balanced(table(spark, d, "lineitem").select(*keys), *keys)
        .select(
            "l_orderkey", (F.col("l_linenumber") % 4).cast("bigint").alias("line"), (pk * 100000 + sk).alias("off"),
            (pk % 300).alias("p300"), (pk % 7 == 0).alias("tainted"), ((sk + pk) % 5).alias("severity"),
        )
        .distinct()
        .select(
            F.concat(F.lit("r"), (ok % 20).cast("string")).alias("repo_id"),
            F.concat(
                _pick(DIRS, slot), F.lit("/o"), ok.cast("string"), F.lit("."), _pick(DOC_EXTS, F.floor(ok / 8) % 6)
            ).alias("path"),
            "line",
            F.concat(F.lit("R"), (p300 % 12).cast("string")).alias("rule_id"),
            _pick(SEVERITY_CYCLE, F.col("severity")).alias("base_severity"),
            _pick(CATEGORIES, p300 % 12 % 5).alias("category"),
            raw.alias("raw"),
            F.when(F.col("tainted"), F.concat(F.lit("v"), (p300 % 3).cast("string"))).alias("taint_source"),
            (p300 % 12).alias("rule_rank"),
            "off",
            _pick(DIR_TYPES, slot).alias("file_type"),
            F.when((slot == 2) & (ok % 3 == 0), "jest").alias("framework"),
        )
    )


def first_findings(spark: SparkSession, d: str) -> DataFrame:
    """Of the line findings of one rule on one line the one of the least `off`: (repo_id, path, line, rule_id, raw, off, base_severity)."""
    return first_texts(first_numbers(spark, d)).select("repo_id", "path", "line", "rule_id", "raw", "off", "base_severity")


def first_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that first findings are made of: (l_orderkey, line, rule, least).

    The least is found on one number, made of `off` and the remainders that raw line and severity come from.
    """
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    keys = ["l_orderkey", "line", "rule"]
    return (
        table(spark, d, "lineitem")
        .select(
            "l_orderkey", (F.col("l_linenumber") % 4).cast("bigint").alias("line"), (pk % 12).alias("rule"),
            ((pk * 100000 + sk) * 250 + pk % 50 * 5 + (sk + pk) % 5).alias("least"),
        )
        .repartition(*keys)
        .groupBy(*keys)
        .agg(F.min("least").alias("least"))
    )


def first_texts(rows: DataFrame) -> DataFrame:
    """The rows of numbers with the columns of their findings."""
    ok = F.col("l_orderkey")
    off, code = F.floor(F.col("least") / 250), F.col("least") % 250
    return rows.withColumns({
        "repo_id": F.concat(F.lit("r"), (ok % 20).cast("string")),
        "path": F.concat(_pick(DIRS, ok % 8), F.lit("/o"), ok.cast("string"), F.lit("."), _pick(DOC_EXTS, F.floor(ok / 8) % 6)),
        "rule_id": F.concat(F.lit("R"), F.col("rule").cast("string")),
        "raw": F.concat(F.lit("  call("), F.floor(code / 5).cast("string"), F.lit(")  ")),
        "off": off,
        "base_severity": _pick(SEVERITY_CYCLE, code % 5),
    })


LINE_FINDINGS_SQL = f"""line_findings AS (SELECT DISTINCT 'r' || (l_orderkey % 20) AS repo_id,
  ({_sql_list(DIRS)})[l_orderkey % 8 + 1] || '/o' || l_orderkey || '.'
    || ({_sql_list(DOC_EXTS)})[(l_orderkey // 8) % 6 + 1] AS path,
  (l_linenumber % 4)::BIGINT AS line, 'R' || (l_partkey % 12) AS rule_id,
  ({_sql_list(SEVERITY_CYCLE)})[(l_suppkey + l_partkey) % 5 + 1] AS base_severity,
  ({_sql_list(CATEGORIES)})[l_partkey % 12 % 5 + 1] AS category,
  '  call(' || (l_partkey % 50) || ')  ' AS raw,
  CASE WHEN l_partkey % 7 = 0 THEN 'v' || (l_partkey % 3) END AS taint_source,
  l_partkey % 12 AS rule_rank, l_partkey * 100000 + l_suppkey AS off,
  ({_sql_list(DIR_TYPES)})[l_orderkey % 8 + 1] AS file_type,
  CASE WHEN l_orderkey % 8 = 2 AND l_orderkey % 3 = 0 THEN 'jest' END AS framework
  FROM lineitem)"""


def audit_events(spark: SparkSession, d: str) -> DataFrame:
    """Event log made of the events table."""
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = (
        F.when(F.col("event_type") == "error", "finding_blocked")
        .when(F.col("event_type") == "click", "finding_warned")
        .when(F.col("event_type") == "signup", "finding_excepted")
        .when(F.col("event_type") == "view", "scan_started")
        .otherwise("scan_blocked")
    )
    v, user = F.col("value"), F.col("user_id").cast("string")
    return ev.select(
        F.col("event_id").alias("seq"),
        "ts",
        kind.alias("event"),
        F.concat(F.lit("u"), user).alias("git_user"),
        F.concat(F.lit("R"), (k % 12).cast("string")).alias("rule_id"),
        F.concat(F.lit("C"), (k % 7).cast("string")).alias("category"),
        F.concat(F.lit("f"), (F.col("event_id") % 40).cast("string")).alias("file"),
        (k + 1).alias("line"),
        F.when(v >= 300, "CRITICAL").when(v >= 150, "HIGH").when(v >= 50, "MEDIUM").otherwise("EXPOSURE").alias(
            "severity"
        ),
        F.concat(F.lit("s"), user, F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.when(k % 9 != 0, F.concat(F.lit("h"), k.cast("string"))).alias("code_hash"),
        F.when(k % 10 == 0, F.concat(F.lit("lead"), (k % 4).cast("string"))).alias("exception_by"),
        F.lit("manual").alias("hook"),
    )


EVENTS_SQL = """audit_events AS (SELECT event_id AS seq, ts,
  CASE event_type WHEN 'error' THEN 'finding_blocked' WHEN 'click' THEN 'finding_warned'
    WHEN 'signup' THEN 'finding_excepted' WHEN 'view' THEN 'scan_started' ELSE 'scan_blocked' END AS event,
  'u' || user_id AS git_user, 'R' || (k % 12) AS rule_id, 'C' || (k % 7) AS category,
  'f' || (event_id % 40) AS file, k + 1 AS line,
  CASE WHEN value >= 300 THEN 'CRITICAL' WHEN value >= 150 THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM'
    ELSE 'EXPOSURE' END AS severity,
  's' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
  CASE WHEN k % 9 <> 0 THEN 'h' || k END AS code_hash,
  CASE WHEN k % 10 = 0 THEN 'lead' || (k % 4) END AS exception_by, 'manual' AS hook
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _keyed_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("sk"), F.min("l_returnflag").alias("rf"),
            F.count(F.lit(1)).alias("dup"),
        )
        .withColumn(
            "finding_id", F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        )
    )


KEYED_SQL = """keyed AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk, min(l_suppkey) AS sk,
  min(l_returnflag) AS rf, count(*) AS dup, l_orderkey || '-' || l_linenumber AS finding_id
  FROM lineitem GROUP BY ALL)"""


def finding_state(spark: SparkSession, d: str) -> DataFrame:
    """Stored findings: three quarters of the keyed lines, some resolved, some of a foreign status."""
    status = F.when(F.col("rf") == "R", "resolved").when(F.col("sk") % 31 == 0, "parked").otherwise("open")
    return _keyed_lineitem(spark, d).where(F.col("pk") % 4 != 0).select(
        F.concat(F.lit("r"), (F.col("l_orderkey") % 20).cast("string")).alias("repo_id"),
        "finding_id",
        F.concat(F.lit("R"), (F.col("sk") % 12).cast("string")).alias("rule_id"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("path"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.concat(F.lit("h"), (F.col("pk") % 100).cast("string")).alias("code_hash"),
        status.alias("status"),
        _pick(SEVERITY_CYCLE, F.col("sk") % 5).alias("severity"),
        _pick(SEVERITY_CYCLE, F.col("sk") % 5).alias("base_severity"),
        F.lit("1998-01-01T00:00:00Z").alias("first_seen"),
        F.concat(F.lit("1998-0"), (F.col("pk") % 9 + 1).cast("string"), F.lit("-01T00:00:00Z")).alias("last_seen"),
        F.lit("scan-0").alias("last_scan_id"),
        F.col("dup").alias("times_seen"),
        (F.col("sk") % 2).alias("reopen_count"),
        F.concat(F.lit("old "), F.col("finding_id")).alias("snippet"),
        F.when(status == "resolved", F.lit("1998-06-01T00:00:00Z")).alias("resolved_at"),
        F.create_map(F.lit("note"), F.concat(F.lit("n"), F.col("finding_id"))).alias("extras"),
    )


STATE_SQL = f"""finding_state AS (SELECT 'r' || (l_orderkey % 20) AS repo_id, finding_id,
  'R' || (sk % 12) AS rule_id, 'o' || l_orderkey AS path, l_linenumber::BIGINT AS line,
  'h' || (pk % 100) AS code_hash,
  CASE WHEN rf = 'R' THEN 'resolved' WHEN sk % 31 = 0 THEN 'parked' ELSE 'open' END AS status,
  ({_sql_list(SEVERITY_CYCLE)})[sk % 5 + 1] AS severity, ({_sql_list(SEVERITY_CYCLE)})[sk % 5 + 1] AS base_severity,
  '1998-01-01T00:00:00Z' AS first_seen, '1998-0' || (pk % 9 + 1) || '-01T00:00:00Z' AS last_seen,
  'scan-0' AS last_scan_id, dup AS times_seen, sk % 2 AS reopen_count, 'old ' || finding_id AS snippet,
  CASE WHEN rf = 'R' THEN '1998-06-01T00:00:00Z' END AS resolved_at
  FROM keyed WHERE pk % 4 <> 0)"""


def scan_rows(spark: SparkSession, d: str) -> DataFrame:
    """Findings reported by one scan, repeated identities included, in base form for reconciliation."""
    li = table(spark, d, "lineitem")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")
    keyed = _keyed_lineitem(spark, d).select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), F.col("pk").alias("kpk"),
        F.col("sk").alias("ksk"),
    )
    joined = li.join(keyed, (ok == F.col("k1")) & (ln == F.col("k2"))).where(F.col("kpk") % 4 != 1)
    return joined.select(
        F.concat(F.lit("r"), (ok % 20).cast("string")).alias("repo_id"),
        F.concat(ok.cast("string"), F.lit("-"), ln.cast("string")).alias("finding_id"),
        F.concat(F.lit("R"), (F.col("ksk") % 12).cast("string")).alias("rule_id"),
        F.concat(F.lit("o"), ok.cast("string")).alias("path"),
        (F.col("l_quantity").cast("bigint") * 100 + ln).alias("line"),
        F.when(pk % 50 != 0, F.concat(F.lit("h"), (pk % 100).cast("string"))).alias("code_hash"),
        _pick(SEVERITY_CYCLE, F.col("ksk") % 5).alias("severity"),
        _pick(SEVERITY_CYCLE, F.col("ksk") % 5).alias("base_severity"),
        F.concat(F.lit("new "), ok.cast("string"), F.lit("-"), ln.cast("string")).alias("snippet"),
        F.lit("HIGH").alias("confidence"),
        (F.col("ksk") % 10 == 0).alias("suppressed"),
        (pk * 1000000 + sk * 1000 + (F.col("l_discount") * 100).cast("bigint")).alias("ord"),
    )


SCAN_ROWS_SQL = f"""scan_rows AS (SELECT 'r' || (l.l_orderkey % 20) AS repo_id,
  l.l_orderkey || '-' || l.l_linenumber AS finding_id, 'R' || (k.sk % 12) AS rule_id,
  'o' || l.l_orderkey AS path, CAST(l.l_quantity AS BIGINT) * 100 + l.l_linenumber AS line,
  CASE WHEN l.l_partkey % 50 <> 0 THEN 'h' || (l.l_partkey % 100) END AS code_hash,
  ({_sql_list(SEVERITY_CYCLE)})[k.sk % 5 + 1] AS severity, ({_sql_list(SEVERITY_CYCLE)})[k.sk % 5 + 1] AS base_severity,
  'new ' || l.l_orderkey || '-' || l.l_linenumber AS snippet, 'HIGH' AS confidence, k.sk % 10 = 0 AS suppressed,
  l.l_partkey * 1000000 + l.l_suppkey * 1000 + CAST(floor(l.l_discount * 100) AS BIGINT) AS ord
  FROM lineitem l JOIN keyed k ON l.l_orderkey = k.l_orderkey AND l.l_linenumber = k.l_linenumber
  WHERE k.pk % 4 <> 1)"""


def coverage_files(spark: SparkSession, d: str) -> DataFrame:
    """coverage(repo_id, path, rule_domain): four fifths of the orders were scanned."""
    ok = F.col("o_orderkey")
    return table(spark, d, "orders").where(ok % 5 != 0).select(
        F.concat(F.lit("r"), (ok % 20).cast("string")).alias("repo_id"),
        F.concat(F.lit("o"), ok.cast("string")).alias("path"), F.lit("all").alias("rule_domain"),
    )


COVERAGE_SQL = """coverage AS (SELECT 'r' || (o_orderkey % 20) AS repo_id, 'o' || o_orderkey AS path,
  'all' AS rule_domain FROM orders WHERE o_orderkey % 5 <> 0)"""


def registry_rules(spark: SparkSession, d: str) -> DataFrame:
    """rules(rule_id, pack): the twelve fixture rules, taken from part; R3 belongs to the secrets pack."""
    rid = (F.col("p_partkey") % 12).cast("string")
    return table(spark, d, "part").where(F.col("p_partkey") % 12 != 11).select(
        F.concat(F.lit("R"), rid).alias("rule_id"), F.when(rid == "3", "secrets").otherwise("code").alias("pack")
    ).distinct()


REGISTRY_SQL = """registry AS (SELECT DISTINCT 'R' || (p_partkey % 12) AS rule_id,
  CASE WHEN p_partkey % 12 = 3 THEN 'secrets' ELSE 'code' END AS pack FROM part WHERE p_partkey % 12 <> 11)"""


def exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Risk acceptances made of orders: one per order, list order = order key."""
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    ts = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    expires = F.when(ck % 30 == 0, "not a date").when(
        ck % 3 == 0, ts(F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    )
    return table(spark, d, "orders").select(
        F.concat(F.lit("r"), (ok % 20).cast("string")).alias("repo_id"),
        F.concat(F.lit("exc-"), ok.cast("string")).alias("id"),
        ok.alias("exc_ord"),
        F.lit("exception").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise(
            "pending"
        ).alias("status"),
        F.concat(F.lit("R"), (ck % 12).cast("string")).alias("rule_id"),
        F.concat(_pick(DIRS, ok % 8), F.lit("/o"), ok.cast("string"), F.lit("."), _pick(DOC_EXTS, F.floor(ok / 8) % 6)).alias(
            "path"
        ),
        F.when(ck % 4 != 0, ck % 4).alias("line"),
        F.when(
            ok % 2 == 0,
            F.substring(F.sha2(F.concat(F.lit("  call("), (ck % 50).cast("string"), F.lit(")  ")), 256), 1, 32),
        ).when(
            ok % 3 == 0,
            F.substring(F.sha2(F.concat(F.lit("  call("), (ck % 50).cast("string"), F.lit(")  ")), 256), 1, 16),
        ).alias("line_hash"),
        F.when(ok % 10 == 1, F.lit(1).cast("bigint")).alias("range_from"),
        F.when(ok % 10 == 1, F.lit(2).cast("bigint")).alias("range_to"),
        ts(F.col("o_orderdate")).alias("created_at"),
        expires.alias("expires"),
        F.when(ck % 17 == 0, F.lit("1998-12-01T00:00:00Z")).alias("archived_at"),
        F.when(ck % 17 == 0, "withdrawn").alias("archive_reason"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("lead"), (ck % 3).cast("string"))).alias("reviewed_by"),
        F.col("o_orderpriority").alias("reason"),
        F.when(ok % 5 == 0, F.lit("seen")).alias("review_comment"),
    )


EXCEPTIONS_SQL = f"""exceptions AS (SELECT 'r' || (o_orderkey % 20) AS repo_id, 'exc-' || o_orderkey AS id,
  o_orderkey AS exc_ord, 'exception' AS type,
  CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status,
  'R' || (o_custkey % 12) AS rule_id,
  ({_sql_list(DIRS)})[o_orderkey % 8 + 1] || '/o' || o_orderkey || '.'
    || ({_sql_list(DOC_EXTS)})[(o_orderkey // 8) % 6 + 1] AS path,
  CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 4 END AS line,
  CASE WHEN o_orderkey % 2 = 0 THEN substring(sha256('  call(' || (o_custkey % 50) || ')  '), 1, 32)
    WHEN o_orderkey % 3 = 0 THEN substring(sha256('  call(' || (o_custkey % 50) || ')  '), 1, 16) END AS line_hash,
  CASE WHEN o_orderkey % 10 = 1 THEN 1::BIGINT END AS range_from,
  CASE WHEN o_orderkey % 10 = 1 THEN 2::BIGINT END AS range_to,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  CASE WHEN o_custkey % 30 = 0 THEN 'not a date' WHEN o_custkey % 3 = 0
    THEN strftime(o_orderdate + INTERVAL 90 DAYS, '%Y-%m-%dT%H:%M:%SZ') END AS expires,
  CASE WHEN o_custkey % 17 = 0 THEN '1998-12-01T00:00:00Z' END AS archived_at,
  CASE WHEN o_custkey % 17 = 0 THEN 'withdrawn' END AS archive_reason,
  CASE WHEN o_orderstatus = 'P' THEN 'lead' || (o_custkey % 3) END AS reviewed_by, o_orderpriority AS reason,
  CASE WHEN o_orderkey % 5 = 0 THEN 'seen' END AS review_comment FROM orders)"""


def delivery_queue(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), "ts",
        (k % 13).alias("attempts"),
        F.when(F.col("user_id") % 20 != 0, F.concat(F.lit("r"), (F.col("user_id") % 20).cast("string"))).alias("repo_id"),
        F.col("event_type").alias("payload"),
        F.when(k % 11 == 0, "auth").alias("last_error"),
    )


QUEUE_SQL = """delivery_queue AS (SELECT 'q' || event_id AS id, event_id AS seq, ts, k % 13 AS attempts,
  CASE WHEN user_id % 20 <> 0 THEN 'r' || (user_id % 20) END AS repo_id, event_type AS payload,
  CASE WHEN k % 11 = 0 THEN 'auth' END AS last_error
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""

CTES = {
    "files": FILES_SQL, "code_files": CODE_SQL, "line_findings": LINE_FINDINGS_SQL, "audit_events": EVENTS_SQL,
    "keyed": KEYED_SQL, "finding_state": STATE_SQL, "scan_rows": SCAN_ROWS_SQL, "coverage": COVERAGE_SQL,
    "registry": REGISTRY_SQL, "exceptions": EXCEPTIONS_SQL, "delivery_queue": QUEUE_SQL,
}


def sql(names: str, body: str, *more: str) -> str:
    """`WITH` the named fixtures and further CTE texts, then the body."""
    ctes = [CTES[n] for n in names.split()] + list(more)
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
