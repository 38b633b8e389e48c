"""Report aggregates over findings, and the JSON and Markdown documents built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from siftlake.functions import severity as sev
from siftlake.functions.exprs import round_half_up
from siftlake.functions.paths import basename

# The ten categories of the 2021 list.
OWASP = [
    ("A01", "Broken Access Control"), ("A02", "Cryptographic Failures"), ("A03", "Injection"),
    ("A04", "Insecure Design"), ("A05", "Security Misconfiguration"), ("A06", "Vulnerable Components"),
    ("A07", "Auth Failures"), ("A08", "Integrity Failures"), ("A09", "Logging Failures"), ("A10", "SSRF"),
]
EXPORT_CONTEXT, REVIEW_CONTEXT, REVIEW_WARN = 5, 8, 20
LINGER_DAYS = 30


def risk_score(findings: DataFrame, by: str = "repo_id") -> DataFrame:
    """(repo, findings, risk_score, risk_label): mean weight x 5, at most 100."""
    g = findings.groupBy(by).agg(
        F.count(F.lit(1)).alias("findings"), F.sum(sev.weight(F.col("severity"))).alias("_w")
    )
    score = F.least(F.lit(100).cast("bigint"), round_half_up(F.col("_w") / F.col("findings") * 5))
    return g.select(by, "findings", score.alias("risk_score"), risk_label(score).alias("risk_label"))


def risk_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL").when(score >= 55, "HIGH").when(score >= 30, "MEDIUM")
        .when(score >= 10, "LOW").otherwise("MINIMAL")
    )


def by_severity(findings: DataFrame) -> DataFrame:
    """All five severities with their counts, zero-filled."""
    dim = findings.sparkSession.createDataFrame(list(enumerate(sev.ORDER)), "rank int, severity string")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return dim.join(counts, "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("count"))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.coalesce("category", F.lit("Unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("count")
    )


def severity_and_category(findings: DataFrame) -> DataFrame:
    """Both breakdowns out of one pass over the findings: (kind, value, count)."""
    f = findings.select("severity", F.coalesce("category", F.lit("Unknown")).alias("category"))
    g = f.groupingSets([["severity"], ["category"]], "severity", "category").agg(
        F.count(F.lit(1)).alias("count"), F.grouping("severity").alias("_g")
    )
    is_cat = F.col("_g") == 1
    return g.select(
        F.when(is_cat, "category").otherwise("severity").alias("kind"),
        F.when(is_cat, F.col("category")).otherwise(F.col("severity")).alias("value"), "count",
    )


def checklist(findings: DataFrame) -> DataFrame:
    """One row per rule with its worst severity and number of occurrences, worst first."""
    known = findings.where(F.col("severity").isin(sev.ORDER))
    total = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("occurrences"))
    worst = known.groupBy("rule_id").agg(
        F.min(sev.rank(F.col("severity"))).alias("_r"), F.min_by("category", "off").alias("category")
    )
    return (
        worst.join(total, "rule_id")
        .select("rule_id", F.element_at(F.lit(sev.ORDER), F.col("_r") + 1).alias("severity"), "category", "occurrences")
        .orderBy(sev.rank(F.col("severity")), "rule_id")
    )


def owasp_id(category: Column) -> Column:
    return F.nullif(F.regexp_extract(category, r"(A(?:0[1-9]|10))", 1), F.lit(""))


def owasp_coverage(findings: DataFrame) -> DataFrame:
    """The ten categories with a flag and the number of findings."""
    dim = findings.sparkSession.createDataFrame(OWASP, "id string, name string")
    n = findings.groupBy(owasp_id(F.col("category")).alias("id")).agg(F.count(F.lit(1)).alias("findings"))
    return dim.join(n, "id", "left").select(
        "id", "name", F.coalesce("findings", F.lit(0)).alias("findings"), F.col("findings").isNotNull().alias("hit")
    )


def remediation(findings: DataFrame, n: int = 20) -> DataFrame:
    """Open findings per rule, worst first: count, number of files, up to three file names, OWASP id.

    Files are counted with a distinct count and only three names are kept per rule, so a rule with very
    many files never gathers their list in one place.
    """
    open_ = findings.where(~F.col("excepted"))
    pairs = open_.groupBy("rule_id", "repo_id", "path").agg(
        F.count(F.lit(1)).alias("_n"), F.min("off").alias("_off"), F.min_by("severity", "off").alias("_sev"),
        F.min_by("category", "off").alias("_cat"),
    )
    g = pairs.groupBy("rule_id").agg(
        F.sum("_n").alias("count"), F.count(F.lit(1)).alias("files"), F.min_by("_sev", "_off").alias("severity"),
        F.min_by("_cat", "_off").alias("category"),
    )
    firsts = _first_values(pairs.select("rule_id", basename(F.col("path")).alias("v"), F.struct("_off", "repo_id", "path").alias("o")), "rule_id", 3)
    return (
        g.join(firsts, "rule_id", "left")
        .select(
            "rule_id", "severity", "count", "files", F.array_join("values", " ").alias("first_files"),
            F.greatest(F.col("files") - 3, F.lit(0)).alias("more_files"), owasp_id(F.col("category")).alias("owasp"),
        )
        .orderBy(sev.rank(F.col("severity")), F.desc("count"), "rule_id").limit(n)
    )


def _first_values(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, values): the first n values of `v` per key by order `o`.

    Per-key ranking is done in salted groups first, so each task keeps n rows of its share of a hot key;
    the second ranking sees only those.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("o"), F.lit(64)))
    part = W.partitionBy(key, "_salt").orderBy("o")
    best = salted.withColumn("_k", F.row_number().over(part)).where(F.col("_k") <= n)
    top = best.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("o"))).where(F.col("_k") <= n)
    return top.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("values")
    )


UNIQUE = ["repo_id", "path", "line", "rule_id"]


def partition_findings(findings: DataFrame) -> DataFrame:
    """First finding per (rule, file, line) with `section`: excepted, rejected, exposure or active."""
    one = findings.groupBy(*UNIQUE).agg(
        F.min_by(F.struct("severity", "excepted", "exception_rejected", "confidence", "taint_source"), "off").alias("x")
    ).select(*UNIQUE, "x.*")
    section = (
        F.when(F.col("excepted"), "excepted").when(F.col("exception_rejected"), "rejected")
        .when(F.col("severity") == "EXPOSURE", "exposure").otherwise("active")
    )
    return one.withColumn("section", section)


def top_issues(findings: DataFrame, n: int = 8) -> DataFrame:
    return (
        findings.where(~F.col("excepted")).groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("count"), F.min_by("severity", "off").alias("severity"))
        .orderBy(sev.rank(F.col("severity")), F.desc("count"), "rule_id").limit(n)
    )


def top_files(findings: DataFrame, n: int = 5, lines: int = 8) -> DataFrame:
    """Files by worst severity, then count, with up to eight distinct line numbers in order."""
    open_ = findings.where(~F.col("excepted"))
    g = open_.groupBy("repo_id", "path").agg(
        F.min(sev.rank(F.col("severity"))).alias("worst"), F.count(F.lit(1)).alias("count")
    ).orderBy("worst", F.desc("count"), "repo_id", "path").limit(n)
    # Line numbers are gathered for the chosen files only.
    nums = open_.join(F.broadcast(g.select("repo_id", "path")), ["repo_id", "path"]).where("line > 0").groupBy(
        "repo_id", "path"
    ).agg(F.array_sort(F.collect_set("line")).alias("_l"))
    return g.join(nums, ["repo_id", "path"], "left").select(
        "repo_id", "path", "worst", "count", F.slice(F.coalesce("_l", F.array().cast("array<bigint>")), 1, lines).alias("lines"),
        (F.coalesce(F.size("_l"), F.lit(0)) > lines).alias("more"),
    )


def low_confidence(findings: DataFrame) -> DataFrame:
    """(severity, count, low, tainted) over open findings."""
    return findings.where(~F.col("excepted")).groupBy("severity").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("confidence") == "LOW").alias("low"),
        F.count_if(F.col("taint_source").isNotNull()).alias("tainted"),
    )


def findings_view(findings: DataFrame, view: str = "open", by_file: bool = False) -> DataFrame:
    """open / all / excepted / suppressed findings, ordered by severity or grouped by file (worst first)."""
    conds = {
        "open": ~F.col("suppressed") & ~F.col("excepted"), "all": ~F.col("suppressed"),
        "excepted": ~F.col("suppressed") & F.col("excepted"), "suppressed": F.col("suppressed"),
    }
    if view not in conds:
        raise ValueError(f"view must be one of {sorted(conds)}")
    out = findings.where(conds[view]).withColumn("rank", sev.rank(F.col("severity")))
    if not by_file:
        return out.orderBy("rank", "repo_id", "path", "line", "off")
    worst = out.groupBy("repo_id", "path").agg(F.min("rank").alias("file_rank"))
    return out.join(worst, ["repo_id", "path"]).orderBy("file_rank", "repo_id", "path", "rank", "line", "off")


def churn(state: DataFrame, as_of: str) -> DataFrame:
    """times_seen, days since first seen, and whether a finding has lingered for more than 30 days."""
    secs = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - F.unix_timestamp(F.to_timestamp("first_seen"))
    return state.select(
        "repo_id", "finding_id", F.greatest("times_seen", F.lit(1).cast("bigint")).alias("times_seen"),
        F.floor(secs / 86400).alias("age_days"), (secs > LINGER_DAYS * 86400).alias("lingering"),
    )


def hydrate(state: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Join rule name and text to stored findings; the join strategy follows the rule table's size."""
    return state.join(rule_table, "rule_id", "left")


def context_slice(lines: Column, line: Column, around: int) -> Column:
    """`n: text` for the lines around one line, clipped to the file."""
    start = F.greatest(line - around - 1, F.lit(0)).cast("int")
    end = F.least(F.size(lines), line + around).cast("int")
    return F.when(
        end > start,
        F.transform(
            F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))),
            lambda text, i: F.concat((start + i + 1).cast("string"), F.lit(": "), text),
        ),
    ).otherwise(F.array().cast("array<string>"))


def with_context(findings: DataFrame, files: DataFrame, around: int = EXPORT_CONTEXT) -> DataFrame:
    """(repo_id, path, line, context) for each distinct finding line.

    Lines are gathered per file first (at most as many as the file has), so each text is moved once and
    sliced in its own row; lines are never exploded and joined by range.
    """
    wanted = findings.groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("line")).alias("_want"))
    j = files.join(wanted, ["repo_id", "path"]).withColumn("_lines", F.split("content", "\n"))
    rows = F.transform(
        "_want", lambda n: F.struct(n.alias("line"), context_slice(F.col("_lines"), n, around).alias("context"))
    )
    return j.select("repo_id", "path", F.inline(rows))


def review_payload(findings: DataFrame, files: DataFrame) -> DataFrame:
    """CRITICAL and HIGH findings with eight lines of context either side."""
    eligible = findings.where(F.col("severity").isin("CRITICAL", "HIGH"))
    ctx = with_context(eligible, files, REVIEW_CONTEXT)
    return eligible.join(ctx, ["repo_id", "path", "line"], "left").withColumn(
        "context", F.coalesce(F.array_join("context", "\n"), F.lit("(source not available)"))
    )


def review_warning(findings: DataFrame) -> DataFrame:
    """(repo_id, eligible, large) with large when more than 20 findings would be reviewed."""
    n = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    return findings.groupBy("repo_id").agg(n.alias("eligible"), (n > REVIEW_WARN).alias("large"))


def md_escape(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}]", "")
    return F.regexp_replace(plain, r"([`*_\[\]<>|\\])", r"\\$1")


FINDING_FIELDS = {
    "findingId": "finding_id", "ruleId": "rule_id", "severity": "severity", "name": "name", "category": "category", "filePath": "path", "line": "line",
    "match": "snippet", "why": "why", "scenario": "scenario", "fix": "fix", "excepted": "excepted", "codeHash": "code_hash",
}
SCAN_FIELDS = {"scanDate": "scan_date", "target": "target", "totalFiles": "total_files", "skippedFiles": "skipped"}
MEANING = {
    "CRITICAL": "Can be exploited as it is", "HIGH": "Likely to be exploited", "MEDIUM": "A weakness to plan for", "EXPOSURE": "Tells outsiders more than they need", "INFO": "For information",
}


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string").alias(name)


def _json_rows(df: DataFrame, section: str, order: Column, **fields: Column) -> DataFrame:
    body = F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})
    return df.select("repo_id", F.lit(section).alias("section"), order.cast("string").alias("ord"), body.alias("json"))


def _summary(findings: DataFrame) -> DataFrame:
    """Per repository: findings, risk, a count for each severity, and the categories, most frequent first."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in sev.ORDER]
    named = findings.groupBy("repo_id", F.coalesce("category", F.lit("Unknown")).alias("category")).agg(F.count(F.lit(1)).alias("count"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "category"))), lambda x: F.struct(x["category"].alias("category"), (-x["n"]).alias("count")))
    return risk_score(findings).join(findings.groupBy("repo_id").agg(*counts), "repo_id").join(named.groupBy("repo_id").agg(pairs.alias("categories")), "repo_id")


def _items(findings: DataFrame) -> DataFrame:
    """The checklist of each repository: one row per rule with its worst severity, first name and category, all occurrences."""
    r = sev.rank(F.col("severity"))
    order = F.struct(r, F.col("off"))
    return findings.groupBy("repo_id", "rule_id").agg(
        F.min(r).alias("r"), F.min_by(_optional(findings, "name"), order).alias("name"), F.min_by("category", order).alias("category"), F.count(F.lit(1)).alias("occurrences"),
    ).where(F.col("r") < len(sev.ORDER)).withColumn("severity", F.element_at(F.lit(sev.ORDER), F.col("r") + 1))


def report_json(findings: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Rows (repo_id, section, ord, json): meta, summary, findings and checklist of each repository.

    The document is written as JSON lines: a repository of any size stays spread over tasks, and each
    line is a complete JSON value. scans(repo_id, scan_date, target, total_files, skipped) gives the meta lines.
    """
    total = _summary(findings)
    rows = _json_rows(
        total, "summary", F.lit("0"), riskScore=F.col("risk_score"), riskLabel=F.col("risk_label"), totalFindings=F.col("findings"),
        bySeverity=F.struct(*sev.ORDER), byCategory=F.col("categories"),
    )
    detail = _json_rows(findings, "finding", F.col("off"), **{k: _optional(findings, c) for k, c in FINDING_FIELDS.items()})
    todo = _items(findings)
    todo = _json_rows(todo, "checklist", F.concat(F.col("r").cast("string"), F.col("rule_id")), ruleId=F.col("rule_id"), severity=F.col("severity"), name=F.col("name"),
                      category=F.col("category"), occurrences=F.col("occurrences"), resolved=F.lit(False))
    out = rows.unionByName(detail).unionByName(todo)
    if scans is not None:
        out = out.unionByName(_json_rows(scans, "meta", F.lit("0"), **{k: _optional(scans, c) for k, c in SCAN_FIELDS.items()}))
    return out


def write_json(report: DataFrame, path: str, compression: str = "none") -> None:
    """JSON lines, a folder for each repository and section. Lines are long and alike; `compression` gzip takes a small part of
    the disk, and Spark reads either form."""
    keys = ["repo_id", "section", "ord"]
    report.repartitionByRange(*keys).sortWithinPartitions(*keys).select("repo_id", "section", "json").write.partitionBy("repo_id", "section").text(path, compression=compression)


def _lines(df: DataFrame, s1: Column, s2: Column, prefix: str, lines: list[Column]) -> DataFrame:
    """A block of lines in order; those that are null are left out."""
    at = df.select("repo_id", s1.cast("int").alias("s1"), s2.cast("string").alias("s2"), F.posexplode(F.array_compact(F.array(*lines))).alias("i", "text"))
    return at.select("repo_id", "s1", "s2", F.concat(F.lit(prefix), F.lpad(F.col("i").cast("string"), 3, "0")).alias("s3"), "text")


def report_markdown(findings: DataFrame, scans: DataFrame | None = None, snippet_chars: int | None = None) -> DataFrame:
    """Ordered lines (repo_id, s1, s2, s3, text) of a Markdown report: heading, summary, severities, for each severity its
    rules with places and explanations, checklist. Sort and write as text. Snippets are whole unless a length is given.
    """
    text = F.lit
    blank = text("")
    total = _summary(findings)
    meta = []
    if scans is not None:
        total = total.join(scans.select("repo_id", *[c for c in SCAN_FIELDS.values() if c in scans.columns]), "repo_id", "left")
        meta = [
            F.concat(text("> Date: **"), _optional(total, "scan_date").cast("string"), text("**, target: `"), md_escape(_optional(total, "target")), text("`, files: **"), _optional(total, "total_files").cast("string"), text("**")), blank,
        ]
    skipped = F.when(_optional(total, "skipped").cast("bigint") > 0, F.concat(text("| Skipped files | "), _optional(total, "skipped").cast("string"), text(" |"))) if scans is not None else F.lit(None).cast("string")
    top = _lines(total, F.lit(0), F.lit(""), "", [
        text("# Code scan report"), blank, *meta, text("## Summary"), blank, text("| Property | Value |"), text("|---|---|"),
        F.format_string("| Risk | %s (%d/100) |", "risk_label", "risk_score"), F.format_string("| Findings | **%d** |", "findings"), skipped, blank,
        text("### Findings by severity"), blank, text("| Severity | Count | Meaning |"), text("|---|---|---|"),
        *[F.when(F.col(s) > 0, F.format_string(f"| {s} | **%d** | {MEANING[s]} |", F.col(s))) for s in sev.ORDER], blank, text("---"), blank, text("## Findings"), blank,
    ])
    known = findings.withColumn("_s", sev.rank(F.col("severity")) + 1).where(F.col("_s") <= len(sev.ORDER))
    heads = known.groupBy("repo_id", "_s").agg(F.count(F.lit(1)).alias("n"))
    heads = _lines(heads, F.col("_s"), F.lit(""), "", [F.concat(text("### "), F.element_at(F.lit(sev.ORDER), F.col("_s")), F.format_string(" (%d)", "n")), blank])
    about = ["name", "category", "why", "scenario", "fix"]
    rules = known.groupBy("repo_id", "_s", "rule_id").agg(*[F.min_by(_optional(known, c), "off").alias(c) for c in about])
    given = lambda c, line: F.when(F.coalesce(F.col(c), F.lit("")) != "", line)
    note = lambda c, label: [given(c, F.concat(text(f"**{label}:** "), F.col(c))), given(c, blank)]
    before = _lines(rules, F.col("_s"), F.col("rule_id"), "0:", [
        F.concat(text("#### "), md_escape(F.col("rule_id")), text(" - "), md_escape(F.col("name"))), blank,
        given("category", F.concat(text("**Category:** "), md_escape(F.col("category")))), given("category", blank), text("**Occurrences:**"), blank,
    ])
    after = _lines(rules, F.col("_s"), F.col("rule_id"), "2:", [blank, *note("why", "Why"), *note("scenario", "Scenario"), *note("fix", "Fix"), text("---"), blank])
    snippet = F.col("snippet") if snippet_chars is None else F.substring("snippet", 1, snippet_chars)
    shown = F.when((F.col("snippet") != "") & (F.col("snippet") != "[REDACTED]"), F.concat(text("  `"), md_escape(F.trim(snippet)), text("`"))).otherwise("")
    places = known.select(
        "repo_id", F.col("_s").cast("int").alias("s1"), F.col("rule_id").alias("s2"),
        F.concat(text("1:"), F.col("path"), text(":"), F.lpad(F.col("line").cast("string"), 9, "0"), text(":"), F.lpad(F.col("off").cast("string"), 19, "0")).alias("s3"),
        F.concat(text("- `"), md_escape(F.col("path")), text("` line **"), F.col("line").cast("string"), text("**"), shown).alias("text"),
    )
    items = _items(findings)
    todo = items.select(
        "repo_id", F.lit(90).alias("s1"), F.concat(text("1:"), F.col("r").cast("string"), F.col("rule_id")).alias("s2"), F.lit("").alias("s3"),
        F.concat(
            text("- [ ] `"), F.col("severity"), text("` **"), md_escape(F.col("rule_id")), text("** - "), md_escape(F.col("name")),
            F.when(F.col("occurrences") > 1, F.format_string(" _(%d occurrences)_", "occurrences")).otherwise(""),
        ).alias("text"),
    )
    list_head = _lines(total, F.lit(90), F.lit("0:"), "", [text("## Checklist"), blank, text("Tick off what is resolved:"), blank])
    end = _lines(total, F.lit(99), F.lit(""), "", [blank, text("---")])
    out = top
    for part in (heads, before, places, after, list_head, todo, end):
        out = out.unionByName(part)
    return out


def write_markdown(report: DataFrame, path: str, compression: str = "none") -> None:
    """One folder per repository; a range partitioning on the sort keys keeps the lines in order over its files."""
    keys = ["repo_id", "s1", "s2", "s3"]
    report.repartitionByRange(*keys).sortWithinPartitions(*keys).select("repo_id", "text").write.partitionBy(
        "repo_id"
    ).text(path, compression=compression)
