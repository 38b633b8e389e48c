"""The written reports, whole and in order."""

import json

import pytest
from pyspark.sql import functions as F

from siftlake.operators import reports

ROWS = [
    ("r", "src/b.js", 12, "INJ-1", "Name *x*", "HIGH", "Injection (A03)", "eval(a|b)", "Because.", None, "Do not.", False, 30, "h1", "f1"),
    ("r", "src/a.js", 7, "INJ-1", "Name *x*", "HIGH", "Injection (A03)", "x" * 300, "Because.", None, "Do not.", True, 20, "h2", "f2"),
    ("r", "src/a.js", 9, "SEC-2", "Key", "CRITICAL", None, "[REDACTED]", None, "Someone reads it.", None, False, 40, None, "f3"),
    ("r", "src/a.js", 9, "INJ-1", "Name *x*", "CRITICAL", "Injection (A03)", "", None, None, None, False, 50, None, "f4"),
    ("r", "src/c.js", 1, "ODD", "Odd", "LOW", "Other", "x", None, None, None, False, 60, None, "f5"),
    ("q", "a", 1, "ODD", "Odd", "INFO", "Other", "x", None, None, None, False, 1, None, "f6"),
]
SCHEMA = (
    "repo_id string, path string, line long, rule_id string, name string, severity string, category string, snippet string, why string, scenario string, fix string,"
    " excepted boolean, off long, code_hash string, finding_id string"
)
WANTED = """# Code scan report

> Date: **2024-05-01**, target: `src\\_x`, files: **3**

## Summary

| Property | Value |
|---|---|
| Risk | MEDIUM (30/100) |
| Findings | **5** |
| Skipped files | 2 |

### Findings by severity

| Severity | Count | Meaning |
|---|---|---|
| CRITICAL | **2** | Can be exploited as it is |
| HIGH | **2** | Likely to be exploited |

---

## Findings

### CRITICAL (2)

#### INJ-1 - Name \\*x\\*

**Category:** Injection (A03)

**Occurrences:**

- `src/a.js` line **9**

---

#### SEC-2 - Key

**Occurrences:**

- `src/a.js` line **9**

**Scenario:** Someone reads it.

---

### HIGH (2)

#### INJ-1 - Name \\*x\\*

**Category:** Injection (A03)

**Occurrences:**

- `src/a.js` line **7**  `{}`
- `src/b.js` line **12**  `eval(a\\|b)`

**Why:** Because.

**Fix:** Do not.

---

## Checklist

Tick off what is resolved:

- [ ] `CRITICAL` **INJ-1** - Name \\*x\\* _(3 occurrences)_
- [ ] `CRITICAL` **SEC-2** - Key

---
""".format("x" * 300)


@pytest.fixture(scope="module")
def findings(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame([("r", "2024-05-01", "src_x", 3, 2)], "repo_id string, scan_date string, target string, total_files long, skipped long")


def test_markdown_file(spark, findings, scans, tmp_path):
    reports.write_markdown(reports.report_markdown(findings, scans), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "md" / "repo_id=r").glob("part-*")))
    assert text == WANTED
    other = "".join(p.read_text() for p in sorted((tmp_path / "md" / "repo_id=q").glob("part-*")))
    assert "Date" not in other and "### INFO (1)" in other and "Skipped" not in other
    short = reports.report_markdown(findings, snippet_chars=80).where("text like '%xxx%'").collect()
    assert [r.text for r in short] == ["- `src/a.js` line **7**  `" + "x" * 80 + "`"]


def test_json_lines(spark, findings, scans, tmp_path):
    reports.write_json(reports.report_json(findings, scans), str(tmp_path / "json"))
    read = lambda s: [json.loads(x) for p in sorted((tmp_path / "json" / "repo_id=r" / f"section={s}").glob("part-*")) for x in p.read_text().splitlines()]
    assert read("meta") == [{"scanDate": "2024-05-01", "target": "src_x", "totalFiles": 3, "skippedFiles": 2}]
    (summary,) = read("summary")
    assert summary["totalFindings"] == 5 and summary["bySeverity"] == {"CRITICAL": 2, "HIGH": 2, "MEDIUM": 0, "EXPOSURE": 0, "INFO": 0}
    assert summary["byCategory"] == [{"category": "Injection (A03)", "count": 3}, {"category": "Other", "count": 1}, {"category": "Unknown", "count": 1}]
    rows = {r["findingId"]: r for r in read("finding")}
    assert len(rows) == 5 and rows["f2"]["match"] == "x" * 300 and rows["f3"]["scenario"] == "Someone reads it." and rows["f3"]["codeHash"] is None
    assert list(rows["f1"]) == list(reports.FINDING_FIELDS)
    items = [(i["ruleId"], i["severity"], i["occurrences"], i["resolved"]) for i in read("checklist")]
    assert items == [("INJ-1", "CRITICAL", 3, False), ("SEC-2", "CRITICAL", 1, False)]


def test_reports_of_findings_without_texts(spark):
    bare = spark.createDataFrame([("r", "a", 1, "R", "HIGH", "c", "s", False, 1)], "repo_id string, path string, line long, rule_id string, severity string, category string, snippet string, excepted boolean, off long")
    assert reports.report_markdown(bare).where("text = '- [ ] `HIGH` **R** - '").count() == 1
    assert reports.report_json(bare).where(F.col("section") == "finding").count() == 1


def test_reports_are_written_compressed(spark, tmp_path):
    """Long lines that are alike take a fraction of their length on disk, and are read again whole."""
    n = 20_000
    rows = spark.range(n).select(F.lit("r").alias("repo_id"), F.lit("finding").alias("section"), F.lpad(F.col("id").cast("string"), 9, "0").alias("ord"),
                                 F.concat(F.lit("x" * 200), F.col("id").cast("string")).alias("json"))
    reports.write_json(rows, f"{tmp_path}/j", "gzip")
    reports.write_markdown(rows.select("repo_id", F.lit(1).alias("s1"), F.lit("").alias("s2"), F.col("ord").alias("s3"), F.col("json").alias("text")), f"{tmp_path}/m", "gzip")
    for name in "jm":
        size = sum(p.stat().st_size for p in (tmp_path / name).rglob("part-*"))
        assert size < 200 * n / 10
        back = spark.read.option("recursiveFileLookup", "true").text(f"{tmp_path}/{name}")
        assert back.exceptAll(rows.select(F.col("json").alias("value"))).count() == 0 and back.count() == n
