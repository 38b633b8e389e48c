"""The whole job: two scans, the second without the finding of the first."""

import collections

from pyspark.sql import functions as F

from siftlake.catalog import fixtures as fx
from siftlake.operators import rules as rl
from siftlake.plans import scan_job

EXCEPTION = (
    "repo_id string, id string, exc_ord long, type string, status string, rule_id string, path string, line long, line_hash string, range_from long,"
    " range_to long, created_at string, expires string, archived_at string, archive_reason string, reviewed_by string, reason string"
)


def test_two_scans(spark, sf, tmp_path):
    root = str(tmp_path / "store")
    packs = rl.load_packs()
    registry = spark.createDataFrame([(r.id, r.source) for r in packs], "rule_id string, pack string")
    files = lambda text: spark.createDataFrame([("r", "src/a.js", text)], "repo_id string, path string, content string")
    first = files("el.innerHTML = data;\nconst x = 1;\n")
    empty = fx.finding_state(spark, sf).where(F.lit(False))
    exceptions = spark.createDataFrame(
        [("r", "e1", 1, "exception", "approved", "INJ-002", "src/a.js", None, None, None, None, "2024-01-01T00:00:00Z", None, None, None, "x", "known"),
         ("r", "e2", 2, "exception", "pending", "INJ-001", "src/b.js", 1, None, None, None, "2023-01-01T00:00:00Z", None, None, None, None, "old")], EXCEPTION)

    def run(n, table, at):
        result = scan_job.scan(table, as_of=at, exceptions=exceptions)
        scans = spark.createDataFrame([(f"s{n}", "pre-commit", "full", 1, "dev")], "session_id string, hook string, scan_mode string, files_count int, git_user string").withColumn("ts", F.to_timestamp(F.lit(at)))
        return scan_job.persist(result, root=root, scan_id=f"s{n}", at=at, rules=registry, empty_state=empty, exceptions=exceptions, scans=scans)

    one = run(1, first, "2024-05-01T00:00:00Z")
    assert {r.transition for r in one.where("rule_id = 'INJ-002'").collect()} == {"inserted"}
    two = run(2, files("const x = 1;\n"), "2024-05-02T00:00:00Z")
    assert {r.transition for r in two.where("rule_id = 'INJ-002'").collect()} == {"resolved"}
    state = scan_job.store.read_state(spark, f"{root}/state")
    assert {r.status for r in state.where("rule_id = 'INJ-002'").collect()} == {"resolved"}
    events = collections.Counter(r.event for r in spark.read.parquet(f"{root}/events").collect())
    assert events["scan_started"] == 2 and events["scan_passed"] == 2 and events["finding_excepted"] >= 1 and events["finding_resolved"] >= 1
    ended = {r.id: r.archive_reason for r in scan_job.store.read_state(spark, f"{root}/exceptions").collect()}
    assert ended == {"e1": "finding_resolved", "e2": "review_expired"}
