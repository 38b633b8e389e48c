"""Invariants of state, exceptions and delivery; hot groups stay split and whole."""

import time

import pytest
from pyspark.sql import Window as W, functions as F

from siftlake.catalog import events as log, fixtures as fx, state as st, streams
from siftlake.functions.ranking import numbered
from siftlake.operators import audit, exceptions as ex, export, queue, reconcile as rc, scope
from siftlake.sources import files as src, store


def test_reconcile_again_changes_only_counters(spark, sf):
    kw = dict(scan_id="s", at=st.AT, coverage=fx.coverage_files(spark, sf), rules=fx.registry_rules(spark, sf))
    scan = fx.scan_rows(spark, sf)
    one = rc.new_state(rc.reconcile(fx.finding_state(spark, sf), scan, **kw))
    two = rc.new_state(rc.reconcile(one, scan, **kw))
    same = ["repo_id", "finding_id", "rule_id", "path", "line", "status", "first_seen", "last_seen", "reopen_count", "resolved_at"]
    assert one.select(same).exceptAll(two.select(same)).count() == 0
    assert two.count() == one.count() >= fx.finding_state(spark, sf).count()


def test_without_coverage_nothing_resolves(spark, sf):
    merged = rc.reconcile(fx.finding_state(spark, sf), fx.scan_rows(spark, sf), scan_id="s", at=st.AT)
    assert merged.where("transition = 'resolved'").count() == 0


def test_numbering_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
        F.when(F.col("id") % 9 != 1, F.pmod(F.xxhash64("id"), F.lit(1000))).alias("o"), "id")
    got = numbered(df, ["k"], ["o", "id"], "n")
    want = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("o", "id")).cast("bigint"))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 3000
    whole = numbered(df, [], ["o", "id"], "n")
    assert whole.exceptAll(df.withColumn("n", F.row_number().over(W.orderBy("o", "id")).cast("bigint"))).count() == 0
    assert numbered(df.where("false"), ["k"], ["o"], "n").count() == 0


def test_a_million_sessions_of_one_day_are_dealt_out_evenly(spark):
    n = 1_000_000
    events = spark.range(n, numPartitions=8).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3600).alias("ts"), F.col("id").alias("seq"),
        F.lit("finding_blocked").alias("event"), F.lit("h").alias("code_hash"), F.lit("R").alias("rule_id"), F.lit("f").alias("file"), F.lit("pre-commit").alias("hook"))
    rows, skipped = audit.history(events)
    got = rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.min("ts").alias("first")).cache()
    assert (got.count(), skipped.first()[0]) == (n // 10, 0)
    assert got.where("n <> 10").count() == 0 and got.where("last > first + interval 1 second").count() == 0
    heads = events.select("session_id", F.col("ts").alias("first_ts"), F.col("seq").alias("first_seq"), F.lit("h").alias("first_hook"))
    sizes = sorted(r[1] for r in numbered(heads, [], ["first_ts", "first_seq"], "n").groupBy(F.floor((F.col("n") - 1) / 1000)).count().collect())
    assert sizes == [1000] * 1000
    dealt = heads.repartitionByRange(8, "first_ts", "first_seq").groupBy(F.spark_partition_id()).count().orderBy("count").collect()
    assert dealt[-1][1] < 2 * dealt[len(dealt) // 2][1]


def test_first_finding_of_a_line_is_found_on_one_number(spark, sf):
    got = fx.first_findings(spark, sf)
    plan = st.hashed(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    key = ["repo_id", "path", "line", "rule_id"]
    want = fx.line_findings(spark, sf).groupBy(*key).agg(F.min_by("raw", "off").alias("raw"), F.min("off").alias("off"), F.min_by("base_severity", "off").alias("base_severity"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.columns == want.columns


def test_a_million_findings_of_one_file_name(spark):
    """Acceptances of index.js are filed by hash: each meets its own finding, not all files of the name."""
    n, k = 1_000_000, 2_000
    digest = F.md5(F.col("id").cast("string"))
    findings = spark.range(n, numPartitions=8).select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("app/m"), F.col("id").cast("string"), F.lit("/index.js")).alias("path"), (F.col("id") % 500).alias("line"), F.lit("R").alias("rule_id"),
        digest.alias("code_hash"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("text "), F.col("id").cast("string"))).otherwise("[REDACTED]").alias("snippet"))
    none = F.lit(None).cast("string")
    wanted = F.col("id") * 500 + 7
    exceptions = spark.range(k, numPartitions=4).select(
        F.lit("r").alias("repo_id"), F.lit("R").alias("rule_id"), F.lit("index.js").alias("path"), F.lit(1_000).cast("long").alias("line"), F.lit(None).cast("long").alias("range_from"), F.lit(None).cast("long").alias("range_to"),
        F.when(F.col("id") % 2 == 0, F.md5(wanted.cast("string"))).otherwise(F.left(F.md5(wanted.cast("string")), F.lit(16))).alias("line_hash"), none.alias("archived_at"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"),
        F.lit("approved").alias("status"), none.alias("created_at"), none.alias("expires"), F.col("id").alias("exc_ord"), none.alias("reviewed_by"))
    got = ex.match_exceptions(findings, exceptions)
    assert got.count() == k
    assert got.where(F.col("path") != F.concat(F.lit("app/m"), ((F.substring("exc.id", 2, 9).cast("long")) * 500 + 7).cast("string"), F.lit("/index.js"))).count() == 0


def test_many_files_whose_lines_share_a_hash(spark):
    """Acceptances of one hash in many files: each finding meets that of its own file, the first of those that ask for the same."""
    n = 60_000
    at = lambda c: F.concat(F.lit("src/f"), c.cast("string"), F.lit(".js"))
    findings = spark.range(n, numPartitions=8).select(
        F.lit("r").alias("repo_id"), at(F.col("id")).alias("path"), F.lit(3).cast("long").alias("line"), F.lit("R").alias("rule_id"), F.lit(H).alias("code_hash"), F.lit("text").alias("snippet"))
    none = F.lit(None).cast("string")
    exceptions = spark.range(2 * n, numPartitions=8).select(
        F.lit("r").alias("repo_id"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("id"), F.col("id").alias("exc_ord"), F.lit("approved").alias("status"), F.lit("R").alias("rule_id"),
        at(F.col("id") % n).alias("path"), F.lit(3).cast("long").alias("line"), F.lit(H).alias("line_hash"), F.lit(None).cast("long").alias("range_from"), F.lit(None).cast("long").alias("range_to"),
        none.alias("created_at"), none.alias("expires"), none.alias("archived_at"), none.alias("reviewed_by"))
    start = time.monotonic()
    got = ex.match_exceptions(findings, exceptions).cache()
    assert got.count() == n and got.where(F.col("path") != at(F.substring("exc.id", 2, 9))).count() == 0
    assert time.monotonic() - start < 90  # by hash alone 7.2 billion pairs meet


def test_batches_of_a_hot_session_are_split_and_whole(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("session_id"), F.col("id").alias("line"))
    out = audit.batches(df, ["line"], ["line"], part_rows=200).collect()
    assert sum(r.n for r in out) == 5000 and max(r.n for r in out) < 400
    assert len({f.line for r in out for f in r.findings}) == 5000


def test_verdicts_go_to_the_parts_of_their_findings(spark):
    rows = [("a", "p", 1, "R1"), ("a", "p", 1, "R1"), ("a", "p", None, "R1"), ("a", "q", 1, "R1"), ("b", "p", 1, "R1"), ("b", "q", None, "R2")]
    f = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "session_id string, path string, line long, rule_id string, i int")
    made = lambda df: df.withColumn("text", F.concat("path", F.lit("-"), "rule_id"))
    off = spark.createDataFrame([rows[0], rows[2], rows[4], ("b", "gone", 1, "R1"), ("c", "p", 1, "R1")], "session_id string, path string, line long, rule_id string")
    for part_rows in (1, 100):
        out = audit.batches(f, ["i", "text", "excepted"], ["path", "line", "rule_id"], part_rows, made, off).collect()
        got = sorted((x.i, r.session_id, x.text, x.excepted) for r in out for x in r.findings)
        assert got == [(i, r[0], f"{r[1]}-{r[3]}", i in (0, 1, 2, 4)) for i, r in enumerate(rows)] and sum(r.n for r in out) == 6


def test_packed_findings_are_exchanged_once(spark, sf):
    packed = log.packed_findings(spark, sf)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in plan and "orders" not in str(packed.inputFiles())
    cols = [*log.PAYLOAD, "blocks"]
    got = packed.select("session_id", F.explode("findings").alias("f")).select("session_id", *[f"f.{c}" for c in cols]).collect()
    want = log.session_findings(spark, sf).select("session_id", *cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.excepted for r in got} == {True, False}
    assert not any("orders" in f for f in log.QUERIES["audit_findings_batch"](spark, sf).inputFiles())


def test_possible_rows_for_paths_of_several_depths(spark):
    exc = [("r", "e1", 1, "R1", "a/b.js", "approved"), ("r", "e2", 2, "R1", "b.js", "rejected"), ("r", "e3", 3, "R2", "./c.js", "approved"), ("r", "e4", 0, "R3", "c.js", "pending"), ("r", "e5", 5, "R3", "c.js", "approved")]
    exc = [(*e, None, None, None, None, None, "2024-01-01T00:00:00Z", None, "x") for e in exc]
    exc = spark.createDataFrame(exc, "repo_id string, id string, exc_ord long, rule_id string, path string, status string, line long, line_hash string, range_from long, range_to long, archived_at string, created_at string, expires string, reviewed_by string")
    found = [("r", "x/a/b.js", 1, "R1"), ("r", "b.js", 2, "R1"), ("r", "d/c.js", None, "R2"), ("r", "c.js", 4, "R3"), ("r", "xc.js", 5, "R2"), ("s", "c.js", 6, "R2")]
    rows = spark.createDataFrame([(*f, i) for i, f in enumerate(found)], "repo_id string, path string, line long, rule_id string, i int")
    made = lambda df: df.withColumns({"code_hash": F.lit("h"), "snippet": F.lit("t")})
    some = ex.possible(rows, exc, made)
    assert sorted(r.i for r in some.collect()) == [0, 1, 2, 3]
    got = [{tuple(r) for r in ex.accepted(made(f), exc, "2024-01-02T00:00:00Z").collect()} for f in (some, rows)]
    verdicts = ex.apply_exceptions(made(rows), exc, "2024-01-02T00:00:00Z").where("excepted").select(*ex.FINDING_KEY)
    assert got[0] == got[1] == {tuple(r) for r in verdicts.collect()} == {found[0], found[2]}


def test_summary_counts_accepted_findings_beside_all(spark):
    schema = "session_id string, severity string, action string"
    rows = [("a", "CRITICAL", "block"), ("a", "HIGH", "block"), ("a", "LOW", "warn"), ("b", "CRITICAL", "block"), ("c", "MEDIUM", "warn")]
    scans = spark.createDataFrame([(s, "manual", "full", 1) for s in "abcd"], "session_id string, hook string, scan_mode string, files_count long")
    out = audit.scan_summary(spark.createDataFrame(rows, schema), spark.createDataFrame([rows[0], rows[2], rows[3]], schema), scans)
    got = {r.session_id: (r.findings_total, r.findings_critical, r.exceptions_applied, r.blocked) for r in out.collect()}
    assert got == {"a": (3, 1, 2, True), "b": (1, 1, 1, False), "c": (1, 0, 0, False), "d": (0, 0, 0, False)}


@pytest.mark.parametrize("name", ["audit_top_rules", "audit_categories"])
def test_counts_without_verdicts_read_no_exceptions(spark, sf, name):
    read = log.QUERIES[name](spark, sf).inputFiles()
    assert any("lineitem" in f for f in read) and not any("orders" in f for f in read)


def test_queue_parts_are_whole(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("seq"), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts"),
                                  F.lit(0).cast("bigint").alias("attempts"), F.lit("r1").alias("repo_id"), F.lit("x").alias("payload"), F.lit(None).cast("string").alias("last_error"))
    out = queue.batches(df, "2024-01-02 00:00:00", rows=100).collect()
    assert sum(r.n for r in out) == 3000 and max(r.n for r in out) < 200


EXC = "repo_id string, id string, exc_ord long, status string, rule_id string, path string, line long, line_hash string, range_from long, range_to long, created_at string, expires string, archived_at string, reviewed_by string"
FND = "repo_id string, path string, line long, rule_id string, code_hash string, snippet string"
H = "a" * 32


@pytest.mark.parametrize(
    "exc, finding, hit",
    [
        (dict(line_hash=H), {}, True), (dict(line_hash="a" * 16), {}, True), (dict(line_hash="b" * 32), {}, False),
        (dict(line_hash="b" * 32, line=3), dict(snippet="[REDACTED]"), True), (dict(line_hash="b" * 32, line=4), dict(snippet="[REDACTED]"), False),
        ({}, {}, True), (dict(range_from=1, range_to=2), {}, False), (dict(range_from=3, range_to=9), {}, True),
        (dict(path="a.js"), {}, True), (dict(path="x/a.js"), {}, False), (dict(path="./src/a.js"), dict(path=".\\src\\a.js"), True), (dict(archived_at="2024"), {}, False),
    ],
)
def test_exception_matching(spark, exc, finding, hit):
    e = dict(repo_id="r", id="e", exc_ord=1, status="approved", rule_id="R", path="src/a.js", line=None, line_hash=None, range_from=None, range_to=None, created_at=None, expires=None, archived_at=None, reviewed_by=None)
    f = dict(repo_id="r", path="src/a.js", line=3, rule_id="R", code_hash=H, snippet="text")
    e.update(exc), f.update(finding)
    got = ex.match_exceptions(spark.createDataFrame([tuple(f.values())], FND), spark.createDataFrame([tuple(e.values())], EXC))
    assert (got.count() == 1) is hit


@pytest.mark.parametrize(
    "status, expires, want",
    [("pending", None, "expired"), ("approved", None, "approved"), ("approved", "2023-01-01T00:00:00Z", "expired"), ("rejected", "2023-01-01T00:00:00Z", "expired"),
     ("pending", "not a date", "pending"), ("rejected", None, "rejected"), ("pending", "2025-01-01T00:00:00Z", "pending")],
)
def test_verdict_order(spark, status, expires, want):
    expiry = ex.effective_expiry(F.lit(status), F.lit("2024-01-01T00:00:00Z"), F.lit(expires).cast("string"))
    got = spark.range(1).select(ex.verdict(F.lit(status), expiry, F.to_timestamp(F.lit("2024-01-15T00:00:01Z")))).first()[0]
    assert got == want


@pytest.mark.parametrize(
    "pattern, path, want",
    [("src/*.js", "src/a.js", True), ("src/*.js", "src/b/a.js", False), ("docs/**", "docs/a/b.md", True), ("**/*.test.js", "a/b.test.js", True),
     ("*.md", "a.md", True), ("*.md", "x/a.md", False), ("docs/a/", "docs/a/b", True), ("docs/a/", "docs/ab", False), ("src/a?.js", "src/ab.js", True), ("bin/x", "bin/x", True), ("bin/(", "bin/", False)],
)
def test_scope_patterns(spark, pattern, path, want):
    files = spark.createDataFrame([("a", path)], "repo_id string, path string")
    entries = spark.createDataFrame([(None, pattern)], "repo_id string, pattern string")
    assert (scope.exclude_files(files, entries).count() == 0) is want


def test_store_keeps_old_version_until_the_switch(spark, tmp_path):
    root = str(tmp_path / "state")
    assert store.read_state(spark, root) is None
    store.write_state(spark.range(3), root)
    old = store.read_state(spark, root)
    store.write_state(old.where("id > 0"), root)
    assert (old.count(), store.read_state(spark, root).count()) == (3, 2)
    store.write_state(old.where("id > 99"), root)
    assert store.read_state(spark, root).count() == 0


def test_tree_with_broken_bytes(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_bytes(b"ok \xff\n")
    (tmp_path / "y.txt").write_text("t")
    rows = {r.path: r.content for r in src.read_tree(spark, str(tmp_path), "r").collect()}
    assert rows == {"a/x.py": "ok �\n", "y.txt": "t"}


def test_lengths_of_texts_that_no_task_holds(spark, tmp_path):
    mark = b"\xef\xbb\xbf"
    texts = {
        "empty": b"", "end": b"\n", "ends": b"\n\n\n\n", "a": b"a", "b b%20.js": b"ab\n", "cr": b"a\r\nb\r", "mark": mark, "mark end": mark + b"\n", "mark ends": mark + b"\n\n",
        "marked": mark + b"a\nb", "in a line": b"a" + mark + b"\n" + mark + b"\n", "broken": b"\xe2\x82\n\xff\xfe\xf0\x9f\x92\n\x80\xc3", "umlaut": "ä\nö€😀".encode() * 40, "long": b"x" * 3000 + b"\ny",
        "n.gz": b"no archive \xff\n\n", "sub/o.ZST": mark + b"c\n", "sub/zero": b"\x00\n\x00",
    }
    (tmp_path / "sub").mkdir()
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
    wanted = {r.path: r.n for r in src.read_tree(spark, str(tmp_path), "r").select("path", F.length("content").alias("n")).collect()}
    limits = {"spark.sql.files.maxPartitionBytes": "16", "spark.sql.files.openCostInBytes": "0", "spark.sql.sources.binaryFile.maxLength": "100"}
    for key, value in limits.items():
        spark.conf.set(key, value)
    try:
        got = {r.path: r.n_chars for r in src.text_lengths(spark, str(tmp_path), "r").collect()}
        some = src.text_lengths(spark, str(tmp_path), "r", "b*").collect()
    finally:
        for key in limits:
            spark.conf.unset(key)
    assert got == wanted and set(got) == set(texts) - {"empty"}  # Spark lists no empty file
    assert {tuple(r) for r in some} == {("r", "b b%20.js", 3), ("r", "broken", wanted["broken"])}


def test_files_larger_than_a_cell_are_read(spark, sf):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # as 2 GB is for a real one
    try:
        rows = streams.QUERIES["src_files"](spark, sf).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert len(rows) == 14 and all(r.has_text for r in rows)


def test_unknown_language_and_mode(spark):
    df = spark.createDataFrame([("r", "a.js", "")], "repo_id string, path string, content string")
    with pytest.raises(ValueError):
        src.keep_language(df, "cobol")
    with pytest.raises(ValueError):
        src.vendor_filter(df, "some")


def test_verdict_paths_need_a_directory_boundary(spark):
    f = spark.createDataFrame([("r", "src/a.js", 1, "R"), ("r", "src/xa.js", 1, "R")], "repo_id string, path string, line int, rule_id string")
    v = spark.createDataFrame([("r", "a.js", "R", 1, 1, True, "0.9", None)], "repo_id string, path string, rule_id string, line int, ord int, confirmed boolean, confidence string, error string")
    got = {r.path: r.verdict is not None for r in export.join_verdicts(f, v).collect()}
    assert got == {"src/a.js": True, "src/xa.js": False}


def test_findings_without_a_line_keep_their_exception(spark):
    cols = "repo_id string, finding_id string, rule_id string, path string, line long, off long, suppressed boolean, snippet string, code_hash string"
    found = spark.createDataFrame([("r", "f", "R1", "a/b.js", None, 0, False, "", "h")], cols)
    exc = spark.createDataFrame(
        [("r", "e1", 1, "R1", "a/b.js", None, None, None, None, None, "approved", "2024-01-01T00:00:00Z", None, "x")],
        "repo_id string, id string, exc_ord long, rule_id string, path string, line long, line_hash string, range_from long, range_to long, archived_at string,"
        " status string, created_at string, expires string, reviewed_by string",
    )
    key = [k for k in ex.FINDING_KEY]
    assert set(key) <= set(found.columns)
    assert ex.apply_exceptions(found, exc, "2024-05-01T00:00:00Z").first().excepted


def test_paths_of_rules_without_globs_get_no_keys(spark, monkeypatch):
    seen = []
    met = scope.met
    monkeypatch.setattr(scope, "met", lambda paths, *rest: seen.append(paths) or met(paths, *rest))
    found = spark.createDataFrame([("R1", "src/a.js"), ("R2", "src/a.js"), ("R3", "docs/a.js"), ("R3", "src/a.js")], "rule_id string, path string")
    entries = spark.createDataFrame([("R1", None), ("R3", ["docs/"])], "rule_id string, globs array<string>")
    got = {tuple(r) for r in scope.flag_rule_excludes(found, entries).collect()}
    assert got == {("R1", "src/a.js", True), ("R2", "src/a.js", False), ("R3", "docs/a.js", True), ("R3", "src/a.js", False)}
    assert {r.rule_id for r in seen[0].collect()} == {"R3"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tails_of_paths_are_compiled_and_verdicts_joined_by_a_number(spark, sf):
    """No lambda runs over a finding's path, and the join that brings the verdicts sorts by a hash before it sorts by texts."""
    rows = [("r", p) for p in ("a.js", "./app\\\\x\\\\a.js", "app/x/a.js", "./a.js", "a.js/", "/a.js", "")]
    paths = spark.createDataFrame(rows, "repo_id string, path string").withColumn("_clean", ex.clean_path(F.col("path")))
    old = F.regexp_replace(F.translate("path", "\\", "/"), r"^\./", "")
    assert paths.where(~F.col("_clean").eqNullSafe(old)).count() == 0
    tails = ex.path_suffixes(paths.withColumn("_depths", F.array(F.lit(1), F.lit(3))), "_clean", "_depths")
    assert {r._file for r in tails.where("path = 'app/x/a.js'").collect()} == {"a.js", "app/x/a.js"}
    assert [r._file for r in tails.where("path = 'a.js'").collect()] == ["a.js"]
    plan = _plan(ex.match_exceptions(st.hashed(spark, sf), fx.exceptions(spark, sf)))
    assert "lambdafunction" not in plan
    joined = _plan(ex.apply_exceptions(st.hashed(spark, sf), fx.exceptions(spark, sf), st.AS_OF))
    last = next(line for line in joined.splitlines() if "Join" in line)
    assert "LeftOuter" in last and "xxhash64" in last.split("]")[0]


def test_patterns_of_a_known_size_are_sent_to_the_paths(spark, sf):
    from siftlake.catalog import scan as sc_cat

    plan = _plan(scope.pattern_hits(fx.document_files(spark, sf), sc_cat.scope_entries(spark)))
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_the_outer_join_of_a_reconciliation_is_made_once(spark, sf):
    plan = _plan(rc.counters(st.merged(spark, sf)))
    assert "FullOuter" not in plan


def test_code_files_are_dealt_out_by_key(spark, sf):
    assert "Exchange hashpartitioning(o_orderkey" in _plan(fx.code_files(spark, sf))
