"""The pattern index against a plain matcher, on its plan and at size."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.operators import path_index as ix, scope
from siftlake.sources import files as src

SCOPE = [
    "src", "src/", "src/a.js", "/", "docs/**", "**/*.test.js", "*.md", "src/a?.js", "lib/*2.py", "**/package.json", "**/node_modules/**", "a/**/z/*.ts", "*", "**", "?",
    "**/x*/**", "bin/(", "sr*/a.js", "**.js", "src/***", "a.b*c.d*", "**/b/", "src//a", "*a.b.c", "**/", "src/[a]", "é*/ü", "b/*/c/*/d", "*/d", "x\\y",
]
PATHS = [
    "src/a.js", "src/ab.js", "src", "srcx/a.js", "src/b/a.test.js", "a.test.js", "readme.md", "x/readme.md", "docs/a/b.md", "docs", "lib/f2.py", "lib/x/f2.py", "package.json", "p/package.json",
    "p/node_modules/q/r.js", "node_modules/q.js", "a/b/z/c.ts", "a/z/c.ts", "a/z/", "", "q", "/abs/x.js", "p/xy/z", "bin/(", "bin/(/a", "a.bxc.dy", "src//a", "za.b.c", "src/[a]", "éa/ü",
    "b/1/c/2/d", "b/1/c/d", "x/y", "src/line\nend.js", "k/b", "k/b/c",
]
IGNORE = [
    ("", "*.log"), ("", "/vendor/"), ("", "!f8?.log"), ("docs", "f1*"), ("docs", "!f1?4.js"), ("", "**/page_1*.html"), ("", "dist/**/f2*.py"), ("", "node_modules"), ("a", "/b"), ("a", "b/c"),
    ("", "/*.cfg"), ("", "!/keep.cfg"), ("a/b", "*"), ("a/b", "!q?"), ("", "!"), ("", "# no"), ("", "  "), ("", "/"), ("", "x*y"), ("", "/s/t*/u"), ("", ".env"),
]
IGNORE_PATHS = [
    "a.log", "q/a.log", "a.log/b", "f81.log", "vendor/x", "q/vendor/x", "docs/f12", "docs/x/f1/y", "docs/f134.js", "f12", "q/page_12.html", "page_12.html", "dist/a/f2.py", "dist/f2.py", "node_modules/x",
    "q/node_modules/x/y", "a/b", "a/b/q1", "a/b/zz", "a/x/b/c/d", "b/c", "k.cfg", "keep.cfg", "q/k.cfg", "xzy", "q/xzzy/r", "s/t1/u/v", "s/t1/v", ".env", "q/.env/z", "ab.env",
]


def plain_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in parts)


def plain_scope(pattern, path):
    p, path = pattern.replace("\\", "/"), path.replace("\\", "/")
    norm = p.removesuffix("/")
    if ("*" in norm or "?" in norm) and not pattern.endswith("/"):
        return re.fullmatch(plain_regex(norm), path) is not None
    return path == norm or path.startswith(norm + "/")


def test_scope_patterns_like_a_plain_matcher(spark):
    files = spark.createDataFrame([("r", p) for p in PATHS], "repo_id string, path string")
    entries = spark.createDataFrame([(None if i % 2 else "r", p) for i, p in enumerate(SCOPE)], "repo_id string, pattern string")
    got = {(r.pattern, r.path) for r in scope.pattern_hits(files, entries).collect()}
    assert got == {(q, p) for q, p in itertools.product(SCOPE, PATHS) if plain_scope(q, p)}


def test_first_pattern_counts_and_owners_stay_apart(spark):
    files = spark.createDataFrame([("r", "src/a.js", "t1"), ("q", "src/a.js", "t2"), (None, "src/a.js", "t3"), ("r", "b.js", "t4"), ("r", None, "t5")], "repo_id string, path string, content string")
    entries = spark.createDataFrame([("r", "**/a.js"), ("r", "src"), (None, "*/*.js"), ("s", "**"), (None, ""), (None, None)], "repo_id string, pattern string").coalesce(1)
    got = {(r.content, r.excluded_by) for r in scope.match_scope(files, entries).collect()}
    assert got == {("t1", "*/*.js"), ("t2", "*/*.js"), ("t3", "*/*.js"), ("t4", None), ("t5", None)}
    assert {r.content for r in scope.exclude_files(files, entries).collect()} == {"t4", "t5"}
    own = {(r.content, r.excluded_by) for r in scope.match_scope(files, entries.where("repo_id is not null")).collect()}
    assert own == {("t1", "**/a.js"), ("t2", None), ("t3", None), ("t4", None), ("t5", None)}


def plain_ignored(lines, path):
    out = False
    for folder, line in lines:
        line = line.strip()
        if not line or line.startswith("#") or (folder and not path.startswith(folder + "/")):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        anchored, line = line.startswith("/"), line.removeprefix("/").removesuffix("/")
        if re.search(("^" if anchored else "(?:^|/)") + plain_regex(line) + "(?:/|$)", path.removeprefix(folder + "/") if folder else path):
            out = not negated
    return out


@pytest.mark.parametrize("seed", range(4))
def test_ignore_lines_like_a_plain_matcher(spark, seed):
    lines = [IGNORE[i] for i in np.random.default_rng(seed).permutation(len(IGNORE))[: len(IGNORE) - 6 * seed]]
    rows = [("r", folder, 0, i, line) for i, (folder, line) in enumerate(lines)]
    rules = src.parse_ignore_lines(spark.createDataFrame(rows, "repo_id string, dir string, dir_order int, rule_order int, line string"))
    files = spark.createDataFrame([("r", p) for p in IGNORE_PATHS] + [("other", "a.log")], "repo_id string, path string")
    kept = {(r.repo_id, r.path) for r in src.apply_ignore(files, rules).collect()}
    assert kept == {("r", p) for p in IGNORE_PATHS if not plain_ignored(lines, p)} | {("other", "a.log")}


def test_rules_with_globs_and_whole_rules(spark):
    findings = spark.createDataFrame([("R1", "a", 1), ("R2", "docs/a", 2), ("R2", "src/b.js", 3), ("R2", "src/b.js", 4), ("R3", None, 5), (None, "docs/a", 6)], "rule_id string, path string, n int")
    entries = spark.createDataFrame([("R1", None), ("R1", ["x"]), ("R2", ["docs/", "**/*.py"]), ("R2", ["*/b.*"]), ("R3", [""]), ("R3", []), (None, None)], "rule_id string, globs array<string>")
    flagged = scope.flag_rule_excludes(findings, entries)
    assert flagged.columns == ["rule_id", "path", "n", "scope_excluded"]
    assert {(r.n, r.scope_excluded) for r in flagged.collect()} == {(1, True), (2, True), (3, True), (4, True), (5, True), (6, False)}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_has_no_regex_column_and_no_nested_loop(spark, tmp_path):
    spark.createDataFrame([("r", "a", "text")], "repo_id string, path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    entries = spark.createDataFrame([("r", "a*")], "repo_id string, pattern string")
    lines = spark.createDataFrame([("r", "", 0, 0, "*.x")], "repo_id string, dir string, dir_order int, rule_order int, line string")
    for df in (scope.match_scope(files, entries), scope.exclude_files(files, entries), src.apply_ignore(files, src.parse_ignore_lines(lines))):
        plan = plan_of(df)
        assert "RLIKE" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        # the text stands on one side of one join only
        assert sum("content" in line for line in plan.splitlines() if "Join" in line and "Exchange" not in line) <= 1
    assert "content" not in plan_of(scope.covered_by(files, entries))


def test_a_hundred_thousand_patterns_and_a_million_paths(spark):
    n, k = 1_000_000, 100_000
    path = F.format_string("d%d/e%d/f%d.js", F.col("id") % 1000, F.floor(F.col("id") / 1000) % 100, F.col("id"))
    files = spark.range(n, numPartitions=8).select(F.lit("r").alias("repo_id"), path.alias("path"))
    f = F.col("id")
    pattern = (
        F.when(f % 4 == 0, F.format_string("d%d/e%d/", f % 1000, f % 97)).when(f % 4 == 1, F.format_string("d%d/e%d/f*1.js", f % 1000, f % 100))
        .when(f % 4 == 2, F.format_string("**/f%d.js", f * 7)).otherwise(F.format_string("**/*.x%d", f))
    )
    entries = spark.range(k, numPartitions=8).select(F.when(f % 2 == 0, "r").alias("repo_id"), pattern.alias("pattern"))
    got = scope.covered_by(files, entries).select(F.col("_path").alias("path")).distinct()

    def count_plain():
        folders = {(i % 1000, i % 97) for i in range(0, k, 4)}
        ones = {(i % 1000, i % 100) for i in range(1, k, 4)}
        names = {i * 7 for i in range(2, k, 4)}
        at = ((i % 1000, i // 1000 % 100, i) for i in range(n))
        return sum((d, e) in folders or ((d, e) in ones and i % 10 == 1) or i in names for d, e, i in at)

    assert got.count() == count_plain()
    assert ix.ANY == "*"
