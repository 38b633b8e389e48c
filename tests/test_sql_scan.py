"""The scan as an SQL function."""

from siftlake.operators import match, rules
from siftlake.plans.sql import register_scan


def test_same_matches_as_the_column_form(spark):
    import random

    patterns = ["a([0-9])?b", "b+", "(?:x|y)z", "é.", "it's \\\\ \"q\"", "^l", "tok(?=en)", "nothing", "(?<=a)b", "@"]
    rule_list = [rules.to_rule({"id": f"P{i}", "pattern": p, "severity": "LOW", "flags": "gim", **({"file_types": ["js"]} if i == 1 else {})}, "corpus", i) for i, p in enumerate(patterns)]
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1xyzél@\n") for _ in range(rng.randint(0, 900))) for _ in range(20)]
    texts += ["it's \\ \"q\"\ntoken", "ab\ufdd0ab\ufdd1\nxz\ufdd2b", "", "ab\n" * 3000]
    files = spark.createDataFrame([("r", f"{i}.{'js' if i % 2 else 'txt'}", t) for i, t in enumerate(texts)] + [("r", "none.js", None)], "repo_id string, path string, content string")
    files.createOrReplaceTempView("texts_of_the_test")
    register_scan(spark, rule_list, "scan_of_the_test")
    got = spark.sql("SELECT path, m.* FROM (SELECT path, scan_of_the_test(content, path) AS ms FROM texts_of_the_test) LATERAL VIEW inline(ms) m")
    wanted = match.match_table(files, rule_list)
    cols = ["path", "rule_id", "off", "line", "raw", "text", "value"]
    assert sorted(tuple(r) for r in got.select(cols).collect()) == sorted(tuple(r) for r in wanted.select(cols).collect())
    assert {r.severity for r in got.select("severity").distinct().collect()} == {"LOW"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Join" not in plan
    # any SQL may follow, and rows without a match are kept on request
    assert spark.sql("SELECT count(*) FROM (SELECT scan_of_the_test(content, path) AS ms FROM texts_of_the_test) LATERAL VIEW OUTER inline(ms) m WHERE m.off IS NULL").first()[0] >= 2
