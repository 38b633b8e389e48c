"""Every built-in rule finds its vulnerable sample and leaves its clean one alone."""

import json

import pytest
from pyspark.sql import functions as F

from siftlake.operators import classify, match, rules

FILE = {"js": "src/a.js", "ts": "src/a.ts", "python": "src/a.py", "php": "src/a.php", "aspnet": "src/a.aspx",
        "aspnet-cs": "src/a.cs", "infra": "src/a.py", "secrets": "src/a.py"}


def raw_rules():
    for path in sorted(rules.PACK_DIR.glob("*.json")):
        pack = json.loads(path.read_text())
        for i, r in enumerate(pack["rules"]):
            yield pack["pack_id"], i, r


def samples():
    for pack, i, r in raw_rules():
        for kind in ("hit", "miss"):
            text = r[kind]
            key = f"{pack}-{i}-{kind}"
            if r.get("match_mode") == "filename":
                yield r["id"], pack, key, f"{key}/{text}", "x"
            else:
                path = FILE.get(pack) or "src/a." + r["file_types"][0]
                yield r["id"], pack, key, f"{key}/{path}", text


@pytest.fixture(scope="module")
def found(spark):
    rows = [("r", path, text) for _, _, _, path, text in samples()]
    files = classify.classify_files(spark.createDataFrame(rows, "repo_id string, path string, content string"))
    out = match.scan_files(files, rules.load_packs()).select("path", "rule_id").distinct().collect()
    return {(r[0], r[1]) for r in out}


def test_samples(found):
    problems = []
    for rule_id, pack, key, path, text in samples():
        hit = (path, rule_id) in found
        if hit != key.endswith("hit"):
            problems.append((rule_id, key, text))
    assert not problems


def test_packs_are_valid(spark):
    assert rules.rule_problems(rules.read_packs(spark)).collect() == []


def test_spark_and_driver_defaults_agree(spark):
    loaded = {(r.source, r.ord): r for r in rules.load_packs()}
    rows = rules.read_packs(spark).select(
        "source", "rule_ord", "severity", "flags", "antipattern", "lookahead", "lookbehind", "taint_aware", "match_mode"
    ).collect()
    assert len(rows) == len(loaded)
    for row in rows:
        r = loaded[(row[0], row[1])]
        assert (r.severity, r.flags, r.antipattern, r.lookahead, r.lookbehind, r.taint_aware, r.match_mode) == tuple(row[2:])


@pytest.mark.parametrize(
    "bad",
    [
        dict(pattern="x"), dict(id="A"), dict(id="A", pattern="x", severity="HUGE"), dict(id="A", pattern="x*"),
        dict(id="A", pattern="x", confidence_rules=[{"if_value_matches": "a", "confidence": "LOW"}]),
    ],
)
def test_bad_rules_are_refused(bad):
    with pytest.raises(ValueError):
        rules.to_rule(bad, "p", 0)


def test_problem_report(spark):
    rows = spark.createDataFrame([("p", 0, json.dumps(dict(id="A", pattern="x*", severity="HUGE")))], "source string, rule_ord int, j string")
    parsed = rows.select("source", "rule_ord", F.from_json("j", rules.RULE_SCHEMA).alias("r")).select("source", "rule_ord", "r.*")
    got = {r[2] for r in rules.rule_problems(rules.with_defaults(parsed)).collect()}
    assert got == {"unknown severity", "pattern matches empty text"}
