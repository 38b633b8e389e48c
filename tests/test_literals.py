"""Literals of patterns, and the matches that depend on them, against Python's own matcher."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.functions import literals as lt
from siftlake.operators import match, rules

WANTED = {
    "token": {"token"}, "(?i)PassWord": {"password"}, "[Pp]ass[wW]ord": {"password"}, "a|bc": {"a", "bc"}, "x*abc": {"abc"}, "(?:foo|bar)baz": {"baz"}, "(?:foo|bazaar)b": {"foo", "bazaar"},
    "ab?c": {"a"}, "a{2}b": {"a"}, "(?=secret)\\w+": {"secret"}, "(?!secret)\\w+": set(), "\\d+": set(), "[0-9]{16}": set(), "a?": set(), "key\\s*=\\s*value": {"value"}, "\\bid\\b.*name": {"name"},
    "(?:(?:ab|cd)+x)?": set(), "é+abc": {"abc"}, "abcé": {"abc"}, "(ab|abc)": {"ab"}, "^import\\s": {"import"}, "[ab]c": {"ac", "bc"}, "[^a]c": {"c"}, "(?<=pre)fix": {"pre"}, "(": set(),
}


@pytest.mark.parametrize("pattern, wanted", WANTED.items())
def test_needed_literals(pattern, wanted):
    assert set(lt.required(pattern)) == wanted


def test_no_match_without_a_literal():
    """Every match of random patterns holds one of the literals."""
    rng = random.Random(3)

    def pattern(depth):
        if depth == 0:
            return rng.choice(["a", "B", "[ab]", "[^a]", "\\w", ".", "ab", "é", "[A-C]"])
        a, b = pattern(depth - 1), pattern(depth - 1)
        return rng.choice([a + b, f"(?:{a}|{b})", f"({a})?{b}", f"(?:{a})+{b}", f"(?:{a}){{0,2}}{b}", f"(?={a}){b}", f"(?:{a}){{2}}"])

    for _ in range(400):
        p = pattern(rng.randint(1, 4))
        need = lt.required(p)
        for _ in range(20):
            text = "".join(rng.choice("aAbBcé\n") for _ in range(rng.randint(0, 12)))
            if re.search(p, text, re.I) and need:
                assert any(x in text.lower() for x in need), (p, need, text)


def test_one_automaton_for_all_literals(spark):
    words = ["pass", "password", "word", "ssw", "a.b", "[x]", "-----begin ", "$p", "\\\\", "zz", "z-a^]"]
    texts = ["", "password", "passwor", "xpass-word", "a.b a-b", "[x][y]", "-----begin k", "cost $p", "c:\\\\dir", "zzz", "no", "pass" * 30, "z-a^]"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", lt.literals_in(F.col("t"), words).alias("w")).collect()
    for t, found in got:
        wanted = set()
        for i in range(len(t)):
            here = [w for w in words if t.startswith(w, i)]
            wanted |= {max(here, key=len)} if here else set()
        assert set(found) == wanted
    needs = {0: frozenset(["password"]), 1: frozenset(["pass"]), 2: frozenset(["@", "longer"]), 3: frozenset(["zz", "word"]), 4: frozenset()}
    got = spark.createDataFrame([(t,) for t in [*texts, "a@b", "longer"]], "t string").select("t", lt.admitted(F.col("t"), needs).alias("k")).collect()
    for t, found in got:
        assert set(found) == {k for k, ws in needs.items() if any(w in t for w in ws)}


def test_built_in_rules_have_literals_that_their_samples_hold():
    without = []
    for r in rules.load_packs():
        need = lt.required(r.pattern)
        if r.match_mode != "filename" and not need:
            without.append(r.id)
    assert without == []


def test_every_rule_of_many_keeps_its_own_matches(spark):
    """Texts with marks of their own, patterns with and without groups, several rules in one text."""
    patterns = ["a([0-9])?b", "b+", "(?:x|y)z", "é.", "(\\d)(\\d)", "^l", "q$", "nothing", "(?<=a)b", "a(?=b)"]
    rule_list = [rules.to_rule({"id": f"P{i}", "pattern": p, "severity": "HIGH", "flags": "gim"}, "corpus", i) for i, p in enumerate(patterns)]
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1xyzéElq\n") for _ in range(rng.randint(0, 300))) for _ in range(30)]
    texts += ["ab\ufdd0ab\ufdd1\nxz\ufdd2b", "\ufdd1", "", "l\nl\r\nq", "$0 \\1 ab a1b"]
    files = spark.createDataFrame([("r", f"{i}.txt", t) for i, t in enumerate(texts)], "repo_id string, path string, content string")
    got = sorted((int(x.path[:-4]), x.rule_id, x.off, x.line, x.text, x.value) for x in match.match_table(files, rule_list).collect())
    wanted = []
    for i, t in enumerate(texts):
        for k, p in enumerate(patterns):
            for m in re.finditer(p, t, re.I | re.M):
                value = m.group(1) if m.re.groups else None
                wanted.append((i, f"P{k}", m.start(), t.count("\n", 0, m.start()) + 1, m.group(0), value or m.group(0)))
    assert got == sorted(wanted)


def test_plan_moves_no_text(spark, tmp_path):
    from siftlake.operators import classify

    spark.createDataFrame([("r", "a.py", "text")], "repo_id string, path string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    rule_list = [rules.to_rule({"id": f"P{i}", "pattern": p, "severity": "HIGH"}, "corpus", i) for i, p in enumerate(["abc", "d(e)f"])]
    for df in (match.match_table(files, rule_list), match.scan_files(classify.classify_files(files), rule_list)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "explode" not in plan
        node = df._jdf.queryExecution().executedPlan()
        while node.nodeName() != "Generate":
            node = node.child()
        assert "content" not in node.requiredChildOutput().mkString(",")
